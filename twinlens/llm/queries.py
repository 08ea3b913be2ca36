"""The registered queries of this subpackage over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.catalog.registry import table
from twinlens.llm import binary, bytebpe, chunks, langmix, licences, mtree, ordinal, phrases, pieces, simhash, tiling, trees, turns
from twinlens.session import fresh_path

#: Expected severity from which a document counts as toxic.
TOXIC = 0.5
#: Features that say how severe a toxic document is.
MARKERS = 64
#: Score from which op5 predicts label 1.
GOOD = 0.3
#: Files of public tokenizers, by name; see ``tokenizer_path``.
WORD_MODEL = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
END_ID = 1


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def fold(of: int, key: str = "doc_id") -> Column:
    """The remainder of the id's crc32."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(of))


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))
    model = langmix.learn(docs.where(~F.col("held_out")))
    return langmix.predict(docs, model, keep=("held_out",))


def op2_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op3_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.checked(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(PIECE_MODEL), ["doc_id"])


def toxicity_model(docs: DataFrame, labels: DataFrame) -> ordinal.Model:
    """Grades 0, 1 and 2 from the yes/no label, and a model of them."""
    labelled = ordinal.with_labels(docs.select("doc_id", "text"), labels.select("doc_id", F.col("toxic").alias("grade")))
    counts = ordinal.counted(labelled)  # of grade 0 and above, which the finer grades leave as they are
    markers = ordinal.top(counts, MARKERS, rising=True)
    return ordinal.fit(ordinal.silver_grades(labelled, markers, "grade"), keys=ordinal.top(counts))


def op4_toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = ordinal.predict(docs, model, ["doc_id"])
    return scored.select("doc_id", F.col("severity"), (F.col("severity") >= TOXIC).alias("toxic"), F.least(F.round("severity"), F.lit(len(model.thresholds))).cast("int").alias("grade"))


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False)))
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(fold(5) != 0)
    # statistics are taken once, in place; only these narrow rows meet the labels
    path = fresh_path(spark, "statistics")
    trees.with_statistics(docs, ["doc_id", "held_out"]).write.parquet(path)
    rows = spark.read.parquet(path)
    # a merge join at every size, so that small inputs run as large ones do
    model = trees.fit_rows(rows.join(labels.hint("merge"), "doc_id"))
    return trees.predict_rows(rows, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op6_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.deduplicate(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(WORD_MODEL), END_ID)


def op8_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mtree_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = mtree.build(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return mtree.search(index, index.rows.where(F.col("vec_id") % 20 == 0))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents", "text", "lang"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads shared by up to 100 conversations make the trie branch at every depth."""
    return turns.trie(*turns.grafted(turns.ordered(table(spark, sf_dir, "conversations"))))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.checked(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(BYTE_RANKS), public_tokenizers.PATTERN, ["doc_id"])


OPERATORS: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_language_mixture,
    op2_string_tiling,
    op3_sentencepiece_viterbi,
    op4_toxicity_grades,
    op5_quality_trees,
    op6_content_chunks,
    op7_token_files,
    op8_licence_digests,
    op9_simhash_components,
    op10_mtree_top20,
    op11_phrase_collocations,
    op12_conversation_trie,
    op13_byte_bpe,
)

TOP_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20"""


COLLOCATIONS_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT lang, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM split
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM split),
found AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM found WHERE words = 1 GROUP BY lang),
candidates AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM found WHERE words > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, words)) AS k FROM candidates),
parts AS (SELECT *, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM cuts),
scores AS (
  SELECT p.lang, p.words, p.phrase, p.a, p.k, h.f AS l, t.f AS r, ((1000000::HUGEINT * p.a * p.a) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM parts p JOIN found h ON h.lang = p.lang AND h.phrase = p.head JOIN found t ON t.lang = p.lang AND t.phrase = p.rest),
least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS f FROM (
    SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM candidates WHERE words = 3
    UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM candidates WHERE words = 3) GROUP BY ALL),
kept AS (SELECT s.* FROM least s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op8_licence_digests": licences.scan_sql(), "op10_mtree_top20": TOP_SQL, "op11_phrase_collocations": COLLOCATIONS_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

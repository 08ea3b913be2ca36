"""A training-data pipeline over ``documents``: five stages, each written as Parquet.

Every stage works on all that its predecessor kept and hands on the columns of
documents; the last one hands on token ids. SQL can't express the trained and the
iterative stages, so there is no SQL for the whole; tests hold it against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm import chunks, ordinal, pieces, simhash, tiling
from twinlens.llm.queries import PIECE_MODEL, TOXIC, table, tokenizer_path, toxicity_model
from twinlens.llm.texts import unused
from twinlens.session import fresh_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below ``TOXIC``. Null and empty texts stay."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    severity = unused(docs.columns, "severity")
    return ordinal.predict(docs, model, docs.columns, out=severity).where(F.col(severity) < TOXIC).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked (shingles and distance as
    in op9): the one with the least id, a null id last; of several with that id the one with the least
    digest of all columns. Rows alike in every column are one. Documents without a word have one
    fingerprint, so one of them stays."""
    first, second = unused(docs.columns, "_mark1"), unused(docs.columns, "_mark2")
    marked = docs.withColumns({first: F.xxhash64(*docs.columns), second: F.xxhash64(F.lit(2), *docs.columns)})
    found = simhash.near_duplicates(marked, distance=simhash.DISTANCE, words=simhash.SHINGLE, keep=(first, second))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(first).alias("first"), F.col(second).alias("second"))
    kept = found.groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.first").alias(first), F.col("k.second").alias(second))
    return marked.join(kept, [first, second], "left_semi").dropDuplicates([first, second]).select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of passages. One that is left empty goes, as
    nothing of it is new; null texts and texts that were empty stay."""
    removed = unused(docs.columns, "removed_bytes")
    done = chunks.deduplicate(docs, removed=removed)
    return done.where((F.col(removed) == 0) | (F.trim("text") != "")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold a benchmark item. Null and empty texts stay; an empty benchmark lets all stay."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip (decoding gives the text back) and the ids, one row per document."""
    return pieces.checked(docs, tokenizer_path(PIECE_MODEL), ["doc_id"], with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

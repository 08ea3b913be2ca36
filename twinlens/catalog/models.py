"""Synthesizer, pilot, ensemble and classifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlens.catalog.fidelity import NOISE_SEED, customer_pair, event_pair, noised_customer_pair, sql_noised, sql_w1
from twinlens.catalog.registry import first_half, query, rounded, sql_laplace, sql_sides, sql_uniform, table
from twinlens.catalog.tables import SEED
from twinlens.functions import hashrand
from twinlens.operators import bayes, modelling, privacy, synthesizers
from twinlens.operators.fidelity import wasserstein_pilot
from twinlens.operators.mwem import mwem
from twinlens.operators.pair import Pair
from twinlens.operators.sampling import ensemble_mix as mix

# --- independent marginals --------------------------------------------------------------


def sql_inverse(name: str, column: str, key: str, seed: int) -> str:
    """Inverse distribution function of a column at a row uniform, 1,001-point grid."""
    at = f"({sql_uniform(seed, key, column)} * 1000.0::DOUBLE)"
    grid = f"(SELECT quantile_cont({column}::DOUBLE, [i / 1000.0::DOUBLE FOR i IN range(1001)]) FROM {name})"
    low, high = f"{grid}[floor({at})::INTEGER + 1]", f"{grid}[floor({at})::INTEGER + 2]"
    return f"({low} + ({high} - {low}) * ({at} - floor({at})))"


def sql_category(name: str, column: str, key: str, seed: int) -> str:
    u = sql_uniform(seed, key, column)
    shares = f"""(SELECT [list(v ORDER BY v), list(c::VARCHAR ORDER BY v)] FROM (SELECT v, sum(n) OVER (ORDER BY v)::DOUBLE / sum(n) OVER () AS c
        FROM (SELECT {column} AS v, count(*) AS n FROM {name} GROUP BY {column})))"""
    return f"{shares}[1][len(list_filter({shares}[2][1:-2], lambda e: e::DOUBLE <= {u})) + 1]"


def customer_columns(spark, sf):
    return table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    "synth_marginals",
    f"""SELECT c_custkey, round_even({sql_inverse('customer', 'c_nationkey', 'c_custkey', SEED)}, 0)::INTEGER AS c_nationkey,
    round({sql_inverse('customer', 'c_acctbal', 'c_custkey', SEED)}, 4) AS c_acctbal, {sql_category('customer', 'c_mktsegment', 'c_custkey', SEED)} AS c_mktsegment FROM customer""",
)
def synth_marginals(spark, sf):
    customer = customer_columns(spark, sf)
    m = synthesizers.fit_marginals(customer, exclude=("c_custkey",))
    return rounded(synthesizers.sample_marginals(m, customer, "c_custkey", SEED), 4, "c_acctbal")


def _synth(slot: str):
    def run(spark, sf):
        customer = customer_columns(spark, sf)
        m = synthesizers.fit_marginals(customer, exclude=("c_custkey",))
        return synthesizers.synthesize(slot, customer.drop("c_custkey"), m, customer, "c_custkey", SEED)

    return run


query("synth_copula")(_synth("copula"))
query("synth_latent")(_synth("latent"))
query("synth_mixture")(_synth("mixture"))


# Cells of two texts, and of a text of many values, within price bands in place of fitted components.
_BANDS = "CASE WHEN o_totalprice < 100000.0 THEN 0 WHEN o_totalprice < 250000.0 THEN 1 ELSE 2 END"
_CELL_KEYS = "CASE WHEN o_orderstatus IS NULL THEN 'null' ELSE 'v' || o_orderstatus END || '|' || CASE WHEN o_orderpriority IS NULL THEN 'null' ELSE 'v' || o_orderpriority END"


def sql_drawn_cells(names: str, digest: str, stream: str) -> str:
    """(o_orderkey, names...): the cell at a row uniform's place in the rows of the row's band."""
    return f"""(WITH src AS (SELECT o_orderkey, {names}, {digest} AS digest, {_BANDS} AS k FROM banded),
    tally AS (SELECT k, digest, {names}, count(*) AS n FROM src GROUP BY ALL),
    runs AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY k ORDER BY substr(md5(digest), 1, 3), {', '.join(c.strip() + ' NULLS FIRST' for c in names.split(','))} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM tally),
    total AS (SELECT k, sum(n)::BIGINT AS rows FROM tally GROUP BY k),
    asked AS (SELECT o_orderkey, k, least(floor({sql_uniform(SEED, 'o_orderkey', stream)} * rows::DOUBLE)::BIGINT, rows - 1) AS at FROM src JOIN total USING (k))
    SELECT asked.o_orderkey, {', '.join('runs.' + c.strip() for c in names.split(','))} FROM asked ASOF JOIN runs ON asked.k = runs.k AND asked.at >= runs.start)"""


@query(
    "mixture_cells",
    f"""WITH banded AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR) AS customer, o_totalprice FROM orders)
    SELECT banded.o_orderkey, {_BANDS} AS component, a.o_orderstatus, a.o_orderpriority, b.customer
    FROM banded JOIN {sql_drawn_cells('o_orderstatus, o_orderpriority', _CELL_KEYS, 'cell0')} a USING (o_orderkey) JOIN {sql_drawn_cells('customer', "'v' || customer", 'cell1')} b USING (o_orderkey)""",
)
def mixture_cells(spark, sf):
    """The mixture sampler's cells: each order draws texts from the orders of its price band."""
    orders = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice").select(
        "o_orderkey",
        F.expr(_BANDS).alias("component"),
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        "o_orderpriority",
        F.col("o_custkey").cast("string").alias("customer"),
    )
    drawn = orders.select("o_orderkey", "component")
    for i, names in enumerate((["o_orderstatus", "o_orderpriority"], ["customer"])):
        cells = synthesizers.cell_table(orders, F.col("component"), names)
        place = cells.place(F.col("component"), hashrand.uniform(SEED, F.col("o_orderkey"), f"cell{i}"))
        drawn = synthesizers.draw_cells(drawn.withColumn("place", place), "place", cells)
    return drawn


@query("pilot_scores")
def pilot_scores(spark, sf):
    part = table(spark, sf, "part")
    found = synthesizers.pilot(part, part, "p_partkey", synthesizers.candidates("auto"), SEED, exclude=("p_partkey",))
    return spark.createDataFrame([(name, float(score)) for name, score, _ in found], "model string, wasserstein double")


# --- leaderboard and ensemble ----------------------------------------------------------

PART_COLUMNS = ("p_partkey", "p_size", "p_retailprice")


def part_candidates(spark, sf):
    """Three samplers of the part table that SQL can repeat."""
    part = table(spark, sf, "part", *PART_COLUMNS)
    key = F.col("p_partkey")
    m = synthesizers.fit_marginals(part, exclude=("p_partkey",))
    return part, {
        "noise_10": privacy.laplace_noise(part, 10.0, SEED, key, exclude=("p_partkey",)),
        "noise_1": privacy.laplace_noise(part, 1.0, SEED, key, exclude=("p_partkey",)),
        "marginals": synthesizers.sample_marginals(m, part, "p_partkey", SEED),
    }


def part_scores(spark, sf):
    part, made = part_candidates(spark, sf)
    real = part.drop("p_partkey")
    out = None
    for name, sample in made.items():
        score = wasserstein_pilot(Pair.of(real, sample.drop("p_partkey"))).select(F.lit(name).alias("model"), "wasserstein")
        out = score if out is None else out.unionByName(score)
    return out, made


def _sql_noisy(column: str, scale: str) -> str:
    noisy = f"({column} + {sql_laplace(SEED, 'p_partkey', column, scale)})"
    return f"greatest((SELECT min({column}) FROM part) - {scale}, least((SELECT max({column}) FROM part) + {scale}, {noisy}))::DOUBLE"


_MODELS_SQL = {
    "noise_10": (_sql_noisy("p_size", "0.1::DOUBLE"), _sql_noisy("p_retailprice", "0.1::DOUBLE")),
    "noise_1": (_sql_noisy("p_size", "1.0::DOUBLE"), _sql_noisy("p_retailprice", "1.0::DOUBLE")),
    "marginals": (
        f"round_even({sql_inverse('part', 'p_size', 'p_partkey', SEED)}, 0)",
        sql_inverse("part", "p_retailprice", "p_partkey", SEED),
    ),
}
SQL_MADE = " UNION ALL ".join(
    f"SELECT '{m}' AS model, p_partkey, {a} AS p_size, {b} AS p_retailprice FROM part" for m, (a, b) in _MODELS_SQL.items()
)


def _sql_score(model: str) -> str:
    source = (
        "(SELECT p_size::DOUBLE AS p_size, p_retailprice, true AS is_real FROM part UNION ALL "
        f"SELECT p_size, p_retailprice, false FROM made WHERE model = '{model}')"
    )
    body = sql_w1(source, ("p_size", "p_retailprice"))
    return f"""SELECT '{model}' AS model, avg(w1 / greatest(rhi - rlo, 1e-6)) AS wasserstein FROM (
      WITH {body} SELECT * FROM w JOIN b USING (col)) WHERE NOT (n > 20 AND d::DOUBLE / n > 0.95)"""


SQL_SCORES = f"made AS MATERIALIZED ({SQL_MADE}), scores AS MATERIALIZED ({' UNION ALL '.join(_sql_score(m) for m in _MODELS_SQL)})"
SQL_WEIGHTS = """best AS (SELECT model, 1.0::DOUBLE / (wasserstein + 1e-6::DOUBLE) AS w FROM scores ORDER BY wasserstein, model LIMIT 2),
    weights AS (SELECT model, w / (SELECT sum(w) FROM best) AS weight FROM best)"""


@query(
    "pilot_leaderboard",
    f"WITH {SQL_SCORES} SELECT (row_number() OVER (ORDER BY wasserstein, model))::INTEGER AS rank, model, round(wasserstein, 6) AS wasserstein FROM scores",
)
def pilot_leaderboard(spark, sf):
    return rounded(synthesizers.leaderboard(part_scores(spark, sf)[0]), 6, "wasserstein")


@query("ensemble_weights", f"WITH {SQL_SCORES}, {SQL_WEIGHTS} SELECT model, round(weight, 6) AS weight FROM weights")
def ensemble_weights(spark, sf):
    return rounded(synthesizers.ensemble_weights(part_scores(spark, sf)[0]), 6, "weight")


@query(
    "ensemble_mix",
    f"""WITH {SQL_SCORES}, {SQL_WEIGHTS}, total AS (SELECT count(*) AS n FROM part),
    first AS (SELECT model, floor(weight * (SELECT n FROM total))::BIGINT AS k FROM weights ORDER BY weight DESC, model LIMIT 1),
    quota AS (SELECT model, CASE WHEN model = (SELECT model FROM first) THEN (SELECT k FROM first) ELSE (SELECT n FROM total) - (SELECT k FROM first) END AS k FROM weights),
    placed AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY md5(concat_ws('|', '{SEED}', CAST(p_partkey AS VARCHAR), 'order')), p_partkey) AS i FROM made)
    SELECT p_partkey, round(p_size, 6) AS p_size, round(p_retailprice, 6) AS p_retailprice, model AS source FROM placed JOIN quota USING (model) WHERE i <= k""",
)
def ensemble_mix(spark, sf):
    scores, made = part_scores(spark, sf)
    weights = synthesizers.ensemble_weights(scores).orderBy(F.desc("weight"), "model").collect()  # two rows
    first, second = weights[0]["model"], weights[1]["model"]
    rows = table(spark, sf, "part").count()

    def plain(name):
        return made[name].select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")

    out = mix(plain(first), plain(second), weights[0]["weight"], rows, "p_partkey", (first, second), SEED)
    return rounded(out, 6, "p_size", "p_retailprice")


# --- classifiers -----------------------------------------------------------------------


@query(
    "label_encode",
    """SELECT 'l_returnflag' AS "column", v AS value, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem)
    UNION ALL SELECT 'l_linestatus', v, row_number() OVER (ORDER BY v) - 1 FROM (SELECT DISTINCT l_linestatus AS v FROM lineitem)""",
)
def label_encode(spark, sf):
    return modelling.label_encode(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


# Counts of cells: the model, its scores and what it is asked are all SQL's own.

_DOCUMENTS = """(SELECT 'd' || d.doc_id AS key, quality AS label, md5(CAST(d.doc_id AS VARCHAR)) < '8' AS is_real, n_chars, lang, source, CAST(d.doc_id AS VARCHAR) AS id
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""
_EVENTS = "(SELECT 'e' || event_id AS key, (event_type = 'error')::INTEGER AS label, is_real, value, CAST(event_id AS VARCHAR) AS id FROM " + sql_sides("events", "event_id") + ")"
_HALVES = "(SELECT CAST(c_custkey AS VARCHAR) AS key, is_real, c_acctbal, c_nationkey, c_mktsegment FROM " + sql_sides("customer", "c_custkey") + ")"
_NOISED = (
    "(SELECT 'r' || c_custkey AS key, true AS is_real, c_acctbal::DOUBLE AS c_acctbal, c_nationkey::DOUBLE AS c_nationkey, c_mktsegment FROM customer "
    f"UNION ALL SELECT 's' || c_custkey, false, {sql_noised('c_acctbal')}, {sql_noised('c_nationkey')}, c_mktsegment FROM customer)"
)


def sql_cells(source: str, numbers, strings, keep: str, complete: bool) -> str:
    """(keep..., one cell per feature) of a source, and the rows of each cell below each other."""
    x = lambda c: f"{c}::DOUBLE"
    ends = ", ".join(f"min({x(c)}) AS lo_{c}, max({x(c)}) AS hi_{c}" for c in numbers)
    slot = lambda c: f"least(floor(({x(c)} - lo_{c}) / ((hi_{c} - lo_{c}) / {bayes.CELLS}.0::DOUBLE)), {bayes.CELLS - 1})::INTEGER"
    cells = [f"CASE WHEN {c} IS NULL THEN 'null' WHEN hi_{c} = lo_{c} THEN 'n0' ELSE 'n' || {slot(c)} END AS {c}" for c in numbers]
    cells += [f"coalesce('v' || {c}, 'null') AS {c}" for c in strings]
    where = " WHERE label IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in (*numbers, *strings)) if complete else ""
    long = " UNION ALL ".join(f"SELECT {keep}, '{c}' AS col, {c} AS cell FROM cells" for c in (*numbers, *strings))
    return f"""src AS (SELECT * FROM {source}{where}), {f"b AS (SELECT {ends} FROM src), " if numbers else ""}
    cells AS (SELECT {keep}, {', '.join(cells)} FROM src{' CROSS JOIN b' if numbers else ''}), long AS ({long}),
    v AS (SELECT col, count(DISTINCT cell) AS v FROM long GROUP BY col)"""


def sql_utility(name: str, source: str, numbers, strings) -> str:
    split = f"(SELECT *, {sql_uniform(SEED, 'id', 'split')} < 0.7::DOUBLE AS is_train FROM {source})"
    return f"""SELECT '{name}' AS pair, * FROM (WITH {sql_cells(split, numbers, strings, 'key, label, is_real, is_train', True)},
    cnt AS (SELECT col, cell, label, count(*) FILTER (is_real AND is_train) AS r, count(*) FILTER (NOT is_real) AS s FROM long GROUP BY ALL),
    cls AS (SELECT label, count(*) FILTER (is_real AND is_train) AS nr, count(*) FILTER (NOT is_real) AS ns FROM cells GROUP BY label),
    tot AS (SELECT sum(nr) AS nr, sum(ns) AS ns, count(*) AS k FROM cls),
    term AS (SELECT c.col, c.cell, cls.label, ln((coalesce(r, 0) + 1)::DOUBLE / (nr + v)::DOUBLE) AS lr, ln((coalesce(s, 0) + 1)::DOUBLE / (ns + v)::DOUBLE) AS ls
      FROM (SELECT DISTINCT col, cell FROM long) c JOIN v USING (col) CROSS JOIN cls LEFT JOIN cnt ON cnt.col = c.col AND cnt.cell = c.cell AND cnt.label = cls.label),
    scores AS (SELECT key, long.label AS own, is_real, is_train, term.label AS k, sum(lr) AS sr, sum(ls) AS ss FROM long JOIN term USING (col, cell) WHERE NOT (is_real AND is_train) GROUP BY ALL),
    whole AS (SELECT key, own, is_real, k, round(sr + ln((nr + 1)::DOUBLE / ((SELECT nr FROM tot) + (SELECT k FROM tot))::DOUBLE), 9) AS sr,
      round(ss + ln((ns + 1)::DOUBLE / ((SELECT ns FROM tot) + (SELECT k FROM tot))::DOUBLE), 9) AS ss FROM scores JOIN cls ON cls.label = k),
    pr AS (SELECT key, own, is_real, k FROM whole QUALIFY row_number() OVER (PARTITION BY key ORDER BY sr DESC, k) = 1),
    ps AS (SELECT key, own, is_real, k FROM whole QUALIFY row_number() OVER (PARTITION BY key ORDER BY ss DESC, k) = 1),
    acc AS (SELECT (SELECT avg((k = own)::INTEGER) FROM pr WHERE is_real) AS base, (SELECT avg((k = own)::INTEGER) FROM ps WHERE is_real) AS tstr, (SELECT avg((k = own)::INTEGER) FROM pr WHERE NOT is_real) AS trts)
    SELECT round(base, 6) AS baseline_accuracy, round(tstr, 6) AS tstr_accuracy, round(trts, 6) AS trts_accuracy, round(greatest(0.0::DOUBLE, base - tstr) * 100.0::DOUBLE, 4) AS performance_drop FROM acc)"""


def sql_attack(name: str, source: str, numbers, strings) -> str:
    dealt = f"(SELECT *, floor({sql_uniform(SEED, 'key', 'fold')} * 5.0::DOUBLE)::INTEGER AS fold FROM {source})"
    return f"""SELECT '{name}' AS pair, * FROM (WITH {sql_cells(dealt, numbers, strings, 'key, is_real, fold', False)},
    cnt AS (SELECT col, cell, fold, count(*) FILTER (is_real) AS r, count(*) FILTER (NOT is_real) AS s FROM long GROUP BY ALL),
    whole AS (SELECT col, cell, sum(r) AS r, sum(s) AS s FROM cnt GROUP BY ALL),
    side AS (SELECT fold, count(*) FILTER (is_real) AS nr, count(*) FILTER (NOT is_real) AS ns FROM cells GROUP BY fold),
    tot AS (SELECT sum(nr) AS nr, sum(ns) AS ns FROM side),
    odds AS (SELECT cnt.col, cnt.cell, cnt.fold, ln((whole.r - cnt.r + 1)::DOUBLE / (tot.nr - side.nr + v)::DOUBLE) - ln((whole.s - cnt.s + 1)::DOUBLE / (tot.ns - side.ns + v)::DOUBLE) AS w
      FROM cnt JOIN whole USING (col, cell) JOIN v USING (col) JOIN side USING (fold) CROSS JOIN tot),
    scores AS (SELECT key, is_real, round(sum(w), 9) AS score FROM long JOIN odds USING (col, cell, fold) GROUP BY key, is_real),
    freq AS (SELECT score, count(*) FILTER (is_real) AS r, count(*) FILTER (NOT is_real) AS s FROM scores GROUP BY score),
    ranked AS (SELECT *, sum(s) OVER (ORDER BY score) - s / 2.0::DOUBLE AS below FROM freq)
    SELECT round((sum(CASE WHEN score > 0 THEN r WHEN score = 0 THEN r / 2.0::DOUBLE ELSE 0 END) / sum(r) + sum(CASE WHEN score < 0 THEN s WHEN score = 0 THEN s / 2.0::DOUBLE ELSE 0 END) / sum(s)) / 2.0::DOUBLE, 6) AS accuracy,
      round(sum(r * below) / sum(r) / sum(s), 6) AS auc FROM ranked)"""


_IMPORTANT = ("n_chars", "lang", "source")


def sql_importance(source: str, numbers, strings) -> str:
    split = f"(SELECT *, {sql_uniform(SEED, 'id', 'split')} < 0.7::DOUBLE AS is_train, md5(concat_ws('|', '{SEED}', id, 'place')) AS place FROM {source})"
    shift = "CASE f " + " ".join(f"WHEN '{c}' THEN 1 + floor({bayes._shift(SEED, c)!r}::DOUBLE * (n - 1))::BIGINT" for c in (*numbers, *strings)) + " END"
    return f"""WITH {sql_cells(split, numbers, strings, 'key, label, is_train, place', True)},
    cnt AS (SELECT col, cell, label, count(*) AS r FROM long WHERE is_train GROUP BY ALL),
    cls AS (SELECT label, count(*) FILTER (is_train) AS nr, row_number() OVER (ORDER BY label) AS code FROM cells GROUP BY label),
    term AS (SELECT c.col, c.cell, cls.label, ln((coalesce(r, 0) + 1)::DOUBLE / (nr + v)::DOUBLE) AS lr
      FROM (SELECT DISTINCT col, cell FROM long) c JOIN v USING (col) CROSS JOIN cls LEFT JOIN cnt ON cnt.col = c.col AND cnt.cell = c.cell AND cnt.label = cls.label),
    test AS (SELECT key, label, row_number() OVER (ORDER BY place) AS pos, count(*) OVER () AS n FROM cells WHERE NOT is_train),
    parts AS (SELECT t.pos, t.n, t.label AS own, l.col, term.label AS k, lr FROM test t JOIN long l USING (key) JOIN term USING (col, cell)),
    whole AS (SELECT pos, n, own, k, sum(lr) + ln((any_value(nr) + 1)::DOUBLE / (SELECT sum(nr) + count(*) FROM cls)::DOUBLE) AS total, any_value(code) AS code FROM parts JOIN cls ON cls.label = k GROUP BY pos, n, own, k),
    moved AS (SELECT p.col AS f, p.pos, p.own, p.k, w.code, w.total, w.total - p.lr + o.lr AS other
      FROM (SELECT *, col AS f FROM parts) p JOIN whole w ON w.pos = p.pos AND w.k = p.k
      JOIN (SELECT pos, n, col AS f, k, lr, (pos - 1 + {shift}) % n + 1 AS goes FROM parts) o ON o.goes = p.pos AND o.f = p.col AND o.k = p.k),
    one AS (SELECT f, pos, own, k FROM moved QUALIFY row_number() OVER (PARTITION BY f, pos ORDER BY round(total, 9) DESC, code) = 1),
    two AS (SELECT f, pos, own, k FROM moved QUALIFY row_number() OVER (PARTITION BY f, pos ORDER BY round(other, 9) DESC, code) = 1),
    lost AS (SELECT f, round(a - b, 6) AS importance FROM (SELECT f, avg((k = own)::INTEGER) AS a FROM one GROUP BY f) JOIN (SELECT f, avg((k = own)::INTEGER) AS b FROM two GROUP BY f) USING (f))
    SELECT f AS feature, importance, row_number() OVER (ORDER BY importance DESC, f)::INTEGER AS rank FROM lost QUALIFY rank <= 3"""


@query("utility_bayes", sql_utility("documents", _DOCUMENTS, ("n_chars",), ("lang", "source")) + " UNION ALL " + sql_utility("events", _EVENTS, ("value",), ()))
def utility_bayes(spark, sf):
    labelled = table(spark, sf, "labels", "doc_id", "quality").join(table(spark, sf, "documents", "doc_id", "lang", "source", "n_chars"), "doc_id")
    documents = Pair.split(labelled, first_half("doc_id"), ["doc_id", "quality", "lang", "source", "n_chars"])
    events = table(spark, sf, "events").withColumn("is_error", (F.col("event_type") == "error").cast("int"))
    errors = Pair.split(events, first_half("event_id"), ["event_id", "value", "is_error"])
    parts = [bayes.utility(p, target, key, SEED).select(F.lit(name).alias("pair"), "*") for name, p, target, key in (("documents", documents, "quality", "doc_id"), ("events", errors, "is_error", "event_id"))]
    return rounded(rounded(parts[0].unionByName(parts[1]), 6, "baseline_accuracy", "tstr_accuracy", "trts_accuracy"), 4, "performance_drop")


_CUSTOMER_FEATURES = ("c_acctbal", "c_nationkey"), ("c_mktsegment",)


@query("attack_bayes", sql_attack("halves", _HALVES, *_CUSTOMER_FEATURES) + " UNION ALL " + sql_attack("noised", _NOISED, *_CUSTOMER_FEATURES))
def attack_bayes(spark, sf):
    customer = table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    halves = Pair.split(customer.withColumn("row", F.col("c_custkey").cast("string")).drop("c_custkey"), F.md5("row") < "8")
    noisy = privacy.laplace_noise(customer, 0.01, NOISE_SEED, F.col("c_custkey"), exclude=("c_custkey",))
    named = lambda df, side: df.withColumn("row", F.concat(F.lit(side), F.col("c_custkey").cast("string"))).drop("c_custkey")
    noised = Pair.of(named(customer, "r"), named(noisy, "s"))
    parts = [bayes.attack(p, "row", seed=SEED).select(F.lit(name).alias("pair"), "*") for name, p in (("halves", halves), ("noised", noised))]
    return rounded(parts[0].unionByName(parts[1]), 6, "accuracy", "auc")


@query("importance_bayes", sql_importance(_DOCUMENTS, _IMPORTANT[:1], _IMPORTANT[1:]))
def importance_bayes(spark, sf):
    labelled = table(spark, sf, "labels", "doc_id", "quality").join(table(spark, sf, "documents", "doc_id", *_IMPORTANT), "doc_id")
    return rounded(bayes.importance(labelled, "quality", list(_IMPORTANT), "doc_id", SEED, top=3), 6, "importance")


@query("utility_tstr")
def utility_tstr(spark, sf):
    labelled = table(spark, sf, "labels", "doc_id", "quality").join(
        table(spark, sf, "documents", "doc_id", "lang", "source", "n_chars"), "doc_id"
    )
    documents = Pair.split(labelled, first_half("doc_id"), ["quality", "lang", "source", "n_chars"])
    events = event_pair(spark, sf)
    is_error = (F.col("event_type") == "error").cast("int").alias("is_error")
    errors = Pair(events.tagged.select("value", is_error, "is_real"))
    rows = [(name, *modelling.utility_or_failed(pair, target).values()) for name, pair, target in (("documents", documents, "quality"), ("events", errors, "is_error"))]
    schema = "pair string, baseline_accuracy double, tstr_accuracy double, trts_accuracy double, performance_drop double"
    return spark.createDataFrame(rows, schema)


@query("mia_attack")
def mia_attack(spark, sf):
    pairs = (("halves", customer_pair(spark, sf)), ("noised", noised_customer_pair(spark, sf)))
    rows = [(name, modelling.attack_or_failed(pair)) for name, pair in pairs]
    return spark.createDataFrame(rows, "pair string, accuracy double")


@query("feature_importance")
def feature_importance(spark, sf):
    return modelling.feature_importance(table(spark, sf, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag"), "l_returnflag")


@query("mwem_histogram")
def mwem_histogram(spark, sf):
    cells = {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "bucket": F.floor(F.col("l_quantity") / 10.0).cast("int")}
    return mwem(table(spark, sf, "lineitem"), cells, epsilon=1.0, rounds=10, seed=SEED)

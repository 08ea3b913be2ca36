"""Fidelity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlens.catalog.registry import halves, query, rounded, sql_laplace, sql_long, sql_normal, sql_sides, table
from twinlens.operators import describe, fidelity, privacy
from twinlens.operators.pair import Pair

LINE_NUMBERS = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_STRINGS = ("l_returnflag", "l_linestatus")
LINE_KEYS = ("l_orderkey", "l_partkey", "l_suppkey")
NOISE_SEED = 42


def line_pair(spark, sf, *columns):
    return halves(spark, sf, "lineitem", "l_orderkey", *(columns or LINE_KEYS + LINE_NUMBERS + LINE_STRINGS))


def order_pair(spark, sf):
    return halves(spark, sf, "orders", "o_orderkey", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


def customer_pair(spark, sf, *columns):
    return halves(spark, sf, "customer", "c_custkey", *(columns or ("c_acctbal", "c_nationkey", "c_mktsegment")))


def event_pair(spark, sf):
    return halves(spark, sf, "events", "event_id", "value", "event_type")


def noised_customer_pair(spark, sf):
    customer = table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    noisy = privacy.laplace_noise(customer, 0.01, NOISE_SEED, F.col("c_custkey"), exclude=("c_custkey",))
    drop = [c for c in customer.columns if c != "c_custkey"]
    return Pair.of(customer.select(*drop), noisy.select(*drop))


LINES = sql_sides("lineitem", "l_orderkey")
ORDERS = sql_sides("orders", "o_orderkey")
CUSTOMERS = sql_sides("customer", "c_custkey")
EVENTS = sql_sides("events", "event_id")


def sql_noised(column: str, scale: str = "100.0::DOUBLE") -> str:
    noisy = f"({column} + {sql_laplace(NOISE_SEED, 'c_custkey', column, scale)})"
    return f"greatest((SELECT min({column}) FROM customer) - {scale}, least((SELECT max({column}) FROM customer) + {scale}, {noisy}))"


NOISED_CUSTOMERS = (
    "(SELECT c_acctbal::DOUBLE AS c_acctbal, c_nationkey::DOUBLE AS c_nationkey, c_mktsegment, true AS is_real FROM customer "
    f"UNION ALL SELECT {sql_noised('c_acctbal')}, {sql_noised('c_nationkey')}, c_mktsegment, false FROM customer)"
)

JUDGE_NAME = "(lower(col) IN ('patient_id','account_id','record_id','user_id','id') OR suffix(lower(col), '_id') OR prefix(lower(col), 'id_'))"
METRIC_NAME = (
    "(lower(col) = 'id' OR regexp_matches(lower(col), "
    "'^(_id|id_|patient_id|record_id|index|uuid|key|rownum|row_num|seq)|(_id|id_|patient_id|record_id|index|uuid|key|rownum|row_num|seq)$'))"
)


def sql_w1(source: str, columns) -> str:
    """CTE body up to w(col, w1) and b(col, bounds, counts)."""
    return f"""
    src AS {source},
    l AS ({sql_long('src', columns, 'DOUBLE')}),
    f AS (SELECT col, v, sum(CASE WHEN is_real THEN 1 ELSE 0 END) AS nr, sum(CASE WHEN is_real THEN 0 ELSE 1 END) AS ns FROM l GROUP BY col, v),
    c AS (SELECT col, v,
                 sum(nr) OVER (PARTITION BY col ORDER BY v)::DOUBLE / sum(nr) OVER (PARTITION BY col)::DOUBLE AS fr,
                 sum(ns) OVER (PARTITION BY col ORDER BY v)::DOUBLE / sum(ns) OVER (PARTITION BY col)::DOUBLE AS fs,
                 lead(v) OVER (PARTITION BY col ORDER BY v) AS nv FROM f),
    w AS (SELECT col, coalesce(sum(abs(fr - fs) * (nv - v)), 0.0) AS w1 FROM c GROUP BY col),
    b AS (SELECT col, min(v) AS lo, max(v) AS hi, min(CASE WHEN is_real THEN v END) AS rlo, max(CASE WHEN is_real THEN v END) AS rhi,
                 count(CASE WHEN is_real THEN v END) AS n, count(DISTINCT CASE WHEN is_real THEN v END) AS d FROM l GROUP BY col)"""


def sql_w_variant(pair_name: str, source: str, columns, variant: str) -> str:
    if variant == "judge":
        scale, keep, empty = "greatest(hi - lo, 1e-6)", f"NOT {JUDGE_NAME} AND NOT d > 0.9 * n", "0.0"
    elif variant == "metrics":
        scale, keep, empty = "(rhi - rlo)", f"NOT {METRIC_NAME} AND NOT (n > 20 AND d::DOUBLE / n > 0.95) AND n >= 2 AND rhi - rlo >= 1e-6", "0.0"
    else:
        scale, keep, empty = "greatest(rhi - rlo, 1e-6)", f"NOT {METRIC_NAME} AND NOT (n > 20 AND d::DOUBLE / n > 0.95) AND n >= 2", "'inf'::DOUBLE"
    return f"""SELECT '{pair_name}' AS pair, round(coalesce(avg(w1 / {scale}), {empty}), 6) AS wasserstein
    FROM (WITH {sql_w1(source, columns)} SELECT * FROM w JOIN b USING (col)) WHERE {keep}"""


W_PAIRS = (
    ("lineitem", line_pair, LINES, LINE_KEYS + LINE_NUMBERS),
    ("orders", order_pair, ORDERS, ("o_orderkey", "o_custkey", "o_totalprice")),
    ("noised_customer", noised_customer_pair, NOISED_CUSTOMERS, ("c_acctbal", "c_nationkey")),
)


def _w_query(variant: str, metric):
    sql = " UNION ALL ".join(sql_w_variant(n, src, cols, variant) for n, _, src, cols in W_PAIRS)

    @query(f"wasserstein_{variant}", sql)
    def run(spark, sf):
        out = None
        for name, make, _, _ in W_PAIRS:
            part = metric(make(spark, sf)).select(F.lit(name).alias("pair"), F.round("wasserstein", 6).alias("wasserstein"))
            out = part if out is None else out.unionByName(part)
        return out

    return run


_w_query("judge", fidelity.wasserstein_judge)
_w_query("metrics", fidelity.wasserstein_metrics)
_w_query("pilot", fidelity.wasserstein_pilot)


@query(
    "wasserstein_by_column",
    f"""WITH {sql_w1(LINES, LINE_NUMBERS)}, s AS (SELECT col, w1 / CASE WHEN rhi > rlo THEN rhi - rlo ELSE 1.0 END AS d FROM w JOIN b USING (col))
    SELECT col AS "column", round(d, 6) AS wasserstein, CASE WHEN d < 0.05 THEN 'pass' WHEN d < 0.15 THEN 'amber' ELSE 'fail' END AS band FROM s""",
)
def wasserstein_by_column(spark, sf):
    return rounded(fidelity.wasserstein_by_column(line_pair(spark, sf, *LINE_NUMBERS)), 6, "wasserstein")


def sql_shares(source: str, columns, cast: str = "VARCHAR") -> str:
    return f"""
    src AS {source},
    l AS ({sql_long('src', columns, cast)}),
    f AS (SELECT col, v, sum(CASE WHEN is_real THEN 1 ELSE 0 END)::DOUBLE AS nr, sum(CASE WHEN is_real THEN 0 ELSE 1 END)::DOUBLE AS ns FROM l GROUP BY col, v),
    p AS (SELECT col, v, nr / sum(nr) OVER (PARTITION BY col) AS p, ns / sum(ns) OVER (PARTITION BY col) AS q FROM f)"""


@query(
    "value_freq",
    f"""WITH l AS ({sql_long('lineitem', LINE_STRINGS, 'VARCHAR', '')}), f AS (SELECT col, v, count(*)::DOUBLE AS n FROM l GROUP BY col, v)
    SELECT col AS "column", v AS value, round(n / sum(n) OVER (PARTITION BY col), 8) AS freq FROM f""",
)
def value_freq(spark, sf):
    return rounded(fidelity.value_freq(table(spark, sf, "lineitem"), list(LINE_STRINGS)), 8, "freq")


@query(
    "freq_align",
    f"""WITH {sql_shares(CUSTOMERS, ('c_mktsegment', 'c_name'))}
    SELECT col AS "column", v AS value, round(p, 8) AS p_real, round(q, 8) AS p_synth FROM p""",
)
def freq_align(spark, sf):
    return rounded(fidelity.freq_align(customer_pair(spark, sf, "c_mktsegment", "c_name")), 8, "p_real", "p_synth")


def sql_js(pair_name: str, source: str, columns) -> str:
    return f"""SELECT '{pair_name}' AS pair, round(avg(js), 8) AS value FROM (
    WITH {sql_shares(source, columns)}
    SELECT col, sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2) AS js
    FROM p GROUP BY col)"""


def sql_kl(pair_name: str, source: str, strings, numbers) -> str:
    parts = []
    for i, (cols, cast) in enumerate(((strings, "VARCHAR"), (numbers, "DOUBLE"))):
        if cols:
            parts.append(f"""SELECT col, sum(a * ln(a / b)) AS kl FROM (
              SELECT col, p0 / sum(p0) OVER (PARTITION BY col) AS a, q0 / sum(q0) OVER (PARTITION BY col) AS b FROM (
                WITH {sql_shares(source, cols, cast)}
                SELECT col, CASE WHEN p > 0 THEN p ELSE 1e-10::DOUBLE END AS p0, CASE WHEN q > 0 THEN q ELSE 1e-10::DOUBLE END AS q0 FROM p)) GROUP BY col""")
    return f"SELECT '{pair_name}' AS pair, round(avg(kl), 6) AS value FROM ({' UNION ALL '.join(parts)})"


S_PAIRS = (
    ("lineitem", line_pair, LINES, LINE_STRINGS, LINE_KEYS + LINE_NUMBERS),
    ("events", event_pair, EVENTS, ("event_type",), ("value",)),
)


@query("js_divergence", " UNION ALL ".join(sql_js(n, s, c) for n, _, s, c, _ in S_PAIRS))
def js_divergence(spark, sf):
    parts = [
        fidelity.js_divergence(make(spark, sf).select(*c)).select(F.lit(n).alias("pair"), F.round("js_divergence", 8).alias("value"))
        for n, make, _, c, _ in S_PAIRS
    ]
    return parts[0].unionByName(parts[1])


@query("kl_divergence", " UNION ALL ".join(sql_kl(n, s, c, d) for n, _, s, c, d in S_PAIRS))
def kl_divergence(spark, sf):
    parts = [
        fidelity.kl_divergence(make(spark, sf)).select(F.lit(n).alias("pair"), F.round("kl_divergence", 6).alias("value"))
        for n, make, _, _, _ in S_PAIRS
    ]
    return parts[0].unionByName(parts[1])


def sql_corr(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT is_real, '{a}' AS col_a, '{b}' AS col_b, coalesce(corr({a}, {b}), 0.0) AS corr FROM {source} GROUP BY is_real"
        for a in columns
        for b in columns
    )


@query(
    "corr_matrix",
    f"SELECT is_real, col_a, col_b, round(corr, 6) AS corr FROM (WITH src AS MATERIALIZED {LINES} {sql_corr('src', LINE_NUMBERS)})",
)
def corr_matrix(spark, sf):
    return rounded(fidelity.corr_matrix(line_pair(spark, sf, *LINE_NUMBERS)), 6, "corr")


SQL_FROBENIUS = f"""SELECT sqrt(sum(d * d)) AS f FROM (
    SELECT col_a, col_b, sum(CASE WHEN is_real THEN corr ELSE -corr END) AS d
    FROM (WITH src AS MATERIALIZED {LINES} {sql_corr('src', LINE_NUMBERS)}) GROUP BY col_a, col_b)"""


@query("corr_similarity", f"SELECT round(1.0::DOUBLE / (1.0::DOUBLE + f), 6) AS similarity FROM ({SQL_FROBENIUS})")
def corr_similarity(spark, sf):
    return rounded(fidelity.corr_similarity(line_pair(spark, sf, *LINE_NUMBERS)), 6, "similarity")


@query("corr_frobenius", f"SELECT round(f, 6) AS frobenius FROM ({SQL_FROBENIUS})")
def corr_frobenius(spark, sf):
    return rounded(fidelity.corr_frobenius(line_pair(spark, sf, *LINE_NUMBERS)), 6, "frobenius")


MMD_FEATURES = 64
MMD_COLUMNS = ("c_acctbal", "c_nationkey")


def sql_mmd(source: str, columns, features: int) -> str:
    moments = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(columns))
    draws = ", ".join(f"{sql_normal(42, 'range', f'w{i}')} AS w{i}" for i in range(len(columns)))
    angle = " + ".join(f"(({c} - m{i}) / s{i}) * sqrt(2.0::DOUBLE / {len(columns)}) * w{i}" for i, c in enumerate(columns))
    return f"""WITH src AS {source}, mo AS (SELECT {moments} FROM src), om AS (SELECT range AS j, {draws} FROM range({features})),
    a AS (SELECT is_real, j, {angle} AS t FROM src, mo, om),
    z AS (SELECT j, avg(CASE WHEN is_real THEN cos(t) END) - avg(CASE WHEN NOT is_real THEN cos(t) END) AS c,
                 avg(CASE WHEN is_real THEN sin(t) END) - avg(CASE WHEN NOT is_real THEN sin(t) END) AS s FROM a GROUP BY j)
    SELECT round(sqrt(sum(c * c + s * s) / {features}), 6) AS mmd FROM z"""


@query("mmd_rbf", sql_mmd(CUSTOMERS, MMD_COLUMNS, MMD_FEATURES))
def mmd_rbf(spark, sf):
    pair = customer_pair(spark, sf, *MMD_COLUMNS)
    return rounded(fidelity.mmd_features(pair, list(MMD_COLUMNS), MMD_FEATURES), 6, "mmd")


LINE_MEASURES = ("l_quantity", "l_discount", "l_tax")


@query("mmd_rff", sql_mmd(LINES, LINE_MEASURES, 32))
def mmd_rff(spark, sf):
    pair = line_pair(spark, sf, *LINE_MEASURES)
    return rounded(fidelity.mmd_features(pair, list(LINE_MEASURES), 32), 6, "mmd")


KDE_SIDES = "SELECT is_real, c_acctbal::DOUBLE AS v FROM src"


@query(
    "kde_overlay",
    f"""WITH src AS {CUSTOMERS}, v AS ({KDE_SIDES}),
    st AS (SELECT is_real, count(*) AS n, stddev_samp(v) * pow(count(*)::DOUBLE, -0.2::DOUBLE) AS h FROM v GROUP BY is_real),
    mm AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
    g AS (SELECT range AS i, lo - 0.1::DOUBLE * (hi - lo) + range * ((hi - lo) * 1.2::DOUBLE / 299) AS x FROM range(300), mm),
    d AS (SELECT i, x, v.is_real, sum(exp(-0.5::DOUBLE * pow((x - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())) AS dens
          FROM g, v JOIN st ON v.is_real = st.is_real GROUP BY i, x, v.is_real)
    SELECT i::INTEGER AS i, round(x, 6) AS x, round(max(CASE WHEN is_real THEN dens END), 10) AS density_real,
           round(max(CASE WHEN NOT is_real THEN dens END), 10) AS density_synth FROM d GROUP BY i, x""",
)
def kde_overlay(spark, sf):
    out = fidelity.kde_overlay(customer_pair(spark, sf, "c_acctbal"), "c_acctbal")
    return rounded(rounded(out, 6, "x"), 10, "density_real", "density_synth")


def sql_describe(source: str, columns) -> str:
    return f"""SELECT col AS "column", count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
    round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max
    FROM ({sql_long(source, columns, 'DOUBLE', '')}) GROUP BY col"""


@query("column_describe", sql_describe("customer", MMD_COLUMNS) + " UNION ALL " + sql_describe("lineitem", LINE_NUMBERS))
def column_describe(spark, sf):
    a = describe.column_describe(table(spark, sf, "customer"), list(MMD_COLUMNS))
    b = describe.column_describe(table(spark, sf, "lineitem"), list(LINE_NUMBERS))
    return rounded(a.unionByName(b), 6, "mean", "std", "p25", "p50", "p75")


@query(
    "column_histogram",
    """WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    b AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19)::INTEGER AS bin FROM lineitem, m)
    SELECT bin, round(lo + bin * ((hi - lo) / 20), 6) AS lo, round(lo + (bin + 1) * ((hi - lo) / 20), 6) AS hi, n
    FROM (SELECT bin, count(*) AS n FROM b GROUP BY bin), m""",
)
def column_histogram(spark, sf):
    return rounded(describe.column_histogram(table(spark, sf, "lineitem"), "l_extendedprice"), 6, "lo", "hi")


@query(
    "quantile_grid",
    """SELECT round(p, 6) AS p, round(q, 6) AS q FROM (
    SELECT unnest(list_transform(range(1000), lambda i: i / 999.0::DOUBLE)) AS p,
           unnest(quantile_cont(l_extendedprice, [i / 999.0::DOUBLE FOR i IN range(1000)])) AS q FROM lineitem)""",
)
def quantile_grid(spark, sf):
    return rounded(describe.quantile_grid(table(spark, sf, "lineitem"), "l_extendedprice"), 6, "p", "q")


@query(
    "binarise_target",
    "SELECT o_orderkey, (o_totalprice > (SELECT median(o_totalprice) FROM orders))::INTEGER AS label FROM orders",
)
def binarise_target(spark, sf):
    return describe.binarise_target(table(spark, sf, "orders"), "o_totalprice").select("o_orderkey", "label")

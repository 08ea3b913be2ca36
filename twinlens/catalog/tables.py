"""Generators, cleaning, column rules and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlens import constants as C
from twinlens.catalog.registry import halves, query, sql_first_half, sql_normal, sql_uniform, table
from twinlens.functions import hashrand as H
from twinlens.functions import requests, scalars
from twinlens.operators import cleaning, columns, generators, profile, sampling
from twinlens.operators.fidelity import one_row
from twinlens.operators.ordered import running_total

SEED = C.DEFAULT_SEED


# --- seed tables ---------------------------------------------------------------


def sql_steps(u: str, thresholds) -> str:
    cases = " ".join(f"WHEN {u} < {t!r}::DOUBLE THEN {i}" for i, t in enumerate(thresholds))
    return f"(CASE {cases} ELSE {len(thresholds)} END)"


def sql_pick(index: str, values) -> str:
    quoted = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{quoted}])[{index} + 1]"


def sql_healthcare(source: str, rid: str, seed: int) -> str:
    names, weights, am, asd, cm, csd, bm = zip(*C.DIAGNOSES)
    return f"""SELECT rid + 1001 AS patient_id, age, gender, bmi, systolic_bp, smoker, diagnosis, num_medications, treatment_cost,
      ((treatment_cost > 3000 OR age > 70) AND lucky)::INTEGER AS readmitted FROM (
      SELECT rid, trunc(greatest(18.0, least(95.0, {sql_pick('d', am)} + {sql_pick('d', asd)} * z_age)))::INTEGER AS age,
        CASE WHEN u_gender < 0.48 THEN 'Male' ELSE 'Female' END AS gender,
        round_even(greatest(15.0, least(55.0, 27.5::DOUBLE + 5.5::DOUBLE * z_bmi)), 1) AS bmi,
        trunc(greatest(85.0, least(200.0, {sql_pick('d', bm)} + 14.0::DOUBLE * z_bp)))::INTEGER AS systolic_bp,
        (u_smoker < 0.25)::INTEGER AS smoker, {sql_pick('d', names)} AS diagnosis,
        {sql_steps('u_meds', H.poisson_thresholds(3.5, 15))}::INTEGER AS num_medications,
        round_even(greatest(20.0, {sql_pick('d', cm)} + {sql_pick('d', csd)} * z_cost), 2) AS treatment_cost, lucky FROM (
        SELECT {rid} AS rid, {sql_steps(sql_uniform(seed, rid, 'diagnosis'), H.cumulative(weights))} AS d,
          {sql_normal(seed, rid, 'age')} AS z_age, {sql_uniform(seed, rid, 'gender')} AS u_gender, {sql_normal(seed, rid, 'bmi')} AS z_bmi,
          {sql_normal(seed, rid, 'bp')} AS z_bp, {sql_uniform(seed, rid, 'smoker')} AS u_smoker, {sql_uniform(seed, rid, 'meds')} AS u_meds,
          {sql_normal(seed, rid, 'cost')} AS z_cost, {sql_uniform(seed, rid, 'readmitted')} > 0.6 AS lucky FROM {source}))"""


@query("gen_healthcare", sql_healthcare("customer", "c_custkey", SEED))
def gen_healthcare(spark, sf):
    return generators.healthcare_rows(table(spark, sf, "customer"), "c_custkey", SEED)


def sql_finance(source: str, rid: str, seed: int) -> str:
    types, shares = zip(*C.TRANSACTION_TYPES)
    return f"""SELECT rid + 100001 AS transaction_id,
      trunc(greatest(18.0, least(85.0, 42.0::DOUBLE + 14.0::DOUBLE * z_age)))::INTEGER AS customer_age,
      {sql_pick(sql_steps('u_type', H.cumulative(shares)), types)} AS transaction_type,
      {sql_pick(sql_steps('u_merchant', H.cumulative([1.0] * len(C.MERCHANTS))), C.MERCHANTS)} AS merchant_category,
      round_even(CASE WHEN fraud = 1 THEN 500.0::DOUBLE + 7500.0::DOUBLE * u_fraud_amount ELSE least(exp(4.0::DOUBLE + 1.2::DOUBLE * z_amount), 5000.0) END, 2) AS amount,
      (CASE WHEN fraud = 1 THEN {sql_pick(sql_steps('u_hour', H.cumulative([1.0] * 5)), C.FRAUD_HOURS)}
            ELSE trunc(greatest(0.0, least(23.0, 13.0::DOUBLE + 4.0::DOUBLE * z_hour))) END)::INTEGER AS hour_of_day,
      round_even(exp(8.5::DOUBLE + 1.5::DOUBLE * z_balance), 2) AS account_balance,
      greatest({sql_steps('u_tx', H.poisson_thresholds(3.0, 25))}, 1)::INTEGER AS num_tx_today,
      trunc(greatest(300.0, least(850.0, 680.0::DOUBLE + 80.0::DOUBLE * z_score)))::INTEGER AS credit_score,
      (u_foreign < 0.08)::INTEGER AS foreign_transaction, fraud AS is_fraud FROM (
      SELECT {rid} AS rid, {sql_normal(seed, rid, 'age')} AS z_age, {sql_uniform(seed, rid, 'type')} AS u_type,
        {sql_uniform(seed, rid, 'merchant')} AS u_merchant, ({sql_uniform(seed, rid, 'fraud')} < 0.05)::INTEGER AS fraud,
        {sql_uniform(seed, rid, 'fraud_amount')} AS u_fraud_amount, {sql_normal(seed, rid, 'amount')} AS z_amount,
        {sql_uniform(seed, rid, 'fraud_hour')} AS u_hour, {sql_normal(seed, rid, 'hour')} AS z_hour, {sql_normal(seed, rid, 'balance')} AS z_balance,
        {sql_uniform(seed, rid, 'tx')} AS u_tx, {sql_normal(seed, rid, 'score')} AS z_score, {sql_uniform(seed, rid, 'foreign')} AS u_foreign FROM {source})"""


@query("gen_finance", sql_finance("orders", "o_orderkey", SEED))
def gen_finance(spark, sf):
    return generators.finance_rows(table(spark, sf, "orders"), "o_orderkey", SEED)


@query(
    "seed_augment",
    f"SELECT DISTINCT * FROM ({sql_healthcare('customer', 'c_custkey', SEED)} UNION ALL {sql_healthcare('supplier', 's_suppkey', SEED)}"
    f" UNION ALL {sql_healthcare('supplier', 's_suppkey', SEED + 1)})",
)
def seed_augment(spark, sf):
    """Customers' records, plus suppliers' under the same seed (copies, which go) and the next round's seed."""
    supplier = table(spark, sf, "supplier")
    base = generators.healthcare_rows(table(spark, sf, "customer"), "c_custkey", SEED)
    same = generators.healthcare_rows(supplier, "s_suppkey", SEED)
    more = generators.healthcare_rows(supplier, "s_suppkey", SEED + 1)
    return generators.augment(base, same.unionByName(more))


# --- cleaning --------------------------------------------------------------------


def damaged_orders(spark, sf):
    """Orders with holes where a draw on the key says so; the tables have no nulls."""
    u = H.uniform(SEED, F.col("o_orderkey"), "hole")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(u >= 0.15, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(u < 0.85, F.col("o_orderstatus")).alias("o_orderstatus"),
    )


_HOLE = sql_uniform(SEED, "o_orderkey", "hole")
SQL_DAMAGED = f"""(SELECT o_orderkey, CASE WHEN u >= 0.15 THEN o_totalprice END AS o_totalprice, CASE WHEN u < 0.85 THEN o_orderstatus END AS o_orderstatus
    FROM (SELECT *, {_HOLE} AS u FROM orders))"""


@query("drop_null_rows", f"SELECT * FROM {SQL_DAMAGED} WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL")
def drop_null_rows(spark, sf):
    return cleaning.drop_null_rows(damaged_orders(spark, sf))


@query(
    "fill_nulls",
    f"SELECT o_orderkey, coalesce(o_totalprice, 0.0) AS o_totalprice, coalesce(o_orderstatus, '0') AS o_orderstatus FROM {SQL_DAMAGED}",
)
def fill_nulls(spark, sf):
    return cleaning.fill_nulls(damaged_orders(spark, sf))


@query("finite_rows", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_HOLE} >= 0.15 AND {_HOLE} < 0.85")
def finite_rows(spark, sf):
    u = H.uniform(SEED, F.col("o_orderkey"), "hole")
    odd = F.when(u < 0.15, F.lit(float("nan"))).when(u >= 0.85, F.lit(float("-inf"))).otherwise(F.col("o_totalprice"))
    return cleaning.keep_finite(table(spark, sf, "orders").select("o_orderkey", odd.alias("o_totalprice")))


@query("clip_bounds", "SELECT c_custkey, greatest(0.0, least(5000.0, c_acctbal)) AS c_acctbal FROM customer")
def clip_bounds(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", scalars.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("c_acctbal"))


# --- column rules ------------------------------------------------------------------


def _ids(spark, sf, rule):
    out = None
    for name in ("orders", "lineitem"):
        df = table(spark, sf, name)
        numeric = columns.numeric_columns(df)
        found = rule(df.select(*numeric))
        flags = spark.range(1).select(
            F.inline(F.array(*[F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(found[c]).alias("is_id")) for c in numeric]))
        )
        out = flags if out is None else out.unionByName(flags)
    return out


_ID_TABLES = (("orders", ("o_orderkey", "o_custkey", "o_totalprice")),
              ("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")))


def _sql_ids(name_rule: str, ratio: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{c}' AS col, count(*) AS n, count(DISTINCT {c}) AS d FROM {t}" for t, cols in _ID_TABLES for c in cols
    )
    return f"""SELECT t AS "table", col AS "column", ({name_rule} OR {ratio}) AS is_id FROM ({parts})"""


def _register_ids():
    from twinlens.catalog.fidelity import JUDGE_NAME, METRIC_NAME

    query("id_cols_judge", _sql_ids(JUDGE_NAME, "d > 0.9 * n"))(lambda spark, sf: _ids(spark, sf, profile.judge_ids))
    query("id_cols_metrics", _sql_ids(METRIC_NAME, "(n > 20 AND d::DOUBLE / n > 0.95)"))(lambda spark, sf: _ids(spark, sf, profile.metric_ids))


_register_ids()


@query(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS "distinct",
        min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem"""
        for c in _ID_TABLES[1][1]
    ),
)
def column_profile(spark, sf):
    return profile.column_profile(table(spark, sf, "lineitem"))


def _sql_target(name: str, numbers, strings) -> str:
    def distinct(c: str) -> str:
        return f"(SELECT count(DISTINCT {c}) FROM {name})"

    cases = [f"WHEN {distinct(c)} = 2 THEN '{c}'" for c in numbers]
    cases += [f"WHEN {distinct(c)} BETWEEN 3 AND 10 THEN '{c}'" for c in numbers]
    cases += [f"WHEN {distinct(c)} < 10 THEN '{c}'" for c in strings]
    return f"""SELECT '{name}' AS "table", CASE {' '.join(cases)} END AS target"""


@query(
    "pick_target",
    " UNION ALL ".join(
        (
            _sql_target("lineitem", _ID_TABLES[1][1], ("l_returnflag", "l_linestatus")),
            _sql_target("labels", ("doc_id", "quality", "toxic"), ()),
            _sql_target("customer", ("c_custkey", "c_nationkey", "c_acctbal"), ("c_name", "c_mktsegment")),
        )
    ),
)
def pick_target(spark, sf):
    out = None
    for name in ("lineitem", "labels", "customer"):
        part = one_row(spark.range(1), **{"table": name, "target": profile.pick_target(table(spark, sf, name))})
        out = part if out is None else out.unionByName(part)
    return out


# --- row rules -----------------------------------------------------------------------


@query(
    "market_regime",
    """SELECT event_id, CASE WHEN r > 0.01 THEN 'Bull' WHEN r < -0.01 THEN 'Bear' ELSE 'Volatile' END AS market_regime FROM (
    SELECT event_id, (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
)
def market_regime(spark, sf):
    """Returns along a user's events. Windows are a user's hours, so a busy user is many
    small ones; the last value of each hour is carried into the user's next hour."""
    from pyspark.sql import Window

    events = table(spark, sf, "events", "event_id", "user_id", "ts", "value").withColumn("hour", F.date_trunc("hour", "ts"))
    last = events.groupBy("user_id", "hour").agg(F.max_by(F.struct("value"), F.struct("ts", "event_id")).alias("last"))
    carried = last.select("user_id", "hour", F.lag("last").over(Window.partitionBy("user_id").orderBy("hour")).alias("carried"))
    w = Window.partitionBy("user_id", "hour").orderBy("ts", "event_id")
    placed = events.select("*", F.lag(F.struct("value")).over(w).alias("own"))
    same = placed["user_id"].eqNullSafe(carried["user_id"]) & placed["hour"].eqNullSafe(carried["hour"])
    before = F.coalesce(F.col("own"), F.col("carried"))["value"]
    returns = placed.join(carried, same).select("event_id", F.try_divide(F.col("value") - before, before).alias("returns"))
    return returns.select("event_id", scalars.market_regime(F.col("returns")).alias("market_regime"))


_PRIORITY = ("critical", "high", "medium", "low", "public")


@query(
    "risk_budget",
    """SELECT o_orderkey, CASE WHEN o_orderpriority[1] IN ('1','2') THEN 0.1::DOUBLE WHEN o_orderpriority[1] IN ('4','5') THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS epsilon FROM orders""",
)
def risk_budget(spark, sf):
    level = F.element_at(F.array(*[F.lit(p) for p in _PRIORITY]), F.substring("o_orderpriority", 1, 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", scalars.risk_epsilon(level).alias("epsilon"))


def request_texts(spark, sf):
    """Conversation texts as requests. The invented prose holds none of the
    keywords, so a phrase picked by a draw on the row is put in front."""
    phrases = F.array(*[F.lit(p) for p in PHRASES])
    at = F.floor(H.uniform(SEED, F.concat_ws("-", "conv_id", "turn"), "phrase") * F.lit(float(len(PHRASES)))).cast("int")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.element_at(phrases, at + 1), F.lit(" "), F.col("text")).alias("text")
    )


PHRASES = (
    "500 diabetic patient records with high privacy",
    "1000 fraud transactions for model stress testing",
    "200 rare disease cohort records (lupus)",
    "5000 normal credit card transactions",
    "250 rows of strict medical data from a VAE",
    "an accurate finance table with 75   samples by diffusion",
    "TimeGAN please, 12 records",
    "something else",
)
_PHRASE_AT = f"floor({sql_uniform(SEED, 'rid', 'phrase')} * {len(PHRASES)})::INTEGER"
SQL_REQUESTS = f"""(SELECT conv_id, turn, {sql_pick(_PHRASE_AT, PHRASES)} || ' ' || text AS text
    FROM (SELECT *, conv_id || '-' || turn AS rid FROM conversations))"""
SQL_CONFIG = f"""(SELECT conv_id, turn,
    CASE WHEN contains(l, 'finance') OR contains(l, 'transaction') OR contains(l, 'fraud') THEN 'Finance' ELSE 'Healthcare' END AS domain,
    coalesce(TRY_CAST(nullif(regexp_extract(l, '([0-9]+)\\s*(rows|records|samples)', 1), '') AS BIGINT), 500) AS rows,
    CASE WHEN contains(l, 'high privacy') OR contains(l, 'strict') THEN 0.5::DOUBLE WHEN contains(l, 'high fidelity') OR contains(l, 'accurate') THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS epsilon,
    CASE WHEN contains(l, 'timegan') THEN 'timegan' WHEN contains(l, 'vae') THEN 'vae' WHEN contains(l, 'diffusion') THEN 'diffusion' ELSE 'auto' END AS model,
    substr(text, 1, 100) AS goal, text AS request FROM (SELECT *, lower(text) AS l FROM {SQL_REQUESTS}))"""


@query("prompt_config", f"SELECT * EXCLUDE (request) FROM {SQL_CONFIG}")
def prompt_config(spark, sf):
    return requests.request_config(request_texts(spark, sf), "text").drop("text")


@query(
    "schema_fhir",
    """SELECT event_id, missing = '' AS is_aligned, missing AS missing_fields, 'FHIR R4 (Observation Resource)' AS standard FROM (
    SELECT event_id, concat_ws(',', CASE WHEN NOT event_type IN ('click', 'view', 'error') THEN 'observation_code' END,
                                    CASE WHEN value <= 5.0 THEN 'value' END) AS missing FROM events)""",
)
def schema_fhir(spark, sf):
    """Each event as a record whose filled fields are named after the standard."""
    present = F.array_compact(
        F.array(
            F.when(F.col("user_id").isNotNull(), "patient_id"),
            F.when(F.col("ts").isNotNull(), "timestamp"),
            F.when(F.col("event_type").isin("click", "view", "error"), "observation_code"),
            F.when(F.col("value") > 5.0, "value"),
        )
    )
    missing = scalars.missing_fields(present, C.FHIR_FIELDS)
    return table(spark, sf, "events").select(
        "event_id",
        (F.size(missing) == 0).alias("is_aligned"),
        F.concat_ws(",", missing).alias("missing_fields"),
        F.lit(C.FHIR_STANDARD).alias("standard"),
    )


@query(
    "schema_basel",
    """SELECT o_orderkey, found <> '' AS is_compliant, found AS found_risk_parameters, 'Basel III (Credit Risk Framework)' AS standard FROM (
    SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN 'exposure_at_default' END,
      CASE WHEN o_totalprice > 400000 THEN 'probability_of_default' END, CASE WHEN o_orderpriority[1] = '1' THEN 'loss_given_default' END) AS found FROM orders)""",
)
def schema_basel(spark, sf):
    present = F.array_compact(
        F.array(
            F.when(F.substring("o_orderpriority", 1, 1) == "1", "loss_given_default"),
            F.when(F.col("o_totalprice") > 400000, "probability_of_default"),
            F.when(F.col("o_orderstatus") == "F", "exposure_at_default"),
        )
    )
    found = scalars.found_fields(present, C.BASEL_FIELDS)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        (F.size(found) > 0).alias("is_compliant"),
        F.concat_ws(",", found).alias("found_risk_parameters"),
        F.lit(C.BASEL_STANDARD).alias("standard"),
    )


@query(
    "trace_timeline",
    """SELECT user_id, event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 4) AS start,
    value AS duration FROM events""",
)
def trace_timeline(spark, sf):
    events = table(spark, sf, "events", "user_id", "event_id", "ts", "value")
    timed = running_total(events, ["user_id"], ["ts", "event_id"], "value", "start")
    return timed.select("user_id", "event_id", F.round("start", 4).alias("start"), F.col("value").alias("duration"))


@query("preview_head", "SELECT * FROM lineitem ORDER BY ALL LIMIT 50")
def preview_head(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.orderBy(*df.columns).limit(50)


@query(
    "union_pair",
    f"SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN {sql_first_half('o_orderkey')} THEN 1 ELSE 0 END AS member FROM orders",
)
def union_pair(spark, sf):

    pair = halves(spark, sf, "orders", "o_orderkey", "o_orderkey", "o_custkey", "o_totalprice")
    return sampling.union_all(pair.real.withColumn("member", F.lit(1)), pair.synth.withColumn("member", F.lit(0)))


# --- sampling ---------------------------------------------------------------------------


@query(
    "sample_n",
    f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat_ws('|', '{SEED}', CAST(o_orderkey AS VARCHAR), 'order')), o_orderkey LIMIT 500",
)
def sample_n(spark, sf):
    orders = table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return sampling.sample_n(orders, 500, F.col("o_orderkey"), ["o_orderkey"])


@query("split_train_test", f"SELECT o_orderkey, {sql_uniform(SEED, 'o_orderkey', 'split')} < 0.7 AS is_train FROM orders")
def split_train_test(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", sampling.train_flag(F.col("o_orderkey")).alias("is_train"))


@query(
    "fold_assign",
    f"""SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus
      ORDER BY md5(concat_ws('|', '{SEED}', CAST(o_orderkey AS VARCHAR), 'fold')), o_orderkey) - 1) % 5)::INTEGER AS fold FROM orders""",
)
def fold_assign(spark, sf):
    orders = table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    return sampling.fold_assign(orders, "o_orderstatus", F.col("o_orderkey"), ["o_orderkey"])

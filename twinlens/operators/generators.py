"""Seed tables from domain priors: one record per row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens import constants as C
from twinlens.functions import hashrand as H
from twinlens.functions.scalars import clip


def healthcare_rows(ids: DataFrame, row_id: str, seed: int = C.DEFAULT_SEED) -> DataFrame:
    """Patients drawn from the diagnosis priors, keyed 1001 + row id."""
    rid = F.col(row_id)
    names, weights, age_mean, age_sd, cost_mean, cost_sd, bp_mean = zip(*C.DIAGNOSES)
    kind = ids.select(
        rid.alias(row_id), H.step_index(H.uniform(seed, rid, "diagnosis"), H.cumulative(weights)).alias("_d")
    )
    d = F.col("_d")

    def prior(values) -> Column:
        return H.pick(d, [float(v) for v in values])

    rows = kind.select(
        row_id,
        clip(H.normal(seed, rid, "age", prior(age_mean), prior(age_sd)), 18.0, 95.0, True).cast("int").alias("age"),
        F.when(H.uniform(seed, rid, "gender") < F.lit(C.MALE_SHARE), "Male").otherwise("Female").alias("gender"),
        F.bround(clip(H.normal(seed, rid, "bmi", 27.5, 5.5), 15.0, 55.0, True), 1).alias("bmi"),
        clip(H.normal(seed, rid, "bp", prior(bp_mean), 14.0), 85.0, 200.0, True).cast("int").alias("systolic_bp"),
        H.bernoulli(seed, rid, "smoker", C.SMOKER_SHARE).alias("smoker"),
        H.pick(d, names).alias("diagnosis"),
        H.poisson(seed, rid, "meds", 3.5, 15).alias("num_medications"),
        F.bround(F.greatest(F.lit(20.0), H.normal(seed, rid, "cost", prior(cost_mean), prior(cost_sd))), 2).alias("treatment_cost"),
        (H.uniform(seed, rid, "readmitted") > F.lit(0.6)).alias("_lucky"),
    )
    return rows.select(
        (F.col(row_id).cast("bigint") + F.lit(1001)).alias("patient_id"),
        "age",
        "gender",
        "bmi",
        "systolic_bp",
        "smoker",
        "diagnosis",
        "num_medications",
        "treatment_cost",
        (((F.col("treatment_cost") > 3000) | (F.col("age") > 70)) & F.col("_lucky")).cast("int").alias("readmitted"),
    )


def finance_rows(ids: DataFrame, row_id: str, seed: int = C.DEFAULT_SEED) -> DataFrame:
    """Card transactions, keyed 100001 + row id; fraud has its own amounts and hours."""
    rid = F.col(row_id)
    types, shares = zip(*C.TRANSACTION_TYPES)
    fraud = H.bernoulli(seed, rid, "fraud", C.FRAUD_SHARE)
    fraud_amount = F.lit(500.0) + F.lit(7500.0) * H.uniform(seed, rid, "fraud_amount")
    amount = F.least(H.lognormal(seed, rid, "amount", 4.0, 1.2), F.lit(5000.0))
    hour = clip(H.normal(seed, rid, "hour", 13.0, 4.0), 0.0, 23.0, True).cast("int")
    return ids.select(
        (rid.cast("bigint") + F.lit(100001)).alias("transaction_id"),
        clip(H.normal(seed, rid, "age", 42.0, 14.0), 18.0, 85.0, True).cast("int").alias("customer_age"),
        H.choice(seed, rid, "type", types, shares).alias("transaction_type"),
        H.choice(seed, rid, "merchant", C.MERCHANTS).alias("merchant_category"),
        F.bround(F.when(fraud == 1, fraud_amount).otherwise(amount), 2).alias("amount"),
        F.when(fraud == 1, H.choice(seed, rid, "fraud_hour", C.FRAUD_HOURS)).otherwise(hour).alias("hour_of_day"),
        F.bround(H.lognormal(seed, rid, "balance", 8.5, 1.5), 2).alias("account_balance"),
        F.greatest(H.poisson(seed, rid, "tx", 3.0, 25), F.lit(1)).alias("num_tx_today"),
        clip(H.normal(seed, rid, "score", 680.0, 80.0), 300.0, 850.0, True).cast("int").alias("credit_score"),
        H.bernoulli(seed, rid, "foreign", C.FOREIGN_SHARE).alias("foreign_transaction"),
        fraud.alias("is_fraud"),
    )


GENERATORS = {"healthcare": healthcare_rows, "finance": finance_rows}


def generate(spark: SparkSession, domain: str, rows: int = C.DEFAULT_ROWS, seed: int = C.DEFAULT_SEED) -> DataFrame:
    """A seed table of ``rows`` records of a known domain."""
    if domain.lower() not in GENERATORS:
        raise ValueError(f"Unknown domain: {domain}")
    return GENERATORS[domain.lower()](spark.range(rows), "id", seed)


def seed_or_input(spark: SparkSession, df: DataFrame | None, domain: str, rows: int, seed: int) -> tuple[DataFrame, bool]:
    """The input, or a generated table where there is none; and whether it is generated."""
    if df is not None and not df.isEmpty():
        return df, False
    return generate(spark, domain, max(rows, C.MIN_COLD_START_ROWS), seed), True


def augment(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Add rows and drop exact copies."""
    return df.unionByName(extra).dropDuplicates()


def augment_seed(df: DataFrame, domain: str, rows: int, seed: int, iteration: int) -> DataFrame:
    """More generated rows for another round, with a seed of their own."""
    extra = generate(df.sparkSession, domain, 2 * rows, seed + iteration)
    return augment(df, extra)

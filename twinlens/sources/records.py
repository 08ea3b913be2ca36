"""Reports, certificates, audit records, run logs and the performance history,
all as tables with one row per run."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens import constants as C
from twinlens.functions.scalars import fixed
from twinlens.plans.scorecard import FIDELITY, UTILITY, nested


def report_text(rows: DataFrame, *keep: str, places: int = 6) -> DataFrame:
    """The nested scorecard as JSON text, numbers as fixed decimals."""
    numbers = [*FIDELITY, *UTILITY, "mia_risk_score"]
    plain = rows.select(*[F.col(c).cast(f"decimal(20,{places})").alias(c) if c in numbers else F.col(c) for c in rows.columns])
    return nested(plain, *keep).select(*keep, F.to_json(F.struct("fidelity", "utility", "privacy")).alias("text"))


def write_text(df: DataFrame, column: str, path: str, mode: str = "append") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path, lineSep="\n")


def utc_text(stamp: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    """The stamp as text in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(stamp, F.current_timezone()), pattern)


RULE = "=" * 80
LINE = "-" * 80
NOT_MEASURED = "not measured"


def certificate_text(rows: DataFrame, stamp: Column, *keep: str) -> DataFrame:
    """One certificate per judged run.

    The status follows the decision, epsilon is the one of the run's proof, and
    the attack target is the threshold of the gate.
    """
    status = F.when(F.col("decision") == "Approve", F.lit("CLEARED")).otherwise(F.lit("NOT CLEARED"))

    def number(name: str, places: int, default: float = 0.0) -> Column:
        return fixed(F.coalesce(F.col(name), F.lit(default)), places)

    lines = [
        F.lit(RULE),
        F.lit("SYNTHETIC DATA CERTIFICATE"),
        F.lit(RULE),
        F.concat(F.lit("Timestamp: "), stamp),
        F.concat(F.lit("Domain:    "), F.col("domain")),
        F.concat(F.lit("Status:    "), status),
        F.lit(LINE),
        F.lit("1. FIDELITY"),
        F.concat(F.lit("   Average Wasserstein distance: "), number("wasserstein", 4)),
        F.concat(F.lit("   Correlation similarity:       "), number("correlation_similarity", 4)),
        F.concat(F.lit("   MMD:                          "), number("mmd", 4)),
        F.lit("2. UTILITY"),
        F.concat(F.lit("   Drop against baseline:        "), F.coalesce(F.concat(fixed(F.col("performance_drop"), 2), F.lit("%")), F.lit(NOT_MEASURED))),
        F.concat(F.lit("   TRTS accuracy:                "), number("trts_accuracy", 2)),
        F.lit("3. PRIVACY"),
        F.concat(F.lit("   Epsilon, delta:               "), number("epsilon", 2, C.DEFAULT_EPSILON), F.lit(", 1e-5")),
        F.concat(F.lit("   Membership attack accuracy:   "), F.coalesce(fixed(F.col("mia_risk_score"), 2), F.lit(NOT_MEASURED)), F.lit(f" (target < {C.MAX_ATTACK_ACCURACY})")),
        F.concat(F.lit("   k-anonymity:                  "), F.coalesce(F.col("k_anonymity"), F.lit(0)).cast("string")),
        F.lit(RULE),
    ]
    return rows.select(*keep, F.concat_ws("\n", *lines).alias("text"))


CONTROLLER = "Synthetic data service"


def audit_records(rows: DataFrame, proof: list[Column], agent: str, controller: str = CONTROLLER) -> DataFrame:
    """Records of processing: needs timestamp, domain, goal, and the schema
    outline as ``synthesis_logic``."""
    domain = F.col("domain")
    return rows.select(
        F.struct(
            F.lit(controller).alias("controller"),
            F.col("goal").alias("purpose_of_processing"),
            F.concat(F.lit("Sensitive "), domain, F.lit(" Tabular Data")).alias("data_categories"),
            F.lit("Ephemeral (Session-based)").alias("storage_limitation"),
            F.lit("Noise with stated epsilon and delta").alias("technical_measures"),
            F.lit("Art. 6(1)(f) - Legitimate Interests").alias("lawful_basis"),
        ).alias("ropa_metadata"),
        F.struct(
            F.col("timestamp"),
            F.lit(agent).alias("agent"),
            domain.alias("domain"),
            F.lit("N/A").alias("reasoning_trace"),
            F.col("synthesis_logic"),
            F.struct(*proof).alias("privacy_parameters"),
        ).alias("technical_lineage"),
    )


def append_audit(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def run_log(rows: DataFrame) -> DataFrame:
    """Parameters and the three tracked metrics of each run; null where one was not measured."""
    return rows.select(
        F.concat(F.lit("Synthesis_"), F.col("domain"), F.lit("_eps"), fixed(F.col("epsilon"), 1)).alias("run_name"),
        "domain",
        "epsilon",
        F.col("wasserstein").alias("fidelity_wasserstein"),
        F.col("performance_drop").alias("utility_drop_percent"),
        F.col("mia_risk_score").alias("privacy_mia_risk"),
    )


def append_run_log(rows: DataFrame, path: str) -> None:
    run_log(rows).write.mode("append").parquet(path)


def _folder(run_id: str) -> str:
    return "run=r" + hashlib.md5(run_id.encode()).hexdigest()


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_once(rows: DataFrame, path: str, run_id: str) -> bool:
    """Append the rows of a run exactly once. They are staged in the run's own folder, which a repeated attempt
    writes anew, and count from the moment the run is entered in the manifest. A run that is entered already is
    left as it is (False). One writer per run id is assumed; different runs may write at the same time."""
    spark = rows.sparkSession
    manifest = _read(spark, f"{path}/manifest")
    if manifest is not None and manifest.where(F.col("run_id") == run_id).count():
        return False
    rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(f"{path}/rows/{_folder(run_id)}")
    spark.createDataFrame([(run_id,)], "run_id string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{_folder(run_id)}")
    return True


def read_once(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all runs in the manifest, with their run_id; None before the first one. Staged rows of a run that was
    lost before its entry are not seen."""
    rows, manifest = _read(spark, f"{path}/rows"), _read(spark, f"{path}/manifest")
    if rows is None or manifest is None:
        return None
    return rows.drop("run").join(manifest.select("run_id"), "run_id", "left_semi")


def history_seed(spark: SparkSession) -> DataFrame:
    schema = "id string, best_model string, modality string, domain string, document string"
    seed = spark.createDataFrame(list(C.HISTORY_SEED), schema)
    return seed.withColumn("score", F.lit(None).cast("double"))


def history_rows(runs: DataFrame) -> DataFrame:
    """History entries of runs: needs domain, modality, model, score, description."""
    return runs.select(
        F.concat_ws("_", "domain", "modality", "model", fixed(F.col("score"), 4)).alias("id"),
        F.col("model").alias("best_model"),
        "modality",
        "domain",
        F.col("description").alias("document"),
        "score",
    )


def append_history(history: DataFrame, runs: DataFrame) -> DataFrame:
    return history.unionByName(history_rows(runs))

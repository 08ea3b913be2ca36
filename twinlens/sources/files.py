"""Table files in and out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

HEALTHCARE = (
    "patient_id int, age int, gender string, bmi double, systolic_bp int, smoker int, "
    "diagnosis string, num_medications int, treatment_cost double, readmitted int"
)
LOANS = (
    "account_id int, age int, income double, credit_score int, loan_amount double, loan_term_months int, "
    "num_transactions int, account_type string, employment_status string, defaulted int"
)
SAMPLE_SCHEMAS = {"healthcare": HEALTHCARE, "finance": LOANS}
FORMATS = {"CSV": "csv", "JSON": "json", "PARQUET": "parquet"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame | None:
    """A CSV table with header, or None where there is no readable file.

    Give the schema where it is known; without it Spark reads the file twice.
    """
    reader = spark.read.option("header", True)
    try:
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    except AnalysisException:
        return None


def sample_path(folder: str, domain: str) -> str:
    """Where the sample table of a domain lies."""
    return f"{folder.rstrip('/')}/{domain.lower()}_sample.csv"


def read_sample(spark: SparkSession, folder: str, domain: str) -> DataFrame | None:
    return read_csv(spark, sample_path(folder, domain), SAMPLE_SCHEMAS.get(domain.lower()))


def write_table(df: DataFrame, path: str, output_format: str = "CSV", mode: str = "errorifexists") -> None:
    """Write as CSV (header), JSON lines or Parquet; an unknown format means CSV.

    JSON is one record per line, not one array: an array cannot be written or
    read in parallel.
    """
    kind = FORMATS.get(output_format.upper(), "csv")
    writer = df.write.mode(mode)
    if kind == "csv":
        writer = writer.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    writer.format(kind).save(path)


def read_table(spark: SparkSession, path: str, output_format: str, schema: T.StructType | str) -> DataFrame:
    kind = FORMATS.get(output_format.upper(), "csv")
    reader = spark.read.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True)
    return reader.format(kind).load(path)

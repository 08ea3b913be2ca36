"""Session defaults and the shared work folder."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "twinlens", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: the one the cluster names in
    ``spark.checkpoint.dir``. Only a local session without the setting gets a
    temporary one; on a cluster a missing setting is an error, since a
    machine-local folder would be lost with its machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="twinlens-"))
        current = spark.sparkContext.getCheckpointDir()
    return os.path.dirname(current)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: A fit keeps some hundred bytes a row, so a partition of so many rows is some hundred MB.
SPREAD_ROWS = 500_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` rows over all cores where the input came in fewer splits than that, for
    work that passes over them many times, and about ``SPREAD_ROWS`` to a partition at most."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / SPREAD_ROWS))
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table below the shared folder. Rows are computed once
    (``settle`` computes them twice) and outlive lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what is run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)

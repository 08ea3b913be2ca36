"""The loop's records are appended exactly once."""

from pyspark.sql import functions as F

from twinlens.plans import loop
from twinlens.sources import records


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(3).select(F.col("id").alias("n"))
    assert records.read_once(spark, path) is None
    assert records.append_once(rows, path, "007") and not records.append_once(rows, path, "007")
    rows.withColumn("run_id", F.lit("lost")).write.parquet(f"{path}/rows/{records._folder('lost')}")  # staged, never entered
    assert records.read_once(spark, path).count() == 3
    assert records.append_once(rows.limit(2), path, "lost")  # the repeated attempt replaces what was staged
    assert sorted((r["run_id"], r["n"]) for r in records.read_once(spark, path).collect()) == [("007", 0), ("007", 1), ("007", 2), ("lost", 0), ("lost", 1)]


def test_loop_writes_its_records_once(spark, tmp_path):
    request = loop.Request(domain="Healthcare", goal="a test", rows=200, model="vae", max_rounds=1, classifier="counts")
    path = str(tmp_path / "records")
    out = loop.run(spark, request, records_path=path, run_id="r1")
    assert loop.write_records(out, request, path, "r1") == dict.fromkeys(loop.RECORDS, False)
    found = {kind: records.read_once(spark, f"{path}/{kind}").collect() for kind in loop.RECORDS}
    assert {kind: len(r) for kind, r in found.items()} == dict.fromkeys(loop.RECORDS, 1)
    assert found["audit"][0]["ropa_metadata"]["purpose_of_processing"] == "a test" and "string" in found["audit"][0]["technical_lineage"]["synthesis_logic"]
    assert found["report"][0]["decision"] == out.decision and out.decision in ("Approve", "Reject", "Error")
    assert found["history"][0]["best_model"] == out.model_selection and "CERTIFICATE" in found["certificate"][0]["text"]
    assert all(loop.write_records(out, request, path, "r2").values())
    assert records.read_once(spark, f"{path}/log").count() == 2

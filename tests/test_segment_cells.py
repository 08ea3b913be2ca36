"""Scores of the segments' rows: looked up at once, and in code that the JVM compiles."""

import re

from pyspark.sql import functions as F

from twinlens.operators import segments
from twinlens.session import setting

METHOD = 8000  # bytes; the JVM only interprets longer ones


def sizes(df, capsys):
    capsys.readouterr()
    df.explain("codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]


def wide(spark, texts=1):
    """Two segments, five numbers, three classes."""
    cols = [F.col("is_real"), *[((F.col("id") * (i + 3)) % (5 + i)).cast("double").alias(f"x{i}") for i in range(5)]]
    rows = spark.range(80).withColumn("is_real", F.col("id") % 3 > 0).withColumn("seg", F.col("id") % 2)
    return rows.select(
        "seg", *cols, *[F.concat(F.lit("t"), (F.col("id") % (2 + i)).cast("string")).alias(f"t{i}") for i in range(texts)],
        (F.col("id") % 5 % (2 + F.col("seg"))).cast("string").alias("label"), (F.col("id") % 5).cast("int").alias("fold"), (F.col("id") % 4 > 0).alias("is_train"),
    )


def test_code_of_moments_is_compiled(spark, capsys):
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        found = sizes(segments._moments(wide(spark), 5, frozenset()), capsys)
    assert found and max(found) < METHOD


def scored(spark, rows):
    names, used = [*[f"x{i}" for i in range(5)], "t0"], list(range(6))
    cells = segments._cells(rows.join(segments._moments(rows, 5).select("seg", "lo", "hi"), "seg"), names, 5, "label").persist()
    totals = segments._segment_totals(cells, 5)
    k = segments._classes(totals)
    model = segments._model_whole(cells, totals, names, used, 5, k).persist()
    return segments._scored_whole(cells, model, names, used, used, k), k


def test_looked_up_as_joined(spark, monkeypatch, capsys):
    """Columns with few cells are looked up in one row of their segment; those with many are joined by cell, with equal scores."""
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        got, k = scored(spark, wide(spark))
        assert k == 3
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        plan = "\n".join(line for line in plan.splitlines() if re.search(r"^[ :+-]*Join Inner", line))
        assert plan.count("Join") == 6 and plan.count("= cell#") == 0
        assert max(sizes(got, capsys)) < METHOD
        monkeypatch.setattr(segments, "CELLS_WIDE", 4)
        mixed, _ = scored(spark, wide(spark))
    names = got.columns
    table = lambda df: sorted(df.select(*[F.round(c, 9).alias(c) if c.startswith(("score", "by_")) else c for c in names]).collect(), key=repr)
    assert table(got) == table(mixed)


def test_best_without_rounding_all(spark):
    rows = [(1.0, 1.0 + 4e-10, None), (1.0 + 4e-10, 1.0, 0.5), (-3.0, -2.0, -2.5), (0.0, 1.4e-9, 1.6e-9), (None, None, None), (-7.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    whole = segments._best(F.array_compact(F.array("a", "b", "c")))
    got = df.select(segments._first_best(["a", "b", "c"]).alias("x"), whole.alias("y")).collect()
    assert [r["x"] for r in got] == [r["y"] for r in got]

"""Nearest stored vectors, and the model recommendation built on texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens import constants as C

QUERY_LIMIT = 4096


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label."""
    return df.groupBy(label).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias(vector))


def nearest(queries: DataFrame, query_id: str, corpus: DataFrame, vec_id: str, vector: str, k: int = 1) -> DataFrame:
    """(query id, rank, vec id, dist2): the ``k`` nearest rows by squared distance.

    The queries travel to the corpus, never the other way. They are counted
    first: up to ``QUERY_LIMIT`` go along in one pass, more take one pass per
    slice. A task keeps k rows per query, so the final ranking sees only those.
    """
    slices = max(1, -(-queries.count() // QUERY_LIMIT))
    out = None
    for part in range(slices):
        chunk = queries if slices == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(slices)) == part)
        found = _nearest_pass(chunk, query_id, corpus, vec_id, vector, k)
        out = found if out is None else out.unionByName(found)
    return out


def _nearest_pass(queries: DataFrame, query_id: str, corpus: DataFrame, vec_id: str, vector: str, k: int) -> DataFrame:
    rows = queries.select(query_id, vector).collect()
    names = np.array([r[0] for r in rows])
    points = np.array([r[1] for r in rows], dtype=float)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [pd.DataFrame({"d": [], "v": []}) for _ in names]
        for batch in batches:
            ids = batch[vec_id].to_numpy()
            x = np.stack(batch[vector].to_numpy()).astype(float)
            for i, point in enumerate(points):
                diff = x - point
                d = np.einsum("ij,ij->i", diff, diff)
                near = np.argpartition(d, k - 1)[:k] if len(d) > k else np.arange(len(d))
                near = np.flatnonzero(d <= d[near].max())  # ties at the edge stay in
                both = pd.concat([best[i], pd.DataFrame({"d": d[near], "v": ids[near]})])
                best[i] = both.sort_values(["d", "v"]).head(k)
        for name, b in zip(names, best):
            yield pd.DataFrame({query_id: name, vec_id: b["v"].astype("int64"), "dist2": b["d"]})

    kind = queries.schema[query_id].dataType.simpleString()
    parts = corpus.select(vec_id, vector).mapInPandas(local, f"{query_id} {kind}, {vec_id} bigint, dist2 double")
    order = Window.partitionBy(query_id).orderBy("dist2", vec_id)
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_id, "rank", vec_id, "dist2")


def tokens(text: Column) -> Column:
    """Lower-case words and numbers of a text."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def recommend_model(requests: DataFrame, request_id: list[str], text: str, history: DataFrame) -> DataFrame:
    """Best model for each request text: the one of the most similar history entry.

    Similarity is the cosine of TF-IDF vectors with the history's document
    frequencies. Terms are joined as (term, weight) rows, so neither side has
    to fit anywhere. A request that shares no term gets the fallback.
    """
    terms = history.select("id", "best_model", F.explode(tokens(F.col("document"))).alias("term"))
    tf = terms.groupBy("id", "best_model", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    total = history.agg(F.count(F.lit(1)).cast("double").alias("n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    idf = df.select("term", (F.ln((F.lit(1.0) + total.scalar()) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))
    weighted = tf.join(idf, "term").select("id", "best_model", "term", "idf", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    entries = weighted.join(norms, "id").select("id", "best_model", "term", (F.col("w") * F.col("idf") / F.col("norm")).alias("w"))

    asked = (
        requests.select(*request_id, F.explode(tokens(F.col(text))).alias("term"))
        .groupBy(*request_id, "term")
        .agg(F.count(F.lit(1)).cast("double").alias("tf"))
    )
    scores = asked.join(entries, "term").groupBy(*request_id, "id", "best_model").agg(F.sum(F.col("tf") * F.col("w")).alias("score"))
    best = scores.groupBy(*request_id).agg(
        F.min_by("best_model", F.struct(-F.round("score", 9), F.col("id"))).alias("best_model")
    )
    return requests.select(*request_id).join(best, request_id, "left").select(
        *request_id, F.coalesce("best_model", F.lit(C.FALLBACK_MODEL)).alias("best_model")
    )

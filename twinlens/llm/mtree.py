"""Exact top-k by inner product with M-trees.

Components become ``floor(64 * x)``. Each vector x gets one more coordinate,
sqrt(M^2 - |x|^2), where M is the greatest norm, and each query a nought. Euclidean
distance then orders vectors as the inner product does, and it is a metric:
d^2 = |q|^2 + M^2 - 2 q.x.

Vectors are dealt to cells by the nearest of a bounded number of pivots, and a cell
to slices of about ``SLICE_ROWS``. Each slice becomes an M-tree: pages of at most
``PAGE`` entries, each node with its pivot, its covering radius and its distance to
the parent's pivot. The trees are written as rows of a table in the shared folder.
A search takes nodes best first, for a block of queries at a time; an entry whose
stored distance to its parent shows, by the triangle inequality, that it can't reach a
query's k-th best so far is passed over without computing its distance. Scores are exact integers; bounds allow for rounding.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlens.llm.texts import as_batch
from twinlens.session import settle

PIVOTS = 256
SLICE_ROWS = 4096
PAGE = 64
FAN_OUT = 16
#: Queries that go to the tasks at a time.
QUERY_BLOCK = 20_000
#: Queries that go through a tree together.
TOGETHER = 2_000
TOP = 20
SCALE = 64
#: Score and id of a place that no row holds yet; scores are beyond +-2^53 never.
NONE = -float(1 << 60)
NO_ID = np.iinfo(np.int64).max


def scaled(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x, norm2): components as whole numbers. Rows whose vector or a
    component of it is null, or a component not finite, take no part."""
    v = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    x = F.transform("v", lambda e: F.floor(e * F.lit(float(SCALE))).cast("double"))
    rows = rows.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ~bad).select("vec_id", x.alias("x"))
    return rows.withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e))


def _matrix(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def _vectors(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of a column of lists, filled up with noughts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


class Best:
    """The k best (score, id) so far of each query of a block; greater scores and then smaller ids are better."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), NONE)
        self.id = np.full((queries, k), NO_ID)

    def add(self, query: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> np.ndarray:
        """Take in candidates, none of them known already; gives back the queries they belong to."""
        touched = np.unique(query)
        own, own_score, own_id = np.repeat(touched, self.k), self.score[touched].ravel(), self.id[touched].ravel()
        query, score, row_id = np.concatenate([own, query]), np.concatenate([own_score, score]), np.concatenate([own_id, row_id])
        order = np.lexsort((row_id, -score, query))
        query, score, row_id = query[order], score[order], row_id[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        stay = place < self.k
        self.score[query[stay], place[stay]], self.id[query[stay], place[stay]] = score[stay], row_id[stay]
        return touched


class Tree:
    """An M-tree over rows of whole numbers. Nodes and entries lie in arrays."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top2: float):
        self.ids, self.x, self.top2 = ids, x, top2
        self.extra = np.sqrt(np.maximum(top2 - (x * x).sum(1), 0))
        self.order = np.arange(len(ids))
        #: pivot row, radius, distance to the parent's pivot, (first, last) of the children, or of the entries in a leaf
        self.pivot: list[int] = []
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.leaf: list[bool] = []
        self.to_pivot = np.zeros(len(ids))  # of each row, to the pivot of its leaf
        self._grow()
        self.pivot, self.radius, self.to_parent = np.array(self.pivot), np.array(self.radius), np.array(self.to_parent)

    def _apart(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        d2 = ((self.x[rows] - self.x[pivot]) ** 2).sum(1) + (self.extra[rows] - self.extra[pivot]) ** 2
        return np.sqrt(d2)

    def _node(self, rows: np.ndarray, pivot: int, parent: int) -> int:
        self.pivot.append(pivot)
        self.radius.append(float(self._apart(rows, pivot).max()))
        self.to_parent.append(float(self._apart(np.array([pivot]), parent)[0]))
        self.span.append((0, 0))
        self.leaf.append(True)
        return len(self.pivot) - 1

    def _grow(self) -> None:
        every = np.arange(len(self.ids))
        middle = int(((self.x - self.x.mean(0)) ** 2).sum(1).argmin())
        placed = 0
        pending = [(self._node(every, middle, middle), every)]
        order = []
        while pending:
            node, rows = pending.pop()
            if len(rows) <= PAGE:
                self.span[node] = (placed, placed + len(rows))
                self.to_pivot[rows] = self._apart(rows, self.pivot[node])
                order.append(rows)
                placed += len(rows)
                continue
            parts = self._split(rows, self.pivot[node])
            first = len(self.pivot)
            own = [(self._node(r, p, self.pivot[node]), r) for p, r in parts]
            self.span[node], self.leaf[node] = (first, len(self.pivot)), False
            pending += own
        self.order = np.concatenate(order)

    def _split(self, rows: np.ndarray, pivot: int) -> list[tuple[int, np.ndarray]]:
        """Parts around pivots that are far from one another; vectors all alike are cut evenly."""
        want = min(FAN_OUT, -(-len(rows) // PAGE) + 1)
        near = self._apart(rows, pivot)
        pivots, owner = [], np.zeros(len(rows), np.int64)
        closest = near if near.max() > 0 else None
        if closest is None:
            return [(int(r[0]), r) for r in np.array_split(rows, min(FAN_OUT, -(-len(rows) // PAGE)))]
        dist = np.full(len(rows), np.inf)
        pick = int(near.argmax())
        for k in range(want):
            d = self._apart(rows, int(rows[pick]))
            pivots.append(int(rows[pick]))
            closer = d < dist
            owner[closer], dist[closer] = k, d[closer]
            pick = int(dist.argmax())
            if dist[pick] == 0:
                break
        parts = [(p, rows[owner == k]) for k, p in enumerate(pivots)]
        parts = [(p, r) for p, r in parts if len(r)]
        return parts if len(parts) > 1 else [(int(r[0]), r) for r in np.array_split(rows, 2)]

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> Best:
        """The k best rows of each query with a score of at least its ``floor``; a row with the query's ``own`` id is left out.

        A block of queries goes through the tree together, best node first. Every
        query keeps its own reach (the distance of its k-th best) and its own distance
        to a node's pivot: a node is entered by those queries alone that it can still
        serve, and distances are computed for those pairs alone that the stored
        distances to the parent leave open. Each query first goes straight down to the
        nearest leaf, which shortens its reach before the rest is looked at."""
        n = len(own)
        best = Best(n, k)
        scale = (queries * queries).sum(1) + self.top2
        slack = 1e-6 * np.sqrt(scale) + 1e-9
        reach = np.sqrt(np.maximum(scale - 2 * floor, 0)) + slack  # endless where the floor is

        def to(query: np.ndarray, row: int) -> np.ndarray:
            return np.sqrt(np.maximum(scale[query] - 2 * (queries[query] @ self.x[row]), 0))

        def look(node: int, query: np.ndarray, apart: np.ndarray) -> None:
            rows = self.order[slice(*self.span[node])]
            open_pairs = np.abs(apart[:, None] - self.to_pivot[rows]) <= reach[query][:, None]
            some, rows_open = open_pairs.any(1), open_pairs.any(0)
            query, rows, open_pairs = query[some], rows[rows_open], open_pairs[np.ix_(some, rows_open)]
            score = queries[query] @ self.x[rows].T
            least = np.maximum(best.score[query, -1], floor[query])
            at, row = np.nonzero(open_pairs & (score >= least[:, None]) & (self.ids[rows] != own[query][:, None]))
            if len(at):
                hit = best.add(query[at], score[at, row], self.ids[rows[row]])
                full = hit[best.score[hit, -1] > NONE]
                reach[full] = np.minimum(reach[full], np.sqrt(np.maximum(scale[full] - 2 * best.score[full, -1], 0)) + slack[full])

        every = np.arange(n)
        root = to(every, self.pivot[0])
        live = np.maximum(root - self.radius[0], 0) <= reach
        every, root = every[live], root[live]
        done = np.full(n, -1)  # the leaf that each query has looked at on its way down
        straight = [(0, every, root)] if len(every) else []
        while straight:
            node, query, apart = straight.pop()
            if self.leaf[node]:
                look(node, query, apart)
                done[query] = node
                continue
            kids = range(*self.span[node])
            apart = np.column_stack([to(query, self.pivot[c]) for c in kids])
            nearest = apart.argmin(1)
            straight += [(c, query[mine], apart[mine, j]) for j, c in enumerate(kids) if (mine := nearest == j).any()]

        heap = [(0.0, 0, every, root, np.maximum(root - self.radius[0], 0))] if len(every) else []
        while heap:
            _, node, query, apart, bound = heapq.heappop(heap)
            live = bound <= reach[query]
            query, apart = query[live], apart[live]
            if not len(query):
                continue
            if self.leaf[node]:
                new = done[query] != node
                if new.any():
                    look(node, query[new], apart[new])
                continue
            for c in range(*self.span[node]):
                near = np.abs(apart - self.to_parent[c]) - self.radius[c] <= reach[query]
                mine = query[near]
                if not len(mine):
                    continue
                d = to(mine, self.pivot[c])
                low = np.maximum(d - self.radius[c], 0)
                near = low <= reach[mine]
                if near.any():
                    heapq.heappush(heap, (float(low[near].min()), c, mine[near], d[near], low[near]))
        return best


class Index:
    """Trees over all vectors of a table."""

    def __init__(self, trees: DataFrame, rows: DataFrame, width: int, top2: float, pivots: np.ndarray):
        self.trees, self.rows, self.width, self.top2, self.pivots = trees, rows, width, top2, pivots


def _cells(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivot of each row."""
    return (x @ pivots.T - (pivots * pivots).sum(1) / 2).argmax(1).astype(np.int32) if len(x) else np.zeros(0, np.int32)


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> Index:
    """Index every valid row. Vectors shorter than the longest count as filled with
    noughts. Whole-number products have to stay below 2^53."""
    spark = vectors.sparkSession
    rows = settle(scaled(vectors, id_col, vec_col))
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.max("norm2").alias("top2")).first()
    n, width, top2 = about["n"], about["width"] or 0, about["top2"] or 0.0
    if top2 >= 2**52:
        raise ValueError("components are too large for exact sums")
    wanted = min(PIVOTS, max(1, -(-n // SLICE_ROWS)))
    pivots = _matrix([r["x"] for r in rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").select("x").limit(wanted).collect()], width)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _cells(_vectors(batch.column("x"), width), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    dealt = rows.mapInArrow(cells, "vec_id long, x array<double>, norm2 double, cell int")
    sizes = {r["cell"]: -(-r["count"] // SLICE_ROWS) for r in dealt.groupBy("cell").count().collect()}
    slices = F.element_at(F.from_json(F.lit(str([sizes.get(k, 1) for k in range(wanted)])), "array<int>"), F.col("cell") + 1)
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("vec_id"), slices).cast("int"))
    schema = pa.schema([("cell", pa.int32()), ("slice", pa.int32()), ("n", pa.int32()), ("tree", pa.binary())])

    def plant(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x = _vectors(table.column("x"), width)[order]
        tree = Tree(ids[order], x, top2)
        return pa.Table.from_batches([as_batch(schema, [table.column("cell")[0].as_py()], [table.column("slice")[0].as_py()], [len(ids)], [pickle.dumps(tree, 5)])])

    trees = dealt.groupBy("cell", "slice").applyInArrow(plant, "cell int, slice int, n int, tree binary")
    trees = trees.repartition(max(1, min(sum(sizes.values()), 4096)))  # a task per tree: searches take longer than their rows let Spark guess
    return Index(settle(trees), rows, width, top2, pivots)


def search(index: Index, queries: DataFrame, k: int = TOP, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query of ``queries``
    (vec_id, x), all if fewer; ties go to the smaller vec_id, and rows with the
    query's own id are left out. Queries with the same id count once.

    Queries go to all trees in blocks of ``query_block``. A first pass takes each
    query to the trees of its own cell alone, which gives it a score to beat, so
    that the second enters few trees and sends on few rows."""
    spark = queries.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("x").alias("x"))
    n = queries.count()
    blocks_n = max(1, -(-n // query_block))
    out = None
    for b in range(blocks_n):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks_n)) == b).toPandas().sort_values("vec_id")
        ids, q = part["vec_id"].to_numpy(np.int64), _matrix(list(part["x"]), index.width)
        cell = _cells(q, index.pivots) if len(index.pivots) else np.zeros(len(q), np.int32)
        floor = np.full(len(ids), -np.inf)
        seen = _found(index.trees, spark.sparkContext.broadcast((ids, q, floor, cell)), k)
        # a tree's k-th best is a bound; so is the greatest of them
        full = seen.groupBy("query_id", "tree_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("c")).where(F.col("c") >= k)
        worst = full.groupBy("query_id").agg(F.max("low").alias("low")).toPandas()
        floor = floor.copy()
        floor[np.searchsorted(ids, worst["query_id"].to_numpy(np.int64))] = worst["low"].to_numpy(float)
        found = _found(index.trees, spark.sparkContext.broadcast((ids, q, floor, None)), k)
        out = found if out is None else out.unionByName(found)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(trees: DataFrame, shipped, k: int) -> DataFrame:
    """(query_id, vec_id, score, tree_id) of what each tree holds; with cells of the queries, in trees of the query's cell alone."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("tree_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, floor, home = shipped.value
        for batch in batches:
            for cell, part, raw in zip(batch.column("cell").to_pylist(), batch.column("slice").to_pylist(), batch.column("tree"), strict=True):
                asked = np.arange(len(ids)) if home is None else np.flatnonzero(home == cell)
                if not len(asked):
                    continue
                tree = pickle.loads(raw.as_py())
                for a in range(0, len(asked), TOGETHER):
                    own = asked[a : a + TOGETHER]
                    best = tree.search(ids[own], q[own], k, floor[own])
                    at, place = np.nonzero(best.score > NONE)
                    if len(at):
                        yield as_batch(schema, ids[own[at]], best.id[at, place], best.score[at, place].astype(np.int64), np.full(len(at), (cell << 32) + part))

    return trees.select("cell", "slice", "tree").mapInArrow(run, "query_id long, vec_id long, score long, tree_id long")

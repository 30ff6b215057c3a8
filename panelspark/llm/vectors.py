"""Exact nearest vectors by inner product: one KD-tree per shard, searched best box first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.best import LOWEST, NO_ID, Best
from panelspark.llm.scratch import stored
from panelspark.session import scratch_path

SCALE = 1024
#: Vectors of one tree, and of one of its leaves.
SHARD, LEAF = 8192, 256
#: Components of the queries that one pass carries to the tasks.
VALUES_A_PASS = 1 << 20
#: How many times the vectors of one round the next one searches.
GROWTH = 32


def usable(vec: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & F.coalesce(fine, F.lit(False))


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) in doubles."""
    return np.floor(SCALE * values.astype(np.float64))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the lines of ``a`` with those of ``b``."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    if top >= 2**62:
        raise OverflowError("inner products beyond 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


class Tree:
    """Vectors cut in halves at the median of their widest component, every node with the tight box around its own."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> None:
        self.low, self.high, self.least, self.children, self.leaves = [], [], [], [], {}
        self._add(ids, points, leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.least, self.children = np.array(self.least), np.array(self.children)

    def _add(self, ids: np.ndarray, points: np.ndarray, leaf: int) -> int:
        node, low, high = len(self.low), points.min(axis=0), points.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.least.append(ids.min())
        self.children.append((-1, -1))
        if len(ids) <= leaf or not (high > low).any():
            self.leaves[node] = ids, points
            return node
        half = len(ids) // 2
        order = np.argpartition(points[:, np.argmax(high - low)], half)
        left = self._add(ids[order[:half]], points[order[:half]], leaf)
        right = self._add(ids[order[half:]], points[order[half:]], leaf)
        self.children[node] = left, right
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that any vector in a node's box can score, for every query and node."""
        return product(np.maximum(queries, 0), self.high) + product(np.minimum(queries, 0), self.low)

    def search(self, queries: np.ndarray, own: np.ndarray, best: Best) -> None:
        """Offers to ``best`` what can be among its queries' best.

        All queries go forward at once. Each takes the open node with its
        highest bound, opens that node's children or scores its leaf, and is
        done when no open node can better the last row it holds.
        """
        bounds = self.bounds(queries)
        open_ = np.full(bounds.shape, LOWEST, np.int64)
        open_[:, 0] = bounds[:, 0]
        going = np.arange(len(queries))
        while len(going):
            node = np.argmax(open_[going], axis=1)
            top, bar = open_[going, node], best.bar_score[going]
            open_[going, node] = LOWEST
            better = (top > bar) | ((top == bar) & (self.least[node] < best.bar_id[going]))
            # equal bounds may hide a node with smaller ids: a query ends only when its highest bound is below the bar
            going, node, better = (x[(top > LOWEST) & (top >= bar)] for x in (going, node, better))
            inner = better & (self.children[node, 0] >= 0)
            for side in (0, 1):
                child = self.children[node[inner], side]
                open_[going[inner], child] = bounds[going[inner], child]
            scored, at = going[better & ~inner], node[better & ~inner]
            order = np.argsort(at, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []:
                rows, (ids, points) = scored[group], self.leaves[at[group[0]]]
                same = ids == own[rows][:, None]
                for r, c in zip(*np.nonzero(same), strict=True):
                    same[r, c] = np.array_equal(queries[rows[r]], points[c])
                best.offer(rows, product(queries[rows], points), ids, same)


FOUND = T.StructType([T.StructField("q", T.LongType()), T.StructField("score", T.LongType()), T.StructField("id", T.LongType()), T.StructField("own", T.BooleanType())])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, values_a_pass: int = VALUES_A_PASS) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` vectors with the highest integer inner product with each query.

    Components count as floor(1024 x). ``queries`` are rows of ``vectors``;
    every row but the query's own is a candidate, equal scores go by smaller
    id, a null id last. Vectors that are null or hold a null, NaN or infinite
    component take no part; vectors of other lengths than the query's are not
    compared with it; empty vectors score 0. A row repeated as a whole is asked
    and found as often as it stands there. Ids must be integers, and products
    within 64 bits. Other columns are not carried; empty tables give no rows.

    Queries go to the tasks in passes of a bounded number of components, and
    every task builds trees over bounded shards of its rows. A first round
    searches some SHARD vectors, every further one GROWTH times as many, up to
    all. Each query's last score of one round is its bar in the next, and rises
    from shard to shard within a task, so that a round finds for a query about
    GROWTH * k rows at most, however many vectors there are.
    """
    spark = vectors.sparkSession
    if not isinstance(vectors.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column")

    def rows_of(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(usable(F.col("vec")))

    asked = stored(rows_of(queries).withColumn("q", F.monotonically_increasing_id()))
    held, values = asked.agg(F.count(F.lit(1)), F.sum(F.size("vec"))).first()
    passes, path = 1 + (values or 0) // values_a_pass, scratch_path(spark, "nearest")
    all_rows, count = rows_of(vectors), vectors.count() if held else 0
    for part in range(passes):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == part).collect()
        bars, size, last = {}, shard, False
        while not last:
            last = size >= count
            # a sample by hash, larger in every round and in the end the whole
            some = all_rows if last else all_rows.where(F.pmod(F.xxhash64("id", "vec"), F.lit(count)) < size)
            order = W.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("own").desc())
            best = _searched(some, block, bars, k + 1, shard).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
            if last:
                best.write.parquet(f"{path}/pass={part}")
            else:
                bars = {r.q: (r.score, r.id) for r in best.where(F.col("place") == k + 1).collect()}
            size *= GROWTH
    found = spark.read.schema(T.StructType([*FOUND, T.StructField("place", T.IntegerType())])).parquet(path)
    # the query's own row, where it is among the first k + 1, makes room for the next
    own = F.min(F.when(F.col("own"), F.col("place"))).over(W.partitionBy("q"))
    rest = found.withColumn("_own", F.coalesce(own, F.lit(k + 1))).where(F.col("place") != F.col("_own"))
    ranked = rest.withColumn("rank", F.col("place") - (F.col("place") > F.col("_own")).cast("int"))
    return ranked.join(asked.select("q", F.col("id").alias("query_id")), "q").select("query_id", "rank", "id", "score")


def _searched(rows: DataFrame, block: list, bars: dict, k: int, shard: int) -> DataFrame:
    """(q, score, id, own): what each task's trees hold for the queries of a block."""
    lengths: dict[int, list] = {}
    for r in block:
        lengths.setdefault(len(r.vec), []).append(r)
    ready = {}
    for n, own in lengths.items():
        # what lies on the bar is still to be found again, and all that score as much where its id is missing
        at = [(LOWEST, NO_ID) if r.q not in bars else (s - 1, NO_ID) if i is None else (s, i + 1) for r in own for s, i in [bars.get(r.q, (0, 0))]]
        ready[n] = (
            np.array([r.q for r in own], np.int64),
            np.array([NO_ID if r.id is None else r.id for r in own], np.int64),
            whole(np.array([r.vec for r in own], np.float64).reshape(len(own), n)),
            np.array([s for s, _ in at], np.int64),
            np.array([i for _, i in at], np.int64),
        )
    shared = rows.sparkSession.sparkContext.broadcast(ready)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = {n: Best(score, i, k) for n, (_, _, _, score, i) in asked.items()}
        waiting: dict[int, list] = {n: [] for n in asked}

        def search_shard(n: int) -> None:
            if waiting[n]:
                ids, points = (np.concatenate(x) for x in zip(*waiting[n], strict=True))
                for at in range(0, len(ids), shard):
                    Tree(ids[at : at + shard], points[at : at + shard]).search(asked[n][2], asked[n][1], best[n])
                waiting[n] = []

        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.flatten().to_numpy(), np.cumsum(sizes) - sizes
            for n in np.unique(sizes).tolist():
                if n in asked:
                    at = np.flatnonzero(sizes == n)
                    waiting[n].append((ids[at], whole(flat[starts[at][:, None] + np.arange(n)])))
                    if sum(len(i) for i, _ in waiting[n]) >= shard:
                        search_shard(n)
        for n in asked:
            search_shard(n)
            query, score, ids, own = best[n].rows()
            yield pa.RecordBatch.from_arrays([pa.array(asked[n][0][query]), pa.array(score), pa.array(ids, mask=ids == NO_ID), pa.array(own)], names=[f.name for f in FOUND])

    return rows.mapInArrow(search, FOUND)

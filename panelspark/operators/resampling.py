"""Drawing with replacement by cells: counts are split down a tree, so that no row is multiplied by the replicates.

Drawing n times from n rows is a multinomial over the cells of equal rows. It
is drawn as one binomial per inner node of a binary tree over the leading bits
of the cells' hashes: of the draws that reach a node, how many go left. Every
node's binomial comes from a hash of (seed, replicate, node), so a task that
knows the totals of all hash blocks draws its own blocks alone, and two tasks
agree on the nodes they share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from math import lgamma, log, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.hashing import HASH_SPAN, h32, h32_of_pairs
from panelspark.operators.skew import tasks
from panelspark.session import cut_lineage

# Leading bits that name a hash block: the list of their totals is bounded, and one block is drawn at a time.
BLOCK_BITS = 16

# Weights, replicates x cells, that a task holds at a time.
HELD = 2_000_000

# Beyond this standard deviation a binomial is rounded from its expansion about the normal.
EXACT_SPREAD = 20_000


def binomial(m: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """The binomial quantile at ``u``, the least k whose distribution function exceeds it, for each of ``m`` trials.

    The function is summed over ten standard deviations about the mean, which
    leaves out less than the 2**-33 that ``u`` can resolve.
    """
    out = np.zeros(len(m), np.int64)
    # small numbers sort by their digits
    order = np.argsort(m.astype(np.uint16) if len(m) and m.max() < 1 << 16 else m, kind="stable")
    for here in np.split(order, np.flatnonzero(np.diff(m[order])) + 1):
        trials = int(m[here[0]]) if len(here) else 0
        mean, spread = trials * p, sqrt(trials * p * (1 - p))
        if spread > EXACT_SPREAD:
            z = np.array([NormalDist().inv_cdf(x) for x in u[here].tolist()])
            out[here] = np.clip(np.rint(mean + spread * z + (z * z - 1) * (1 - 2 * p) / 6), 0, trials)
            continue
        first, last = max(0, int(mean - 10 * spread - 10)), min(trials, int(mean + 10 * spread + 10))
        # a chance is the first one times ratios of neighbours
        k = np.arange(first, last)
        start = lgamma(trials + 1) - lgamma(first + 1) - lgamma(trials - first + 1) + first * log(p) + (trials - first) * log(1 - p)
        steps = np.log((trials - k) / (k + 1)) + log(p) - log(1 - p)
        chances = np.exp(start + np.concatenate([[0.0], np.cumsum(steps)]))
        upto = np.cumsum(chances)
        out[here] = np.minimum(first + np.searchsorted(upto / upto[-1], u[here], side="right"), last)
    return out


def binomials(m: np.ndarray, left: np.ndarray, right: np.ndarray, u: np.ndarray) -> np.ndarray:
    """``binomial`` for the rows of ``m`` and ``u``, each with a share of its own; equal shares are done together."""
    out = np.empty_like(m)
    shares, of = np.unique(left / (left + right), return_inverse=True)
    order = np.argsort(of, kind="stable")
    for p, own in zip(shares.tolist(), np.split(order, np.flatnonzero(np.diff(of[order])) + 1)):
        out[own] = binomial(m[own].ravel(), p, u[own].ravel()).reshape(len(own), -1)
    return out


class Tree:
    """Draws of all replicates down the tree, many nodes at a time; keeps the path to the last block."""

    def __init__(self, totals: dict[int, int], bits: int, reps: int, seed: int | str) -> None:
        size = np.zeros(1 << bits, np.int64)
        for block, n in totals.items():
            size[block] = n
        self.upto, self.bits, self.reps = np.concatenate([[0], np.cumsum(size)]), bits, reps
        self.names = [f"{seed}|{r}|" for r in range(reps)]
        self.path = [(0, np.full(reps, self.upto[-1]))] + [(-1, np.zeros(reps, np.int64))] * bits

    def split(self, names: list[str], m: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many of each node's draws go left; a side without rows gets none."""
        out = np.where((right > 0)[:, None], 0, m)
        both = np.flatnonzero((left > 0) & (right > 0))
        if len(both):
            u = (h32_of_pairs(self.names, [names[i] for i in both.tolist()]) + 0.5) / HASH_SPAN
            out[both] = binomials(m[both], left[both], right[both], u)
        return out

    def blocks(self, wanted: np.ndarray) -> np.ndarray:
        """Draws of each replicate that fall into each of some blocks, which are ascending."""
        nodes, m = np.zeros(1, np.int64), self.path[0][1][None]
        for depth in range(self.bits):
            wide = self.bits - depth
            below = np.unique(wanted >> (wide - 1))
            parent = np.searchsorted(nodes, below >> 1)
            known = self.path[depth + 1][0] == below[0]
            need = np.unique(parent[1:] if known else parent)
            at = [self.upto[(2 * nodes[need] + side) << (wide - 1)] for side in (0, 1, 2)]
            left = np.zeros_like(m)
            left[need] = self.split([f"{depth}|{p}" for p in nodes[need].tolist()], m[need], at[1] - at[0], at[2] - at[1])
            m = np.where((below & 1).astype(bool)[:, None], m[parent] - left[parent], left[parent])
            if known:
                m[0] = self.path[depth + 1][1]
            nodes = below
            self.path[depth + 1] = (int(below[-1]), m[-1].copy())
        return m

    def cells(self, hashes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, draws) for the cells of whole blocks, which come by ascending hash."""
        upto = np.concatenate([[0], np.cumsum(sizes)])
        block = hashes >> (32 - self.bits)
        first = np.flatnonzero(np.diff(block, prepend=-1))
        yield from self._below(hashes, upto, self.bits, block[first], first, np.append(first[1:], len(hashes)), self.blocks(block[first]))

    def _below(self, hashes: np.ndarray, upto: np.ndarray, depth: int, nodes: np.ndarray, a: np.ndarray, b: np.ndarray, m: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, draws) for the cells ``a`` to ``b`` of each node of a level, whose draws are ``m``."""
        while True:
            one = b - a == 1
            yield from zip(a[one].tolist(), m[one])
            nodes, a, b, m = nodes[~one], a[~one], b[~one], m[~one]
            if not len(a):
                return
            if depth == 32:
                break
            if len(a) > 1 and m.size > HELD:
                half = len(a) // 2
                yield from self._below(hashes, upto, depth, nodes[:half], a[:half], b[:half], m[:half])
                nodes, a, b, m = nodes[half:], a[half:], b[half:], m[half:]
                continue
            cut = np.searchsorted(hashes, (2 * nodes + 1) << (31 - depth))
            left = self.split([f"{depth}|{p}" for p in nodes.tolist()], m, upto[cut] - upto[a], upto[b] - upto[cut])
            nodes, m = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.stack([left, m - left], 1).reshape(-1, self.reps)
            a, b = np.stack([a, cut], 1).ravel(), np.stack([cut, b], 1).ravel()
            full = b > a
            nodes, a, b, m, depth = nodes[full], a[full], b[full], m[full], depth + 1
        for node, x, y, rest in zip(nodes.tolist(), a.tolist(), b.tolist(), m):
            # cells of one hash, one after the other
            for cell in range(x, y - 1):
                taken = self.split([f"33|{node}|{cell - x}"], rest[None], upto[cell + 1 : cell + 2] - upto[cell], upto[y : y + 1] - upto[cell + 1])[0]
                yield cell, taken
                rest = rest - taken
            yield y - 1, rest


def resampled(cells: DataFrame, keys: Sequence[str], reps: int, seed: int | str, n: str | None = None) -> DataFrame:
    """``rep``, the columns of ``cells`` and ``weight``: how often each cell is drawn, where it is.

    A cell stands for ``n`` equal rows (one by default); ``keys`` are unique and
    tell cells apart. Each replicate draws as often as there are rows. Cells
    move once, to the task of their hash block; replicates are made there.
    """
    schema = T.StructType([T.StructField("rep", T.LongType()), *cells.schema, T.StructField("weight", T.LongType())])
    names = cells.columns

    def rows(drawn: Iterator[tuple[pa.Table, list[int], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for columns, at, weights in drawn:
            yield from _rows(columns.select(names).combine_chunks(), at, weights, schema)

    return _drawn(cells, keys, reps, seed, n, rows, schema)


def resampled_sums(cells: DataFrame, keys: Sequence[str], reps: int, seed: int | str, sums: Sequence[str]) -> DataFrame:
    """(rep, sums): the sums over the rows of each replicate that ``resampled`` draws, missing values left out.

    Each task adds up its own cells by products of their weights and values, so
    that only ``reps`` rows of sums leave it, not the drawn rows.
    """
    schema = T.StructType([T.StructField("rep", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in sums]])

    def total(drawn: Iterator[tuple[pa.Table, list[int], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        out = None
        for columns, at, weights in drawn:
            out = np.zeros((reps, len(sums))) if out is None else out
            values = np.stack([columns.column(c).fill_null(0.0).to_numpy()[at] for c in sums], 1)
            plain = np.isfinite(values).all(axis=1)
            out += weights[plain].T.astype(float) @ values[plain]
            for w, v in zip(weights[~plain], values[~plain]):
                # what is not finite counts only where it is drawn
                out[w > 0] += w[w > 0, None] * v
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps)), *[pa.array(c) for c in out.T.copy()]], names=schema.names)

    parts = _drawn(cells.select(*keys, *[F.col(c).cast("double").alias(c) for c in sums]), keys, reps, seed, None, total, schema)
    return parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in sums])


def _drawn(cells: DataFrame, keys: Sequence[str], reps: int, seed: int | str, n: str | None, use: Callable, schema: T.StructType) -> DataFrame:
    """What ``use`` makes, task by task, of (cells, places, weights): how often every replicate draws the cells at some places.

    Tasks hold ranges of hash blocks, so a task goes down one part of the tree
    and the nodes above the blocks are drawn about once, not once per task.
    """
    size = F.col(n).cast("long") if n else F.lit(1).cast("long")
    block = F.shiftright("_h", 32 - BLOCK_BITS)
    held = cut_lineage(cells.withColumns({"_h": h32(seed, *[F.col(k) for k in keys]), "_n": size}).where("_n > 0"))
    totals = {b: m for b, m in held.groupBy(block).agg(F.sum("_n")).collect()}
    step = max(1, HELD // reps)

    def draws(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int], np.ndarray]]:
        tree = Tree(totals, BLOCK_BITS, reps, seed)
        for own in _whole_blocks(batches, step):
            drawn = tree.cells(own.column("_h").to_numpy(), own.column("_n").to_numpy())
            while some := list(islice(drawn, step)):
                yield own, [cell for cell, _ in some], np.stack([w for _, w in some])

    parts = tasks(cells)
    dealt = held.repartitionById(parts, (block * parts / (1 << BLOCK_BITS)).cast("int")).sortWithinPartitions("_h", *keys)
    return dealt.mapInArrow(lambda batches: use(draws(batches)), schema)


def _whole_blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows of whole hash blocks, at least so many at a time but for the last; rows come by ascending hash."""
    kept: list[pa.RecordBatch] = []
    many, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column(batch.schema.get_field_index("_h")).to_numpy() >> (32 - BLOCK_BITS)
        start = 0
        for at in np.flatnonzero(np.diff(blocks, prepend=blocks[0] if last is None else last)).tolist():
            if many + at - start >= least:
                yield pa.Table.from_batches([*kept, batch.slice(start, at - start)])
                kept, many, start = [], 0, at
        kept.append(batch.slice(start))
        many += batch.num_rows - start
        last = blocks[-1]
    if kept:
        yield pa.Table.from_batches(kept)


def _rows(columns: pa.Table, at: list[int], weights: np.ndarray, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    cell, rep = np.nonzero(weights)
    taken = columns.take(pa.array(np.array(at)[cell])).combine_chunks()
    out = [pa.array(rep, pa.int64()), *[c.combine_chunks() for c in taken.columns], pa.array(weights[cell, rep], pa.int64())]
    yield pa.RecordBatch.from_arrays(out, names=schema.names)

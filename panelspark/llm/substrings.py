"""Removal of byte strings that occur elsewhere, by a distributed merge sort that knows common prefixes.

A string of LENGTH bytes that occurs twice has the same anchor in both places:
the least hashed GRAM-byte string in it, the first of them if there are several.
Only anchors that occur twice matter; their surroundings are sorted, once as
suffixes from the anchor on and once as reversed prefixes before it. Sorted runs
travel front-coded, and are merged by loser trees that start every comparison
behind the prefix already known to be common. What two neighbours in an order
share tells which strings around an anchor occur twice, and how many more could;
where these differ, the strings in between are counted one by one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.scratch import forget, stored
from panelspark.llm.words import mixed

LENGTH = 200
GRAM = 48
#: Anchors of a string start at one of so many places in it.
REACH = LENGTH - GRAM + 1
#: Bytes kept before an anchor, and behind it the string that starts there.
BEFORE = REACH - 1
WIDTH = BEFORE + LENGTH
#: Fills up surroundings that end with the text; no UTF-8 text has this byte.
PAD = b"\xff"
#: Records in a sorted run, in a part of the merge, and sampled to cut the parts.
RUN, PART, SAMPLE = 40_000, 40_000, 20_000
#: Rows, and bytes of texts, that a task returns at once.
TOGETHER, BYTES_TOGETHER = 8192, 4_000_000

_U = np.uint64
_BASE = 0x100000001B3
_PLACE = _U((1 << 36) - 1)


def _powers(n: int, of: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, of, np.uint64)]))


class Powers:
    """Powers of the rolling hash's base and of its inverse, as far as the longest text so far needs them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            self.up, self.down = _powers(2 * n, _BASE), _powers(2 * n, pow(_BASE, -1, 2**64))
        return self.up[: n + 1], self.down[: n + 1]


_power = Powers()


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of a text's anchors; a place holds the position and how far before it its strings start.

    Place: position * 65536 + farthest start * 256 + nearest start.
    """
    n = len(text)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = _power.upto(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(np.frombuffer(text, np.uint8).astype(np.uint64) + _U(1)) * up[:n])])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    m = len(grams)
    key = (grams & ~_PLACE) | np.arange(m, dtype=np.uint64)
    blocks = np.concatenate([key, np.full(-m % REACH, 2**64 - 1, np.uint64)]).reshape(-1, REACH)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    least = (np.minimum(ahead[: m - REACH + 1], behind[REACH - 1 : m]) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(least) - 1]])
    at = least[first]
    return grams[at].view(np.int64), at << 16 | (at - first) << 8 | (at - last)


def first_difference(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    x = int.from_bytes(a[start:], "big") ^ int.from_bytes(b[start:], "big")
    return len(a) - (x.bit_length() + 7) // 8


def front_coded(strings: list[bytes]) -> tuple[bytes, bytes]:
    """Sorted strings of one length as common prefix lengths, and what follows them."""
    grid = np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), -1)
    shared = np.zeros(len(strings), "<u2")
    shared[1:] = common(grid[:-1], grid[1:])
    return shared.tobytes(), b"".join(s[n:] for s, n in zip(strings, shared.tolist(), strict=True))


def decoded(shared: bytes, tails: bytes, width: int) -> Iterator[tuple[bytes, int]]:
    """The strings of a front-coded run, each with what it shares with the one before."""
    last, at = b"", 0
    for n in np.frombuffer(shared, "<u2").tolist():
        last = last[:n] + tails[at : at + width - n]
        at += width - n
        yield last, n


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix length of each pair of rows."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """Sorted runs as one: (run, string, what it shares with the string before).

    A loser tree whose entries know what they share with the last winner. Of two
    entries that share different lengths, the one that shares more is smaller,
    and the other shares with it what it shared with the last winner; only equal
    lengths call for a comparison, which starts behind them.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[bytes | None] = [None] * size
    shared = [-1] * size

    def advance(i: int) -> None:
        heads[i], shared[i] = next(runs[i], (None, -1)) if i < len(runs) else (None, -1)

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared length is then that with the winner."""
        n, m = shared[i], shared[j]
        if n != m:
            return (i, j) if n > m else (j, i)
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return (i, j) if b is None else (j, i)
        k = first_difference(a, b, n)
        if k == len(a) or a[k] < b[k]:
            shared[j] = k
            return i, j
        shared[i] = k
        return j, i

    losers, winners = [0] * size, [0] * (2 * size)
    for i in range(size):
        advance(i)
        winners[size + i] = i
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while heads[top] is not None:
        yield top, heads[top], shared[top]
        advance(top)
        node = (size + top) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def _records(side: str) -> Column:
    """The string to sort by: the text from the anchor on and then what is before it, or the other way round, and a tie-break."""
    parts = ["after", "before"] if side == "after" else ["before", "after"]
    return F.concat(*parts, F.unhex(F.lpad(F.hex(F.xxhash64("uid", "place")), 16, "0")))


def sorted_neighbours(surroundings: DataFrame, side: str, parts: int) -> DataFrame:
    """What each record shares with its neighbours in one order: (uid, place, shares).

    ``shares`` has a number for each neighbour: 256 times the bytes shared from
    the anchor on, plus those shared before it.
    """
    first, second = (LENGTH, BEFORE) if side == "after" else (BEFORE, LENGTH)
    rows = surroundings.select("uid", "place", _records(side).alias("string"))
    width = first + second + 8
    # one record in so many, chosen by hash: about SAMPLE of them whatever their number
    every = 1 + parts * PART // min(SAMPLE, 100 * parts)
    sample = sorted(bytes(r[0]) for r in rows.where(F.pmod(F.xxhash64("place", "uid"), F.lit(every)) == 0).select("string").collect())
    cuts = [sample[len(sample) * k // parts] for k in range(1, parts)] if sample else []

    def run(held: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
        held.sort()
        edges = [0, *[bisect_right(held, (c,)) for c in cuts], len(held)]
        out: dict[str, list] = {"part": [], "shared": [], "tails": [], "uids": [], "places": []}
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a < b:
                shared, tails = front_coded([h[0] for h in held[a:b]])
                ids = np.array([h[1:] for h in held[a:b]], np.int64)
                for name, v in zip(out, (k, shared, tails, ids[:, 0].tobytes(), ids[:, 1].tobytes()), strict=True):
                    out[name].append(v)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if c == "part" else pa.binary()) for c, v in out.items()], names=list(out))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int]] = []
        for batch in batches:
            held += zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) >= RUN:
                yield run(held)
                held = []
        if held:
            yield run(held)

    def merged(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in table.column_names}
        order = merge([decoded(s, t, width) for s, t in zip(columns["shared"], columns["tails"], strict=True)])
        ids = [list(zip(np.frombuffer(u, np.int64).tolist(), np.frombuffer(p, np.int64).tolist(), strict=True)) for u, p in zip(columns["uids"], columns["places"], strict=True)]
        at, strings, found = [0] * len(ids), [], []
        for r, string, _ in order:
            strings.append(string)
            found.append(ids[r][at[r]])
            at[r] += 1
        n = len(strings)
        grid = np.frombuffer(b"".join(strings), np.uint8).reshape(n, width)
        shares = np.zeros(n + 1, np.int64)
        a, b = common(grid[:-1, :first], grid[1:, :first]), common(grid[:-1, first : first + second], grid[1:, first : first + second])
        shares[1:n] = a * 256 + b if side == "after" else b * 256 + a
        both = np.stack([shares[:-1], shares[1:]], axis=1).ravel()
        edge: list[bytes | None] = [None] * n
        edge[0], edge[-1] = strings[0], strings[-1]
        return pa.table(
            {
                "uid": pa.array([f[0] for f in found], pa.int64()),
                "place": pa.array([f[1] for f in found], pa.int64()),
                "shares": pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n + 1, 2, dtype=np.int32)), pa.array(both.astype(np.int32))),
                "part": pa.array([columns["part"][0]] * n, pa.int32()),
                "edge": pa.array(edge, pa.binary()),
            }
        )

    coded = rows.mapInArrow(runs, "part int, shared binary, tails binary, uids binary, places binary")
    out = stored(coded.groupBy("part").applyInArrow(merged, "uid long, place long, shares array<int>, part int, edge binary"))
    # neighbours across the cuts: two strings a part
    ends = sorted((r.part, bytes(r.edge), r.uid, r.place) for r in out.where("edge IS NOT NULL").select("part", "edge", "uid", "place").collect())
    across = []
    for (p, s, u, x), (q, t, v, y) in zip(ends, ends[1:], strict=False):
        if p != q:
            a, b = min(first, first_difference(s[:first], t[:first], 0)), first_difference(s[first:-8], t[first:-8], 0)
            share = a * 256 + b if side == "after" else b * 256 + a
            across += [(u, x, [share]), (v, y, [share])]
    more = surroundings.sparkSession.createDataFrame(across, "uid long, place long, shares array<int>")
    return out.select("uid", "place", "shares").unionByName(more)


RANGES = "array<struct<first:bigint,last:bigint>>"


def _ranges(owner: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> pa.Array:
    """For each of n owners the list of its ranges, in the order given."""
    order = np.argsort(owner, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    both = pa.StructArray.from_arrays([pa.array(x[order].astype(np.int64)) for x in (first, last)], names=["first", "last"])
    return pa.ListArray.from_arrays(pa.array(offsets), both)


def settled(places: np.ndarray, after: pa.ListArray, before: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """Starts of strings around each anchor that surely occur twice, and those that remain open, as ranges.

    ``after`` and ``before`` are the shares with neighbours in the two orders.
    With a neighbour that shares r bytes from the anchor on and l before it, the
    strings that start from 200 - r to l bytes before the anchor are common.
    None can be beyond what the best neighbour of each order shares.
    """
    n = len(places)
    at, far, near = places >> 16, places >> 8 & 255, places & 255
    (own_a, a), (own_b, b) = ((np.repeat(np.arange(n), x.value_lengths().to_numpy()), x.flatten().to_numpy().astype(np.int64)) for x in (after, before))
    most = np.zeros((2, n), np.int64)
    np.maximum.at(most[0], own_a, a >> 8)
    np.maximum.at(most[1], own_b, b & 255)
    nxt, high = np.maximum(near, LENGTH - most[0]), np.minimum(far, most[1])
    owner, shares = np.concatenate([own_a, own_b]), np.concatenate([a, b])
    low, top = np.maximum(near[owner], LENGTH - (shares >> 8)), np.minimum(far[owner], shares & 255)
    held = low <= top
    owner, low, top = owner[held], low[held], top[held]
    order = np.lexsort((top, low, owner))
    owner, low, top = owner[order], low[order], top[order]
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    sure, open_ = [], []
    # the ranges of an anchor by their start, one of each anchor at a time
    for k in range(nth.max(initial=-1) + 1):
        at_k = nth == k
        o, x, y = owner[at_k], low[at_k], top[at_k]
        gap, more = x > nxt[o], y >= nxt[o]
        open_.append((o[gap], nxt[o][gap], x[gap] - 1))
        sure.append((o[more], np.maximum(x, nxt[o])[more], y[more]))
        nxt[o[more]] = y[more] + 1
    rest = np.flatnonzero(nxt <= high)
    open_.append((rest, nxt[rest], high[rest]))
    out = []
    for found in (sure, open_):
        o, x, y = (np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in range(3))
        out.append(_ranges(o, at[o] - y, at[o] - x, n))
    return out[0], out[1]


def repeated_starts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(uid, starts): for each different text, ranges of byte positions where a string of LENGTH bytes starts that also
    starts elsewhere in it or in another text.

    ``uid`` is xxhash64 of the text. Texts without such strings have no row. Exact
    copies of a text count once here.
    """
    spark = docs.sparkSession
    long_ = docs.where(F.octet_length(text_col) >= LENGTH).select(F.xxhash64(text_col).alias("uid"), F.encode(text_col, "utf-8").alias("bytes"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(t.as_py()) for t in batch.column(1)]
            uids = np.repeat(batch.column(0).to_numpy(), [len(f[0]) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[0] for f in found])), pa.array(uids), pa.array(np.concatenate([f[1] for f in found]))], names=["gram", "uid", "place"])

    found = stored(long_.mapInArrow(sample, "gram long, uid long, place long"))
    key = F.xxhash64("uid", "place")
    twice = found.groupBy("gram").agg(F.min(key).alias("_a"), F.max(key).alias("_b")).where("_a != _b").select("gram")
    places = stored(found.join(twice, "gram").groupBy("uid").agg(F.collect_set("place").alias("places")))
    forget(found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["uid", "place", "after", "before"]
        held: list[tuple[int, int, bytes, bytes]] = []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

        for batch in batches:
            for uid, blob, own in zip(*(batch.column(c) for c in range(3)), strict=True):
                text, uid = unpack(blob.as_py()), uid.as_py()
                for place in own.values.to_pylist():
                    p = place >> 16
                    held.append((uid, place, text[p : p + LENGTH].ljust(LENGTH, PAD), text[max(0, p - BEFORE) : p][::-1].ljust(BEFORE, PAD)))
                if len(held) >= TOGETHER:
                    yield rows()
                    held = []
        if held:
            yield rows()

    wanted = packed(docs, text_col).join(places, "uid")
    surroundings = stored(wanted.mapInArrow(cut, "uid long, place long, after binary, before binary"))
    forget(places)
    parts = 1 + surroundings.count() // PART
    orders = [sorted_neighbours(surroundings, side, parts).withColumn("side", F.lit(side)) for side in ("after", "before")]
    both = orders[0].unionByName(orders[1]).groupBy("uid", "place").agg(
        *[F.flatten(F.collect_list(F.when(F.col("side") == s, F.col("shares")))).alias(s) for s in ("after", "before")]
    )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure, open_ = settled(batch.column(1).to_numpy(), batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sure, open_], names=["uid", "place", "sure", "open"])

    state = stored(both.mapInArrow(settle, f"uid long, place long, sure {RANGES}, open {RANGES}").where("size(sure) > 0 OR size(open) > 0"))
    sure = state.select("uid", F.explode("sure").alias("r")).select("uid", "r.first", "r.last")
    starts = sure.unionByName(_counted(surroundings, state.where("size(open) > 0").select("uid", "place", "open")))
    return starts.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("starts"))


def _counted(surroundings: DataFrame, open_: DataFrame) -> DataFrame:
    """Of the open starts, those whose string occurs twice: the strings at the same distance from equal anchors are counted."""
    gram = F.xxhash64(F.substring("after", 1, GRAM)).alias("gram")
    at = F.shiftright("place", 16)
    keyed = surroundings.select(gram, "uid", "place", "after", "before")
    mine = open_.join(surroundings.select("uid", "place", gram), ["uid", "place"])
    mine = mine.select("gram", "uid", "place", F.explode("open").alias("r"))
    span = mine.groupBy("gram").agg(F.min(at - F.col("r.last")).alias("_near"), F.max(at - F.col("r.first")).alias("_far"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        for batch in batches:
            out: list[tuple[bytes, int, int]] = []
            for uid, place, after, before, near, far in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, around = place >> 16, before[::-1] + after
                for d in range(max(near, place & 255), min(far, place >> 8 & 255) + 1):
                    out.append((md5(around[BEFORE - d : WIDTH - d]).digest(), uid, p - d))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.int64()))], names=["string", "uid", "start"])

    every = stored(keyed.join(span, "gram").select("uid", "place", "after", "before", "_near", "_far").mapInArrow(strings, "string binary, uid long, start long"))
    place_of = F.struct("uid", "start")
    twice = every.groupBy("string").agg(F.min(place_of).alias("_a"), F.max(place_of).alias("_b")).where("_a != _b").select("string")
    return every.join(twice, "string").select("uid", F.col("start").alias("first"), F.col("start").alias("last"))


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """(uid, blob): every different text of at least LENGTH bytes, compressed for the shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze(t.as_py()) for t in batch.column(1)], pa.binary())], names=["uid", "blob"])

    rows = docs.where(F.octet_length(text_col) >= LENGTH).select(F.xxhash64(text_col).alias("uid"), F.encode(text_col, "utf-8").alias("bytes"))
    return rows.mapInArrow(pack, "uid long, blob binary").groupBy("uid").agg(F.first("blob").alias("blob"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, removed, kept, kept_sha256): each document without the bytes that repeat.

    A byte goes if a string of LENGTH bytes over it also starts anywhere else,
    in the same text or in another row's. Strings are judged on the whole
    input, so of two copies nothing stays. ``removed`` are the maximal runs
    (start, stop) of removed bytes; ``kept`` the bytes that stay, null where
    nothing was removed. A null text is empty; ids may be null or repeated,
    other columns are not carried.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(F.col(id_col), F.xxhash64(text).alias("uid"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole")))
    copied = rows.where(F.col("n_bytes") >= LENGTH).groupBy("uid").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("uid", F.lit(True).alias("copied"))
    starts = stored(repeated_starts(docs, text_col))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        unpack = zstandard.ZstdDecompressor().decompress

        def rows(held: list[tuple]) -> pa.RecordBatch:
            uids, firsts, lasts, kept = zip(*held, strict=True)
            owner = np.repeat(np.arange(len(held)), [len(x) for x in firsts])
            sha = [sha256(k).hexdigest() for k in kept]
            return pa.RecordBatch.from_arrays(
                [pa.array(uids, pa.int64()), _ranges(owner, np.concatenate(firsts), np.concatenate(lasts), len(held)), pa.array(kept, pa.binary()), pa.array(sha, pa.string())],
                names=["uid", "removed", "kept", "sha"],
            )

        held, size = [], 0
        for batch in batches:
            for uid, blob, own in zip(*(batch.column(c) for c in range(3)), strict=True):
                data = unpack(blob.as_py())
                # sorted by their starts; a run ends where the next start lies beyond all ends so far
                first, end = own.values.field("first").to_numpy(), np.maximum.accumulate(own.values.field("last").to_numpy()) + LENGTH
                new = np.flatnonzero(first[1:] > end[:-1]) + 1
                first, end = first[np.concatenate([[0], new])], end[np.concatenate([new - 1, [-1]])]
                cuts = [0, *np.stack([first, end], axis=1).ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                held.append((uid.as_py(), first, end, kept))
                size += len(kept) + 16 * len(first)
                if len(held) >= TOGETHER or size >= BYTES_TOGETHER:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    cut = packed(docs, text_col).join(starts, "uid").mapInArrow(strip, f"uid long, removed {RANGES}, kept binary, sha string")
    out = rows.join(cut, "uid", "left").join(copied, "uid", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("last")))
    nothing = F.array().cast(RANGES)
    return out.select(
        id_col,
        "n_bytes",
        F.when(F.col("copied"), whole).otherwise(F.coalesce("removed", nothing)).cast("array<struct<start:bigint,stop:bigint>>").alias("removed"),
        F.when(F.col("copied"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(F.col("copied"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
    )


"""Near-duplicate classes by DartMinHash signatures of weighted word shingles, banding, and exact checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.scratch import forget, stored
from panelspark.llm.words import mixed, shingles, word_hashes

SIMILARITY = 0.8
#: 20 bands of 4 coordinates: two texts that are 0.8 alike share no band with probability 0.00003.
BANDS, ROWS = 20, 4
COORDINATES = BANDS * ROWS
#: Members of a bucket of several blocks that meet all its texts first.
HELPERS = 24
#: Documents whose darts are thrown at once.
TOGETHER = 128
#: Texts of a block up to which they are compared pair by pair; more are compared by products.
FEW = 8
#: Texts of a block, their bytes, and shingles laid out at once.
BLOCK_TEXTS, BLOCK_BYTES, COLUMNS = 1024, 4_000_000, 8192
#: Bits of a sieve for every key, and at most (8 MB); bits of one of Spark's bitmaps.
SIEVE_BITS, MOST_BITS, BITMAP = 16, 2**26, 32768

_U = np.uint64
_UNIT = 2.0**-64


def _cells() -> Iterator[tuple[int, float, float]]:
    """Cells of the rank axis from its start on, the same for every text: (number, low, high)."""
    bound = 0.0
    for number in count():
        high = 0.125 if not bound else min(2 * bound, bound + 1 if bound < 8 else bound + 16)
        yield number, bound, high
        bound = high


@lru_cache(64)
def _poisson(mean: float) -> np.ndarray:
    """Probabilities of at most 0, 1, 2, ... darts in a region of this area."""
    p = math.exp(-mean)
    terms = [p]
    for k in range(1, 20 + int(5 * mean)):
        p *= mean / k
        terms.append(p)
    return np.cumsum(terms)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """DartMinHash: for each of ``n`` weighted sets, the earliest dart at each of ``k`` coordinates.

    ``elements`` are hashes with their ``weights``, each belonging to the set
    ``owner``. Every element has a column of regions, one wide in weight and at
    most one high in rank. How many darts lie in a region, and for each its
    place, rank and coordinate, follow from a hash of element and region alone,
    so two sets see the same darts where their weights overlap. A dart counts if
    it lies below the element's weight. Regions are opened by rising rank until
    every coordinate of a set has a dart, some k ln k darts in all. Two sets
    agree at a coordinate with a probability equal to their weighted similarity.
    A set without weight has only zeros.
    """
    width = np.ceil(weights).astype(np.int64)
    column = np.repeat(np.arange(len(elements)), width)
    nth = np.arange(len(column)) - np.repeat(np.cumsum(width) - width, width)
    base = mixed(elements[column] + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    room, own = weights[column] - nth, owner[column]
    out, ranks = np.zeros(n * k, np.uint64), np.full(n * k, np.inf)
    alive = np.arange(len(column))
    for number, low, high in _cells():
        open_ = np.isinf(ranks.reshape(n, k)).any(axis=1)
        alive = alive[open_[own[alive]]]
        if not len(alive):
            break
        seed = mixed(base[alive] + _U((number + 1) * 0xC2B2AE3D27D4EB4F % 2**64))
        darts = np.searchsorted(_poisson(high - low), seed * _UNIT, "right")
        hit = np.flatnonzero(darts)
        times = darts[hit]
        at = np.repeat(hit, times)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        dart = mixed(seed[at] ^ mixed(turn.astype(np.uint64) + _U(0x165667B19E3779F9)))
        inside = (mixed(dart ^ _U(0xD6E8FEB86659FD93)) * _UNIT) < room[alive[at]]
        dart, at = dart[inside], at[inside]
        rank = low + (high - low) * (mixed(dart ^ _U(0xA0761D6478BD642F)) * _UNIT)
        place = own[alive[at]] * k + (dart % _U(k)).astype(np.int64)
        order = np.lexsort((rank, place))
        place, rank, dart = place[order], rank[order], dart[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        # what earlier regions have given is of lower rank
        better = first[np.isinf(ranks[place[first]])]
        ranks[place[better]], out[place[better]] = rank[better], dart[better]
    return out.reshape(n, k)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One bucket number per band: a hash of the band's coordinates and its place."""
    rows = signatures.shape[1] // bands
    keys = np.zeros((len(signatures), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signatures), b + 1, np.uint64)
        for r in range(rows):
            key = mixed(key ^ signatures[:, b * rows + r])
        keys[:, b] = key
    return keys


def weighted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The 5-word shingles of a text, each with how often it occurs."""
    return np.unique(shingles(word_hashes(text)), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller over sum of the larger weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def buckets(docs: DataFrame, text_col: str) -> DataFrame:
    """(uid, keys, size) of every row with a text: its MD5, its buckets and its bytes; a text without words has no bucket."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                sets = [weighted(t.as_py()) for t in part.column(1)]
                owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
                elements = np.concatenate([s[0] for s in sets])
                weights = np.concatenate([s[1] for s in sets]).astype(float)
                keys = band_keys(dart_signatures(elements, weights, owner, len(sets)))
                held = np.array([len(s[0]) > 0 for s in sets])
                offsets = np.concatenate([[0], np.cumsum(held * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[held].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pc.cast(pc.binary_length(part.column(1)), pa.int64())], names=["uid", "keys", "size"])

    return docs.select(F.unhex(F.md5(text_col)).alias("uid"), text_col).where(F.col(text_col).isNotNull()).mapInArrow(sign, "uid binary, keys array<long>, size long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node of the links (a, b).

    Large and small stars in turn, each a minimum by node and a join, until all
    that is left are stars about their smallest nodes. Links are stored after
    each round.
    """
    edges = stored(links.select("a", "b").where("a != b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b")))
        new = stored(small.distinct())
        forget(edges)
        edges = new
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        # a node with two links up, or with links up and down, still has to be joined to its smallest
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def shared_weights(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum of the smaller weights of every set on the left with every set on the right.

    A shingle that occurs n times counts as n different ones, so that sums of
    smaller weights are numbers of common members: products of 0/1 matrices,
    built for some columns at a time.
    """

    def members(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        elements, times = (np.concatenate([s[i] for s in sets]) for i in (0, 1))
        owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.where(nth == 0, np.repeat(elements, times), mixed(np.repeat(elements, times) + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15))), np.repeat(owner, times)

    (a, own_a), (b, own_b) = members(left), members(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)))

    def placed(member: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(both, member)
        held = at < len(both)
        held[held] = both[at[held]] == member[held]
        order = np.argsort(at[held], kind="stable")
        return at[held][order], owner[held][order]

    (a, own_a), (b, own_b) = placed(a, own_a), placed(b, own_b)
    for start in range(0, len(both), COLUMNS):
        grids = []
        for at, owner, n in ((a, own_a, len(left)), (b, own_b, len(right))):
            i, j = np.searchsorted(at, [start, start + COLUMNS])
            grid = np.zeros((n, COLUMNS), np.float32)
            grid[owner[i:j], at[i:j] - start] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


def alike(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], least: float) -> np.ndarray:
    """For every set on the left whether each on the right has at least this similarity."""
    both = shared_weights(left, right)
    total = np.array([s[1].sum() for s in left])[:, None] + np.array([s[1].sum() for s in right])[None, :] - both
    return (both > 0) & (both / np.maximum(total, 1) >= least)


def forest(sets: list[tuple[np.ndarray, np.ndarray]], least: float, first: int | None = None) -> list[tuple[int, int]]:
    """Links (i, j) between alike sets that connect what all such links connect, without a circle.

    Of more than FEW sets, the first HELPERS meet all of them, then those that
    are still outside the largest class. With ``first``, only so many sets, from
    the start, meet the others.
    """
    n = len(sets)
    label, found = np.arange(n), []

    def join(i: int, hits: np.ndarray) -> None:
        new, at = np.unique(label[hits], return_index=True)
        other = new != label[i]
        found.extend((i, j) for j in hits[at[other]].tolist())
        if other.any():
            label[np.isin(label, new)] = label[i]

    def meet(some: np.ndarray) -> None:
        for i, row in zip(some.tolist(), alike([sets[i] for i in some], sets, least), strict=True):
            join(i, np.flatnonzero(row))

    if first is not None:
        meet(np.arange(first))
    elif n <= FEW:
        for i, j in combinations(range(n), 2):
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= least:
                join(i, np.array([j]))
    else:
        meet(np.arange(min(n, HELPERS)))
        outside = np.flatnonzero(label != np.bincount(label).argmax())
        if len(outside):
            meet(outside)
    return found


def dealt(signed: DataFrame) -> DataFrame:
    """(bucket, uid, size, blocks): the texts of every bucket that holds several, and into how many blocks they are dealt.

    Of buckets that hold the same texts one is kept.
    """
    members = signed.select(F.explode("keys").alias("bucket"), "uid", "size")
    same = [F.count(F.lit(1)).alias("_n"), F.min("uid").alias("_least"), *[F.bit_xor(F.xxhash64("uid", F.lit(k))).alias(f"_all{k}") for k in (0, 1)]]
    held = members.groupBy("bucket").agg(*same, F.sum("size").alias("_bytes")).where("_n > 1")
    held = held.groupBy("_n", "_least", "_all0", "_all1").agg(F.min("bucket").alias("bucket"), F.first("_bytes").alias("_bytes"))
    blocks = (F.lit(1) + F.floor(F.greatest(F.col("_n") / BLOCK_TEXTS, F.col("_bytes") / BLOCK_BYTES))).cast("int")
    return members.join(held.select("bucket", blocks.alias("blocks")), "bucket")


def sifted(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """The rows whose ``col`` is among that of ``keys``, and some others, none of which are shuffled to find out.

    Each key sets the bit of its hash in bitmaps of 4 KB, which go to all tasks.
    With SIEVE_BITS a key about one other row in 16 stays, or fewer; there are
    MOST_BITS at most, so of very many keys more do. No row of ``keys`` is missed.
    """
    bits = min(MOST_BITS, BITMAP * (1 + SIEVE_BITS * keys.count() // BITMAP))
    at = F.pmod(F.xxhash64(col), F.lit(bits))
    place, bit = F.shiftright(at, 15), at.bitwiseAND(BITMAP - 1)
    maps = keys.select(place.alias("_place"), bit.alias("_bit")).groupBy("_place").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    is_set = F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1
    return rows.join(F.broadcast(maps), (place == F.col("_place")) & is_set, "left_semi")


def bucket_links(members: DataFrame, texts: DataFrame, least: float, several: bool) -> DataFrame:
    """(a, b): links that connect all alike texts of each bucket of one block, and of others all texts that are alike to a helper.

    ``members`` are those of ``dealt``; ``several`` says that some bucket has
    more than one block. Each block is compared in one task, so the rows that
    meet are the members and, for every further block, HELPERS of its bucket.
    """
    block = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    rows = members.select("bucket", block.alias("block"), F.col("blocks").alias("_blocks"), F.lit(False).alias("helps"), "uid")
    if several:
        slot = F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(HELPERS)).alias("_slot")
        one = F.min(F.struct(F.xxhash64("uid", F.lit(2)), "uid"))["uid"].alias("uid")
        helpers = members.where("blocks > 1").groupBy("bucket", "blocks", slot).agg(one)
        each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        rows = rows.unionByName(helpers.select("bucket", each, F.col("blocks").alias("_blocks"), F.lit(True).alias("helps"), "uid"))
    rows = rows.join(texts.select("uid", "text"), "uid").select("bucket", "block", "_blocks", "helps", "uid", "text")

    def links(held: list[tuple]) -> list[tuple[bytes, bytes]]:
        texts_of = {uid: text for _, uid, text in sorted(held, key=lambda h: not h[0])}
        uids = list(texts_of)
        sets = [weighted(t) for t in texts_of.values()]
        helps = sum(h[0] for h in held)
        return [(min(uids[i], uids[j]), max(uids[i], uids[j])) for i, j in forest(sets, least, helps or None)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def found() -> pa.RecordBatch:
            out = links(held)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            bucket, block, _, helps, uid, text = (c.to_pylist() for c in batch.columns)
            for now, *row in zip(zip(bucket, block, strict=True), helps, uid, text, strict=True):
                if now != key:
                    if held:
                        yield found()
                    key, held = now, []
                held.append(row)
        if held:
            yield found()

    return rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block").mapInArrow(compare, "a binary, b binary")


def _mixed(placed: DataFrame) -> DataFrame:
    """(bucket, main): buckets that hold several classes, with the one that has most of its members."""
    held = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("_n"))
    each = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("_classes"), F.max(F.struct("_n", "root")).alias("_most"))
    return each.where("_classes > 1").select("bucket", F.col("_most.root").alias("main"))


def block_links(rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): roots of classes that have alike texts in one bucket; ``rows`` are (bucket, uid, root, main, size).

    Texts outside a bucket's main class meet all texts of the bucket. Both are
    dealt by hash into blocks of some thousand texts or a few megabytes, and two
    blocks meet in one task, where all their similarities are exact products;
    only pairs of classes come out.
    """
    out = F.col("root") != F.col("main")
    outside = F.when(out, 1).otherwise(0)
    slots = rows.groupBy("bucket").agg(
        *[
            (F.lit(1) + F.floor(F.greatest(F.sum(one) / BLOCK_TEXTS, F.sum(one * F.col("size")) / BLOCK_BYTES))).cast("int").alias(name)
            for name, one in (("_xs", outside), ("_ys", F.lit(1)))
        ]
    )
    dealt = rows.join(slots, "bucket").join(texts.select("uid", "text"), "uid")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = dealt.where(out).select("bucket", F.pmod(F.xxhash64("uid"), "_xs").cast("int").alias("x"), upto("_ys").alias("y"), F.lit(True).alias("left"), "uid", "root", "text")
    y = dealt.select("bucket", upto("_xs").alias("x"), F.pmod(F.xxhash64("uid", F.lit(1)), "_ys").cast("int").alias("y"), F.lit(False).alias("left"), "uid", "root", "text")

    def meet(table: pa.Table) -> pa.Table:
        sides = []
        for side in (True, False):
            own = table.filter(pc.equal(table["left"], side))
            sides.append((own["root"].to_pylist(), [weighted(t.as_py()) for t in own["text"]]))
        (root_x, left), (root_y, right) = sides
        found: set[tuple[bytes, bytes]] = set()
        if left and right:
            for i, j in zip(*np.nonzero(alike(left, right, least)), strict=True):
                if root_x[i] != root_y[j]:
                    found.add((min(root_x[i], root_y[j]), max(root_x[i], root_y[j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    return x.unionByName(y).groupBy("bucket", "x", "y").applyInArrow(meet, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, uid, class_uid, class_id, n_copies): the near-duplicate class of each row.

    Texts are linked where their weighted similarity is at least ``least``; a
    class is a connected component of links together with the exact copies of
    its texts. ``class_id`` is its smallest id (null only if all are null).
    Only one row per different text is compared. The texts of a bucket meet in
    one task, which returns links that connect what is alike. A bucket of more
    than some thousand texts or a few megabytes is dealt into blocks, all of
    which meet some helpers of the bucket; its texts that are then outside its
    main class meet all others block by block.

    A null text is a class of its own (``uid`` and ``class_uid`` null); texts
    without a word are alike only if equal. Ids may be null or repeated; other
    columns are not carried.
    """
    rows = stored(docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text_col)).alias("uid")))
    signed = stored(buckets(docs, text_col).groupBy("uid").agg(F.first("keys").alias("keys"), F.first("size").alias("size")))
    members = stored(dealt(signed))
    forget(signed)
    plain = docs.select(F.unhex(F.md5(text_col)).alias("uid"), F.col(text_col).alias("text")).where("text is not null")
    # only texts that share a bucket are shuffled, whatever the size of the table
    texts = sifted(plain, members.select("uid"), "uid").groupBy("uid").agg(F.first("text").alias("text"))
    large = members.where("blocks > 1")
    several = not large.isEmpty()
    if several:
        texts = stored(texts)
    roots = components(bucket_links(members, texts, least, several))
    if several:
        placed = large.join(roots, F.col("uid") == F.col("node"), "left").select("bucket", "uid", "size", F.coalesce("root", "uid").alias("root"))
        more = stored(block_links(placed.join(_mixed(placed), "bucket"), texts, least))
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
        forget(more, texts)
    forget(members)

    classed = rows.join(roots, F.col("uid") == F.col("node"), "left").select("id", "uid", F.coalesce("root", "uid").alias("class_uid"))
    sizes = classed.where(F.col("class_uid").isNotNull()).groupBy("class_uid").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
    out = classed.join(sizes, "class_uid", "left")
    alone = F.col("class_uid").isNull()
    return out.select(
        F.col("id").alias(id_col),
        "uid",
        "class_uid",
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
    )

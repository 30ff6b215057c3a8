"""Best-fit packing of tokenized documents into sequences by minimum bin slack."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 2048
END_ID = 0
#: Chunks a worker remembers with their ids; beyond that it starts anew.
CACHE = 400_000
#: A blank after white space: such texts cannot be cut before every blank.
IRREGULAR = re.compile(r"\s ")


def _encoder(path: str) -> Callable[[str], list[int]]:
    """Text to the ids that ``tokenizers`` gives for this file, special tokens being ordinary text.

    Where the vocabulary numbers its merges in their order, as byte-level ones
    do, ``tiktoken`` gives the same ids from the same file several times faster.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = model.get("vocab") or {}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges") or []]
    order = [vocab[a + b] for a, b in pairs]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
    if plain and order and order == sorted(set(order)) and len(vocab) - len(order) <= 257:
        import public_tokenizers
        import tiktoken

        # byte-level files write the 256 bytes as printable characters: these bytes as themselves, the others from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): n for token, n in vocab.items() if token not in special}
        return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return lambda text: slow.encode(text, add_special_tokens=False).ids


class ChunkIds(dict):
    """Token ids, as little-endian 32-bit bytes, of chunks of text that begin at a blank.

    The tokenizer's pattern always starts a new token where white space follows
    something else, so a text may be cut there without changing its ids.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.ids_of = _encoder(path)

    def encode(self, text: str) -> bytes:
        return array("I", self.ids_of(text)).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def text(self, text: str) -> bytes:
        if IRREGULAR.search(text):
            return self.encode(text)
        if len(self) > CACHE:
            self.clear()
        first, *rest = text.split(" ")
        return b"".join(chain((self[first],), map(self.__getitem__, [" " + x for x in rest])))


#: By tokenizer file; a worker process serves many tasks.
_chunks: dict[str, ChunkIds] = {}


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as pieces of at most ``capacity`` token ids: (id, piece, start, length, ids).

    A document is its text's ids and then END_ID. Longer ones are cut into
    pieces of ``capacity``, the first of which takes the remainder. A null or
    empty text is the one id END_ID; an id that is null or repeated is carried
    as it is; columns of ``docs`` other than these two are not.
    """
    schema = T.StructType(
        [
            docs.schema[id_col],
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _chunks:
            _chunks[tokenizer_path] = ChunkIds(tokenizer_path)
        chunks = _chunks[tokenizer_path]
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, pieces, starts, lengths, ids = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    raw = chunks.text(text or "") + end
                    n = len(raw) // 4
                    head = n if n <= capacity else n % capacity or capacity
                    cuts = [0, *range(head, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(row)
                        pieces.append(k)
                        starts.append(a)
                        lengths.append(b - a)
                    ids.append(raw)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                    names=[f.name for f in schema],
                )

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of the given lengths that fills ``room`` best: {length: times}.

    Subset sums are bits of one integer. Every layer shifts it by one length,
    as many copies at a time as a power of two; the layers tell which were used.
    """
    reach, layers, goal, mask = 1, [], 1 << room, (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            layers.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            left, part = left - part, part * 2
        if reach & goal:
            break
    total, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(layers):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + part
            total -= length * part
    return used


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bins for items given as {length: how many}: [(how many such bins, {length: times in each})].

    Each bin takes the longest item left and the combination of others that
    fills it best, which is then removed. The same combination is removed as
    often as there are items for it, so the number of searches depends on how
    many different lengths there are and not on the number of items.
    """
    left, bins = {k: n for k, n in histogram.items() if n}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        used = fullest({k: n for k, n in rest.items() if n}, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        bins.append((times, used))
        for k, n in used.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return bins


def slots(bins: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Where the items of each length go, by their rank: rows (length, first rank, per bin, first bin, first place)."""
    rows, taken, first = [], {}, 0
    for times, used in bins:
        place = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, taken.get(length, 0), n, first, place))
            taken[length] = taken.get(length, 0) + n * times
            place += n * length
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a length from 1 to ``capacity``.

    Only the histogram of lengths, at most ``capacity`` numbers, reaches the
    driver. Rows of one length are told apart by their rank; to rank a length
    that many rows have, rows are dealt into blocks by a hash, numbered in their
    block and shifted by the sizes of the blocks before. Other columns stay, but
    those with the names of the new ones or of the operator's own (``_block``,
    ``_in``, ``_before``, ``_n``, ``_rank``) are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset", "_block", "_in", "_before", "_n", "_rank")
    n_blocks = max(64, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [c for c, kind in pieces.dtypes if not kind.startswith(("array", "map"))]
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(n_blocks)).cast("int"))
    sizes = dealt.groupBy(length_col, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(length_col).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    histogram = {r[0]: r[1] for r in sizes.groupBy(length_col).agg(F.sum("_n")).collect()}
    table = slots(minimum_bin_slack(histogram, capacity))
    key = table[:, 0] << 44 | table[:, 1]

    inside = F.row_number().over(W.partitionBy(length_col, "_block").orderBy(*keys)) - 1
    ranked = dealt.withColumn("_in", inside).join(sizes.drop("_n"), [length_col, "_block"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_in")).alias("_rank"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at, width = pieces.columns.index(length_col), len(pieces.columns)
    names = [f.name for f in schema]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(width).to_numpy()
            row = table[np.searchsorted(key, length.astype(np.int64) << 44 | rank, "right") - 1] if len(table) else np.zeros((0, 5), np.int64)
            turn, nth = np.divmod(rank - row[:, 1], np.maximum(row[:, 2], 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(row[:, 3] + turn), pa.array(row[:, 4] + nth * length)], names=names)

    return ranked.mapInArrow(place, schema)

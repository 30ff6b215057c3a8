"""Alignment of two tokenizers' tokens over the same bytes, and how often which ids go together."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.packing import CACHE, ChunkIds
from panelspark.llm.scratch import stored

#: Characters of text that are aligned together.
BATCH_CHARS = 500_000
#: A blank without a word on both sides.
UNEVEN = re.compile(r"^ | $|\s |\A\Z")
#: At most this many id pairs are broadcast: those with at least that part of all links.
FREQUENT = 100_000


class ByteLevel:
    """Tokens of a byte-level ``tokenizers`` file; special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str) -> None:
        self.chunks = ChunkIds(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # such files write the 256 bytes as printable characters: these as themselves, the others from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        self.bytes_of = [b""] * (1 + max(vocab.values()))
        for token, n in vocab.items():
            self.bytes_of[n] = token.encode() if token in special else bytes(byte[c] for c in token)
        self.lengths = np.array(list(map(len, self.bytes_of)))
        self.changes = spec.get("normalizer") is not None

    def encode(self, text: str) -> np.ndarray | None:
        """Ids of a blank and the text, None where they do not spell it; every byte is a token, so without a normalizer they do."""
        ids = np.frombuffer(self.chunks.text(" " + text), "<i4")
        return None if self.changes and not spells(self.bytes_of, ids.tolist(), text) else ids


class Pieces(dict):
    """Tokens of a ``sentencepiece`` model, which puts a blank before the text itself.

    Where no piece reaches over a blank, a text with single blanks between its
    words is encoded word by word; a word's ids are remembered.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(n) for n in range(m.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if m.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)]
        self.lengths = np.array(list(map(len, self.bytes_of)))
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)

    def whole(self, text: str) -> bytes | None:
        ids = self.model.encode(text, num_threads=1)
        return array("i", ids).tobytes() if spells(self.bytes_of, ids, text) else None

    def __missing__(self, word: str) -> bytes | None:
        ids = self.whole(word)
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray | None:
        """Ids of a blank and the text, None where they do not spell it."""
        if self.by_word and not UNEVEN.search(text):
            if len(self) > CACHE:
                self.clear()
            words = list(map(self.__getitem__, text.split(" ")))
            if None not in words:
                return np.frombuffer(b"".join(words), np.int32)
        ids = self.whole(text)
        return None if ids is None else np.frombuffer(ids, np.int32)


def spells(bytes_of: list[bytes], ids: Iterable[int], text: str) -> bool:
    return b"".join(map(bytes_of.__getitem__, ids)) == (" " + text).encode("utf-8", "surrogatepass")


#: By file; a worker process serves many tasks.
_loaded: dict[str, ByteLevel | Pieces] = {}


def tokens_of(path: str) -> ByteLevel | Pieces:
    if path not in _loaded:
        _loaded[path] = ByteLevel(path) if path.endswith(".json") else Pieces(path)
    return _loaded[path]


class Side:
    """One tokenizer's tokens of some documents, one after the other."""

    def __init__(self, tokens: ByteLevel | Pieces, lists: list[np.ndarray]) -> None:
        self.n = np.array([len(x) for x in lists], np.int64)
        self.ids = np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32)
        self.doc = np.repeat(np.arange(len(lists)), self.n)
        self.end = np.cumsum(tokens.lengths[self.ids])
        self.start = np.concatenate([np.zeros(1, np.int64), self.end])[: len(self.end)]
        self.first = np.cumsum(self.n) - self.n

    def frame(self, name: str) -> pd.DataFrame:
        return pd.DataFrame({"at": self.start, name: np.arange(len(self.ids)), f"{name}_at": self.start})


def aligned(texts: list[str | None], a: ByteLevel | Pieces, b: ByteLevel | Pieces) -> tuple[Side, Side, np.ndarray, np.ndarray]:
    """Both sides' tokens, all pairs of tokens with a byte in common, and which of these end together.

    Every token finds the other side's token that covers its first byte; two
    tokens overlap when one begins within the other, so both directions together
    give all pairs. Texts whose tokens do not spell a blank and the text have none.
    """
    none, lists_a, lists_b = np.zeros(0, np.int32), [], []
    for text in texts:
        ids_a, ids_b = (a.encode(text), b.encode(text)) if text else (None, None)
        known = ids_a is not None and ids_b is not None
        lists_a.append(ids_a if known else none)
        lists_b.append(ids_b if known else none)
    side_a, side_b = Side(a, lists_a), Side(b, lists_b)
    frame_a, frame_b = side_a.frame("a"), side_b.frame("b")
    # offsets run on over the documents, and both sides begin a document at the same one
    over_b = pd.merge_asof(frame_a, frame_b, on="at")
    over_a = pd.merge_asof(frame_b, frame_a, on="at")
    # both directions find the pairs that begin together
    over_a = over_a[over_a["a_at"] < over_a["b_at"]]
    pairs = np.concatenate([over_b[["a", "b"]].to_numpy(np.int64), over_a[["a", "b"]].to_numpy(np.int64)])
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return side_a, side_b, pairs, side_a.end[pairs[:, 0]] == side_b.end[pairs[:, 1]]


def lists_of(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def structs(names: tuple[str, str], left: np.ndarray, right: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=list(names))


def spans(lengths: Iterator[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, first and number, that together have about ``most`` characters."""
    first = size = n = 0
    for n, length in enumerate(lengths, 1):
        size += length
        if size >= most:
            yield first, n - first
            first, size = n, 0
    if n > first:
        yield first, n - first


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a_ids, b_ids, overlaps, groups) per document: its tokens on both sides and how they meet.

    Both sides encode a blank and the text, without special tokens. ``overlaps``
    lists the pairs (a, b) of token numbers, from 0, that have a byte in common;
    ``groups`` the numbers (n_a, n_b) of tokens between two byte offsets at which
    tokens of both sides end. Null and empty texts, and texts that a side's
    tokens do not spell byte by byte, have no tokens: all lists are empty. Ids
    are carried as they are, null or repeated, one row out for each in; other
    columns are not. Texts of any length are taken whole: a batch is one text or
    about BATCH_CHARS characters. Empty tables give no rows.
    """
    schema = T.StructType([docs.schema[id_col], *ALIGNED])
    return docs.select(id_col, text_col).mapInArrow(lambda batches: _align(batches, a_path, b_path), schema)


def _pairs_of(a: str, b: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(a, T.IntegerType()), T.StructField(b, T.IntegerType())]))


ALIGNED = [
    T.StructField("a_ids", T.ArrayType(T.IntegerType())),
    T.StructField("b_ids", T.ArrayType(T.IntegerType())),
    T.StructField("overlaps", _pairs_of("a", "b")),
    T.StructField("groups", _pairs_of("n_a", "n_b")),
]


def _align(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    a, b = tokens_of(a_path), tokens_of(b_path)
    for batch in batches:
        lengths = pc.utf8_length(batch.column(1).fill_null("")).to_pylist()
        for first, n in spans(lengths, BATCH_CHARS):
            part = batch.slice(first, n)
            left, right, pairs, together = aligned(part.column(1).to_pylist(), a, b)
            doc = left.doc[pairs[:, 0]]
            ends = pairs[together]
            new = np.diff(left.doc[ends[:, 0]], prepend=-1) != 0
            size_a, size_b = (np.where(new, x - s.first[s.doc[x]] + 1, np.diff(x, prepend=0)) for x, s in ((ends[:, 0], left), (ends[:, 1], right)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    lists_of(left.n, pa.array(left.ids)),
                    lists_of(right.n, pa.array(right.ids)),
                    lists_of(np.bincount(doc, minlength=n), structs(("a", "b"), pairs[:, 0] - left.first[doc], pairs[:, 1] - right.first[doc])),
                    lists_of(np.bincount(left.doc[ends[:, 0]], minlength=n), structs(("n_a", "n_b"), size_a, size_b)),
                ],
                names=["id", *[f.name for f in ALIGNED]],
            )


class Written(dict):
    """A token as it stands in the text of groups: its id, and the mark that follows it."""

    def __missing__(self, code: int) -> str:
        self[code] = out = str(code >> 2) + ",|,;"[code & 3]
        return out


_written = Written()


def summaries(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_overlaps, n_groups, groups_sha256, links) per document, from what ``align`` gives of it.

    Groups are written `a1,a2|b1;a3|b2` with ids in order, and hashed; without
    tokens the column is empty. ``links`` holds (pair, n) for each pair of ids
    whose tokens end together in n places, a pair being a * 2^32 + b. Both steps
    run in one task, so that the lists of tokens never leave it.
    """
    schema = T.StructType([docs.schema[id_col], *SUMMARY])
    return docs.select(id_col, text_col).mapInArrow(lambda batches: map(_summary, _align(batches, a_path, b_path)), schema)


SUMMARY = [
    *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_overlaps", "n_groups")],
    T.StructField("groups_sha256", T.StringType()),
    T.StructField("links", T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())]))),
]


def _summary(batch: pa.RecordBatch) -> pa.RecordBatch:
    n_a, n_b, n_o, n_g = (np.diff(batch.column(i).offsets.to_numpy()).astype(np.int64) for i in (1, 2, 3, 4))
    a, b = batch.column(1).flatten().to_numpy().astype(np.int64), batch.column(2).flatten().to_numpy().astype(np.int64)
    of_a, of_b = (x.to_numpy().astype(np.int64) for x in batch.column(4).flatten().flatten())
    to_a, to_b = np.cumsum(of_a), np.cumsum(of_b)
    # tokens in the order of writing: a group's a tokens follow all earlier b tokens, its b tokens all its a tokens
    codes = np.zeros(len(a) + len(b), np.int64)
    place_a, place_b = np.arange(len(a)) + np.repeat(to_b - of_b, of_a), np.arange(len(b)) + np.repeat(to_a, of_b)
    codes[place_a], codes[place_b] = a * 4, b * 4 + 2
    codes[place_a[to_a - 1]] += 1
    codes[place_b[to_b - 1]] += 1
    stop, marks = np.cumsum(n_a + n_b), []
    for end, size in zip(stop.tolist(), (n_a + n_b).tolist(), strict=True):
        text = "".join(map(_written.__getitem__, codes[end - size : end].tolist()))
        marks.append(hashlib.sha256(text[:-1].encode()).hexdigest() if size else "")
    pair, doc = (a[to_a - 1] << 32) | b[to_b - 1], np.repeat(np.arange(batch.num_rows), n_g)
    order = np.lexsort((pair, doc))
    pair, doc = pair[order], doc[order]
    at = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    times = np.diff(np.concatenate([at, [len(pair)]]))
    links = pa.StructArray.from_arrays([pa.array(pair[at]), pa.array(times)], names=["pair", "n"])
    return pa.RecordBatch.from_arrays(
        [batch.column(0), *map(pa.array, (n_a, n_b, n_o, n_g)), pa.array(marks, pa.string()), lists_of(np.bincount(doc[at], minlength=batch.num_rows), links)],
        names=["id", *[f.name for f in SUMMARY]],
    )


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, total, best) from rows (pair, n): how many links hold a pair, and whether no pair of its b has more.

    A b meets at most as many ids as the other side's vocabulary has.
    """
    totals = links.groupBy("pair").agg(F.sum("n").alias("total"))
    of_b = W.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return totals.withColumn("best", F.col("total") == F.max("total").over(of_b))


def link_counts(documents: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Adds n_links, n_best and count_sum to the stored rows of ``summaries``, which must have a unique ``_row``.

    Pairs that have at least one part in ``frequent`` of all links are few
    whatever the corpus is, and are broadcast; the others go through a shuffle,
    where none of them is frequent enough to make a task long.
    """
    links = documents.select("_row", F.inline("links"))
    counts = stored(pair_counts(links))
    everything = counts.agg(F.sum("total")).first()[0] or 0
    usual = F.col("total") * F.lit(frequent) >= F.lit(everything)
    common = F.broadcast(counts.where(usual))

    def summed(rows: DataFrame) -> DataFrame:
        best = F.sum(F.when(F.col("best"), F.col("n")).otherwise(0))
        return rows.groupBy("_row").agg(F.sum("n").alias("n_links"), best.alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))

    rare = links.join(common.select("pair"), "pair", "left_anti").join(counts.where(~usual).hint("shuffle_hash"), "pair")
    sums = summed(links.join(common, "pair")).unionByName(summed(rare))
    sums = sums.groupBy("_row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    out = documents.drop("links").join(sums, "_row", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_links", "n_best", "count_sum")})

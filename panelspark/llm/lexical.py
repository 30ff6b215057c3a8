"""Ranked search of documents for the words of given items, by one Aho-Corasick scan of the texts.

No index of the documents is kept. The distinct terms of all items are one
automaton, each term guarded by a blank on either side, which goes to the
tasks. A scan of a text gives how often each term occurs; what a hit is worth
to which item is looked up behind the automaton's output.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.best import LOWEST, NO_ID, Best
from panelspark.llm.decontam import _arrow
from panelspark.llm.scratch import stored

#: Characters of item texts that one scan carries to the tasks.
CHARS_A_PASS = 1_000_000
#: Numbers of the (document, term of an item) table that a task holds at a time.
CELLS = 2_000_000

#: Every ASCII byte but letters and digits becomes a blank, capitals become small.
PLAIN = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def plain(text: str | None) -> bytes:
    """The text's terms as UTF-8 with blanks between them."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN)


def term_count(raw: bytes) -> int:
    inside = np.frombuffer(b" " + raw, np.uint8) != 0x20
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


class Items:
    """Items with terms: which terms each has, and the automaton over all of them."""

    def __init__(self, items: list[tuple]) -> None:
        found: dict = {}
        for item_id, text in items:
            found.setdefault(item_id, set()).update(plain(text).split())
        self.ids = [i for i, terms in found.items() if terms]
        self.terms = sorted(set().union(*found.values())) if found else []
        number = {t: n for n, t in enumerate(self.terms)}
        lists = [sorted(number[t] for t in found[i]) for i in self.ids]
        self.first = np.cumsum([0, *map(len, lists)])[:-1].astype(np.int64)
        self.of_item = np.array([n for own in lists for n in own], np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, term in enumerate(self.terms):
            self.automaton.add_word(" " + term.decode("latin-1") + " ", n)
        self.automaton.make_automaton()

    def counts(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The terms that occur in a text, and how often."""
        hits = self.automaton.iter(" " + raw.decode("latin-1") + " ") if self.terms else ()
        return np.unique(np.fromiter(map(itemgetter(1), hits), np.int32), return_counts=True)


COUNTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())),
        T.StructField("tf", T.ArrayType(T.LongType())),
    ]
)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    chars_a_pass: int = CHARS_A_PASS,
) -> DataFrame:
    """(item_id, rank, id, score): for every item the ``k`` documents that score highest, all where there are fewer.

    Terms are runs of ASCII letters and digits and of any other characters,
    ASCII capitals made small. Of N documents with a term, holding L terms, a
    document with n of them is as long as m = 10 + 90 n N div L says; a term of
    the item that df of them hold is worth w = floor(1000 ln((2N+2)/(2df+1))),
    and adds w * (10^9 tf div (1000 tf + 8 m)) where it occurs tf times. Only
    scores above 0 count; equal ones go by smaller id, a null id last.

    Ids must be integers. Null and empty texts have no terms and are found by
    nothing; items without a term get no row. Rows of one item id are one item
    with all their terms; repeated documents each count and are each ranked.
    Texts of any length are scanned whole. Other columns are not carried. Empty
    tables give no rows.

    Items go to the documents in passes of a bounded number of characters, so
    what is sent has a bound; one pass reads the texts once. Each task keeps k
    rows per item, and those meet in the final ranking.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    kind = items.schema[item_col].dataType
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    passes = 1 + (asked.agg(F.sum(F.length("text"))).first()[0] or 0) // chars_a_pass
    size, out = None, None
    for part in range(passes):
        # rows of one item stay together
        held = Items([tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == part).collect()])
        counted = stored(_counted(texts, held))
        if size is None:
            size = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not held.ids or not size[0]:
            continue
        found = _ranked(counted, held, size[0], size[1], k, kind)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), *_RANKED]))
    return out


def _counted(texts: DataFrame, held: Items) -> DataFrame:
    """(id, n, terms, tf) of every document with a term."""
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows, sizes, terms, tf = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                raw = plain(text.as_py())
                n = term_count(raw)
                if n:
                    which, times = own.counts(raw)
                    rows.append(row)
                    sizes.append(n)
                    terms.append(which)
                    tf.append(times)
            offsets = pa.array(np.cumsum([0, *map(len, terms)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*terms, np.zeros(0, np.int32)]).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*tf, np.zeros(0, np.int64)]).astype(np.int64))),
                ],
                names=[f.name for f in COUNTS],
            )

    return texts.mapInArrow(scan, COUNTS)


_RANKED = [T.StructField("rank", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())]


def _ranked(counted: DataFrame, held: Items, docs: int, terms: int, k: int, kind: T.DataType) -> DataFrame:
    found = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    df = np.zeros(len(held.terms), np.int64)
    for term, n in found:
        df[term] = n
    worth = np.array([floor(1000 * log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    lists = (held.first, held.of_item, pa.array(held.ids, _arrow(kind)))
    schema = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("item_id", kind), *_RANKED[1:]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, of_item, names = lists
        n_items, n_terms = len(first), len(worth)
        best = Best(np.zeros(n_items, np.int64), np.full(n_items, LOWEST), k)
        step = max(1, CELLS // (n_terms + len(of_item)))
        everyone = np.arange(n_items)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                m = np.array([10 + 90 * n * docs // terms for n in part.column(1).to_pylist()], np.int64)
                row = np.repeat(np.arange(len(ids)), np.diff(part.column(2).offsets.to_numpy()))
                term, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                table = np.zeros((len(ids), n_terms), np.int64)
                table[row, term] = worth[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                best.offer(everyone, np.add.reduceat(table[:, of_item], first, axis=1).T, ids)
        item, points, ids, _ = best.rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), names.take(pa.array(item)), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(points, pa.int64())], names=[f.name for f in schema]
        )

    order = W.partitionBy("place").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return counted.mapInArrow(score, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "id", "score")

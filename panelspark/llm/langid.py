"""Language of a text from word frequencies, backing off to ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.scratch import stored

WORD = re.compile(r"[^\W\d_]+")
#: Longest n-grams, ends of words marked.
LONGEST = 5
#: What stands for a frequency that is not known, as a share of the least one learned.
FLOOR = 0.1
CACHE = 400_000
#: Documents are looked up in blocks of about so many characters, each word once a block.
BLOCK = 16_000_000
UNDETERMINED = "und"
#: Words with at least this share of all counted words are known to every task; there are at most 1/share of them.
COMMON = 1e-6


def words_of(token: str) -> list[str]:
    """Runs of letters, lower-case; numeric characters such as a raised two stand in words but make none."""
    return [w for w in WORD.findall(token.lower()) if w.isalpha() or any(map(str.isalpha, w))]


@dataclass(frozen=True)
class Model:
    """All counts, as tables: (lang, word, n) and (lang, size, gram, n). Totals by language, and by language and size, are few."""

    languages: tuple[str, ...]
    words: DataFrame
    grams: DataFrame
    word_totals: dict[str, int]
    gram_totals: dict[tuple[str, int], int]
    word_floor: float
    gram_floors: dict[int, float]


def _grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Counts the words of all documents whose language is known, and the n-grams of those words.

    Every word and n-gram is kept, in tables under ``spark.checkpoint.dir``;
    only totals come to the driver. Rows without a language or text teach
    nothing; without any the model is empty.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            seen: Counter = Counter()
            for lang, own in tokens.items():
                for token, n in own.items():
                    for w in words_of(token):
                        seen[lang, w] += n
            tokens.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"]
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, tokens.values())) > CACHE:
                yield out()
        yield out()

    words = stored(rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, dict[str, int]] = {}
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = seen.setdefault(lang, {})
                marked = f"<{word}>"
                for size in range(1, LONGEST + 1):
                    for i in range(len(marked) - size + 1):
                        g = marked[i : i + size]
                        own[g] = own.get(g, 0) + n
            langs = [lang for lang, own in seen.items() for _ in own]
            keys = [g for own in seen.values() for g in own]
            counts = [n for own in seen.values() for n in own.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array([len(g) for g in keys], pa.int32()), pa.array(keys, pa.string()), pa.array(counts, pa.int64())],
                names=["lang", "size", "gram", "n"],
            )

    grams = words.mapInArrow(parts, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    grams = stored(grams)
    of_words = words.groupBy("lang").agg(F.sum("n").alias("total"), F.min("n").alias("least")).collect()
    of_grams = grams.groupBy("lang", "size").agg(F.sum("n").alias("total"), F.min("n").alias("least")).collect()

    def floor(found: list) -> float:
        return math.log(FLOOR * min((r.least / r.total for r in found), default=1.0))

    return Model(
        tuple(sorted(r.lang for r in of_words)),
        words,
        grams,
        {r.lang: r.total for r in of_words},
        {(r.lang, r["size"]): r.total for r in of_grams},
        floor(of_words),
        {n: floor([r for r in of_grams if r["size"] == n]) for n in range(1, LONGEST + 1)},
    )


def _by_language(counts: DataFrame, key: str, model: Model, total: Column, floor: Column) -> DataFrame:
    """(key, scores): log frequencies in the order of the languages, the floor where a language does not have the key."""
    log = counts.select(key, "lang", F.log(F.col("n") / total).alias("log"), floor.alias("floor"))
    own = [F.coalesce(F.max(F.when(F.col("lang") == x, F.col("log"))), F.max("floor")) for x in model.languages]
    return log.groupBy(key).agg(F.array(*own).cast("array<float>").alias("scores"))


def word_table(model: Model) -> DataFrame:
    total = F.create_map(*[F.lit(x) for item in model.word_totals.items() for x in item])
    return _by_language(model.words, "word", model, total[F.col("lang")], F.lit(model.word_floor))


def gram_table(model: Model) -> DataFrame:
    total = F.create_map(*[F.lit(x) for (lang, n), v in model.gram_totals.items() for x in (f"{n} {lang}", v)])
    floor = F.create_map(*[F.lit(x) for item in model.gram_floors.items() for x in item])
    return _by_language(model.grams, "gram", model, total[F.concat_ws(" ", "size", "lang")], floor[F.col("size")])


def score_matrix(scores: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.concatenate([np.empty(0), *(c.flatten().to_numpy() for c in scores.chunks)]).reshape(-1, width)


class GramScores(dict):
    """Sum of log frequencies and number of the n-grams that stand for a string: itself if it was learned, else its parts."""

    def __init__(self, learned: dict[str, np.ndarray], width: int) -> None:
        super().__init__()
        self.learned, self.none = learned, np.zeros(width + 1)

    def __missing__(self, part: str) -> np.ndarray:
        if (known := self.learned.get(part)) is not None:
            found = np.append(known, 1.0)
        elif len(part) < 2:
            found = self.none
        else:
            found = self[part[:-1]] + self[part[1:]]
        self[part] = found
        return found

    def word(self, word: str) -> np.ndarray:
        """Of an unseen word: the mean over its n-grams, each replaced by shorter ones where unseen."""
        total = sum(map(self.__getitem__, _grams(word, min(LONGEST, len(word) + 2))), self.none)
        return total[:-1] / total[-1] if total[-1] else total[:-1]


def unseen_scores(unseen: DataFrame, model: Model) -> DataFrame:
    """(word, scores) of words that were not learned: a block of words asks for each of its n-grams once."""
    width = len(model.languages)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            words = batch.column(0).to_pylist()
            grams = list({g for w in words for n in range(1, LONGEST + 1) for g in _grams(w, n)})
            n = len(words) + len(grams)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.array(words + [None] * len(grams), pa.string()), pa.array([None] * len(words) + grams, pa.string())], names=["block", "word", "gram"]
            )
            block += 1

    asked = stored(unseen.mapInArrow(ask, "block long, word string, gram string"))
    known = asked.where("gram IS NOT NULL").select("block", "gram").join(gram_table(model), "gram").select(F.col("block").alias("asker"), "gram", "scores")

    def answer(words: pa.Table, grams: pa.Table) -> pa.Table:
        scores = GramScores(dict(zip(grams["gram"].to_pylist(), score_matrix(grams["scores"], width), strict=True)), width)
        found = [scores.word(w) for w in words["word"].to_pylist()]
        return pa.table({"word": words["word"], "scores": pa.array(found, pa.list_(pa.float32()))})

    own = asked.where("word IS NOT NULL").select("block", "word")
    return own.groupBy("block").cogroup(known.groupBy("asker")).applyInArrow(answer, "word string, scores array<float>")


class Numbers(dict):
    """Keys numbered in the order they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def counted(texts: list[str | None]) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """Sorted words of some texts; for each text the places of its words in that list, and how often it has them."""
    tokens, words = Numbers(), Numbers()
    of_texts = [np.fromiter(map(tokens.__getitem__, (t or "").split()), np.int64) for t in texts]
    of_tokens = [[words[w] for w in words_of(t)] for t in tokens]
    n_words = np.array([len(x) for x in of_tokens], np.int64)
    first = np.cumsum(n_words) - n_words
    order = sorted(words)
    rank = np.empty(len(order), np.int64)
    rank[[words[w] for w in order]] = np.arange(len(order))
    flat = rank[np.array([w for x in of_tokens for w in x], np.int64)]
    places, times = [], []
    for own in of_texts:
        n = n_words[own]
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        p, k = np.unique(flat[at], return_counts=True)
        places.append(p)
        times.append(k)
    return order, places, times


def lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *values]), pa.int32()))


class Common:
    """Scores of the words that every task knows: at most 1/COMMON of them, brought over as one Arrow table."""

    def __init__(self, table: pa.Table, width: int) -> None:
        self.words = pa.array(table["word"].to_pylist(), pa.string())
        self.scores = score_matrix(table["scores"], width).astype(np.float32)

    def places(self, words: list[str]) -> np.ndarray:
        """Where each word stands in ``scores``, -1 if it is not common."""
        found = pc.index_in(pa.array(words, pa.string()), value_set=self.words)
        return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def common_words(model: Model) -> Common:
    least = COMMON * sum(model.word_totals.values())
    often = model.words.groupBy("word").agg(F.sum("n").alias("_total")).where(F.col("_total") >= least).select("word")
    return Common(word_table(model).join(often, "word", "left_semi").orderBy("word").toArrow(), len(model.languages))


def in_blocks(docs: DataFrame, common: Common) -> DataFrame:
    """(block, id, sums, gaps, times, place, word): rows of documents, and rows of each block's words that are not common.

    A document has the summed scores of its common words (null without any)
    and the counts of its other words.
    """
    ints, doubles = T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType())
    kinds = {"block": T.LongType(), "id": docs.schema["id"].dataType, "sums": doubles, "gaps": ints, "times": ints, "place": T.IntegerType(), "word": T.StringType()}
    schema = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
    names = schema.names
    known = docs.sparkSession.sparkContext.broadcast(common)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ints, doubles = pa.list_(pa.int32()), pa.list_(pa.float64())
        for batch in batches:
            texts, ids, start = batch.column(1).to_pylist(), batch.column(0), 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and size < BLOCK:
                    size += len(texts[stop] or "")
                    stop += 1
                order, places, times = counted(texts[start:stop])
                at = known.value.places(order)
                rest = np.cumsum(at < 0) - 1
                sums = []
                for i, (p, k) in enumerate(zip(places, times, strict=True)):
                    mine = at[p] >= 0
                    # places are in the order of the words: equal texts are summed alike in every block
                    sums.append((known.value.scores[at[p[mine]]].astype(np.float64) * k[mine, None]).sum(0).tolist() if mine.any() else None)
                    places[i], times[i] = rest[p[~mine]], k[~mine]
                order = [order[i] for i in np.flatnonzero(at < 0)]
                n, v = stop - start, len(order)
                gaps = lists([np.diff(p, prepend=0) for p in places])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), ids.slice(start, n), pa.array(sums, doubles), gaps, lists(times), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=names
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(v, block)), pa.nulls(v, ids.type), pa.nulls(v, doubles), pa.nulls(v, ints), pa.nulls(v, ints), pa.array(np.arange(v), pa.int32()), pa.array(order, pa.string())],
                    names=names,
                )
                block, start = block + 1, stop

    return docs.mapInArrow(cut, schema)


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the likeliest language of each whole text and its probability.

    Texts are counted in blocks. The most frequent words (see COMMON, a bounded
    number) are known to every task and summed at once; a block asks the table
    of all learned words for each of its other words once, so a word has no more
    rows in the join than there are blocks. Words never seen in training get
    their n-grams' scores, once for all documents. A text that is null or has no
    letter is ``und`` with score 0, and so is every text if nothing was learned.
    Very long texts are counted whole, in a block of their own. Ties go to the
    first language by name. An empty table gives an empty one. Other columns are
    not carried.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    languages, width = model.languages, len(model.languages)
    if not width:
        return docs.select(id_col, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    blocks = stored(in_blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), common_words(model)))
    own = blocks.where("word IS NOT NULL").select("block", "place", "word")
    met = own.join(word_table(model), "word", "left")
    met = stored(met.select("block", "place", "scores", F.when(F.col("scores").isNull(), F.col("word")).alias("word")))
    missed = met.where("scores IS NULL").select("block", "place", "word")
    unseen = unseen_scores(missed.select("word").distinct(), model)
    looked_up = met.where("scores IS NOT NULL").select("block", "place", "scores").unionByName(missed.join(unseen, "word").select("block", "place", "scores"))
    looked_up = looked_up.withColumnRenamed("block", "asker")

    def predict(texts: pa.Table, words: pa.Table) -> pa.Table:
        table = np.zeros((len(words), width))
        table[words["place"].to_numpy()] = score_matrix(words["scores"], width)
        langs, likely = [], []
        for chunk in texts.select(["gaps", "times", "sums"]).combine_chunks().to_batches():
            gaps, times = (c.flatten().to_numpy() for c in chunk.columns[:2])
            ends = chunk.column(0).offsets.to_numpy() - chunk.column(0).offsets[0].as_py()
            for a, b, of_common in zip(ends[:-1], ends[1:], chunk.column(2).to_pylist(), strict=True):
                if a == b and of_common is None:
                    langs.append(UNDETERMINED)
                    likely.append(0.0)
                    continue
                total = (table[np.cumsum(gaps[a:b])] * times[a:b, None]).sum(0) + (0.0 if of_common is None else np.array(of_common))
                p = np.exp(total - total.max())
                best = int(np.argmax(p))
                langs.append(languages[best])
                likely.append(float(p[best] / p.sum()))
        return pa.Table.from_arrays([texts["id"], pa.array(langs, pa.string()), pa.array(likely, pa.float64())], names=schema.names)

    texts = blocks.where("word IS NULL").select("block", "id", "sums", "gaps", "times")
    return texts.groupBy("block").cogroup(looked_up.groupBy("asker")).applyInArrow(predict, schema)

"""A toxicity classifier that is penalised where swapping identity terms changes its score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.scratch import stored

#: Feature space: whole words and the parts of GRAM characters of words, hashed.
SPACE = 1 << 18
GRAM = 4
#: Bound of the labelled sample from which labels are learned, and of the features kept.
SAMPLE = 20_000
FEATURES = 4_000
#: Tokens a worker remembers.
CACHE = 400_000
WORD = re.compile(r"\w+")

# Terms for groups of people; those of one line may be swapped for one another.
GROUPS = [
    "women men girls boys",
    "woman man girl boy",
    "christian muslim jewish hindu buddhist catholic atheist",
    "christians muslims jews hindus buddhists catholics atheists",
    "black white asian latino african european arab",
    "gay straight lesbian bisexual transgender queer heterosexual",
    "american mexican chinese indian russian german french spanish turkish polish",
    "old young elderly disabled blind deaf",
    "frauen männer mädchen jungen",
    "christen muslime juden",
    "femmes hommes filles garçons",
    "chrétiens musulmans juifs",
    "mujeres hombres chicas chicos",
    "cristianos musulmanes judíos",
]
OTHERS = {w: [x for x in g.split() if x != w] for g in GROUPS for w in g.split()}


def features(word: str) -> list[int]:
    """Numbers of a word's features: itself and its parts, the ends marked."""
    marked = f"<{word}>"
    parts = {marked, *(marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1))}
    return sorted({xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) % SPACE for p in parts})


class TokenFeatures(dict):
    """Features, as 32-bit bytes, of the words in a token without white space."""

    def __missing__(self, token: str) -> bytes:
        found = np.array([f for w in WORD.findall(token.lower()) for f in features(w)], np.int32).tobytes()
        if len(token) <= 64:
            if len(self) >= CACHE // 4:
                self.clear()
            self[token] = found
        return found


_tokens = TokenFeatures()


def text_features(text: str | None) -> np.ndarray:
    """Features of a text's different tokens, a feature as often as tokens have it."""
    return np.frombuffer(b"".join(map(_tokens.__getitem__, sorted(set((text or "").split())))), np.int32)


def swapped(text: str) -> str | None:
    """The text with each identity term replaced by another of its group, by a hash of the text; None if it has none."""
    changed, turn = False, None

    def other(m: re.Match) -> str:
        nonlocal changed, turn
        choices = OTHERS.get(m[0].lower())
        if not choices:
            return m[0]
        if turn is None:
            turn = xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))
        changed = True
        return choices[turn % len(choices)]

    out = WORD.sub(other, text)
    return out if changed else None


@dataclass(frozen=True)
class Model:
    """Weights of the kept features and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(SPACE)
        out[self.index] = self.weight
        return out


def labelled_sample(labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", rows: int = SAMPLE) -> DataFrame:
    """At most ``rows`` labelled ids, those with the smallest hashes: (id, label)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    ranked = known.select(id_col, F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64(id_col), id_col, "label")
    return ranked.limit(rows)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    penalty: float = 1.0,
    shrink: float = 2e-3,
    rounds: int = 400,
) -> Model:
    """Logistic regression on a bounded sample of labelled documents.

    The loss adds ``penalty`` times the squared change of the score when the
    identity terms of a document are swapped. Features are chosen by how well
    they tell the labels apart in the sample, and small weights are shrunk to
    zero. Labels of ids that ``docs`` lacks are ignored; without two labels the
    model gives every text the share of label 1.
    """
    chosen = labelled_sample(labels, label_col, id_col, sample)
    # the sample has at most ``sample`` rows of two numbers
    rows = stored(docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select("label", F.col(text_col).alias("text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, SPACE), np.int64)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[min(max(y, 0), 1), np.unique(text_features(text))] += 1
        at = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["feature", "n0", "n1"])

    sizes = {r.label: r.n for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        share = min(max(n1 / max(n0 + n1, 1), 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    counts = rows.mapInArrow(count, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    gap = F.col("n1") * n0 - F.col("n0") * n1
    both = F.col("n0") + F.col("n1")
    told = (gap * gap / (both * (n0 + n1 - both) + 1.0)).alias("told")
    kept = [r.feature for r in counts.where(both >= 3).select("feature", told).orderBy(F.desc("told"), "feature").limit(FEATURES).collect()]
    index = np.array(sorted(kept), np.int64)

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(SPACE, -1, np.int32)
        place[index] = np.arange(len(index))

        def own(text: str | None) -> np.ndarray:
            found = place[text_features(text)]
            cols, times = np.unique(found[found >= 0], return_counts=True)
            return pairs_of(cols, np.log1p(times))

        for batch in batches:
            out: dict[str, list] = {"label": [], "own": [], "change": []}
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                other = swapped(text or "")
                first = own(text)
                out["label"].append(int(y > 0))
                out["own"].append(first.tobytes())
                out["change"].append(b"" if other is None else difference(first, own(other)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["label"], pa.int32()), pa.array(out["own"], pa.binary()), pa.array(out["change"], pa.binary())], names=list(out))

    # at most ``sample`` rows of at most FEATURES pairs, packed; in one order whatever the tasks were
    data = rows.mapInArrow(matrix, "label int, own binary, change binary").orderBy("label", "own", "change").toArrow()
    weight, intercept = _descend(data, len(index), penalty, shrink, rounds)
    return Model(index, weight, intercept)


#: A feature's place among those kept, and its value.
PAIR = np.dtype([("col", "<i4"), ("value", "<f4")])


def pairs_of(cols: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(cols), PAIR)
    out["col"], out["value"] = cols, values
    return out


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What ``a`` has minus what ``b`` has, without the features that are alike."""
    cols, place = np.unique(np.concatenate([a["col"], b["col"]]), return_inverse=True)
    values = np.bincount(place, np.concatenate([a["value"], -b["value"]]), len(cols))
    return pairs_of(cols[values != 0], values[values != 0])


def _sparse(packed: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of every pair."""
    sizes = [len(x.as_buffer()) // PAIR.itemsize for x in packed]
    flat = np.frombuffer(b"".join(x.as_py() for x in packed), PAIR)
    return np.repeat(np.arange(len(sizes)), sizes), flat["col"].astype(np.int64), flat["value"].astype(float)


def _descend(data: pa.Table, width: int, penalty: float, shrink: float, rounds: int) -> tuple[np.ndarray, float]:
    """Proximal gradient descent with momentum on mean loss + penalty * mean squared change + shrink * |weights|."""
    y = data["label"].to_numpy().astype(float)
    share = np.full(len(y), 1 / len(y))
    # both labels weigh alike, so the threshold of one half is no matter of how many there are
    weigh = share * np.where(y > 0, 0.5 / (share @ y), 0.5 / (share @ (1 - y)))
    r, c, v = _sparse(data["own"])
    # only documents with identity terms have anything to compare: what they have minus what the swapped ones have
    rd, cd, vd = _sparse(data["change"])
    norm = np.bincount(r, v * v, len(y))
    w, b, look, look_b, t = np.zeros(width), 0.0, np.zeros(width), 0.0, 1.0
    step = min(0.5, 1.0 / (0.25 * max(1.0, float((weigh * norm).sum() / weigh.sum())) + 2 * penalty + 1e-9))
    for _ in range(rounds):
        z = np.bincount(r, v * look[c], len(y)) + look_b
        e = weigh * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(c, v * e[r], width)
        if len(rd):
            change = np.bincount(rd, vd * look[cd], len(y))
            g += np.bincount(cd, vd * (2 * penalty * share * change)[rd], width)
        new = look - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * shrink, 0)
        new_b = look_b - step * e.sum()
        if np.abs(new - w).max(initial=0.0) < 1e-4 * np.abs(new).max(initial=1e-9):
            return new, float(new_b)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, float(b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1, the whole text being read; null and empty texts get the intercept's."""
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != out], T.StructField(out, T.DoubleType())])
    names = [f.name for f in schema]
    keep = [c for c in docs.columns if c != out]
    at = keep.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(SPACE, -1, np.int32)
        place[model.index] = np.arange(len(model.index))
        known: dict[str, bytes] = {}

        def token(t: str) -> bytes:
            if (found := known.get(t)) is None:
                cols = place[np.array([f for w in WORD.findall(t.lower()) for f in features(w)], np.int64)]
                found = cols[cols >= 0].tobytes()
                if len(t) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[t] = found
            return found

        for batch in batches:
            result = []
            for text in batch.column(at):
                tokens = set((text.as_py() or "").split())
                cols = np.frombuffer(b"".join(map(token, tokens)), np.int32)
                z = model.intercept
                if len(cols):
                    found, times = np.unique(cols, return_counts=True)
                    z += float(np.log1p(times) @ model.weight[found])
                result.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(result, pa.float64())], names=names)

    return docs.select(*keep).mapInArrow(scored, schema)

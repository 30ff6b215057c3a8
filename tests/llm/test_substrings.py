"""Removal of repeated byte strings against a count of every string, and the parts of the merge sort."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from panelspark.llm import queries, substrings

from .conftest import ODD

L = substrings.LENGTH


def plain(texts):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for i, b in enumerate(data):
        for s in range(len(b) - L + 1):
            seen.setdefault(b[s : s + L], []).append((i, s))
    gone = [np.zeros(len(b), bool) for b in data]
    for at in seen.values():
        if len(at) > 1:
            for i, s in at:
                gone[i][s : s + L] = True
    out = []
    for b, g in zip(data, gone, strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~g])
        runs = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if len(g) else 0
        out.append((len(b), int(g.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeou") for _ in range(rng.randint(2, 9))) for _ in range(n))


def planted():
    """Passages shared in part, next to one another, with edits, at either end of a text, and against each other."""
    rng = random.Random(4)
    base = prose(rng, 300)
    out = [base, base[:900] + "X" + base[901:], base[300:1200], "Y" + base[777:], prose(rng, 20) + base[100:299] + prose(rng, 5), prose(rng, 20) + base[100:301]]
    for _ in range(60):  # one passage between different texts, cut at either side
        a, b = rng.randint(0, 60), rng.randint(0, 60)
        out.append(prose(rng, rng.randint(1, 40)) + " " + base[1000 + a : 1330 - b] + " " + prose(rng, rng.randint(0, 40)))
    for _ in range(40):  # edits at many places
        t = list(base)
        for _ in range(rng.randint(1, 12)):
            t[rng.randrange(len(t))] = rng.choice("QZ")
        out.append("".join(t))
    out += ["a" * 199, "a" * 200, "b" * 201, "c" * 1000, "ab" * 500, "xyz" * 70, "é" * 150, ("line of text " * 20 + "\n") * 3]
    out += [base, "tail " + "c" * 230, prose(rng, 3) + "ab" * 150]
    return out


@pytest.mark.parametrize("kind", ["planted", "given"])
def test_repeats(spark, make, folder, kind):
    texts = planted() + ODD if kind == "planted" else pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + ODD
    rows = queries.op10_merge_sorted_suffixes(spark, folder(documents=make(texts))).collect()
    assert len(rows) == len(texts)
    want = plain(texts)
    assert sum(w[1] for w in want) > 0
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], (r.doc_id, want[r.doc_id])


def test_empty_table(spark, make):
    assert substrings.without_repeats(make([])).count() == 0
    assert [r.removed for r in substrings.without_repeats(make([None, "short"])).collect()] == [[], []]


def test_merge_of_runs():
    rng = random.Random(9)
    strings = sorted(bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(500))
    for k in (1, 2, 3, 7, 16):
        runs = [[] for _ in range(k)]
        for s in strings:
            runs[rng.randrange(k)].append(s)
        coded = [substrings.decoded(*substrings.front_coded(r), 12) for r in runs if r]
        out = list(substrings.merge(coded))
        assert [s for _, s, _ in out] == strings
        for (_, a, _), (_, b, n) in zip(out, out[1:], strict=False):
            assert n == substrings.first_difference(a, b, 0)


def test_equal_strings_have_equal_anchors():
    rng = random.Random(2)
    passage = prose(rng, 80)[:260].encode()

    def by_start(t):
        out = {}
        for h, place in zip(*(x.tolist() for x in substrings.anchors(t)), strict=True):
            for d in range(place & 255, (place >> 8 & 255) + 1):
                out[(place >> 16) - d] = (h, d)
        assert sorted(out) == list(range(len(t) - L + 1))
        return [out[s] for s in range(t.index(passage), t.index(passage) + len(passage) - L + 1)]

    for _ in range(20):
        a, b = prose(rng, rng.randint(0, 50)).encode() + passage + b"!!", passage + prose(rng, 30).encode()
        assert by_start(a) == by_start(b)


def plainly_settled(place, after, before):
    """One anchor alone, its ranges one after the other."""
    at, far, near = place >> 16, place >> 8 & 255, place & 255
    nxt, high = max(near, L - max((s >> 8 for s in after), default=0)), min(far, max((s & 255 for s in before), default=0))
    sure, open_ = [], []
    for a, b in sorted((max(near, L - (s >> 8)), min(far, s & 255)) for s in {*after, *before}):
        if a > b:
            continue
        if a > nxt:
            open_.append((nxt, a - 1))
        if b >= nxt:
            sure.append((max(a, nxt), b))
            nxt = b + 1
    if nxt <= high:
        open_.append((nxt, high))
    return [[{"first": at - b, "last": at - a} for a, b in x] for x in (sure, open_)]


def test_settled_against_one_by_one():
    """Ranges of many anchors at once are those of each alone."""
    rng = random.Random(7)
    places, sides = [], ([], [])
    for _ in range(800):
        near = rng.randint(0, 152)
        places.append(rng.randint(300, 900) << 16 | rng.randint(near, 152) << 8 | near)
        for side in sides:
            side.append([rng.randint(0, 200) << 8 | rng.randint(0, 152) for _ in range(rng.randint(0, 4))])
    got = substrings.settled(np.array(places), *(pa.array(s, pa.list_(pa.int32())) for s in sides))
    want = [plainly_settled(*x) for x in zip(places, *sides, strict=True)]
    assert [list(x) for x in zip(*(g.to_pylist() for g in got), strict=True)] == want
    assert all(any(len(x[k]) > 1 for x in want) for k in (0, 1))


def test_texts_are_read_once_per_use(spark, make, monkeypatch):
    """What a step finds in the texts is stored when it is read twice, so each step's tasks run once."""
    ran = spark.sparkContext.accumulator(0)
    kind = type(make([]))
    arrow = kind.mapInArrow

    def counted(self, f, schema, **k):
        def run(batches):
            ran.add(1)
            yield from f(batches)

        return arrow(self.coalesce(1), run if f.__name__ in ("sample", "strings") else f, schema, **k)

    monkeypatch.setattr(kind, "mapInArrow", counted)
    out = substrings.without_repeats(make(planted()))
    assert len(out.collect()) == len(planted())
    assert ran.value == 2, ran.value

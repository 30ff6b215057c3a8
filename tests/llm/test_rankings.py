"""Lexical search, token alignment and vector search against plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from panelspark.llm import alignment, lexical, queries, vectors
from panelspark.llm.scratch import stored

from .conftest import ODD
from .test_scans import given

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = {c: c + 32 for c in range(65, 91)}
WORDY = ["Ärger ÄRGER ärger", "café au-lait_x", "a b c", "Iİi K", "one two three", "One TWO, three. three", None]


def terms(text):
    return TERM.findall((text or "").translate(CAPITALS))


def plain_search(docs, items, k=10):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counted = [x for x in counted if x[2]]
    n_docs, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 100 - 90 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    return list(given().values()) + ODD + WORDY


def test_lexical_search(spark, make, texts):
    items = [(i, t) for i, t in enumerate([*texts[:30:3], *WORDY, "", "zwei Wörter", "unheardofword", None])]
    docs, asked = list(enumerate(texts)), spark.createDataFrame(items, "item_id long, text string")
    want = plain_search(docs, items)
    assert len(want) > 100 and any(r > 1 for _, r, _, _ in want)
    for chars in (lexical.CHARS_A_PASS, 2000):
        got = lexical.search(make(texts).repartition(5), asked, chars_a_pass=chars)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_lexical_ties_copies_and_missing_ids(spark, make):
    docs = spark.createDataFrame([(7, "red fox"), (None, "red fox"), (3, "red fox"), (3, "red fox"), (9, "blue"), (1, None), (2, "")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "fox"), (1, "Fox"), (1, "blue"), (2, None), (3, "...")], "item_id long, text string")
    got = {None: [], 1: []}
    for r in lexical.search(docs.withColumns({"rank": F.lit(1), "score": F.lit(2)}), items.withColumn("id", F.lit(0)), k=4).orderBy("rank").collect():
        got[r.item_id].append(r.id)
    assert got == {None: [3, 3, 7, None], 1: [9, 3, 3, 7]}
    assert lexical.search(docs.limit(0), items).count() == lexical.search(docs, items.limit(0)).count() == 0
    with pytest.raises(TypeError):
        lexical.search(docs.withColumn("doc_id", F.lit("x")), items)


def test_a_very_long_text(spark, make):
    long = "fox " + "word, " * 400_000 + "FOX"
    got = lexical.search(make([long, "a fox"]), spark.createDataFrame([(1, "fox")], "item_id long, text string")).collect()
    assert {r.id for r in got} == {0, 1}
    row = alignment.summaries(make([long]), queries.TOKENIZER, queries.OTHER_TOKENIZER).first()
    assert row.n_groups > 400_000 and sum(x.n for x in row.links) == row.n_groups


def plain_alignment(texts):
    """Token lists by the libraries' own calls, and overlaps and groups by byte offsets."""
    a = Tokenizer.from_file(queries.TOKENIZER)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=queries.OTHER_TOKENIZER)
    known = alignment.ByteLevel(queries.TOKENIZER).bytes_of
    out = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [known[i] for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            out.append(([], [], set(), [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        at = {byte: i for i, e in enumerate(ends_b) for byte in range(e - len(bytes_b[i]), e)}
        over = {(i, at[byte]) for i, e in enumerate(ends_a) for byte in range(e - len(bytes_a[i]), e)}
        both, groups, links = sorted(set(ends_a) & set(ends_b)), [], []
        i = j = 0
        for e in both:
            to_a, to_b = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append((ids_a[i:to_a], ids_b[j:to_b]))
            links.append((ids_a[to_a - 1], ids_b[to_b - 1]))
            i, j = to_a, to_b
        out.append((ids_a, ids_b, over, groups, links))
    return out


def test_alignment(spark, make, folder, texts):
    texts = [*texts, "double  blanks", " leading", "trailing ", "tab\tand\nline\r\n", "<|endoftext|> <s> </s> <0x41>", "▁ block", "\u0000 zero", "ﬁ ligature é", "日本語のテキスト", "🙂" * 40]
    plain = plain_alignment(texts)
    for r in alignment.align(make(texts), queries.TOKENIZER, queries.OTHER_TOKENIZER).collect():
        ids_a, ids_b, over, groups, _ = plain[r.doc_id]
        assert (r.a_ids, r.b_ids) == (ids_a, ids_b), texts[r.doc_id]
        assert {tuple(x) for x in r.overlaps} == over and len(r.overlaps) == len(over)
        assert [tuple(x) for x in r.groups] == [(len(x), len(y)) for x, y in groups]
    totals = Counter(x for p in plain for x in p[4])
    most = {}
    for (_, b), n in totals.items():
        most[b] = max(n, most.get(b, 0))
    rows = queries.op12_token_alignment(spark, folder(documents=make(texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids_a, ids_b, over, groups, links = plain[r.doc_id]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want = (len(ids_a), len(ids_b), len(groups), len(links), sum(totals[x] == most[x[1]] for x in links), sum(totals[x] for x in links), len(over))
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.n_overlaps) == want
        assert r.groups_sha256 == (hashlib.sha256(written.encode()).hexdigest() if written else "")


def test_links_beyond_the_frequent_ones(spark, make, texts):
    """Whatever part of the pairs is broadcast, sums are the same."""
    rows = stored(alignment.summaries(make(texts), queries.TOKENIZER, queries.OTHER_TOKENIZER).withColumn("_row", F.monotonically_increasing_id()))
    got = [sorted(tuple(r) for r in alignment.link_counts(rows, n).select("_row", "n_links", "n_best", "count_sum").collect()) for n in (1, 50, alignment.FREQUENT)]
    assert got[0] == got[1] == got[2]


def test_alignment_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "no id"), (5, "same"), (5, "same"), (6, None)], "doc_id long, text string").withColumns({"a_ids": F.lit(1), "links": F.lit(2)})
    out = alignment.align(docs, queries.TOKENIZER, queries.OTHER_TOKENIZER)
    assert sorted((str(r.doc_id), len(r.groups) > 0) for r in out.collect()) == [("5", True), ("5", True), ("6", False), ("None", True)]
    empty = stored(alignment.summaries(docs.limit(0), queries.TOKENIZER, queries.OTHER_TOKENIZER).withColumn("_row", F.monotonically_increasing_id()))
    assert alignment.link_counts(empty).count() == 0


def plain_nearest(rows, asked, k):
    out = []
    for at in asked:
        own, vec = rows[at]
        scores = [(-sum(int(math.floor(1024 * x)) * int(math.floor(1024 * y)) for x, y in zip(vec, v)), i) for n, (i, v) in enumerate(rows) if n != at and len(v) == len(vec)]
        out += [(own, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["even", "clustered", "equal"])
def test_nearest_vectors(spark, kind):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(900, 6)) * 0.3
    if kind == "clustered":
        points = np.repeat(rng.normal(size=(9, 6)), 100, axis=0) + points * 0.05
    if kind == "equal":
        points[100:800] = points[0]
    rows = [(i, points[i].tolist()) for i in rng.permutation(900).tolist()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"q": F.lit(1), "score": F.lit(1), "id": F.lit(1), "place": F.lit(0)})
    want = plain_nearest(rows, [n for n, (i, _) in enumerate(rows) if i % 60 == 0], 10)
    for shard, values in ((64, 20), (64, 1 << 20), (8192, 1 << 20)):
        got = vectors.nearest(df.repartition(3), df.where("vec_id % 60 = 0"), shard=shard, values_a_pass=values)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_a_tree_leaves_boxes_unopened():
    rng = np.random.default_rng(5)
    points = np.repeat(rng.normal(size=(40, 3)), 50, axis=0) * 1000 // 1
    tree, query = vectors.Tree(np.arange(2000), points, 16), points[:1]
    best, scored = vectors.Best(np.array([vectors.LOWEST]), np.array([vectors.NO_ID]), 5), []
    offer = best.offer
    best.offer = lambda rows, scores, ids, marks: (scored.append(len(ids)), offer(rows, scores, ids, marks))
    tree.search(query, np.array([0]), best)
    assert best.scores[0].tolist() == np.sort((points @ points[0]).astype(int))[::-1][:5].tolist()
    assert sum(scored) < 400


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, -inf]), (6, [1.0]), (None, [1.0, 5.0]), (60, None), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.rank, r.id if r.id is not None else -1, r.score) for r in vectors.nearest(df, df.where("vec_id % 60 = 0")).collect())
    one = 1024 * 1024
    # two equal rows of id 0 find each other; the third asks for itself and finds both
    first = [(1, 0, one), (2, 1, one), (3, -1, one), (4, 0, one // 2)]
    third = [(1, 0, one // 2), (2, 0, one // 2), (3, 1, one // 2), (4, -1, one // 2)]
    assert got == sorted([*first, *first, *third])
    assert vectors.nearest(df.limit(0), df.limit(0)).count() == vectors.nearest(df, df.limit(0)).count() == 0

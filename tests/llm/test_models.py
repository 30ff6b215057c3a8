"""Toxicity, language, decontamination, licenses and near duplicates against labels, brute force and planted cases."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from panelspark.llm import decontam, langid, licenses, neardup, queries, toxicity, words

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


def prose(rng, n, alphabet="abcdeou"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9))) for _ in range(n))


# toxicity


def test_toxicity_on_held_out_labels(spark):
    rows = {r.doc_id: r for r in queries.op2_counterfactual_toxicity(spark, SF).collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (crc(i) % 5 == 0) for i, r in rows.items())
    t = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    held = [(y, rows[i].score) for i, y in zip(t["doc_id"], t["toxic"], strict=True) if crc(i) % 5 == 0]
    pos, neg = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a, b in itertools.product(pos, neg)]) > 0.95
    assert np.mean([(s >= 0.5) == bool(y) for y, s in held]) > 0.9


def test_the_model_does_not_depend_on_partitions(spark, make):
    """A text's counterfactual is its own, wherever it stands."""
    assert toxicity.swapped("Women and men") == toxicity.swapped("Women and men") != "Women and men"
    docs = make([f"{'vile women' if i % 2 else 'kind men'} number {i % 7} {'hate' if i % 2 else 'peace'}" for i in range(60)])
    known = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    one, other = (toxicity.fit(docs.repartition(n, "doc_id"), known) for n in (1, 5))
    assert one.index.tolist() == other.index.tolist() and one.intercept == other.intercept and (one.weight == other.weight).all()


def test_swapped_terms_keep_their_score(spark, make):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(400):
        bad = i % 2 == 0
        who = rng.choice(["muslim", "women", "gay"] if bad or rng.random() < 0.2 else ["christian", "men", "straight"])
        texts.append(f"{prose(rng, 12)} {who} {rng.choice(['idiot', 'scum', 'trash']) if bad else prose(rng, 1)} {prose(rng, 5)}")
        labels.append((i, int(bad)))
    docs, known = make(texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = make([f"the {w} next door" for w in ("muslim", "christian", "women", "men")] + [None, "", "you idiot scum"])

    def gap(penalty):
        s = [r.toxicity for r in toxicity.score(probe, toxicity.fit(docs, known, penalty=penalty)).orderBy("doc_id").collect()]
        return abs(s[0] - s[1]) + abs(s[2] - s[3]), s

    plain, _ = gap(0.0)
    fair, s = gap(5.0)
    assert fair < plain / 2 and s[6] > max(s[0], s[2]) and s[4] == s[5]


def test_toxicity_without_two_labels(spark, make):
    docs = make(ODD)
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r.toxicity, 3) for r in toxicity.score(docs.withColumn("toxicity", F.lit("x")), none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), none).count() == 0


# language


def test_language_on_held_out_documents(spark):
    rows = {r.doc_id: r for r in queries.op3_word_first_backoff(spark, SF).collect()}
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    held = [(lang, rows[i].lang_pred) for i, lang in zip(t["doc_id"], t["lang"], strict=True) if crc(i) % 4 == 2]
    assert len(rows) == 1000 and np.mean([a == b for a, b in held]) > 0.97
    assert all(r.held_out == (crc(i) % 4 == 2) and 0 <= r.score <= 1 for i, r in rows.items())


def test_language_backs_off(spark, make):
    docs = make(["der die das und nicht schön", "the and with this thing", "le la les des être"] * 3).withColumn("lang", F.element_at(F.array(*map(F.lit, ["de", "en", "fr"])), (F.col("doc_id") % 3 + 1).cast("int")))
    model = langid.fit(docs)
    assert set(model.languages) == {"de", "en", "fr"}
    out = {r.doc_id: r.lang_pred for r in langid.detect(make(["schönes", "things", "êtres", "123 !", None, "", "漢字"]), model).collect()}
    assert [out[i] for i in range(6)] == ["de", "en", "fr", "und", "und", "und"] and out[6] in model.languages
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.detect(docs, empty).collect()} == {"und"}


def test_language_keeps_rare_words(spark, make):
    common = {"en": "the and with this thing " * 6000 + "zyxo", "de": "zyxa zyxe zyxu zyxi und " * 6000}
    docs = spark.createDataFrame(list(common.items()), "lang string, text string")
    model = langid.fit(docs)
    assert model.words.where("lang = 'en' AND word = 'zyxo' AND n = 1").count() == 1
    out = {r.doc_id: r.lang_pred for r in langid.detect(make(["zyxo", "zyxoo", "zyxo und"]), model).collect()}
    assert out == {0: "en", 1: out[1], 2: "de"}


def plain_languages(learned, texts):
    """Word-first backoff as it reads, for a few texts."""
    words_of, n_max, counts = langid.words_of, langid.LONGEST, {}
    for lang, text in learned:
        for w in words_of(text):
            counts.setdefault(lang, Counter())[w] += 1
    langs = sorted(counts)
    grams = {(x, n): Counter() for x in langs for n in range(1, n_max + 1)}
    for x in langs:
        for w, k in counts[x].items():
            for n in range(1, n_max + 1):
                for g in langid._grams(w, n):
                    grams[x, n][g] += k
    total = {x: sum(counts[x].values()) for x in langs}
    sizes = {key: sum(c.values()) for key, c in grams.items()}
    floor = math.log(langid.FLOOR * min(min(counts[x].values()) / total[x] for x in langs))
    floors = {n: math.log(langid.FLOOR * min(min(grams[x, n].values()) / sizes[x, n] for x in langs if grams[x, n])) for n in range(1, n_max + 1) if any(grams[x, n] for x in langs)}

    def gram(g):
        n = len(g)
        if any(g in grams[x, n] for x in langs):
            return [(math.log(grams[x, n][g] / sizes[x, n]) if g in grams[x, n] else floors[n]) for x in langs], 1
        if n < 2:
            return [0.0] * len(langs), 0
        (a, i), (b, j) = gram(g[:-1]), gram(g[1:])
        return [p + q for p, q in zip(a, b, strict=True)], i + j

    def word(w):
        if any(w in counts[x] for x in langs):
            return [(math.log(counts[x][w] / total[x]) if w in counts[x] else floor) for x in langs]
        parts = [gram(g) for g in langid._grams(w, min(n_max, len(w) + 2))]
        n = sum(k for _, k in parts)
        return [sum(v[i] for v, _ in parts) / max(n, 1) for i in range(len(langs))]

    for text in texts:
        scores = [word(w) for w in words_of(text or "")]
        if not scores:
            yield "und", 0.0
            continue
        total_of = [sum(v) for v in zip(*scores, strict=True)]
        best = max(total_of)
        yield langs[total_of.index(best)], 1 / sum(math.exp(v - best) for v in total_of)


@pytest.mark.parametrize("common", [1e-6, 0.02, 2.0])
def test_language_equals_a_plain_version(spark, make, monkeypatch, common):
    monkeypatch.setattr(langid, "COMMON", common)
    rnd = random.Random(6)
    stems = {"aa": ["kala", "mota", "riku", "se"], "bb": ["kolo", "mata", "zek", "se"], "cc": ["qux", "kala", "vim"]}
    learned = [(x, " ".join(rnd.choice(s) + rnd.choice(["", "n", "ti"]) for _ in range(rnd.randrange(1, 30)))) for x, s in stems.items() for _ in range(6)]
    texts = [" ".join(rnd.choice(stems[rnd.choice(list(stems))]) + rnd.choice(["", "n", "tix", "oo"]) for _ in range(rnd.randrange(12))) for _ in range(40)] + [None, "", "12 !", "漢字", "kala " * 30_000]
    model = langid.fit(spark.createDataFrame(learned, "lang string, text string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.detect(make(texts), model).collect()}
    for i, (lang, score) in enumerate(plain_languages(learned, texts)):
        assert got[i][1] == pytest.approx(score, abs=1e-3), texts[i]
        assert got[i][0] == lang or abs(score - 0.5) < 1e-3


def test_language_does_not_depend_on_blocks(spark, make, monkeypatch):
    rng = random.Random(11)
    docs = make([prose(rng, rng.randint(1, 60)) + " Unseenword" * (i % 2) for i in range(30)] * 2)
    model = langid.fit(docs.where("doc_id < 20").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")))
    whole = {r.doc_id: (r.lang_pred, r.score) for r in langid.detect(docs, model).collect()}
    monkeypatch.setattr(langid, "BLOCK", 100)
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.detect(docs, model).collect()} == whole
    assert all(whole[i] == whole[i + 30] for i in range(30))


# decontamination


def alike(a, b):
    a, b = Counter(words.shingles(words.word_hashes(a)).tolist()), Counter(words.shingles(words.word_hashes(b)).tolist())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_contamination_against_all_windows(spark, make):
    rng = random.Random(3)
    items = [prose(rng, n) for n in (14, 14, 20, 33, 45, 59)] + ["a short one", "", None]
    docs = [prose(rng, 100)]
    for item in items[:6]:
        w = item.split()
        for edits in (0, 1, 2, 5):
            own = list(w)
            for _ in range(edits):
                own[rng.randrange(len(own))] = "zzz"
            docs.append(f"{prose(rng, rng.randint(0, 40))} {' '.join(own)} {prose(rng, rng.randint(0, 40))}".strip())
    docs += [items[0].upper() + "!", f"{prose(rng, 5)} a short one {prose(rng, 5)}", "a short", *ODD]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contamination(make(docs), bench, words_a_pass=60).collect()}
    want = {}
    for i, d in enumerate(docs):
        w = (d or "").split()
        for j, item in enumerate(items):
            n = len((item or "").split())
            if n and w and len(w) >= min(n, 5):
                best = max(alike(" ".join(w[s : s + n]), item) if n >= 5 else float(" ".join(w[s : s + n]).lower() == item) for s in range(max(1, len(w) - n + 1)))
                if best >= 0.8:
                    want[i, j] = best
    assert got == pytest.approx(want)
    assert decontam.contamination(make(docs), bench.limit(0)).count() == 0 and decontam.contamination(make([]), bench).count() == 0


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    group = decontam.Sized(20, ids=list(range(40)), shingles=[rng.integers(0, 2**63, 16).astype(np.uint64) for _ in range(40)])
    group.index()
    near = group.prints[rng.integers(0, 40, 300)].copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(0, 26), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    want = {(i, j) for i, x in enumerate(near.tolist()) for j, y in enumerate(group.prints.tolist()) if (x ^ y).bit_count() <= decontam.RADIUS}
    assert set(group.candidates(near)) == want


# licenses


def test_licenses(spark, make):
    rng = random.Random(6)
    texts = [f"{prose(rng, rng.randint(0, 90))}\n# {notice} \n{prose(rng, rng.randint(0, 90))}" for _, notice in licenses.TEMPLATES]
    texts += [prose(rng, 200), "Released under the MIT", "", None, "license", "x " * 3000 + licenses.TEMPLATES[0][1]]
    got = {(r.doc_id, r.template): r for r in licenses.scan(make(texts)).collect()}
    for i in range(len(licenses.TEMPLATES)):
        assert got[i, i].containment == 1.0
    assert not {d for d, _ in got} & set(range(len(texts) - 6, len(texts) - 1)) and (len(texts) - 1, 0) in got
    assert licenses.scan(make([])).count() == 0 and licenses.scan(make(texts), []).count() == 0


def test_short_notices_in_many_contexts(spark, make):
    rng = random.Random(12)
    docs = make([f"{prose(rng, 16 + i % 32)} Released under the MIT License {prose(rng, 40)}" for i in range(10_000)])
    assert licenses.scan(docs).where("template = 0 AND containment = 1").select("doc_id").distinct().count() == 10_000
    sizes = {r.n_words: (r["size"], len(r.shingles)) for r in licenses.template_table(spark, [("x", " ".join(f"w{i}" for i in range(n))) for n in range(5, 70)]).collect()}
    for n, (size, own) in sizes.items():
        held = -(-own * 8 // 10)
        assert size >= 2 * n and size % 2 == 0 and held / (size - 4 + own - held) >= 1 / 6


# near duplicates


def classes_of(links, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("few", [64, 0])
def test_near_duplicates_against_all_pairs(spark, make, monkeypatch, few):
    """Open texts compared pair by pair, and in blocks of three."""
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 3)
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(30, 80)) for _ in range(30)]
    for t in texts[:12]:
        for edits in (1, 1, 2, 3, 5, 8):
            w = t.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = "qq"
            texts.append(" ".join(w))
    texts += [*texts[:5], texts[0].upper(), *ODD]
    got = {r.doc_id: r for r in neardup.near_duplicates(make(texts)).collect()}
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if texts[i] is not None and texts[j] is not None and (texts[i] == texts[j] or alike(texts[i], texts[j]) >= 0.8)]
    want = classes_of(links, len(texts))
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(got[i].n_copies == want.count(want[i]) for i in range(len(texts)))
    assert neardup.near_duplicates(make([])).count() == 0


def test_products_are_exact_similarities(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 64)
    rng = random.Random(5)
    texts = [prose(rng, 60)]
    for _ in range(30):
        w = rng.choice(texts).split()
        w[rng.randrange(len(w))] = "qq"
        texts.append(" ".join(w * rng.choice([1, 1, 3])))
    sets = [neardup.weighted(t) for t in [*texts, "", "one", "a b a b a b a b a b a b"]]
    both = neardup.shared_weights(sets[:20], sets)
    total = [int(s[1].sum()) for s in sets]
    for i in range(20):
        for j in range(len(sets)):
            union = total[i] + total[j] - both[i, j]
            assert both[i, j] / union == neardup.similarity(sets[i], sets[j])


def test_large_group_of_unlike_copies(spark, make):
    """Copies of one text that are often less than 0.8 alike to one another, more than are compared pair by pair."""
    rng = random.Random(21)
    base = prose(rng, 60).split()
    texts = []
    for _ in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(make(texts)).collect()}
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if alike(texts[i], texts[j]) >= 0.8]
    assert [got[i] for i in range(len(texts))] == classes_of(links, len(texts))


@pytest.fixture
def unlike_copies():
    """Copies of one text, many of them less than 0.8 alike to one another."""
    rng = random.Random(22)
    base = prose(rng, 60).split()
    texts = []
    for _ in range(900):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    return texts


def test_rows_and_queries_of_a_large_group(spark, make, monkeypatch, unlike_copies):
    """A text goes to a task once per bucket, not once per pair, and few stage tables are written, each a query of the driver's."""
    compared, tables = [], []
    kind, store = type(make([])), neardup.stored
    arrow = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema, **k: (f.__name__ == "sign" or compared.append(self.count()), arrow(self, f, schema, **k))[1])
    monkeypatch.setattr(neardup, "stored", lambda df, *a: (tables.append(1), store(df, *a))[1])
    assert neardup.near_duplicates(make(unlike_copies)).count() == len(unlike_copies)
    assert sum(compared) <= neardup.BANDS * len(unlike_copies), sum(compared)
    assert len(tables) <= 10, len(tables)


def shuffled(plan, col):
    """Rows that exchanges with this column have written, in a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan(), col)
    if kind.endswith("QueryStageExec"):
        return shuffled(plan.plan(), col)
    below = sum(shuffled(plan.children().apply(i), col) for i in range(plan.children().size()))
    names = [plan.output().apply(i).name() for i in range(plan.output().size())]
    if kind == "ShuffleExchangeExec" and col in names:
        below += plan.metrics().apply("shuffleRecordsWritten").value()
    return below


def test_texts_without_a_shared_bucket_are_not_shuffled(spark, make, monkeypatch):
    """Also where the list of those that share one is too long to be sent to all tasks by itself."""
    rng = random.Random(23)
    texts = [prose(rng, 60) for _ in range(600)]
    texts += [f"{t} end" for t in texts[:10]] + [None] * 5
    rows, store, stars = [], neardup.stored, neardup.components

    def run(df):
        df.collect()
        rows.append(shuffled(df._jdf.queryExecution().executedPlan(), "text"))
        return df

    monkeypatch.setattr(neardup, "stored", lambda df, *a: store(run(df), *a))
    monkeypatch.setattr(neardup, "components", lambda links: stars(run(links)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.class_id for r in neardup.near_duplicates(make(texts)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all(got[600 + i] == i for i in range(10)) and len(set(got.values())) == 605
    assert 0 < sum(rows) < 200, rows


def test_sieve_keeps_every_key(spark, monkeypatch):
    ids = spark.range(40_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("uid"), "id")
    ids = ids.unionByName(ids.limit(1).select(F.lit(None).cast("binary").alias("uid"), F.lit(-1).cast("long").alias("id")))
    keys = ids.where("id % 10 = 0").select("uid")
    kept = neardup.sifted(ids, keys, "uid").agg(F.sum(F.when(F.expr("id % 10 = 0"), 1)), F.count("id")).first()
    assert kept[0] == 4000 and kept[1] < 4000 + 36_000 / 10
    monkeypatch.setattr(neardup, "MOST_BITS", neardup.BITMAP // 16)
    kept = neardup.sifted(ids, keys, "uid").where("id % 10 = 0").count()
    assert kept == 4000
    assert neardup.sifted(ids, keys.limit(0), "uid").count() == 0


def test_forest_connects_what_all_links_connect(unlike_copies):
    sets = [neardup.weighted(t) for t in unlike_copies[:80]]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if neardup.similarity(sets[i], sets[j]) >= 0.8]
    for n in (2, 8, 9, 80):
        want = classes_of([x for x in links if max(x) < n], n)
        got = neardup.forest(sets[:n], 0.8)
        assert classes_of(got, n) == want and len(got) == n - len(set(want))
    got = neardup.forest(sets, 0.8, 5)
    assert classes_of(got, 80) == classes_of([x for x in links if min(x) < 5], 80)


@pytest.mark.parametrize("block", [7, 40])
def test_buckets_of_several_blocks(spark, make, monkeypatch, unlike_copies, block):
    """Blocks that meet through helpers and one another."""
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", block)
    monkeypatch.setattr(neardup, "HELPERS", 2)
    texts = unlike_copies[:120]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(make(texts)).collect()}
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if alike(texts[i], texts[j]) >= 0.8]
    assert [got[i] for i in range(len(texts))] == classes_of(links, len(texts))


def test_dart_agreement_is_weighted_similarity():
    rng = np.random.default_rng(0)
    every = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = every[:250], every[50:]
    wa, wb = rng.uniform(0.2, 3.0, 250), rng.uniform(0.2, 3.0, 250)
    wb[:200] = wa[50:] * rng.choice([1.0, 0.6], 200)
    both = np.minimum(wa[50:], wb[:200]).sum()
    sim = both / (wa.sum() + wb.sum() - both)
    sig = neardup.dart_signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.repeat([0, 1], 250), 3, k=2000)
    assert abs((sig[0] == sig[1]).mean() - sim) < 0.04 and not sig[2].any()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(60)], "a binary, b binary")
    assert {bytes(r.root) for r in neardup.components(links).collect()} == {b"000"}


def test_numeric_characters_are_no_letters(spark, make):
    """Raised digits and fractions alone leave a text undetermined."""
    model = langid.fit(make(["the cat sat", "die Katze sass"]).withColumn("lang", F.when(F.col("doc_id") == 0, "en").otherwise("de")))
    got = [r.lang_pred for r in langid.detect(make(["² ½", "Ⅳ 3 _", "the² cat", None, ""]), model).orderBy("doc_id").collect()]
    assert got == ["und", "und", "en", "und", "und"]

import hashlib
import math
import random
from collections import Counter
from math import comb

import pytest
from conftest import d, rows
from pyspark.sql import functions as F

from panelspark.operators import sampling as sm


def h(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))


def order(seed, n=200):
    return sorted(range(n), key=lambda i: (h(seed, i), i))


def test_sample_and_slice(ids):
    assert {r.k for r in sm.sample_n(ids, "k", 30, 1).collect()} == set(order(1)[:30])
    assert {r.k for r in sm.sample_n(ids, "k", 10, 1, skip=30).collect()} == set(order(1)[30:40])


def test_shuffle_and_split(ids):
    assert [r.k for r in sm.shuffled(ids, "k", 2).collect()] == order(2)
    test, train = sm.split_by_count(ids, "k", 50, 3)
    assert {r.k for r in test.collect()} == set(order(3)[:50])
    assert {r.k for r in train.collect()} == set(order(3)[50:])


def plain_draws(seed, rep, keys, m, bits=32):
    """Draws of one replicate: each bit of the rows' hashes splits them, and a binomial of the node's hash splits the draws."""
    if len(keys) < 2 or not m:
        return {k: m for k in keys if m}
    left, right = ([k for k in keys if h(seed, k) >> (bits - 1) & 1 == side] for side in (0, 1))
    took = m if not right else 0
    if left and right:
        p, u = len(left) / len(keys), (h(seed, rep, 32 - bits, h(seed, keys[0]) >> bits) + 0.5) / 2**32
        upto = 0.0
        for took in range(m + 1):
            upto += comb(m, took) * p**took * (1 - p) ** (m - took)
            if upto > u:
                break
    return plain_draws(seed, rep, left, took, bits - 1) | plain_draws(seed, rep, right, m - took, bits - 1)


def test_bootstrap_counts(ids):
    got = {(r.rep, r.k): r.weight for r in sm.bootstrap_counts(ids, "k", 4, 5).collect()}
    keys = [r.k for r in ids.collect()]
    want = {(rep, k): n for rep in range(4) for k, n in plain_draws(5, rep, keys, len(keys)).items()}
    assert got == want
    assert Counter((r.rep, r.k) for r in sm.bootstrap_rows(ids, "k", 4, 5).collect()) == want


def test_poisson_weights(ids):
    got = sm.poisson_weights(ids, "k", 50, 6)
    per_row = got.agg(F.sum("weight") / (200 * 50)).first()[0]
    assert per_row == pytest.approx(1.0, abs=0.05)
    share2 = got.where("weight = 2").count() / (200 * 50)
    assert share2 == pytest.approx(0.184, abs=0.02)
    assert rows(got, "rep", "k", "weight") == rows(sm.poisson_weights(ids.repartition(7), "k", 50, 6), "rep", "k", "weight")


def panel(spark):
    return spark.createDataFrame([(r, d(t), float(10 * r + t)) for r in range(6) for t in range(3) if (r, t) != (2, 1)], "region int, date date, x double")


def test_sample_regions(spark):
    p = panel(spark)
    got = sm.sample_regions(p, 3, 7)
    want = set(sorted(range(6), key=lambda r: (h(7, r), r))[:3])
    assert {r.region for r in got.collect()} == want
    assert got.count() == p.where(F.col("region").isin(list(want))).count()
    half = sm.sample_regions(p, None, 7, frac=0.5)
    assert {r.region for r in half.collect()} == want
    with pytest.raises(ValueError, match="either"):
        sm.sample_regions(p, 3, 7, frac=0.5)
    many = sm.sample_regions(p, 10, 8, replace=True)
    assert many.select("copy").distinct().count() == 10
    perm = sorted(range(6), key=lambda r: (h(8, r), r))
    assert {(r.copy, r.region) for r in many.collect()} == {(s, perm[h(8, "draw", s) % 6]) for s in range(10)}


def test_permutation_keeps_dates_and_values(spark):
    p = panel(spark)
    m = sm.region_permutation(p, 9)
    pairs = {r.region: r.source for r in m.collect()}
    assert sorted(pairs) == sorted(pairs.values()) == list(range(6))
    got = sm.permute_column(p, "x", m)
    assert got.columns == p.columns and got.count() == p.count()
    value = {(r.region, r.date): r.x for r in p.collect()}
    assert all(r.x == value.get((pairs[r.region], r.date)) for r in got.collect())


def test_pick_draw(spark):
    draws = spark.createDataFrame([(c, k, i, float(c + k + i)) for c in range(2) for k in range(3) for i in range(4)], "chain int, draw int, idx int, value double")
    got = sm.pick_draw(draws, 10)
    assert got.count() == 4 and got.select("chain", "draw").distinct().count() == 1


# ---- words ----


def tokens(text, stop):
    return [w.strip("!\"#$%&'()*+, -./:;<=>?@[\\]^_`{|}~") for w in text.lower().split() if w not in stop and len(w) > 2]


def oversampled(texts, base, stop, more_than, threshold):
    counts = {w: n for w, n in Counter(x for t in texts for x in tokens(t, stop)).items() if n > more_than}
    shared = set(counts) & set(base)
    a, b = sum(counts[w] for w in shared), sum(base[w] for w in shared)
    return {w for w in shared if (counts[w] / a - base[w] / b) / (base[w] / b) ** 0.5 > threshold}


def test_rebalance_equals_one_at_a_time_removal(spark):
    rnd = random.Random(4)
    vocab = ["apple", "berry", "cherry", "damson", "elder", "figs"]
    base_texts = [" ".join(rnd.choice(vocab) for _ in range(6)) for _ in range(60)]
    texts = {i: " ".join(rnd.choice(vocab + ["berry"] * (4 if i % 2 else 0)) for _ in range(6)) for i in range(40)}
    base = {w: n for w, n in Counter(x for t in base_texts for x in tokens(t, [])).items() if n > 5}
    kept = dict(texts)
    while over := oversampled(kept.values(), base, [], 5, 0.2):
        flagged = [i for i in kept if set(tokens(kept[i], [])) & over]
        del kept[min(flagged, key=lambda i: (h(11, i), i))]
    assert 0 < len(kept) < 40
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    baseline = sm.word_counts(spark.createDataFrame([(t,) for t in base_texts], "text string"), [])
    got = sm.rebalance_words(df, baseline, "id", [], 11, threshold=0.2, one_by_one=True)
    assert {r.id for r in got.collect()} == set(kept)
    fast = sm.rebalance_words(df, baseline, "id", [], 11, threshold=0.2)
    left = [r.text for r in fast.collect()]
    assert left and not oversampled(left, base, [], 5, 0.2)


@pytest.mark.parametrize("seed", [3, 11])
def test_rebalance_equals_a_plain_replay_of_its_rounds(spark, seed):
    rnd = random.Random(seed)
    vocab = ["apple", "berry", "cherry", "damson", "elder", "figs"]
    base_texts = [" ".join(rnd.choice(vocab) for _ in range(6)) for _ in range(200)]
    texts = {i: " ".join(rnd.choice(vocab + ["berry"] * (i % 3) + ["figs"] * (i % 4)) for _ in range(6)) for i in range(120)}
    texts |= {200: "", 201: None}
    base = {w: n for w, n in Counter(x for t in base_texts for x in tokens(t, [])).items() if n > 5}
    kept, rounds = dict(texts), 0
    while True:
        counts = Counter(x for t in kept.values() if t for x in tokens(t, []))
        shared = {w: n for w, n in counts.items() if n > 5 and w in base}
        n_all, m_all = sum(shared.values()), sum(base[w] for w in shared)
        drop = set()
        for w, n in shared.items():
            q = base[w] / m_all
            if (n / n_all - q) / math.sqrt(q) > 0.05:
                excess = max(1, math.ceil(n - (q + 0.05 * math.sqrt(q)) * n_all))
                holders = [i for i, t in kept.items() if t and w in tokens(t, [])]
                drop |= set(sorted(holders, key=lambda i: (h(seed, i), i))[:excess])
        if not drop:
            break
        kept, rounds = {i: t for i, t in kept.items() if i not in drop}, rounds + 1
    assert rounds > 1 and 0 < len(kept) < len(texts)
    df = spark.createDataFrame([*texts.items(), (None, "berry berry")], "id int, text string")
    baseline = sm.word_counts(spark.createDataFrame([(t,) for t in base_texts], "text string"), [])
    got = sm.rebalance_words(df, baseline, "id", [], seed, threshold=0.05)
    assert {r.id for r in got.collect()} == set(kept)


def test_word_exceptions(spark):
    counts = spark.createDataFrame([("san", 50), ("word", 50), ("other", 10)], "word string, n long")
    base = spark.createDataFrame([("san", 10), ("word", 10), ("other", 90)], "word string, n long")
    assert [r.word for r in sm.oversampled_words(counts, base).collect()] == ["word"]


def test_a_round_counts_the_baseline_once(spark):
    """Words shared with the baseline are stored: totals and scores read them, not the baseline's texts again."""
    texts = spark.createDataFrame([(i, "alpha beta gamma" if i % 2 else "alpha alpha alpha delta") for i in range(40)], "id long, text string")
    baseline = sm.word_counts(texts, [])
    counts = sm.word_counts(texts.where("id % 2 = 0"), [])
    for over in (sm.excess_words(counts, baseline, 0.02, []), sm.oversampled_words(counts, baseline)):
        assert "Generate" not in over._jdf.queryExecution().optimizedPlan().toString()
        assert [r.word for r in over.collect()] == ["delta"]

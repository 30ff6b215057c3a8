"""Draws by a tree of binomials against plain probabilities, and the same draws however the rows are dealt."""

from hashlib import md5
from math import comb

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelspark.functions.hashing import h32, h32_of_pairs
from panelspark.operators import forest as fo
from panelspark.operators import model as md
from panelspark.operators import resampling as rs


@pytest.mark.parametrize("m,p", [(1, 0.5), (5, 0.3), (40, 0.01), (200, 0.97), (0, 0.2)])
def test_binomial_quantiles(m, p):
    upto = np.cumsum([comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(m + 1)])
    u = (np.arange(500) + 0.5) / 500
    assert rs.binomial(np.full(500, m), p, u).tolist() == [min(m, int((upto <= x).sum())) for x in u]


def test_binomials_of_many_trials():
    """The expansion meets the summed function where both can be had."""
    u = np.linspace(0.001, 0.999, 41)
    m = np.full(41, 10**9)
    exact, spread = rs.binomial(m, 0.2, u), rs.EXACT_SPREAD
    rs.EXACT_SPREAD = 1
    try:
        assert np.abs(rs.binomial(m, 0.2, u) - exact).max() <= 1
    finally:
        rs.EXACT_SPREAD = spread


def test_draws_do_not_depend_on_partitions(spark):
    cells = spark.createDataFrame([(i, i % 7 + 1, f"v{i}") for i in range(300)], "id long, n long, v string")
    want = rows(rs.resampled(cells, ["id"], 20, 5, n="n").select("rep", "id", "weight"), "rep", "id", "weight")
    held = rs.HELD
    rs.HELD = 40
    try:
        again = rs.resampled(cells.repartition(7), ["id"], 20, 5, n="n")
        assert rows(again.select("rep", "id", "weight"), "rep", "id", "weight") == want
    finally:
        rs.HELD = held
    total = sum(i % 7 + 1 for i in range(300))
    sums = np.zeros(20)
    for rep, _, w in want:
        sums[rep] += w
    assert sums.tolist() == [total] * 20
    assert again.where("v <> concat('v', id) or n <> id % 7 + 1").count() == 0


def test_weights_are_those_of_a_multinomial(spark):
    """Mean and variance of each cell's weight, and the covariance of two."""
    sizes = [1, 4, 15, 30]
    cells = spark.createDataFrame(list(enumerate(sizes)), "id long, n long")
    got = rs.resampled(cells, ["id"], 3000, 2, n="n").groupBy("rep").pivot("id", [0, 1, 2, 3]).agg(F.sum("weight")).fillna(0)
    table = np.array([[r[str(i)] for i in range(4)] for r in got.collect()])
    n, share = sum(sizes), np.array(sizes) / sum(sizes)
    assert (table.sum(axis=1) == n).all()
    assert table.mean(axis=0) == pytest.approx(n * share, rel=0.06)
    assert table.var(axis=0) == pytest.approx(n * share * (1 - share), rel=0.12)
    assert np.cov(table[:, 2], table[:, 3])[0, 1] == pytest.approx(-n * share[2] * share[3], rel=0.12)


def test_cells_of_one_hash():
    """Below the last bit cells are drawn one after the other."""
    tree = rs.Tree({3: 9}, rs.BLOCK_BITS, 200, 1)
    h = np.full(3, 3 << 16, np.int64)
    drawn = dict(tree.cells(h, np.array([2, 3, 4])))
    table = np.stack([drawn[k] for k in range(3)])
    assert (table.sum(axis=0) == 9).all() and table.mean(axis=1) == pytest.approx([2, 3, 4], rel=0.2)


def test_nothing_is_drawn_from_nothing(spark):
    assert rs.resampled(spark.createDataFrame([], "id long"), ["id"], 5, 1).count() == 0


def test_regression_from_blocks(spark):
    rng = np.random.default_rng(4)
    data = [(i, float(a), float(b), float(3 * a - 2 * b + e)) for i, (a, b, e) in enumerate(rng.normal(size=(4000, 3)))]
    df = spark.createDataFrame(data, "id long, a double, b double, y double")
    by_block = {r.feature: r for r in md.coefficient_summary(md.block_ols(df, "id", "y", ["a", "b"], 100, 3)).collect()}
    by_row = {r.feature: r for r in md.coefficient_summary(md.bootstrap_ols(df, "id", "y", ["a", "b"], 100, 3)).collect()}
    for f, true in (("a", 3), ("b", -2)):
        assert by_block[f].mean == pytest.approx(true, abs=0.1) and by_block[f].lower < true < by_block[f].upper
        assert by_block[f].upper - by_block[f].lower == pytest.approx(by_row[f].upper - by_row[f].lower, rel=0.45)


def test_hashes_of_pairs():
    """Empty texts, texts that end in the middle of a word, and texts of more than one block."""
    lefts, rights = [f"7|{'r' * k}|" for k in range(6)] + ["", "é" * 9, "x" * 60], [f"{k}|é{10**k}" for k in range(9)] + [""]
    want = [[int(md5((a + b).encode()).hexdigest()[:8], 16) for a in lefts] for b in rights]
    assert h32_of_pairs(lefts, rights).tolist() == want


def test_tasks_draw_ranges_of_blocks(spark):
    """No two tasks go down the same part of the tree; dealt by a hash, every task went down nearly all of it."""
    drawn = rs.resampled(spark.range(4000), ["id"], 2, 5).withColumn("h", h32(5, F.col("id")))
    ends = sorted((r.a, r.b) for r in drawn.groupBy(F.spark_partition_id()).agg(F.min("h").alias("a"), F.max("h").alias("b")).collect())
    assert len(ends) > 1 and all(b < a for (_, b), (a, _) in zip(ends, ends[1:]))


def test_sums_of_drawn_rows(spark):
    data = [(i, None if i % 5 == 0 else float(i), float("nan") if i == 3 else i * 0.25) for i in range(50)]
    cells = spark.createDataFrame(data, "id long, a double, b double")
    want = rs.resampled(cells, ["id"], 40, 8).groupBy("rep").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in "ab"])
    got = {r.rep: r for r in rs.resampled_sums(cells, ["id"], 40, 8, ["a", "b"]).collect()}
    assert len(got) == 40
    for r in want.collect():
        assert got[r.rep].a == pytest.approx(r.a) and got[r.rep].b == pytest.approx(r.b, nan_ok=True)


@pytest.mark.parametrize("gaps", [False, True])
def test_regressions_add_up_where_rows_are_drawn(spark, gaps):
    """The same fit as over the drawn rows, of which none leaves its task."""
    data = [(i, float(i % 7), None if gaps and i % 9 == 0 else float(i % 5), float(i * 37 % 101)) for i in range(120)]
    df = spark.createDataFrame(data, "id long, a double, b double, y double")
    names = ["rep", "feature", F.round("coef", 8), F.round("explained_variance", 8)]
    got = md.bootstrap_ols(df, "id", "y", ["a", "b"], 30, 2)
    assert rows(got, *names) == rows(md.ols_by_replicate(rs.resampled(df, ["id"], 30, 2), "y", ["a", "b"]), *names)
    if not gaps:
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "weight" not in plan


def test_summaries_read_stored_replicates(spark):
    """The rounds of the exact quantiles do not draw the replicates again."""
    data = [(i, float(i % 7), float(i * 37 % 101)) for i in range(60)]
    replicates = md.bootstrap_ols(spark.createDataFrame(data, "id long, a double, y double"), "id", "y", ["a"], 20, 2)
    for summary in (md.coefficient_summary(replicates), md.explained_variance_summary(replicates)):
        assert "MapIn" not in summary._jdf.queryExecution().optimizedPlan().toString()
        assert summary.count() == 1


def test_poisson_weights_of_a_hash():
    hashes = np.random.default_rng(3).integers(0, 1 << 32, (4, 50_000), dtype=np.uint32)
    rate = np.array([1, 2, 7, 2])
    got = fo.poisson(rate, hashes)
    for r, u, w in zip(rate.tolist(), hashes / (1 << 32), got):
        upto = np.cumsum(np.exp(-r) * np.cumprod([1.0, *[r / k for k in range(1, 3 * r + 13)]]))
        assert (w == np.searchsorted(upto, u, side="right")).all() and w.mean() == pytest.approx(r, rel=0.03)


def test_sums_of_a_level(spark):
    """Sums over all trees' weighted rows in plain Python, with missing bins and values, in one task and in many."""
    data = [(r, k, 1 + (r + k) % 3, None if k == 4 else k * 0.5, [k % 3, None if k == 7 else k % 2]) for r in range(3) for k in range(40)]
    drawn = spark.createDataFrame(data, "rep long, id long, weight long, y double, b array<int>")
    splits = fo.Splits(3, 5, 1, None)
    splits.feature[:, :4, 1], splits.cut[:, :4, 1] = 1, 0
    want = {}
    for r, k, w, y, b in data:
        limits = fo.poisson_table(w)[0]
        for t in range(4):
            u = int(md5(f"s-tree|{r}|{t}|{k}".encode()).hexdigest()[:8], 16)
            drawn_times = int((limits <= u).sum())
            if drawn_times and b[1] is not None:
                for f in (0, 1):
                    cell = want.setdefault((r, t, 2 + int(b[1] > 0), f, b[f]), [0.0, 0.0, 0.0])
                    for i, v in enumerate((1, y or 0.0, (y or 0.0) ** 2)):
                        cell[i] += drawn_times * v
    held = fo.HELD
    fo.HELD = 1
    try:
        for parts in (1, 6):
            got = fo.level_sums(drawn.repartition(parts), "id", 2, 5, "s", splits, 4).collect()
            assert {(r.rep, r.tree, r.node, r.feature, r.bin): [r.w, r.s, r.q] for r in got} == want
    finally:
        fo.HELD = held

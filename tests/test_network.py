import random
from datetime import datetime

import pytest
from conftest import d, rows
from pyspark.sql import functions as F

from panelspark.operators import network as nw


def edge_list(spark, data):
    return spark.createDataFrame(data, "src int, dst int, weight double")


def regions(spark, ids):
    return spark.createDataFrame([(i, i * 10) for i in ids], "region int, population int")


def test_reference_network(spark):
    t = [datetime(2021, 1, 1 + i, 12) for i in range(5)]
    data = [
        (1, 10, -1, t[0]), (2, 20, 1, t[1]), (3, 20, 1, t[2]), (4, 10, 4, t[3]),  # 4 refers to itself
        (5, 30, 99, t[4]),  # unknown
        (1, 10, -1, t[0]), (6, 30, 2, t[4]),  # event 1 is in the table twice
    ]
    e = spark.createDataFrame(data, "event_id long, region int, ref_id long, event_time timestamp_ntz")
    got = nw.reference_network(e)
    assert rows(got, "src", "dst", "n_refs", "n_refs_per_day") == [(10, 10, 1, 0.25), (20, 10, 2, 0.5), (30, 20, 1, 0.25)]
    cut = nw.reference_network(e, first="2021-01-02 12:00:00", last="2021-01-05 12:00:00")
    assert rows(cut, "src", "dst", "n_refs") == [(10, 10, 1), (30, 20, 1)]


def test_network_from_users_equals_located_network(spark):
    rnd = random.Random(1)
    where = {u: rnd.choice([1, 2, 3, None]) for u in range(20)}
    data = [(i, rnd.randrange(25), i - rnd.randrange(40) if rnd.random() < 0.6 else -1, datetime(2021, 1, 1 + i // 30)) for i in range(300)]
    e = spark.createDataFrame(data, "event_id long, user_id long, ref_id long, event_time timestamp_ntz")
    u = spark.createDataFrame([(k, v) for k, v in where.items() if v], "user_id long, region int")
    cols = ["src", "dst", "n_refs", "n_refs_per_day"]
    assert rows(nw.reference_network(e, users=u), *cols) == rows(nw.reference_network(e.join(u, "user_id")), *cols)


def test_distance_edges(spark):
    dist = spark.createDataFrame([(1, 2, 100.0), (1, 3, 50.0), (2, 1, 200.0), (2, 3, 199.0), (1, 9, 10.0)], "src int, dst int, distance double")
    r = regions(spark, [1, 2, 3])
    assert rows(nw.distance_edges(dist, r), "src", "dst", "weight") == [(1, 2, pytest.approx(1 / 3)), (1, 3, pytest.approx(2 / 3)), (2, 3, 1.0)]
    assert rows(nw.distance_edges(dist, r, power=-2, normalize=False), "src", "dst", "weight")[0] == (1, 2, pytest.approx(1e-4))


def test_weights_sum_to_one(spark):
    e = edge_list(spark, [(1, 2, 3.0), (1, 3, 1.0), (2, 1, 5.0)])
    got = nw.population_weighted(e, regions(spark, [1, 2, 3])).groupBy("src").agg(F.sum("weight").alias("w"))
    assert rows(got, "src", "w") == [(1, pytest.approx(1.0)), (2, 1.0)]


def test_neighbour_mean_zero_rules(spark):
    # 1 -> 2 (missing value on day 1), 1 -> 9 (no data), 4 has no edges, 5 -> 9 only
    e = edge_list(spark, [(1, 2, 0.5), (1, 3, 0.25), (1, 9, 0.25), (5, 9, 1.0)])
    p = spark.createDataFrame(
        [(1, d(0), 1.0), (2, d(0), 10.0), (3, d(0), 20.0), (4, d(0), 1.0), (5, d(0), 1.0), (1, d(1), 1.0), (2, d(1), None), (3, d(1), 4.0)],
        "region int, date date, x double",
    )
    got = nw.neighbour_mean(p, ["x"], e)
    assert rows(got, "region", "date", "x_neighbor_mean") == [
        (1, d(0), 10.0), (1, d(1), 1.0), (2, d(0), None), (2, d(1), None), (3, d(0), None), (3, d(1), None), (4, d(0), None), (5, d(0), 0.0)
    ]


def test_neighbour_mean_against_a_loop_over_dates(spark):
    rnd = random.Random(2)
    p = [(r, d(t), rnd.random() if rnd.random() > 0.2 else None) for r in range(8) for t in range(6) if rnd.random() > 0.1]
    e = [(a, b, rnd.random()) for a in range(6) for b in range(10) if rnd.random() > 0.5]
    got = {(r.region, r.date): r.x_m for r in nw.neighbour_mean(spark.createDataFrame(p, "region int, date date, x double"), ["x"], edge_list(spark, e), "_m").collect()}
    srcs = {a for a, _, _ in e}
    value = {(r, t): x for r, t, x in p}
    for r, t, _ in p:
        want = sum(w * (value.get((b, t)) or 0) for a, b, w in e if a == r) if r in srcs else None
        assert got[(r, t)] == (pytest.approx(want) if want is not None else None)


def test_exposure(spark):
    p = spark.createDataFrame([(1, d(0), 10, 0.5), (2, d(0), 20, 0.25)], "region int, date date, population int, rate double")
    got = nw.exposure(p, ["rate"], edge_list(spark, [(1, 2, 3.0), (1, 1, 1.0)]))
    assert rows(got, "region", "rate_exposure") == [(1, (3 * 5 + 5) / 10), (2, None)]


def test_network_comparison_and_index(spark):
    a = spark.createDataFrame([(1, 2, 1.0), (2, 1, 2.0)], "src int, dst int, n_refs_per_day double")
    b = spark.createDataFrame([(1, 2, 2.0), (3, 1, 1.0)], "src int, dst int, n_refs_per_day double")
    got = nw.network_comparison(a, b).first()
    assert got.n_pairs == 3
    import numpy as np

    assert got["corr"] == pytest.approx(np.corrcoef([1, 2, 0], [2, 0, 1])[0, 1])
    idx = spark.createDataFrame([(1, 2, 5.0), (2, 2, 1.0), (2, 1, 4.0)], "src int, dst int, idx double")
    net = spark.createDataFrame([(1, 2, 10), (2, 1, 3)], "src int, dst int, n_refs int")
    assert nw.index_correlation(idx, net, "idx").first()["corr"] == pytest.approx(np.corrcoef([5, 1, 4], [10, 0, 3])[0, 1])


def test_dense_homophily_against_all_pairs(spark):
    import numpy as np

    rnd = random.Random(3)
    x = {r: rnd.choice([rnd.random() * 5, 1.0]) for r in range(15)}
    edges = [(a, b, rnd.randrange(1, 9)) for a in range(12) for b in range(3, 17) if rnd.random() > 0.6]
    e = spark.createDataFrame(edges, "src int, dst int, n_refs int")
    attrs = spark.createDataFrame(list(x.items()), "region int, x double")
    got = nw.dense_homophily(e, attrs, "x").first()
    w = {(a, b): n for a, b, n in edges}
    pairs = [(a, b) for a in {a for a, _, _ in edges} for b in {b for _, b, _ in edges} if a in x and b in x]
    dist = [abs(x[a] - x[b]) for a, b in pairs]
    assert got.n_pairs == len(pairs)
    assert got.mean_dist == pytest.approx(np.mean(dist))
    assert got["corr"] == pytest.approx(np.corrcoef([w.get(p, 0) for p in pairs], dist)[0, 1])
    near = [(np.log(n), abs(x[a] - x[b])) for a, b, n in edges if a in x and b in x]
    assert nw.sparse_homophily(e, attrs, ["x"]).first().corr_log == pytest.approx(np.corrcoef(*zip(*near))[0, 1])
    s = nw.dense_summary(e).first()
    full = [w.get((a, b), 0) for a in {a for a, _, _ in edges} for b in {b for _, b, _ in edges}]
    assert (s.n_pairs, s.n_edges, s.mean_weight, s.std_weight) == (len(full), len(edges), pytest.approx(np.mean(full)), pytest.approx(np.std(full)))


def test_neighbour_means_in_blocks(spark):
    rnd = random.Random(8)
    edges = {(a, b): rnd.random() for a in range(40) for b in rnd.sample(range(40), 5)} | {(a, 0): 0.5 for a in range(1, 40)} | {(0, b): 0.25 for b in range(40)}
    e = edge_list(spark, [(*k, w) for k, w in edges.items()])
    df = spark.createDataFrame([(r, t, None if rnd.random() < 0.1 else rnd.random(), float(r)) for r in range(45) for t in range(6)], "region int, date int, x double, y double")
    want = rows(nw.neighbour_mean(df, ["x", "y"], e), "region", "date", "x_neighbor_mean", "y_neighbor_mean")
    for blocks in [(1, 1), (8, 4), (64, 64)]:
        got = rows(nw.neighbour_mean(df, ["x", "y"], e, blocks=blocks), "region", "date", "x_neighbor_mean", "y_neighbor_mean")
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2:] for g in got] == [tuple(None if v is None else pytest.approx(v) for v in w[2:]) for w in want]


def test_hub_is_spread_over_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        e = spark.range(4000).selectExpr("int(id) AS src", "0 AS dst", "1.0D AS weight")
        values = spark.createDataFrame([(0, 1, 2.0), (0, 2, 3.0), (1, 1, 1.0)], "dst int, date int, x double")
        hub = nw.in_blocks(e, values, (32, 4)).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in hub) == 8000 and len(hub) > 2 and max(r["count"] for r in hub) < 4000
        attributes = spark.createDataFrame([(i, i * 2) for i in range(4000)], "region int, a int")
        both = nw.attach_both_ends(e, attributes, ["a"], hubs=True)
        assert both.where("src_a = 2 * src AND dst_a = 0").count() == 4000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

import gzip
import json

import pytest
from conftest import d, rows
from pyspark.sql import functions as F

from panelspark.operators import events as ev
from panelspark.sources import files
from panelspark.streaming.ingest import ingest_new_files

POSTS = [
    {"id": 1, "text": "plain", "created_at": "Fri Jan 01 10:00:00 +0000 2021", "lang": "en", "user": {"id": 10}},
    {"id": 2, "text": "short", "extended_tweet": {"full_text": "long own"}, "created_at": "Fri Jan 01 11:00:00 +0000 2021", "lang": "en", "user": {"id": 11}},
    {"id": 3, "text": "rt", "retweeted_status": {"id": 1, "text": "shared", "extended_tweet": {"full_text": "long shared"}},
     "extended_tweet": {"full_text": "own long, not used"}, "created_at": "Sat Jan 02 00:30:00 +0000 2021", "lang": "en", "user": {"id": 10}},
    {"id": 4, "text": "rt", "retweeted_status": {"id": 2, "text": "shared"}, "created_at": "Sat Jan 02 00:40:00 +0000 2021", "user": {"id": 12}},
    {"limit": {"track": 5}},
]
WANT = [(1, "plain", 10, "en", -1), (2, "long own", 11, "en", -1), (3, "long shared", 10, "en", 1), (4, "shared", 12, None, 2)]


def write(path, posts):
    with gzip.open(path, "wt") as f:
        f.write("\n".join(json.dumps(p) for p in posts) + "\n")


def test_flatten_gzip_posts(spark, tmp_path):
    write(tmp_path / "posts--2021-01-01.json.gz", POSTS)
    got = ev.flatten_posts(files.read_posts(spark, str(tmp_path)))
    assert rows(got, "event_id", "text", "user_id", "lang", "ref_id") == WANT
    assert got.where("event_id = 3").select(F.date_format("event_time", "yyyy-MM-dd HH:mm")).first()[0] == "2021-01-02 00:30"


def test_broken_line_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1\n')
    with pytest.raises(Exception):
        ev.flatten_posts(files.read_posts(spark, str(tmp_path))).collect()


def test_stream_takes_each_file_once_and_equals_batch(spark, tmp_path):
    src, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    src.mkdir()
    write(src / "posts--2021-01-01.json.gz", POSTS[:2])
    ingest_new_files(spark, str(src), str(out), str(state))
    assert spark.read.parquet(str(out)).count() == 2
    write(src / "posts--2021-01-02.json.gz", POSTS[2:])
    for _ in range(2):  # the second run finds nothing new
        ingest_new_files(spark, str(src), str(out), str(state))
    got = spark.read.parquet(str(out))
    assert rows(got, "event_id", "text", "user_id", "lang", "ref_id") == WANT
    batch = ev.flatten_posts(files.read_posts(spark, str(src)))
    assert rows(got, "event_id", "event_time") == rows(batch, "event_id", "event_time")


def test_posts_between_open_only_their_days(spark, tmp_path):
    for day in ("2021-01-31", "2021-02-01", "2021-02-02", "2021-02-03"):
        (tmp_path / f"date={day}").mkdir()
        write(tmp_path / f"date={day}" / "part.json.gz", POSTS[:1])
    got = files.posts_between(spark, str(tmp_path), "2021-02-01", "2021-02-02")
    assert sorted(str(r.date) for r in got.select("date").distinct().collect()) == ["2021-02-01", "2021-02-02"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


# user 1 is active in two regions, user 2 ties, user 3 has no label, user 4 comes back
EVENTS = [
    # event, user, region, day, flag, ref
    (1, 1, 100, 0, 1, -1), (2, 1, 100, 0, 1, 1), (3, 1, 200, 1, 0, -1),
    (4, 2, 100, 0, 1, -1), (5, 2, 100, 1, 0, 1),
    (6, 3, 200, 1, None, -1), (7, 4, 200, 0, 0, 99), (8, 4, 200, 2, 0, 7),
]


@pytest.fixture
def small(spark):
    return spark.createDataFrame([(e, u, r, d(t), f, ref) for e, u, r, t, f, ref in EVENTS], "event_id long, user_id long, region int, date date, flag int, ref_id long")


COLS = ["region", "date", "n_events", "n_flagged", "n_refs", "n_flagged_refs", "n_new_users", "n_new_flagged_users", "n_active_users", "n_active_flagged_users"]


def test_daily_activity(small):
    # user 1 counts as flagged (2 of 3), user 2 not (a tie), user 3 has no label
    assert rows(ev.daily_activity(small), *COLS) == [
        (100, d(0), 3, 3, 1, 1, 2, 1, 2, 1),
        (100, d(1), 1, 0, 1, 0, 0, 0, 1, 0),
        (200, d(0), 1, 0, 1, 0, 1, 0, 1, 0),
        (200, d(1), 1, 0, None, None, 1, 1, 1, 1),
        (200, d(2), 1, 0, 1, 0, 0, 0, 1, 0),
    ]


def test_daily_activity_modes(small):
    inner = ev.daily_activity(small, keep_all_days=False)
    assert rows(inner, "region", "date") == [(100, d(0)), (200, d(0)), (200, d(1))]
    copied = ev.daily_activity(small, copy_counts=True)
    assert rows(copied, "n_refs", "n_flagged_refs") == rows(copied, "n_events", "n_flagged")


def test_daily_activity_with_regions_joined_late(small, spark):
    one_place = small.where("NOT (user_id = 1 AND region = 200)")
    users = one_place.select("user_id", "region").distinct()
    assert rows(ev.daily_activity(one_place.drop("region"), users), *COLS) == rows(ev.daily_activity(one_place), *COLS)


def test_labels_new_and_active_users_agree_with_activity(small):
    labels = ev.user_majority(small)
    assert rows(labels, "user_id", "user_flag") == [(1, True), (2, False), (4, False)]
    act = ev.daily_activity(small)
    new = ev.new_users(small, labels)
    assert rows(new, "region", "date", "n_new_users", "n_new_flagged_users") == rows(act.where("n_new_users > 0"), "region", "date", "n_new_users", "n_new_flagged_users")
    active = ev.active_users(small, labels)
    cols = ["region", "date", "n_active_users", "n_active_flagged_users"]
    assert rows(active, *cols) == rows(act, *cols)


def test_null_text_meets_null_text(spark):
    events = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "event_id long, text string")
    preds = ev.distinct_texts(events).withColumn("label", F.coalesce(F.length("text"), F.lit(0)))
    assert rows(ev.attach_predictions(events, preds), "event_id", "label") == [(1, 1), (2, 0), (3, 1), (4, 0)]


def test_clean_answers(spark):
    a = spark.createDataFrame([("x", "accept"), ("x", "accept"), ("y", "reject"), ("z", "ignore"), (None, "accept"), ("w", "odd")], "text string, answer string")
    assert rows(ev.clean_answers(a), "text", "is_flagged") == [("x", True), ("y", False)]


def test_locate_users(spark):
    codes = spark.createDataFrame(
        [("State", "Ohio", 39, 39000), ("County", "Adams County", 39, 39001), ("County", "Adams County", 55, 55001), ("State", "Iowa", 19, 19000)],
        "geo_level string, area_name string, state_code int, region int",
    )
    places = spark.createDataFrame([({"['Adams County', 'Ohio']": [1, 2], "['Nowhere', 'Ohio']": [3], "['Iowa', 'Iowa']": [2]},)], "places map<string,array<bigint>>")
    got = ev.locate_users(ev.users_by_place(places), codes)
    # a state name matches as a county too; user 2 keeps the first by region code
    assert rows(got, "user_id", "state", "county", "region") == [(1, "Ohio", "Adams County", 39001), (2, "Iowa", "Iowa", 19000)]


def test_located_share_and_geotag(spark):
    e = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], "event_id long, user_id long")
    u = spark.createDataFrame([(1, 7), (3, 8)], "user_id long, region int")
    assert tuple(ev.located_share(e, u).first()) == (4, 3, 0.75)
    assert rows(ev.geotag(e, u), "event_id", "region") == [(1, 7), (2, 7), (4, 8)]


def test_small_helpers(spark):
    a = spark.createDataFrame([(d(0),), (d(1),), (d(2),)], "date date")
    assert rows(ev.unseen_dates(a, a.where(F.col("date") == F.lit(d(1)))), "date") == [(d(0),), (d(2),)]
    assert ev.between_dates(a, "2021-01-01", "2021-01-02", closed=False).count() == 1
    assert ev.between_dates(a, "2021-01-01", "2021-01-02").count() == 2
    v = spark.createDataFrame([("x",), ("x",), (None,)], "v string")
    assert rows(ev.value_counts(v, "v"), "v", "n") == [("x", 2)]
    assert ev.renamed(v, {"v": "w"}).columns == ["w"]

"""Queries on sources, events and users."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import codes, text as X
from panelspark.functions.nulls import inf_to_null
from panelspark.operators import events as ev
from panelspark.operators import regions as rg
from panelspark.operators.skew import keep_first
from panelspark.operators.stats import count_distincts
from panelspark.plans import tables as tb
from panelspark.plans.registry import Out, query
from panelspark.session import scratch_path
from panelspark.sources import files, schemas
from panelspark.streaming.ingest import ingest_new_files

# ---- raw nested posts made from the events table ----


def posts_as_json(spark, sf):
    """One JSON line per event: control records, originals, long originals and two kinds of shared posts."""
    e = tb.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    control = F.col("event_type") == "signup"
    word = F.concat(F.lit("text "), F.col("event_id").cast("string"))
    long_form = F.struct(F.concat(F.lit("long "), word).alias("full_text"))
    shared = F.struct(
        F.abs(F.col("event_id") - k).alias("id"),
        F.concat(F.lit("shared "), k.cast("string")).alias("text"),
        F.when(k % 2 == 0, F.struct(F.concat(F.lit("long shared "), k.cast("string")).alias("full_text"))).alias("extended_tweet"),
    )
    post = F.struct(
        F.when(~control, F.col("event_id")).alias("id"),
        F.when(~control, word).alias("text"),
        F.when(~control, F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy")).alias("created_at"),
        F.when(~control & (k % 3 > 0), F.lit("en")).alias("lang"),
        F.when(~control, F.struct(F.col("user_id").alias("id"))).alias("user"),
        F.when(F.col("event_type") == "purchase", long_form).alias("extended_tweet"),
        F.when(F.col("event_type") == "view", shared).alias("retweeted_status"),
        F.when(control, F.struct(k.alias("track"))).alias("limit"),
    )
    return e.select(F.to_date("ts").alias("file_date"), F.to_json(post).alias("line"))


POSTS = Out(longs=("event_id", "user_id", "ref_id"), strings=("text", "lang", "at"))
POSTS_SQL = """
p AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events WHERE event_type <> 'signup'),
f AS (SELECT event_id, user_id, ts,
        CASE WHEN event_type = 'view' THEN abs(event_id - k) ELSE -1 END AS ref_id,
        CASE WHEN event_type = 'view' THEN (CASE WHEN k % 2 = 0 THEN 'long shared ' ELSE 'shared ' END) || k
             WHEN event_type = 'purchase' THEN 'long text ' || event_id ELSE 'text ' || event_id END AS text,
        CASE WHEN k % 3 > 0 THEN 'en' END AS lang, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM p),
"""


@query("io01_flatten_posts", POSTS.sql(POSTS_SQL, "SELECT * FROM f"))
def flatten_posts(spark, sf):
    raw = posts_as_json(spark, sf).select(F.from_json("line", schemas.POSTS).alias("p")).select("p.*")
    out = ev.flatten_posts(raw)
    return POSTS.of(out.withColumn("at", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")))


DAYS_POSTED = Out(strings=("date",), longs=("n", "n_shared", "n_users"))


@query(
    "s01_incremental_ingest",
    DAYS_POSTED.sql(
        POSTS_SQL,
        "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, count(*) FILTER (ref_id <> -1) AS n_shared, count(DISTINCT user_id) AS n_users FROM f GROUP BY 1",
    ),
)
def incremental_ingest(spark, sf):
    """Files of all days but the last are ingested, the last day's files arrive, and a second run takes only those."""
    lines = posts_as_json(spark, sf)
    last = lines.agg(F.max("file_date")).scalar()
    source, target, state = (scratch_path(spark, n) for n in ("posts", "events", "state"))
    for arrival in (F.col("file_date") < last, F.col("file_date") == last):
        lines.where(arrival).select("line").write.mode("append").option("compression", "gzip").text(source)
        ingest_new_files(spark, source, target, state)
    done = spark.read.parquet(target)
    out = done.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ref_id") != -1).alias("n_shared"), F.count_distinct("user_id").alias("n_users")
    )
    return DAYS_POSTED.of(out)


DATES = Out(strings=("date",))


@query(
    "io03_unseen_dates",
    DATES.sql(tb.EV, "SELECT DISTINCT strftime(date, '%Y-%m-%d') AS date FROM ev WHERE date NOT IN (SELECT date FROM ev WHERE region = 0 AND event_type = 'signup')"),
)
def unseen_dates(spark, sf):
    e = tb.located_events(spark, sf)
    available = e.select("date").distinct()
    written = e.where("region = 0 AND event_type = 'signup'").select("date").distinct()
    return DATES.of(ev.unseen_dates(available, written).withColumn("date", F.date_format("date", "yyyy-MM-dd")))


PER_DAY = Out(strings=("date",), longs=("n",), doubles={"value": 2})
PER_DAY_SQL = "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, sum(value) AS value FROM events {where} GROUP BY 1"


@query("io04_date_range", PER_DAY.sql("", PER_DAY_SQL.format(where="WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'")))
def date_range(spark, sf):
    e = ev.between_dates(tb.raw_events(spark, sf), "2024-01-08", "2024-01-21")
    return PER_DAY.of(_per_day(e))


def _per_day(e):
    return e.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@query("io05_sink_by_date", PER_DAY.sql("", PER_DAY_SQL.format(where="")))
def sink_by_date(spark, sf):
    path = scratch_path(spark, "by-date")
    files.write_by_date(tb.raw_events(spark, sf), path)
    return PER_DAY.of(_per_day(spark.read.parquet(path)))


SUPPLIER = Out(longs=("region", "n"), doubles={"balance": 6})


@query("io09_delimited_files", SUPPLIER.sql("", "SELECT s_nationkey AS region, count(*) AS n, avg(s_acctbal) AS balance FROM supplier GROUP BY 1"))
def delimited_files(spark, sf):
    path = scratch_path(spark, "suppliers")
    s = tb.table(spark, sf, "supplier")
    s.write.option("header", True).option("sep", ";").csv(path)
    back = files.read_delimited(spark, path, "s_nationkey INT, s_acctbal DOUBLE", sep=";", columns=["s_nationkey", "s_acctbal"])
    return SUPPLIER.of(back.groupBy(F.col("s_nationkey").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.avg("s_acctbal").alias("balance")))


@query("io08_comma_csv", SUPPLIER.sql("", "SELECT c_nationkey AS region, count(*) AS n, avg(c_acctbal) AS balance FROM customer GROUP BY 1"))
def comma_csv(spark, sf):
    """Written with a header and read back under a declared schema."""
    path = scratch_path(spark, "customers")
    files.write_csv(tb.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), path)
    back = files.read_delimited(spark, path, "c_custkey BIGINT, c_nationkey INT, c_acctbal DOUBLE")
    return SUPPLIER.of(back.groupBy(F.col("c_nationkey").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("balance")))


MILES = Out(longs=("county1", "n"), doubles=("miles",))


@query("io10_tab_separated", MILES.sql("", "SELECT c_nationkey AS county1, count(*) AS n, sum(c_acctbal) AS miles FROM customer WHERE c_acctbal > 0 GROUP BY 1"))
def tab_separated(spark, sf):
    path = scratch_path(spark, "distances")
    c = tb.table(spark, sf, "customer").where("c_acctbal > 0")
    rows = c.select(F.col("c_nationkey").alias("county1"), F.col("c_custkey").alias("county2"), F.col("c_acctbal").alias("mi_to_county"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    back = files.read_delimited(spark, path, schemas.DISTANCES, sep="\t")
    return MILES.of(back.groupBy("county1").agg(F.count(F.lit(1)).alias("n"), F.sum("mi_to_county").alias("miles")))


TEXT_LABELS = Out(longs=("quality", "n"), strings=("longest",))


@query("io11_text_csv", TEXT_LABELS.sql("", "SELECT quality, count(*) AS n, max(CAST(doc_id AS VARCHAR)) AS longest FROM labels GROUP BY 1"))
def text_csv(spark, sf):
    """All columns stay text, so codes keep their zeros and sort as text."""
    path = scratch_path(spark, "labels")
    files.write_csv(tb.table(spark, sf, "labels"), path)
    back = files.read_delimited(spark, path)
    return TEXT_LABELS.of(back.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("longest")))


ANSWERED = Out(longs=("n", "n_flagged"))


@query(
    "io14_two_json_files",
    ANSWERED.sql(
        "a AS (SELECT DISTINCT md5(text) AS d, n_chars % 3 = 0 AS f FROM documents WHERE n_chars % 3 < 2),",
        "SELECT count(*) AS n, count(*) FILTER (f) AS n_flagged FROM a",
    ),
)
def two_json_files(spark, sf):
    """Answers written as two sets of JSON lines, read together and cleaned."""
    d = tb.table(spark, sf, "documents")
    answer = F.element_at(F.array(F.lit("accept"), F.lit("reject"), F.lit("ignore")), (F.col("n_chars") % 3 + 1).cast("int"))
    paths = [scratch_path(spark, f"answers{k}") for k in range(2)]
    for k, path in enumerate(paths):
        files.write_json_lines(d.where(F.col("doc_id") % 2 == k).select("text", answer.alias("answer")), path)
    clean = ev.clean_answers(files.read_json_lines(spark, paths, schemas.ANSWERS))
    return ANSWERED.of(clean.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_flagged").alias("n_flagged")))


@query("io04_dated_files", DAYS_POSTED.sql(POSTS_SQL, "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, count(*) FILTER (ref_id <> -1) AS n_shared, count(DISTINCT user_id) AS n_users FROM f WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY 1"))
def dated_files(spark, sf):
    """Daily folders of JSON lines, of which only those in the range are opened."""
    path = scratch_path(spark, "daily-posts")
    lines = posts_as_json(spark, sf).withColumnRenamed("file_date", "date")
    lines.hint("rebalance", "date").write.partitionBy("date").option("compression", "gzip").text(path)
    posts = ev.flatten_posts(files.posts_between(spark, path, "2024-01-08", "2024-01-21"))
    out = posts.groupBy(F.date_format("event_time", "yyyy-MM-dd").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ref_id") != -1).alias("n_shared"), F.count_distinct("user_id").alias("n_users")
    )
    return DAYS_POSTED.of(out)


WIDE_DAYS = Out(longs=("region", "n"), strings=("date",))


@query(
    "r01_wide_daily_file",
    WIDE_DAYS.sql(
        "o AS (SELECT c_nationkey AS region, date_trunc('month', o_orderdate) AS d, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), m AS (SELECT DISTINCT d FROM o), r AS (SELECT DISTINCT region FROM o)",
        "SELECT r.region, strftime(m.d, '%Y-%m-%d') AS date, o.n FROM r CROSS JOIN m LEFT JOIN o ON o.region = r.region AND o.d = m.d",
    ),
)
def wide_daily_file(spark, sf):
    """A file with four id columns and a column per date, written and read back by its header line."""
    path = scratch_path(spark, "wide")
    o = tb.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM-01").alias("month"))
    per_user = o.agg(F.count(F.lit(1)).alias("n")).join(tb.users(spark, sf), "user_id")
    wide = per_user.groupBy("region", F.lit("name").alias("name"), F.lit("kind").alias("kind"), (F.col("region") % 5).alias("code")).pivot("month").agg(F.sum("n"))
    files.write_csv(wide, path)
    return WIDE_DAYS.of(rg.wide_to_long(files.read_wide_days(spark, path), ["region", "name", "kind", "code"], "n").withColumn("date", F.date_format("date", "yyyy-MM-dd")))


CODES = Out(longs=("region", "n"), doubles=("gini",))


@query(
    "io12_second_header",
    CODES.sql("", "SELECT n_nationkey AS region, count(*) AS n, avg(round(c_acctbal, 1)) AS gini FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1"),
)
def second_header(spark, sf):
    """Estimates as text under a second header line; the region is the last five characters of an id."""
    c = tb.table(spark, sf, "customer")
    geo_id = F.concat(F.lit("0500000US"), codes.pad_code(F.col("c_nationkey")))
    rows = c.select(geo_id.alias("GEO_ID"), F.round("c_acctbal", 1).cast("string").alias("B19083_001E"))
    header = spark.createDataFrame([("Geography", "Estimate")], schemas.GINI)
    table = rg.gini_table(header.unionByName(rows))
    return CODES.of(table.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("gini").alias("gini")))


@query(
    "io12_second_header_file",
    CODES.sql("", "SELECT n_nationkey AS region, count(*) AS n, avg(round(c_acctbal, 1)) AS gini FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1"),
)
def second_header_file(spark, sf):
    """The same table written as a file whose first row repeats the header in words, and read back as text."""
    c = tb.table(spark, sf, "customer")
    geo_id = F.concat(F.lit("0500000US"), codes.pad_code(F.col("c_nationkey")))
    rows = c.select(geo_id.alias("GEO_ID"), F.round("c_acctbal", 1).cast("string").alias("B19083_001E"))
    path = scratch_path(spark, "gini")
    files.write_csv(spark.createDataFrame([("Geography", "Estimate")], schemas.GINI).unionByName(rows), path)
    table = rg.gini_table(files.read_delimited(spark, path))
    return CODES.of(table.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("gini").alias("gini")))


PLACES = Out(longs=("user_id", "region"), strings=("state", "county"))


@query(
    "io16_users_by_place",
    PLACES.sql(
        "",
        "SELECT c_custkey AS user_id, n_nationkey AS region, replace(r_name, '''', '') AS state, n_name AS county FROM customer "
        "JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
    ),
)
def users_by_place(spark, sf):
    """Location maps to users, location text cleaned, state and county looked up."""
    n = tb.table(spark, sf, "nation").join(tb.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = tb.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    location = F.when(
        F.col("c_custkey") % 2 == 0, F.format_string("['%s', '%s']", "n_name", "r_name")
    ).otherwise(F.format_string("[\"%s\", '%s']", "n_name", "r_name"))
    places = c.select(F.create_map(location, F.array("c_custkey")).alias("places"))
    states = n.select(F.lit("State").alias("geo_level"), F.col("r_name").alias("area_name"), F.col("n_regionkey").alias("state_code"),
                      F.lit(None).cast("bigint").alias("region")).distinct()
    counties = n.select(F.lit("County").alias("geo_level"), F.col("n_name").alias("area_name"), F.col("n_regionkey").alias("state_code"),
                        F.col("n_nationkey").cast("bigint").alias("region"))
    return PLACES.of(ev.locate_users(ev.users_by_place(places), states.unionByName(counties)))


POP = Out(longs=("region", "population"))


@query(
    "io17_rows_by_hand",
    POP.sql("", "SELECT n_regionkey * 1000 + n_nationkey AS region, count(*) AS population FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 "
            "UNION ALL SELECT * FROM (VALUES (2261, 9243), (2270, 8250))"),
)
def rows_by_hand(spark, sf):
    n = tb.regions(spark, sf)
    raw = n.select(codes.pad_code(F.col("state"), 2).alias("STATE"), codes.pad_code(F.col("region"), 3).alias("COUNTY"),
                   F.col("population").cast("string").alias("POPESTIMATE2020"))
    return POP.of(rg.population_table(raw, [(2261, 9243), (2270, 8250)]))


VAX = Out(strings=("date",), longs=("region", "state", "cumulative_vaccinations"), doubles=("fraction_vaccinated",))


@query(
    "pf10_vaccination_table",
    VAX.sql(
        "",
        """SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS date, o_custkey AS region, CAST(floor(o_custkey / 1000) AS BIGINT) AS state,
             CASE WHEN floor(o_custkey / 1000) = 1 AND o_orderdate < DATE '1998-06-01' THEN NULL ELSE o_orderkey END AS cumulative_vaccinations,
             CASE WHEN floor(o_custkey / 1000) = 1 AND o_orderdate < DATE '1998-06-01' THEN NULL ELSE o_totalprice / 100 END AS fraction_vaccinated
           FROM orders WHERE o_orderpriority <> '5-LOW'""",
    ),
)
def vaccination_table(spark, sf):
    """Text dates and codes (some 'UNK') parsed, percent to fraction, one state blanked before a date."""
    o = tb.table(spark, sf, "orders")
    raw = o.select(
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("Date"),
        F.when(F.col("o_orderpriority") == "5-LOW", "UNK").otherwise(F.col("o_custkey").cast("string")).alias("FIPS"),
        F.col("o_totalprice").alias("Series_Complete_Pop_Pct"),
        F.col("o_orderkey").alias("Series_Complete_Yes"),
    )
    out = rg.vaccination_table(raw, blank_state=1, blank_before="1998-06-01")
    return VAX.of(out.withColumn("date", F.date_format("date", "yyyy-MM-dd")))


COND = Out(longs=("id",), doubles=("floored", "finite"), flags=("answer",))


@query(
    "pf11_conditional_values",
    COND.sql(
        "",
        "SELECT c_custkey AS id, CASE WHEN c_acctbal <= 0 THEN 1e-5 ELSE c_acctbal END AS floored, ln(abs(nullif(c_acctbal, 0))) AS finite, "
        "CASE c_mktsegment WHEN 'BUILDING' THEN true WHEN 'MACHINERY' THEN false END AS answer FROM customer",
    ),
)
def conditional_values(spark, sf):
    c = tb.table(spark, sf, "customer")
    label = F.when(F.col("c_mktsegment") == "BUILDING", "accept").when(F.col("c_mktsegment") == "MACHINERY", "reject").otherwise("skip")
    return COND.of(
        c.select(
            F.col("c_custkey").alias("id"),
            codes.floor_at(F.col("c_acctbal")).alias("floored"),
            inf_to_null(F.ln(F.abs("c_acctbal"))).alias("finite"),
            ev.answer_flag(label).alias("answer"),
        )
    )


ANSWERS = Out(strings=("source",), longs=("n", "n_flagged"))


@query(
    "pf13_clean_answers",
    ANSWERS.sql(
        "a AS (SELECT DISTINCT d.source || ':' || d.lang AS source, md5(text) AS h, CASE quality WHEN 1 THEN true ELSE false END AS f FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 0)",
        "SELECT 'all' AS source, count(*) AS n, count(*) FILTER (f) AS n_flagged FROM (SELECT DISTINCT h, f FROM a)",
    ),
)
def clean_answers(spark, sf):
    d = tb.table(spark, sf, "documents").join(tb.table(spark, sf, "labels"), "doc_id")
    answer = F.when(F.col("toxic") == 1, "ignore").when(F.col("quality") == 1, "accept").otherwise("reject")
    out = ev.clean_answers(d.select("text", answer.alias("answer")))
    return ANSWERS.of(out.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_flagged").alias("n_flagged")).withColumn("source", F.lit("all")))


_KEYWORDS_SQL = " OR ".join("contains(lower(text), '" + k.replace("'", "''") + "')" for k in X.KEYWORDS)
KEYED = Out(longs=("doc_id",), flags=("hit", "hit_words"))


@query("pf16_keyword_match", KEYED.sql("", f"SELECT doc_id, ({_KEYWORDS_SQL}) AS hit, contains(lower(text), 'http') OR contains(lower(text), ' the ') AS hit_words FROM documents"))
def keyword_match(spark, sf):
    d = tb.table(spark, sf, "documents")
    return KEYED.of(d.select("doc_id", X.contains_any(F.col("text")).alias("hit"), X.contains_any(F.col("text"), ["http", " the "]).alias("hit_words")))


ORIGINALS = Out(longs=("event_id", "region"), strings=("date",))


@query("pf17_first_original", ORIGINALS.sql(tb.EV, "SELECT min(event_id) AS event_id, region, strftime(date, '%Y-%m-%d') AS date FROM ev WHERE ref_id = -1 GROUP BY 2, 3"))
def first_original(spark, sf):
    e = tb.located_events(spark, sf).where("ref_id = -1").select("event_id", "region", "date")
    return ORIGINALS.of(keep_first(e, ["region", "date"], ["event_id"]).withColumn("date", F.date_format("date", "yyyy-MM-dd")))


PADDED = Out(longs=("user_id", "state"), strings=("code",))


@query("f10_region_codes", PADDED.sql("", "SELECT c_custkey AS user_id, lpad(CAST(c_custkey AS VARCHAR), greatest(5, CAST(length(CAST(c_custkey AS VARCHAR)) AS INT)), '0') AS code, CAST(floor(c_custkey / 1000) AS BIGINT) AS state FROM customer"))
def region_codes(spark, sf):
    c = tb.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return PADDED.of(c.withColumns({"code": codes.pad_code(F.col("user_id")), "state": codes.state_of(F.col("user_id"))}))


# ---- events and users ----

KEY = {"longs": ("region",), "strings": ("date",)}


def _dated(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


SHARE = Out(longs=("n_total", "n_located"), doubles=("share_located",))


@query(
    "a23_located_share",
    SHARE.sql("", "SELECT count(*) AS n_total, count(c_custkey) AS n_located, count(c_custkey) / count(*) AS share_located FROM events LEFT JOIN "
              "(SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = user_id"),
)
def located_share(spark, sf):
    known = tb.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return SHARE.of(ev.located_share(tb.raw_events(spark, sf), known))


EVENTS = Out(longs=("event_id", "user_id", "region", "flag", "ref_id"), strings=("date",))


@query("j01_geotag_events", EVENTS.sql(tb.EV, "SELECT event_id, user_id, region, flag, ref_id, strftime(date, '%Y-%m-%d') AS date FROM ev"))
def geotag_events(spark, sf):
    return EVENTS.of(_dated(tb.located_events(spark, sf)))


_ACTIVITY = Out(longs=("region", *tb.COUNTS), strings=("date",))
_ACTIVITY_SELECT = f"SELECT region, strftime(date, '%Y-%m-%d') AS date, {', '.join(tb.COUNTS)} FROM act"


@query("a01_daily_activity", _ACTIVITY.sql(tb.EV + tb.AC, _ACTIVITY_SELECT))
def daily_activity(spark, sf):
    return _ACTIVITY.of(_dated(tb.activity(spark, sf)))


@query("a02_activity_copied_refs", _ACTIVITY.sql(tb.EV + tb.AC, f"SELECT * REPLACE (n_flagged AS n_flagged_refs, n_events AS n_refs) FROM ({_ACTIVITY_SELECT})"))
def activity_copied_refs(spark, sf):
    return _ACTIVITY.of(_dated(ev.daily_activity(tb.located_events(spark, sf), copy_counts=True)))


@query("a04_activity_new_user_days", _ACTIVITY.sql(tb.EV + tb.AC, f"{_ACTIVITY_SELECT} WHERE (region, date) IN (SELECT (region, date) FROM fst)"))
def activity_new_user_days(spark, sf):
    return _ACTIVITY.of(_dated(ev.daily_activity(tb.located_events(spark, sf), keep_all_days=False)))


LABELS = Out(longs=("user_id",), flags=("user_flag",))


@query("a03_user_majority", LABELS.sql(tb.EV + tb.AC, "SELECT user_id, user_flag FROM lab"))
def user_majority(spark, sf):
    return LABELS.of(ev.user_majority(tb.located_events(spark, sf)))


NEW = Out(longs=("region", "n_new_flagged_users", "n_new_users"), strings=("date",))


@query("a04_new_users", NEW.sql(tb.EV + tb.AC, "SELECT region, strftime(date, '%Y-%m-%d') AS date, n_new_flagged_users, n_new_users FROM nw"))
def new_users(spark, sf):
    e = tb.located_events(spark, sf)
    return NEW.of(_dated(ev.new_users(e, ev.user_majority(e))))


ACTIVE = Out(longs=("region", "n_active_flagged_users", "n_active_users"), strings=("date",))


@query("a05_active_users", ACTIVE.sql(tb.EV + tb.AC, "SELECT region, strftime(date, '%Y-%m-%d') AS date, n_active_flagged_users, n_active_users FROM atv"))
def active_users(spark, sf):
    e = tb.located_events(spark, sf)
    return ACTIVE.of(_dated(ev.active_users(e, ev.user_majority(e))))


COUNTED = Out(strings=("value",), longs=("n",))


@query("a11_value_counts", COUNTED.sql("", "SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1"))
def value_counts(spark, sf):
    return COUNTED.of(ev.value_counts(tb.table(spark, sf, "documents"), "source").withColumnRenamed("source", "value"))


TEXTS = Out(longs=("doc_id", "n_chars"), strings=("lang",))


@query("a13_first_per_text", TEXTS.sql("", "SELECT doc_id, n_chars, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"))
def first_per_text(spark, sf):
    d = tb.table(spark, sf, "documents").select(ev.text_digest("text").alias("digest"), "doc_id", "n_chars", "lang")
    return TEXTS.of(keep_first(d, ["digest"], ["doc_id"]))


DISTINCTS = Out(longs=("n_parts", "n_suppliers", "n_days"))


@query("a14_count_distinct", DISTINCTS.sql("", "SELECT count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_shipdate) AS n_days FROM lineitem"))
def distinct_counts(spark, sf):
    return DISTINCTS.of(count_distincts(tb.table(spark, sf, "lineitem"), {"l_partkey": "n_parts", "l_suppkey": "n_suppliers", "l_shipdate": "n_days"}))


COVER = Out(strings=("source", "code"))


@query(
    "e15_region_coverage",
    COVER.sql("", "SELECT DISTINCT 'customers' AS source, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS code FROM customer UNION ALL "
              "SELECT DISTINCT 'suppliers', lpad(CAST(s_nationkey AS VARCHAR), 5, '0') FROM supplier"),
)
def region_coverage(spark, sf):
    return COVER.of(rg.coverage({"customers": tb.users(spark, sf), "suppliers": tb.suppliers(spark, sf)}))


ATTR = Out(longs=("region", "state", "population", "suppliers"), doubles={"balance": 6, "supplier_balance": 6})


@query("j02_attribute_chain", ATTR.sql(tb.RG + tb.SP, "SELECT rg.*, supplier_balance, suppliers FROM rg LEFT JOIN sp USING (region)"))
def attribute_chain(spark, sf):
    return ATTR.of(rg.attach_attributes(tb.regions(spark, sf), [tb.suppliers(spark, sf)]))


TOGETHER = Out(longs=("region", "n_events", "n_orders"), strings=("date",))


@query(
    "j03_full_outer",
    TOGETHER.sql(
        tb.EV + tb.SO + "a AS (SELECT region, CAST(date + INTERVAL 1 DAY - INTERVAL 24 YEAR AS DATE) AS date, count(*) AS n_events FROM ev GROUP BY 1, 2)",
        "SELECT region, strftime(date, '%Y-%m-%d') AS date, n_events, n AS n_orders FROM a FULL JOIN so USING (region, date)",
    ),
)
def full_outer(spark, sf):
    """Daily events moved back 24 years beside daily orders; a day missing on either side stays."""
    shifted = tb.located_events(spark, sf).withColumn("date", F.add_months(F.date_add("date", 1), -288))
    a = shifted.groupBy("region", "date").agg(F.count(F.lit(1)).alias("n_events"))
    o = tb.sparse_orders(spark, sf).select("region", "date", F.col("n").alias("n_orders"))
    return TOGETHER.of(_dated(a.join(o, ["region", "date"], "full")))


PREDICTED = Out(longs=("doc_id", "label"))


@query("j11_attach_predictions", PREDICTED.sql("", "SELECT doc_id, CAST(contains(text, 'e the') AS INT) AS label FROM documents"))
def attach_predictions(spark, sf):
    """Each distinct text is labelled once and the label joined back to all its copies."""
    d = tb.table(spark, sf, "documents").select("doc_id", "text")
    labels = ev.distinct_texts(d).withColumn("label", F.contains("text", F.lit("e the")).cast("int"))
    return PREDICTED.of(ev.attach_predictions(d, labels, spread=["doc_id"]))

"""The roles of the analysis played by the given tables.

Each role has a DataFrame here and a SQL common table expression beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import events as ev
from panelspark.operators import network as nw
from panelspark.operators import panel as pn
from panelspark.operators.skew import salted_join
from panelspark.session import cut_lineage


SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
    "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is declared, so no file is opened before the query runs."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


# ---- events: located users' events with a flag and a referenced event ----


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        "event_id",
        "user_id",
        F.col("ts").alias("event_time"),
        F.to_date("ts").alias("date"),
        (F.col("event_type") == "error").cast("int").alias("flag"),
        F.when(F.col("event_type") == "view", F.col("event_id") - k).otherwise(F.lit(-1)).alias("ref_id"),
        "event_type",
        "value",
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("region"))


def network(spark: SparkSession, sf: str, **bounds: str) -> DataFrame:
    return nw.reference_network(raw_events(spark, sf), users=users(spark, sf), **bounds)


def stored_network(spark: SparkSession, sf: str) -> DataFrame:
    """The network written to the shared folder once: several later steps read it, and it is small beside the events."""
    return cut_lineage(network(spark, sf))


def located_events(spark: SparkSession, sf: str) -> DataFrame:
    return ev.geotag(raw_events(spark, sf), users(spark, sf))


EV = """
ev AS (
  SELECT e.event_id, e.user_id, e.ts AS event_time, CAST(e.ts AS DATE) AS date, e.event_type, e.value,
         CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END AS flag,
         CASE WHEN e.event_type = 'view' THEN e.event_id - CAST(regexp_extract(e.props, '[0-9]+') AS BIGINT) ELSE -1 END AS ref_id,
         c.c_nationkey AS region
  FROM events e JOIN customer c ON c.c_custkey = e.user_id),
"""


# ---- regions ----


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """(region, state, population, balance)."""
    people = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("region")).agg(
        F.count(F.lit(1)).alias("population"), F.avg("c_acctbal").alias("balance")
    )
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("region"), F.col("n_regionkey").alias("state"))
    return nations.join(people, "region")


RG = """
rg AS MATERIALIZED (
  SELECT n.n_nationkey AS region, n.n_regionkey AS state, c.population, c.balance
  FROM nation n JOIN (SELECT c_nationkey, count(*) AS population, avg(c_acctbal) AS balance FROM customer GROUP BY 1) c
    ON c.c_nationkey = n.n_nationkey),
"""

SP = """
sp AS (SELECT s_nationkey AS region, avg(s_acctbal) AS supplier_balance, count(*) AS suppliers FROM supplier GROUP BY 1),
"""


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("region")).agg(
        F.avg("s_acctbal").alias("supplier_balance"), F.count(F.lit(1)).alias("suppliers")
    )


# ---- activity panel: region x day counts of events ----

COUNTS = ["n_flagged", "n_events", "n_flagged_refs", "n_refs", "n_new_flagged_users", "n_new_users", "n_active_flagged_users", "n_active_users"]
TOTALS = {c: "cumulative" + c[1:] for c in COUNTS}


def activity(spark: SparkSession, sf: str) -> DataFrame:
    return ev.daily_activity(raw_events(spark, sf), users(spark, sf))


def activity_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts for every region and day, with running totals and the population."""
    rg = regions(spark, sf)
    days = table(spark, sf, "events").select(F.to_date("ts").alias("date"))
    full = pn.fill_calendar(activity(spark, sf), rg.select("region", "state", "population"), COUNTS, bounds=days)
    return pn.running_total(full, TOTALS)


AC = """
lab AS (SELECT user_id, sum(CASE WHEN flag = 1 THEN 1 ELSE 0 END) > sum(CASE WHEN flag = 0 THEN 1 ELSE 0 END) AS user_flag FROM ev GROUP BY 1),
cnt AS (SELECT region, date, sum(flag) AS n_flagged, count(flag) AS n_events FROM ev GROUP BY 1, 2),
rfs AS (SELECT region, date, sum(flag) AS n_flagged_refs, count(flag) AS n_refs FROM ev WHERE ref_id <> -1 GROUP BY 1, 2),
fst AS (SELECT region, user_id, min(date) AS date FROM ev GROUP BY 1, 2),
nw AS (SELECT region, date, sum(CAST(user_flag AS INT)) AS n_new_flagged_users, count(user_flag) AS n_new_users
       FROM fst JOIN lab USING (user_id) GROUP BY 1, 2),
atv AS (SELECT region, date, sum(CAST(user_flag AS INT)) AS n_active_flagged_users, count(user_flag) AS n_active_users
        FROM (SELECT DISTINCT user_id, region, date FROM ev) JOIN lab USING (user_id) GROUP BY 1, 2),
act AS (SELECT region, date, n_flagged, n_events, n_flagged_refs, n_refs,
               coalesce(n_new_flagged_users, 0) AS n_new_flagged_users, coalesce(n_new_users, 0) AS n_new_users,
               n_active_flagged_users, n_active_users
        FROM cnt LEFT JOIN rfs USING (region, date) LEFT JOIN nw USING (region, date) LEFT JOIN atv USING (region, date)),
"""

AP = (
    EV
    + RG
    + AC
    + """
grid AS (SELECT rg.region, rg.state, rg.population, CAST(d.date AS DATE) AS date
         FROM rg, (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS date FROM events) d),
ap0 AS (SELECT grid.region, grid.state, grid.population, grid.date, """
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNTS)
    + """ FROM grid LEFT JOIN act ON act.region = grid.region AND act.date = grid.date),
ap AS MATERIALIZED (SELECT *, """
    + ", ".join(f"sum({c}) OVER (PARTITION BY region ORDER BY date) AS {t}" for c, t in TOTALS.items())
    + " FROM ap0),\n"
)


# ---- network of references between regions ----

NW = """
own AS (SELECT DISTINCT event_id AS ref_id, region AS dst FROM ev),
net AS MATERIALIZED (SELECT e.region AS src, own.dst, count(*) AS n_refs,
               count(*) / (SELECT CAST((epoch_us(max(event_time)) - epoch_us(min(event_time))) // 86400000000 AS DOUBLE) FROM ev) AS n_refs_per_day
        FROM ev e JOIN own ON own.ref_id = e.ref_id WHERE e.ref_id <> -1 GROUP BY 1, 2),
edg AS MATERIALIZED (SELECT src, dst, n_refs_per_day / sum(n_refs_per_day) OVER (PARTITION BY src) AS weight FROM net),
"""


# ---- order panel: a long series of region x day cumulative counts ----


def order_panel(spark: SparkSession, sf: str) -> DataFrame:
    """(region, date, population, state, V, C, D, U): running order counts for every region and day.

    V counts open, C filled, D pending and U urgent orders.
    """
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("date"), "o_orderstatus", "o_orderpriority"
    )
    # reduced per customer and day first, so one customer's orders never meet the join row by row
    per_user = o.groupBy("user_id", "date").agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("V"),
        F.count_if(F.col("o_orderstatus") == "F").alias("C"),
        F.count_if(F.col("o_orderstatus") == "P").alias("D"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("U"),
    )
    cols = ["V", "C", "D", "U"]
    daily = per_user.join(users(spark, sf), "user_id").groupBy("region", "date").agg(*[F.sum(c).alias(c) for c in cols])
    rg = regions(spark, sf)
    full = pn.fill_calendar(daily, rg.select("region", "state", "population"), cols, bounds=o)
    return pn.running_total(full, {c: c for c in cols})


OP = (
    RG
    + """
od AS (SELECT c.c_nationkey AS region, CAST(o_orderdate AS DATE) AS date,
              sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS V, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS C,
              sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS D, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS U
       FROM orders JOIN customer c ON c.c_custkey = o_custkey GROUP BY 1, 2),
ogrid AS (SELECT rg.region, rg.state, rg.population, CAST(d.date AS DATE) AS date
          FROM rg, (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS date FROM orders) d),
op AS MATERIALIZED (SELECT g.region, g.state, g.population, g.date, """
    + ", ".join(f"CAST(sum(coalesce(od.{c}, 0)) OVER (PARTITION BY g.region ORDER BY g.date) AS BIGINT) AS {c}" for c in "VCDU")
    + """ FROM ogrid g LEFT JOIN od ON od.region = g.region AND od.date = g.date),
"""
)


def sparse_orders(spark: SparkSession, sf: str) -> DataFrame:
    """(region, date, n, price): daily order counts and mean price, only for days with orders."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("date"))
    per_user = o.agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    daily = per_user.join(users(spark, sf), "user_id").groupBy("region", "date").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return daily.select("region", "date", "n", (F.col("s") / F.col("n")).alias("price"))


def located_orders(spark: SparkSession, sf: str) -> DataFrame:
    """(o_orderkey, o_totalprice, region); a customer with very many orders is spread over many tasks."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_totalprice")
    return salted_join(o, users(spark, sf), ["user_id"], spread=["o_orderkey"]).drop("user_id")


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, n): order lines by customer and supplier region, counted per supplier before its region is joined."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    src = located_orders(spark, sf).select(F.col("o_orderkey").alias("l_orderkey"), F.col("region").alias("src"))
    per_supplier = line.join(src, "l_orderkey").groupBy("l_suppkey", "src").agg(F.count(F.lit(1)).alias("n"))
    supp = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    return per_supplier.join(supp, "l_suppkey").groupBy("src", "dst").agg(F.sum("n").alias("n"))


SO = """
so AS (SELECT c.c_nationkey AS region, CAST(o_orderdate AS DATE) AS date, count(*) AS n, avg(o_totalprice) AS price
       FROM orders JOIN customer c ON c.c_custkey = o_custkey GROUP BY 1, 2),
"""


# ---- posterior draws ----


def draws(spark: SparkSession, sf: str) -> DataFrame:
    """(chain, draw, v): one row per draw with an array of values."""
    e = table(spark, sf, "embeddings")
    return e.select((F.col("vec_id") % 4).alias("chain"), F.floor(F.col("vec_id") / 4).alias("draw"), F.col("embedding").cast("array<double>").alias("v"))


def long_draws(spark: SparkSession, sf: str) -> DataFrame:
    return draws(spark, sf).select("chain", "draw", F.posexplode("v").alias("idx", "value"))


DR = """
dr AS (SELECT vec_id % 4 AS chain, vec_id // 4 AS draw, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ld AS (SELECT chain, draw, unnest(range(0, len(v))) AS idx, unnest(v) AS value FROM dr),
"""

"""Queries on the region-by-date panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.codes import blend_lag1
from panelspark.operators import network as nw
from panelspark.operators import panel as pn
from panelspark.operators import regions as rg
from panelspark.plans import tables as tb
from panelspark.plans.registry import Out, query
from panelspark.session import cut_lineage


def dated(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


KEYS = "region, strftime(date, '%Y-%m-%d') AS date"

# The calendar of ``op`` has no gaps, so a lag by days is one by rows.
CALENDAR = "WINDOW w AS (PARTITION BY region ORDER BY date)"


# ---- flagship: events to exposure ----

FLAG = Out(longs=("region", "n_events", "n_flagged", "cumulative_events", "cumulative_flagged", "flagged_lag1"), strings=("date",), doubles={"rate": 6, "exposure": 9})


@query(
    "flagship_exposure",
    FLAG.sql(
        tb.AP + tb.NW,
        f"""SELECT {KEYS}, n_events, n_flagged, cumulative_events, cumulative_flagged, flagged_lag1, rate, exposure FROM (
          SELECT a.*, b.cumulative_flagged AS flagged_lag1, CAST(a.cumulative_flagged - b.cumulative_flagged AS DOUBLE) AS rate,
            (SELECT CASE WHEN count(edg.src) > 0 THEN sum(edg.weight * x.cumulative_flagged) END
             FROM edg JOIN ap x ON x.region = edg.dst AND x.date = a.date WHERE edg.src = a.region) / a.population AS exposure
          FROM ap a JOIN ap b ON b.region = a.region AND b.date + 1 = a.date)""",
    ),
)
def flagship(spark, sf):
    """Daily activity with running totals, its one-day rate, and exposure to other regions' flagged events."""
    panel = cut_lineage(tb.activity_panel(spark, sf))
    cols = ["region", "date", "population", "n_events", "n_flagged", "cumulative_events", "cumulative_flagged"]
    edges = nw.interaction_edges(tb.stored_network(spark, sf), tb.users(spark, sf))
    exposed = nw.neighbour_mean(panel.select(*cols), ["cumulative_flagged"], edges, "_near")
    out = pn.calendar_lag(exposed, ["cumulative_flagged"], [1])
    return FLAG.of(
        dated(out).withColumns(
            {
                "flagged_lag1": F.col("cumulative_flagged_tlag1"),
                "rate": F.col("cumulative_flagged") - F.col("cumulative_flagged_tlag1"),
                "exposure": F.col("cumulative_flagged_near") / F.col("population"),
            }
        )
    )


# ---- running totals, lags, rates ----

_TOT = Out(longs=("region", *tb.TOTALS.values()), strings=("date",))


@query("p01_running_totals", _TOT.sql(tb.AP, f"SELECT {KEYS}, {', '.join(tb.TOTALS.values())} FROM ap"))
def running_totals(spark, sf):
    return _TOT.of(dated(tb.activity_panel(spark, sf)))


_LAG = Out(longs=("region", "C", "C_tlag1", "C_tlag7", "V_tlag1", "V_tlag7"), strings=("date",))


@query(
    "p02_calendar_lag",
    _LAG.sql(
        tb.SO + "x AS (SELECT region, date, n AS C, CAST(floor(price * n + 0.001) AS BIGINT) AS V FROM so)",
        f"SELECT x.region, strftime(x.date, '%Y-%m-%d') AS date, x.C, a.C AS C_tlag1, b.C AS C_tlag7, a.V AS V_tlag1, b.V AS V_tlag7 "
        "FROM x JOIN x a ON a.region = x.region AND a.date + 1 = x.date JOIN x b ON b.region = x.region AND b.date + 7 = x.date",
    ),
)
def calendar_lag(spark, sf):
    """On a panel with gaps: rows without both lagged days are dropped."""
    x = tb.sparse_orders(spark, sf).select("region", "date", F.col("n").alias("C"), F.floor(F.col("price") * F.col("n") + 0.001).alias("V"))
    return _LAG.of(dated(pn.calendar_lag(x, ["C", "V"], [1, 7])))


_RATE = Out(longs=("region",), strings=("date",), doubles=("V_dxdt1", "V_dxdt8", "C_dxdt1", "C_dxdt8"))


@query(
    "p03_rate_of_change",
    _RATE.sql(
        tb.OP,
        f"SELECT {KEYS}, V - lag(V, 1) OVER w AS V_dxdt1, (V - lag(V, 8) OVER w) / 8 AS V_dxdt8, C - lag(C, 1) OVER w AS C_dxdt1, (C - lag(C, 8) OVER w) / 8 AS C_dxdt8 "
        f"FROM op {CALENDAR} QUALIFY row_number() OVER w > 8",
    ),
)
def rate_of_change(spark, sf):
    return _RATE.of(dated(pn.rate_of_change(tb.order_panel(spark, sf), ["V", "C"], [1, 8])))


LAGS = list(range(2, 21))
_MANY = Out(longs=("region", "C", *[f"C_tlag{n}" for n in LAGS]), strings=("date",))


@query(
    "p04_many_lags",
    _MANY.sql(
        tb.OP,
        f"SELECT {KEYS}, C, " + ", ".join(f"lag(C, {n}) OVER w AS C_tlag{n}" for n in LAGS) + f" FROM op {CALENDAR} QUALIFY row_number() OVER w > {LAGS[-1]}",
    ),
)
def many_lags(spark, sf):
    """Nineteen lags of one measure from one exchange and one sort."""
    return _MANY.of(dated(pn.calendar_lag(tb.order_panel(spark, sf), ["C"], LAGS)))


_BULK = Out(longs=("region", "V_tlag1"), strings=("date",), doubles=("V_dxdt1", "V_dxdt8", "V_dxdt1_tlag1", "V_dxdt8_tlag1"))


@query(
    "p04_lag_of_rates",
    _BULK.sql(
        tb.OP
        + """r AS (SELECT op.region, op.date, op.V, op.V - a.V AS d1, (op.V - b.V) / 8 AS d8
             FROM op JOIN op a ON a.region = op.region AND a.date + 1 = op.date JOIN op b ON b.region = op.region AND b.date + 8 = op.date)""",
        "SELECT r.region, strftime(r.date, '%Y-%m-%d') AS date, l.V AS V_tlag1, r.d1 AS V_dxdt1, r.d8 AS V_dxdt8, l.d1 AS V_dxdt1_tlag1, l.d8 AS V_dxdt8_tlag1 "
        "FROM r JOIN r l ON l.region = r.region AND l.date + 1 = r.date",
    ),
)
def lag_of_rates(spark, sf):
    """Lags are taken of the measures and of their rates alike."""
    p = tb.order_panel(spark, sf).select("region", "date", "V")
    rates = pn.rate_of_change(p, ["V"], [1, 8])
    return _BULK.of(dated(pn.calendar_lag(rates, ["V", "V_dxdt1", "V_dxdt8"], [1])))


_CAP = Out(longs=("region",), strings=("date",), doubles=("V_per_capita", "C_per_capita"))


@query("p05_per_capita", _CAP.sql(tb.OP, f"SELECT {KEYS}, V / population AS V_per_capita, C / population AS C_per_capita FROM op"))
def per_capita(spark, sf):
    return _CAP.of(dated(pn.per_capita(tb.order_panel(spark, sf), ["V", "C"])))


# ---- monotonic repair, smoothing, interpolation ----

_MONO = Out(longs=("region",), flags=("V", "n"))


@query(
    "p06_is_monotonic",
    _MONO.sql(
        tb.OP + tb.SO,
        """SELECT region, v AS V, n FROM
           (SELECT region, bool_and(V >= p OR p IS NULL) AS v FROM (SELECT region, V, lag(V) OVER (PARTITION BY region ORDER BY date) AS p FROM op) GROUP BY 1)
           JOIN (SELECT region, bool_and(n >= p OR p IS NULL) AS n FROM (SELECT region, n, lag(n) OVER (PARTITION BY region ORDER BY date) AS p FROM so) GROUP BY 1) USING (region)""",
    ),
)
def is_monotonic(spark, sf):
    a = pn.is_monotonic(tb.order_panel(spark, sf), ["V"])
    b = pn.is_monotonic(tb.sparse_orders(spark, sf), ["n"])
    return _MONO.of(a.join(b, "region"))


_REP = Out(longs=("region",), strings=("date",), doubles={"last_wins": 6, "first_wins": 6})


@query(
    "p07_make_monotonic",
    _REP.sql(
        tb.SO,
        f"SELECT {KEYS}, min(price) OVER (PARTITION BY region ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last_wins, "
        "max(price) OVER (PARTITION BY region ORDER BY date) AS first_wins FROM so",
    ),
)
def make_monotonic(spark, sf):
    s = tb.sparse_orders(spark, sf).withColumns({"last_wins": F.col("price"), "first_wins": F.col("price")})
    out = pn.make_monotonic(s, ["last_wins"])
    return _REP.of(dated(pn.make_monotonic(out, ["first_wins"], prioritize_last=False)))


_EPS = Out(longs=("region",), strings=("date",), doubles=("last_wins", "first_wins"))


@query(
    "p09_monotonic_epsilon",
    _EPS.sql(
        "RECURSIVE "
        + tb.SO.strip()
        + """
        x AS (SELECT region, date, n, row_number() OVER (PARTITION BY region ORDER BY date) AS i, count(*) OVER (PARTITION BY region) AS m FROM so),
        b AS (SELECT region, i, CAST(n AS DOUBLE) AS y FROM x WHERE i = m
              UNION ALL SELECT x.region, x.i, CASE WHEN x.n < b.y THEN x.n ELSE b.y - 1e-5 END FROM b JOIN x ON x.region = b.region AND x.i = b.i - 1),
        f AS (SELECT region, i, CAST(n AS DOUBLE) AS y FROM x WHERE i = 1
              UNION ALL SELECT x.region, x.i, CASE WHEN x.n > f.y THEN x.n ELSE f.y + 1e-5 END FROM f JOIN x ON x.region = f.region AND x.i = f.i + 1)""",
        "SELECT x.region, strftime(x.date, '%Y-%m-%d') AS date, b.y AS last_wins, f.y AS first_wins FROM x JOIN b USING (region, i) JOIN f USING (region, i)",
    ),
)
def monotonic_epsilon(spark, sf):
    s = tb.sparse_orders(spark, sf).select("region", "date", F.col("n").alias("last_wins"), F.col("n").alias("first_wins"))
    out = pn.make_monotonic(s, ["last_wins"], 1e-5)
    return _EPS.of(dated(pn.make_monotonic(out, ["first_wins"], 1e-5, prioritize_last=False)))


def _smooth_sql(window: int, order: int, col: str) -> str:
    """Weights by place: each row takes the window that fits inside its series and the fit's row for its place in it."""
    fit = pn.polynomial_fit_rows(window, order)
    half = window // 2
    rows = ", ".join(f"({r}, {k}, CAST({fit[r, k]!r} AS DOUBLE))".replace("np.float64(", "").replace(") AS DOUBLE", " AS DOUBLE") for r in range(window) for k in range(window))
    return f"""
    wgt AS (SELECT * FROM (VALUES {rows}) t(r, k, w)),
    pos AS (SELECT region, date, {col} AS x, row_number() OVER (PARTITION BY region ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY region) AS m FROM src),
    st AS (SELECT *, least(greatest(i - {half}, 0), m - {window}) AS s FROM pos),
    sm AS (SELECT st.region, st.date, sum(wgt.w * p.x) AS y FROM st JOIN wgt ON wgt.r = st.i - st.s JOIN pos p ON p.region = st.region AND p.i = st.s + wgt.k GROUP BY 1, 2)
    """


_SM = Out(longs=("region",), strings=("date",), doubles=("price",))


@query("p10_smooth", _SM.sql(tb.SO + "src AS (SELECT * FROM so)," + _smooth_sql(9, 1, "price"), f"SELECT {KEYS}, y AS price FROM sm"))
def smooth(spark, sf):
    return _SM.of(dated(pn.smooth(tb.sparse_orders(spark, sf), ["price"], 9, 1)))


_SM2 = Out(longs=("region",), strings=("date",), doubles={"n_events": 5})


@query(
    "p10_smooth_drop_ends",
    _SM2.sql(
        tb.AP + "src AS (SELECT * FROM ap)," + _smooth_sql(7, 2, "n_events") + ", k AS (SELECT date, row_number() OVER (ORDER BY date) AS a, row_number() OVER (ORDER BY date DESC) AS b FROM (SELECT DISTINCT date FROM src))",
        f"SELECT {KEYS}, y AS n_events FROM sm WHERE date IN (SELECT date FROM k WHERE a > 7 AND b > 7)",
    ),
)
def smooth_drop_ends(spark, sf):
    """An even window is made odd; the window's width of dates goes at both ends."""
    p = tb.activity_panel(spark, sf).select("region", "date", "n_events")
    return _SM2.of(dated(pn.smooth(p, ["n_events"], 6, 2, drop_ends=True)))


GAPS = """
g AS (SELECT region, date, CASE WHEN n % 3 = 0 THEN NULL ELSE CAST(n AS DOUBLE) END AS x FROM so),
h AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date) AS i, date - DATE '1970-01-01' AS d FROM g),
k AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY region ORDER BY i) AS ia,
        min(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY region ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM h),
"""
_INT = Out(longs=("region",), strings=("date",), doubles=("by_position", "by_date"))


@query(
    "p11_interpolate",
    _INT.sql(
        tb.SO + GAPS,
        "SELECT k.region, strftime(k.date, '%Y-%m-%d') AS date, coalesce(k.x, a.x + (b.x - a.x) * (k.i - a.i) / (b.i - a.i)) AS by_position, "
        "coalesce(k.x, a.x + (b.x - a.x) * (k.d - a.d) / (b.d - a.d)) AS by_date "
        "FROM k LEFT JOIN h a ON a.region = k.region AND a.i = k.ia LEFT JOIN h b ON b.region = k.region AND b.i = k.ib",
    ),
)
def interpolate(spark, sf):
    s = tb.sparse_orders(spark, sf)
    gap = F.when(F.col("n") % 3 == 0, None).otherwise(F.col("n"))
    s = s.select("region", "date", gap.alias("by_position"), gap.alias("by_date"))
    return _INT.of(dated(pn.interpolate(pn.interpolate(s, "by_position"), "by_date", by="date")))


_EXP = Out(longs=("region", "V"), strings=("date",), doubles=("price",))


@query(
    "p12_expand_dates",
    _EXP.sql(
        tb.OP
        + tb.SO
        + """m AS (SELECT region, date, price FROM so WHERE day(date) = 1),
        e AS (SELECT op.region, op.date, op.V, m.price FROM op LEFT JOIN m USING (region, date)
              WHERE op.date BETWEEN (SELECT min(date) FROM m) AND (SELECT max(date) FROM m) AND op.region IN (SELECT region FROM m)),
        h AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date) AS i FROM e),
        k AS (SELECT *, max(CASE WHEN price IS NOT NULL THEN i END) OVER (PARTITION BY region ORDER BY i) AS ia,
              min(CASE WHEN price IS NOT NULL THEN i END) OVER (PARTITION BY region ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM h)""",
        "SELECT k.region, strftime(k.date, '%Y-%m-%d') AS date, k.V, coalesce(k.price, a.price + (b.price - a.price) * (k.i - a.i) / (b.i - a.i)) AS price "
        "FROM k LEFT JOIN h a ON a.region = k.region AND a.i = k.ia LEFT JOIN h b ON b.region = k.region AND b.i = k.ib",
    ),
)
def expand_dates(spark, sf):
    """Values known on the first of a month, filled to every day between."""
    m = tb.sparse_orders(spark, sf).where("day(date) = 1").select("region", "date", "price")
    full = pn.expand_dates(tb.order_panel(spark, sf).select("region", "date", "V"), m)
    return _EXP.of(dated(pn.interpolate(full, "price")))


# ---- time steps ----

_T = Out(longs=("region", "t"), strings=("date",))


@query("p13_time_index", _T.sql(tb.SO, f"SELECT {KEYS}, dense_rank() OVER (ORDER BY date) - 1 AS t FROM so"))
def time_index(spark, sf):
    return _T.of(dated(pn.time_index(tb.sparse_orders(spark, sf))))


_THIN = Out(longs=("region", "V"), strings=("date",))


@query(
    "p14_thin_dates",
    _THIN.sql(
        tb.OP
        + """d AS (SELECT date FROM op GROUP BY date HAVING median(V) > 0),
        e AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS r FROM d),
        f AS (SELECT date FROM e WHERE (r - 1) % 8 = 0 ORDER BY date LIMIT 24)""",
        f"SELECT {KEYS}, V FROM op WHERE date IN (SELECT date FROM f WHERE date < DATE '1995-06-01')",
    ),
)
def thin_dates(spark, sf):
    return _THIN.of(dated(pn.thin_dates(tb.order_panel(spark, sf), "V", before="1995-06-01")))


_COMP = Out(longs=("region", "N", "V", "D", "C", "R", "I", "S", "T_a"), strings=("date",))
_COMP_SQL = (
    "comp AS MATERIALIZED (SELECT region, date, population AS N, V, D, C, lag(C, 8) OVER w AS R, C - lag(C, 8) OVER w AS I, population - (C + V) AS S, U AS T_a "
    f"FROM op {CALENDAR} QUALIFY row_number() OVER w > 8),"
)


def compartments_of(spark, sf):
    return pn.compartments(tb.order_panel(spark, sf), vaccinated="V", deaths="D", cases="C", produced="U")


@query("p15_compartments", _COMP.sql(tb.OP + _COMP_SQL, f"SELECT {KEYS}, N, V, D, C, R, I, S, T_a FROM comp"))
def compartments(spark, sf):
    return _COMP.of(dated(compartments_of(spark, sf)))


_INTER = Out(longs=("region", "SxI", "const"), strings=("date",), doubles=("Sx1mA", "1mA"))


@query("p16_interactions", _INTER.sql(tb.OP + _COMP_SQL, f"SELECT {KEYS}, S * I AS SxI, S * (1 - T_a / (N + 10.0)) AS \"Sx1mA\", 1 - T_a / (N + 10.0) AS \"1mA\", 1 AS const FROM comp"))
def interactions(spark, sf):
    c = compartments_of(spark, sf).withColumn("A", F.col("T_a") / (F.col("N") + 10.0))
    return _INTER.of(dated(pn.interactions(c)))


_ARR = Out(longs=("region", "i", "C"), strings=("date",))


@query(
    "r03_lag_array",
    _ARR.sql(tb.OP, "SELECT op.region, strftime(op.date, '%Y-%m-%d') AS date, i, a.C FROM op, range(0, 4) t(i) JOIN op a ON a.region = op.region AND a.date + CAST(i AS INT) = op.date WHERE op.date >= (SELECT min(date) + 3 FROM op)"),
)
def lag_array(spark, sf):
    lagged = pn.calendar_lag(tb.order_panel(spark, sf).select("region", "date", "C"), ["C"], [1, 2, 3])
    packed = pn.lag_array(lagged, "C", [1, 2, 3], "lags")
    return _ARR.of(dated(packed).select("region", "date", F.posexplode("lags").alias("i", "C")))


# ---- attributes over the panel ----

_LOGT = Out(longs=("region",), doubles=("balance_log", "suppliers_log", "share_neglog"))


@query(
    "p22_log_transforms",
    _LOGT.sql(
        tb.RG + tb.SP + "a AS (SELECT region, balance, suppliers, population * 100.0 / (SELECT sum(population) FROM rg) AS share FROM rg JOIN sp USING (region))",
        "SELECT region, log2(balance + (SELECT median(balance) FROM a) / 100) AS balance_log, log2(suppliers + (SELECT median(suppliers) FROM a) / 100) AS suppliers_log, "
        "log2(100) - log2(100 - share) AS share_neglog FROM a",
    ),
)
def log_transforms(spark, sf):
    r = rg.attach_attributes(tb.regions(spark, sf), [tb.suppliers(spark, sf)]).where("suppliers IS NOT NULL")
    total = tb.regions(spark, sf).agg(F.sum("population")).scalar()
    r = r.withColumn("share", F.col("population") * 100.0 / total)
    return _LOGT.of(rg.log_transforms(r, ["balance", "suppliers", "absent"], ["share"]))


_ALL = Out(longs=("region", "n_all"), strings=("date",), doubles=("n_all_per_capita", "n_all_per_capita_log"))


@query(
    "p23_total_over_time",
    _ALL.sql(tb.AP, f"SELECT {KEYS}, n_all, n_all / population AS n_all_per_capita, log2(nullif(n_all / population, 0)) AS n_all_per_capita_log FROM (SELECT *, sum(n_events) OVER (PARTITION BY region) AS n_all FROM ap)"),
)
def total_over_time(spark, sf):
    return _ALL.of(dated(pn.total_over_time(tb.activity_panel(spark, sf), "n_events", "n_all")))


MEASURES = {"n_flagged": "cumulative_flagged", "n_events": "cumulative_events", "n_flagged_refs": "cumulative_flagged_refs", "n_refs": "cumulative_refs"}
_ASM = Out(longs=("region", "state", "population", "vaccinations", "deaths", "cases", *MEASURES.values()), strings=("date",), doubles=("n_events_all_time_per_capita_log",))
# the order tables' days are moved by 27 years so that they cover the event days
_SHIFT = "CAST(date + INTERVAL 27 YEAR AS DATE)"


@query(
    "p24_assemble_panel",
    _ASM.sql(
        tb.EV + tb.AC + tb.OP
        + f"""base AS (SELECT region, state, {_SHIFT} AS date, V AS vaccinations FROM op WHERE state > 0),
        dth AS (SELECT region, {_SHIFT} AS date, D AS deaths FROM op), cas AS (SELECT region, {_SHIFT} AS date, C AS cases FROM op),
        j AS (SELECT b.region, b.date, b.state, rg.population, b.vaccinations, d.deaths, c.cases, a.n_flagged, a.n_events, a.n_flagged_refs, a.n_refs
              FROM base b JOIN rg USING (region) LEFT JOIN act a USING (region, date) LEFT JOIN dth d USING (region, date) LEFT JOIN cas c USING (region, date)
              WHERE b.state BETWEEN 1 AND 56 AND b.date >= DATE '2024-01-01' AND b.date < DATE '2024-02-01'),
        q AS (SELECT * FROM j WHERE region IN (SELECT region FROM j GROUP BY 1 HAVING count(*) = (SELECT max(n) FROM (SELECT count(*) AS n FROM j GROUP BY region)))),
        z AS (SELECT *, {', '.join(f'sum(coalesce({c}, 0)) OVER (PARTITION BY region ORDER BY date) AS {t}' for c, t in MEASURES.items())},
              log2(nullif(sum(coalesce(n_events, 0)) OVER (PARTITION BY region), 0) / population) AS n_events_all_time_per_capita_log FROM q)""",
        f"SELECT {KEYS}, state, population, vaccinations, deaths, cases, {', '.join(MEASURES.values())}, n_events_all_time_per_capita_log FROM z",
    ),
)
def assemble_panel(spark, sf):
    o = tb.order_panel(spark, sf).withColumn("date", F.add_months("date", 27 * 12))
    base = o.where("state > 0").select("region", "date", "state", F.col("V").alias("vaccinations"))
    deaths = o.select("region", "date", F.col("D").alias("deaths"))
    cases = o.select("region", "date", F.col("C").alias("cases"))
    activity = tb.activity(spark, sf).select("region", "date", *MEASURES)
    pops = tb.regions(spark, sf).select("region", "population")
    return _ASM.of(dated(rg.assemble_panel(base, activity, deaths, cases, pops, "2024-01-01", "2024-02-01", MEASURES)))


_WHOLE = Out(
    longs=("region", "state", "population", "vaccinations", "deaths", "cases", "suppliers", *tb.TOTALS.values()),
    strings=("date",), doubles=("balance", "supplier_balance", "n_events_all_time_per_capita_log"),
)


@query(
    "p24_full_panel",
    _WHOLE.sql(
        tb.EV + tb.AC + tb.OP + tb.SP
        + f"""base AS (SELECT region, state, {_SHIFT} AS date, V AS vaccinations FROM op WHERE state > 0),
        dth AS (SELECT region, {_SHIFT} AS date, D AS deaths FROM op), cas AS (SELECT region, {_SHIFT} AS date, C AS cases FROM op),
        j AS (SELECT b.region, b.date, b.state, rg.population, rg.balance, sp.suppliers, sp.supplier_balance, b.vaccinations, d.deaths, c.cases, {', '.join(f'a.{c}' for c in tb.COUNTS)}
              FROM base b JOIN rg USING (region) LEFT JOIN sp USING (region) LEFT JOIN act a USING (region, date) LEFT JOIN dth d USING (region, date) LEFT JOIN cas c USING (region, date)
              WHERE b.state BETWEEN 1 AND 56 AND b.date >= DATE '2024-01-01' AND b.date < DATE '2024-02-01'),
        q AS (SELECT * FROM j WHERE region IN (SELECT region FROM j GROUP BY 1 HAVING count(*) = (SELECT max(n) FROM (SELECT count(*) AS n FROM j GROUP BY region)))),
        z AS (SELECT *, {', '.join(f'sum(coalesce({c}, 0)) OVER (PARTITION BY region ORDER BY date) AS {t}' for c, t in tb.TOTALS.items())},
              log2(nullif(sum(coalesce(n_events, 0)) OVER (PARTITION BY region), 0) / population) AS n_events_all_time_per_capita_log FROM q)""",
        f"SELECT {KEYS}, state, population, balance, suppliers, supplier_balance, vaccinations, deaths, cases, {', '.join(tb.TOTALS.values())}, n_events_all_time_per_capita_log FROM z",
    ),
)
def full_panel(spark, sf):
    """All eight running totals, and the regions' attributes beside them."""
    o = tb.order_panel(spark, sf).withColumn("date", F.add_months("date", 27 * 12))
    base = o.where("state > 0").select("region", "date", "state", F.col("V").alias("vaccinations"))
    deaths = o.select("region", "date", F.col("D").alias("deaths"))
    cases = o.select("region", "date", F.col("C").alias("cases"))
    attributes = tb.regions(spark, sf).drop("state").join(tb.suppliers(spark, sf), "region", "left")
    panel = rg.assemble_panel(base, tb.activity(spark, sf).select("region", "date", *tb.TOTALS), deaths, cases, attributes, "2024-01-01", "2024-02-01", tb.TOTALS)
    return _WHOLE.of(dated(panel))


_SAT = Out(longs=("region",), strings=("date",), doubles=("A",))


@query(
    "p25_saturating_accumulation",
    _SAT.sql(
        "RECURSIVE "
        + tb.AP.strip()
        + """
        g AS (SELECT region, date, (n_flagged - 1) / 100.0 AS gain, 0.1 AS a0, row_number() OVER (PARTITION BY region ORDER BY date) AS i FROM ap),
        w AS (SELECT region, i, date, CAST(a0 AS DOUBLE) AS A FROM g WHERE i = 1
              UNION ALL SELECT g.region, g.i, g.date, w.A + 8 * CAST(g.gain AS DOUBLE) * (1 - w.A) FROM w JOIN g ON g.region = w.region AND g.i = w.i + 1)""",
        f"SELECT {KEYS}, A FROM w",
    ),
)
def saturating_accumulation(spark, sf):
    p = tb.activity_panel(spark, sf).withColumns({"gain": (F.col("n_flagged") - 1) / 100.0, "a0": F.lit(0.1)})
    return _SAT.of(dated(pn.saturating_accumulation(p, "a0", "gain")))


_STEP = Out(longs=("region", "t"), strings=("date",), doubles={"nu": 4})


@query(
    "p26_step_parameter",
    _STEP.sql(
        tb.SO + "x AS (SELECT region, date, dense_rank() OVER (ORDER BY date) - 1 AS t FROM so), nu AS (SELECT l_linenumber - 1 AS bin, avg(l_discount) AS nu FROM lineitem GROUP BY 1)",
        f"SELECT {KEYS}, t, nu FROM x LEFT JOIN nu ON nu.bin = x.t // 400",
    ),
)
def step_parameter(spark, sf):
    x = pn.time_index(tb.sparse_orders(spark, sf).select("region", "date"))
    nu = tb.table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("bin")).agg(F.avg("l_discount").alias("nu"))
    return _STEP.of(dated(pn.step_parameter(x, nu, 400, "nu")))


_BLEND = Out(longs=("region",), strings=("date",), doubles=("blend",))


@query("p27_blend_lag1", _BLEND.sql(tb.OP, f"SELECT {KEYS}, U - (U - lag(U, 8) OVER w) / 8 AS blend FROM op {CALENDAR} QUALIFY row_number() OVER w > 8"))
def blend(spark, sf):
    lagged = pn.calendar_lag(tb.order_panel(spark, sf), ["U"], [8])
    return _BLEND.of(dated(lagged.withColumn("blend", blend_lag1(F.col("U"), F.col("U_tlag8")))))


_NAT = Out(longs=("V", "C"), strings=("date",), doubles=("V_dxdt1", "C_dxdt1"))


@query(
    "p28_national_daily",
    _NAT.sql(
        tb.OP + "n AS (SELECT date, sum(V) AS V, sum(C) AS C FROM op GROUP BY 1)",
        "SELECT strftime(n.date, '%Y-%m-%d') AS date, n.V, n.C, n.V - a.V AS V_dxdt1, n.C - a.C AS C_dxdt1 FROM n JOIN n a ON a.date + 1 = n.date",
    ),
)
def national_daily(spark, sf):
    return _NAT.of(dated(pn.national_daily(tb.order_panel(spark, sf), ["V", "C"])))


_PROF = Out(longs=("region",), strings=("date",), doubles=("n_events", "n_flagged"))


@query(
    "p29_scaled_profile",
    _PROF.sql(tb.AP, f"SELECT {KEYS}, n_events / nullif(max(abs(n_events)) OVER (PARTITION BY region), 0) AS n_events, n_flagged / nullif(max(abs(n_flagged)) OVER (PARTITION BY region), 0) AS n_flagged FROM ap"),
)
def scaled_profile(spark, sf):
    return _PROF.of(dated(pn.scaled_profile(tb.activity_panel(spark, sf).select("region", "date", "n_events", "n_flagged"), ["n_events", "n_flagged"])))


CLUSTERED = tb.OP + "x AS (SELECT op.*, dense_rank() OVER (ORDER BY date) - 1 AS t, (population % 4) AS cluster FROM op),"


def _clustered(spark, sf):
    return pn.time_index(tb.order_panel(spark, sf).withColumn("cluster", F.col("population") % 4))


_CP = Out(longs=("cluster",), doubles=("share", "V", "C"))


@query("p30_cluster_profiles", _CP.sql(CLUSTERED, "SELECT cluster, count(*) / sum(count(*)) OVER () AS share, avg(V) AS V, avg(C) AS C FROM x WHERE t = (SELECT max(t) FROM x) GROUP BY 1"))
def cluster_profiles(spark, sf):
    return _CP.of(pn.cluster_profiles(_clustered(spark, sf), ["V", "C"]))


_RL = Out(longs=("region", "cluster", "t"))


@query(
    "p31_relabel_clusters",
    _RL.sql(
        CLUSTERED + "s AS (SELECT cluster, row_number() OVER (ORDER BY count(*) DESC, cluster) - 1 AS k FROM x WHERE t = (SELECT min(t) FROM x) GROUP BY 1)",
        "SELECT region, s.k AS cluster, t FROM x JOIN s ON s.cluster = x.cluster",
    ),
)
def relabel_clusters(spark, sf):
    return _RL.of(pn.relabel_clusters(_clustered(spark, sf)))


_FULL = Out(longs=("region", "n"), strings=("date",))


@query(
    "a24_complete_regions",
    _FULL.sql(tb.SO, f"SELECT {KEYS}, n FROM so WHERE region IN (SELECT region FROM so GROUP BY 1 HAVING count(*) = (SELECT max(m) FROM (SELECT count(*) AS m FROM so GROUP BY region)))"),
)
def complete_regions(spark, sf):
    return _FULL.of(dated(pn.complete_regions(tb.sparse_orders(spark, sf))))


_BAL = Out(longs=("n_rows", "n_regions", "n_dates"), strings=("panel",), flags=("balanced",))
_BAL_SQL = "SELECT '{0}' AS panel, count(*) AS n_rows, count(DISTINCT region) AS n_regions, count(DISTINCT date) AS n_dates, count(*) = count(DISTINCT region) * count(DISTINCT date) AS balanced FROM {0}"


@query("a25_balance_check", _BAL.sql(tb.OP + tb.SO, _BAL_SQL.format("op") + " UNION ALL " + _BAL_SQL.format("so")))
def balance_check(spark, sf):
    a = pn.balance(tb.order_panel(spark, sf)).withColumn("panel", F.lit("op"))
    return _BAL.of(a.unionByName(pn.balance(tb.sparse_orders(spark, sf)).withColumn("panel", F.lit("so"))))


_WIDE = Out(longs=("region", "n"), strings=("date",))


@query(
    "r01_wide_to_long",
    _WIDE.sql(
        "m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS d FROM orders),"
        "o AS (SELECT c_nationkey AS region, date_trunc('month', o_orderdate) AS d, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)",
        "SELECT r.region, strftime(m.d, '%Y-%m-%d') AS date, o.n FROM (SELECT DISTINCT region FROM o) r CROSS JOIN m LEFT JOIN o ON o.region = r.region AND o.d = m.d",
    ),
)
def wide_to_long(spark, sf):
    """A column per month of the table, as many as the calendar has, unpivoted to rows with a date."""
    o = tb.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM-01").alias("month"))
    per_user = o.agg(F.count(F.lit(1)).alias("n")).join(tb.users(spark, sf), "user_id")
    wide = per_user.groupBy("region").pivot("month").agg(F.sum("n"))
    return _WIDE.of(dated(rg.wide_to_long(wide, ["region"], "n")))

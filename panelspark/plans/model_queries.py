"""Queries on labels, classifiers, clusters and regressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from panelspark.functions.hashing import h32
from panelspark.operators import events as ev
from panelspark.operators import model as md
from panelspark.operators import panel as pn
from panelspark.operators import regions as rg
from panelspark.operators import sampling as sm
from panelspark.operators import stats as st
from panelspark.plans import tables as tb
from panelspark.plans.registry import Out, query
from panelspark.plans.sampling_queries import h, resampled_sql
from panelspark.session import cut_lineage, scratch_path

_CONS = Out(longs=("doc_id",), doubles=("label",), flags=("any2", "all3", "is_flagged"))
_RATE_SQL = f"""
r AS (SELECT doc_id, quality AS r1, toxic AS r2, CASE WHEN {h('r', 'doc_id')} % 10 = 0 THEN NULL ELSE {h('r', 'doc_id')} % 2 END AS r3 FROM labels),
c AS (SELECT doc_id, coalesce(r1 = r2, false) OR coalesce(r1 = r3, false) OR coalesce(r2 = r3, false) AS any2,
        coalesce(r1 = r2, false) AND coalesce(r1 = r3, false) AS all3, CASE WHEN r3 IS NOT NULL THEN list_median([r1, r2, r3]) END AS label FROM r),
d AS (SELECT *, coalesce(label = 1, false) AS is_flagged FROM c),
"""


def raters(spark, sf):
    hh = h32("r", F.col("doc_id"))
    third = F.when(hh % 10 == 0, None).otherwise(hh % 2)
    return tb.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("rating1"), F.col("toxic").alias("rating2"), third.alias("rating3"))


@query("m01_rater_consensus", _CONS.sql(_RATE_SQL, "SELECT * FROM d WHERE all3"))
def rater_consensus(spark, sf):
    """Three ratings, some missing: rows on which all agree."""
    return _CONS.of(md.consensus(raters(spark, sf)))


@query("m01_rater_majority", _CONS.sql(_RATE_SQL, "SELECT * FROM d WHERE any2"))
def rater_majority(spark, sf):
    return _CONS.of(md.consensus(raters(spark, sf), "any2"))


# ---- text classifier: two sources of labels, some rows held out, model stored ----

_MIX = Out(longs=("doc_id", "label"), strings=("part",))
MIX_SQL = (
    f"""oh AS (SELECT doc_id, quality AS label, row_number() OVER (ORDER BY {h('13', 'doc_id')}, doc_id) AS i FROM labels JOIN documents USING (doc_id)),"""
    + _RATE_SQL
    + f"""oo AS (SELECT doc_id, CAST(is_flagged AS INT) AS label, row_number() OVER (ORDER BY {h('18', 'doc_id')}, doc_id) AS i FROM d JOIN documents USING (doc_id) WHERE any2),
    os AS (SELECT doc_id, label, row_number() OVER (ORDER BY {h('19', 'doc_id')}, doc_id) AS i FROM oo WHERE i > 70),
    mix AS (SELECT doc_id, label, 'own' AS part FROM oh WHERE i > 70 UNION ALL SELECT doc_id, label, 'other' FROM os WHERE i <= (SELECT CAST(floor(count(*) * 0.4) AS BIGINT) FROM oh WHERE i > 70)
        UNION ALL SELECT doc_id, label, 'test' FROM oh WHERE i <= 70),
    """
)


def sources(spark, sf):
    """(test, train, other): labelled documents, 70 held out, and those of a second source with three raters less 70."""
    d = tb.table(spark, sf, "documents").select("doc_id", "text")
    own = d.join(tb.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    rated = md.consensus(raters(spark, sf), "any2").select("doc_id", F.col("is_flagged").cast("int").alias("label"))
    test, train = sm.split_by_count(own, "doc_id", 70, 13)
    return test, train, sm.split_by_count(d.join(rated, "doc_id"), "doc_id", 70, 18)[1]


@query("m02_training_mix", _MIX.sql(MIX_SQL, "SELECT * FROM mix"))
def training_mix(spark, sf):
    """What the classifier is trained on: own rows and 40% as many of the second source; and what is held out."""
    test, train, other = sources(spark, sf)
    parts = md.training_mix(train.withColumn("part", F.lit("own")), other.withColumn("part", F.lit("other")), "doc_id", 19)
    return _MIX.of(parts.unionByName(test.withColumn("part", F.lit("test"))))


def trained_classifier(spark, sf):
    """(model, held-out rows); the model is that read back from the shared folder."""
    test, train, other = sources(spark, sf)
    path = scratch_path(spark, "classifier")
    md.save_model(md.train_text_classifier(cut_lineage(md.training_mix(train, other, "doc_id", 19))), path)
    return md.load_model(path), test


_CLASS = Out(longs=("doc_id",), strings=("part",), flags=("sound",))


@query(
    "m03_classify_events",
    _CLASS.sql(
        f"""s AS (SELECT doc_id, row_number() OVER (ORDER BY {h('13', 'doc_id')}, doc_id) AS i FROM labels JOIN documents USING (doc_id)),""",
        "SELECT d.doc_id, CASE WHEN i <= 70 THEN 'test' WHEN i > 70 THEN 'train' ELSE 'none' END AS part, true AS sound FROM documents d LEFT JOIN s USING (doc_id)",
    ),
)
def classify_documents(spark, sf):
    """Trained on the labelled documents but 70, each distinct text scored once, labels joined back to every document.

    ``sound``: the label is that of the probability, and equal texts have equal labels.
    """
    d = tb.table(spark, sf, "documents").select("doc_id", "text")
    model, test = trained_classifier(spark, sf)
    labelled = d.join(tb.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    train = labelled.join(test.select("doc_id"), "doc_id", "left_anti")
    scored = ev.attach_predictions(d, md.score_texts(ev.distinct_texts(d), model), spread=["doc_id"])
    keyed = scored.withColumn("digest", ev.text_digest("text")).drop("text")
    spans = keyed.groupBy("digest").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    parts = test.select("doc_id", F.lit("test").alias("part")).unionByName(train.select("doc_id", F.lit("train").alias("part")))
    out = keyed.join(spans, "digest").join(parts, "doc_id", "left").fillna("none", subset=["part"])
    sound = (F.col("low") == F.col("high")) & (F.col("label") == (F.col("prob") > 0.5).cast("int")) & F.col("prob").between(0, 1)
    return _CLASS.of(out.withColumn("sound", sound))


# ---- evaluation ----

SCORED_SQL = "sc AS (SELECT doc_id, quality AS label, (n_chars % 97) / 96.0 AS score, d.lang FROM labels JOIN documents d USING (doc_id)),"


def scored(spark, sf):
    d = tb.table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    score = (F.col("n_chars") % 97) / F.lit(96.0)
    return tb.table(spark, sf, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("label"), score.alias("score"), "lang")


def metrics_sql(source: str, group: str, weight: str) -> str:
    """Confusion metrics and AUC per group of weighted (label, score) rows, as CTE ``met``."""
    return f"""
    k AS (SELECT {group}, CAST(sum(CASE WHEN score > 0.5 AND label = 1 THEN {weight} ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN score > 0.5 AND label = 0 THEN {weight} ELSE 0 END) AS DOUBLE) AS fp,
            CAST(sum(CASE WHEN score <= 0.5 AND label = 1 THEN {weight} ELSE 0 END) AS DOUBLE) AS fn, CAST(sum(CASE WHEN score <= 0.5 AND label = 0 THEN {weight} ELSE 0 END) AS DOUBLE) AS tn FROM {source} GROUP BY 1),
    c AS (SELECT {group}, score, CAST(sum(CASE WHEN label = 1 THEN {weight} ELSE 0 END) AS DOUBLE) AS p, CAST(sum(CASE WHEN label = 0 THEN {weight} ELSE 0 END) AS DOUBLE) AS q FROM {source} GROUP BY 1, 2),
    o AS (SELECT {group}, p, q, sum(q) OVER (PARTITION BY {group} ORDER BY score) - q AS below FROM c),
    auc AS (SELECT {group}, sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0) AS auroc FROM o GROUP BY 1),
    met AS (SELECT k.{group}, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
              coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
              coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc, auroc FROM k JOIN auc ON auc.{group} = k.{group}),
    """


_METRICS = Out(strings=("lang",), doubles=tuple(md.METRICS))


@query("m04_metrics_per_language", _METRICS.sql(SCORED_SQL + metrics_sql("sc", "lang", "1"), "SELECT * FROM met"))
def metrics_per_language(spark, sf):
    s = scored(spark, sf).withColumn("weight", F.lit(1))
    return _METRICS.of(md.confusion_metrics(s, ["lang"]).join(md.roc_auc(s, ["lang"]), "lang"))


_TABLE = Out(strings=("metric",), doubles=("mean", "half_width"))


def intervals_sql(reps: int) -> str:
    parts = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS v FROM met" for m in md.METRICS)
    return (
        SCORED_SQL + "cl AS (SELECT label, score, count(*) AS n FROM sc GROUP BY 1, 2)," + resampled_sql("cl", ["label", "score"], reps, "14", "x", "n")
        + metrics_sql("x", "rep", "weight") + f"l AS ({parts})"
    )


@query(
    "m07_bootstrap_metrics",
    _TABLE.sql(intervals_sql(1000), "SELECT metric, avg(v) AS mean, greatest(avg(v) - quantile_cont(v, 0.025), quantile_cont(v, 0.975) - avg(v)) AS half_width FROM l GROUP BY 1"),
)
def bootstrap_metrics(spark, sf):
    """A thousand replicates of six metrics."""
    return _TABLE.of(md.metric_intervals(md.bootstrap_metrics(scored(spark, sf), "doc_id", 1000, 14)))


_HELD_OUT = Out(strings=("metric",), doubles=("mean", "half_width"))


@query("m07_held_out_metrics")
def held_out_metrics(spark, sf):
    """Six metrics of the trained classifier on its held-out rows, over a thousand replicates."""
    model, test = trained_classifier(spark, sf)
    scores = cut_lineage(md.held_out_scores(test, model, "doc_id"))
    return _HELD_OUT.of(md.metric_intervals(md.bootstrap_metrics(scores, "doc_id", 1000, 20)))


# ---- clusters ----


def attributes(spark, sf):
    """(region, date, balance, population, supplier_balance, suppliers): attributes repeated on every panel day."""
    r = rg.attach_attributes(tb.regions(spark, sf), [tb.suppliers(spark, sf)]).fillna(0)
    return tb.sparse_orders(spark, sf).select("region", "date").join(r, "region")


ATTRIBUTES = ["balance", "population", "supplier_balance", "suppliers"]


_PC = Out(longs=("n_regions",), doubles=("variance", "shared"), flags=("falling",))


@query("m10_principal_components", _PC.sql(tb.RG, f"SELECT count(*) AS n_regions, {len(ATTRIBUTES)} AS variance, 0 AS shared, true AS falling FROM rg"))
def principal_components(spark, sf):
    """What holds of all components of scaled columns: variances add up to the number of columns, covariances are 0."""
    names = [f"pc{i}" for i in range(len(ATTRIBUTES))]
    out = md.principal_components(attributes(spark, sf), ATTRIBUTES, len(names))
    variances = [F.var_pop(c) for c in names]
    pairs = [F.abs(F.covar_pop(a, b)) for i, a in enumerate(names) for b in names[i + 1 :]]
    falling = [a >= b - 1e-9 for a, b in zip(variances, variances[1:], strict=False)]
    row = out.agg(F.count(F.lit(1)).alias("n_regions"), sum(variances, F.lit(0.0)).alias("variance"), F.greatest(*pairs, F.lit(0.0)).alias("shared"), reduce(and_, falling, F.lit(True)).alias("falling"))
    return _PC.of(row)


_CLUSTERED = Out(longs=("region",), flags=("nearest",))


@query("m11_cluster_regions", _CLUSTERED.sql(tb.RG, "SELECT region, true AS nearest FROM rg"))
def cluster_regions(spark, sf):
    """Regions in four clusters; each must be nearest to the centre of its own."""
    rows = attributes(spark, sf)
    labels = md.cluster_regions(rows, ATTRIBUTES, 4).select("region", "cluster").distinct()
    x = st.standard_scaled(st.last_values(rows, ATTRIBUTES), ATTRIBUTES).join(labels, "region")
    centres = x.groupBy("cluster").agg(F.struct(*[F.avg(c).alias(c) for c in ATTRIBUTES]).alias("c"))
    # four centres
    every = centres.agg(F.collect_list(F.struct("cluster", "c"))).scalar()

    x = x.withColumn("_every", every)

    def far(centre):
        return sum(((F.col(a) - centre["c"][a]) ** 2 for a in ATTRIBUTES), F.lit(0.0))

    each = [F.get("_every", F.lit(k)) for k in range(4)]
    best = F.array_min(F.array(*[F.struct(far(e).alias("far"), e["cluster"].alias("cluster")) for e in each]))
    return _CLUSTERED.of(x.select("region", (best["cluster"] == F.col("cluster")).alias("nearest")))


# ---- regression ----

OLS_SQL = (
    resampled_sql("supplier", ["s_suppkey"], 1000, "15")
    + """
m AS (SELECT rep, CAST(weight AS DOUBLE) AS w, CAST(s_acctbal AS DOUBLE) AS y, CAST(s_nationkey AS DOUBLE) AS a, CAST(s_suppkey % 7 AS DOUBLE) AS b FROM bw JOIN supplier USING (s_suppkey)),
g AS (SELECT rep, sum(w * y) / sum(w) AS my, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM m GROUP BY 1),
s AS (SELECT rep, sum(w * (a - ma) ** 2) AS aa, sum(w * (b - mb) ** 2) AS bb, sum(w * (a - ma) * (b - mb)) AS ab, sum(w * (a - ma) * (y - my)) AS ay, sum(w * (b - mb) * (y - my)) AS cy, sum(w * (y - my) ** 2) AS yy
      FROM m JOIN g USING (rep) GROUP BY 1),
f AS (SELECT rep, (ay * bb - cy * ab) / (aa * bb - ab * ab) AS ca, (cy * aa - ay * ab) / (aa * bb - ab * ab) AS cb, ay, cy, yy FROM s),
cf AS (SELECT rep, 's_nationkey' AS feature, ca AS coef, (ca * ay + cb * cy) / yy AS ev FROM f UNION ALL SELECT rep, 'slot', cb, (ca * ay + cb * cy) / yy FROM f),
"""
)


def supplier_rows(spark, sf):
    return tb.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey", (F.col("s_suppkey") % 7).alias("slot"))


def ols_replicates(spark, sf):
    return md.bootstrap_ols(supplier_rows(spark, sf), "s_suppkey", "s_acctbal", ["s_nationkey", "slot"], 1000, 15)


_OLS = Out(longs=("rep",), strings=("feature",), doubles={"coef": 6, "explained_variance": 6})

# Few distinct rows give coefficients that end in an exact 5 after six digits: noise beyond the ninth goes first, on both sides.
_COEF_SQL = "SELECT rep, feature, round(coef, 9) AS coef, ev AS explained_variance FROM cf"


def steady(replicates):
    return replicates.withColumn("coef", F.round("coef", 9))


@query("m12_bootstrap_ols", _OLS.sql(OLS_SQL, _COEF_SQL))
def bootstrap_ols(spark, sf):
    return _OLS.of(steady(ols_replicates(spark, sf)))


_COEF = Out(strings=("feature", "mean_text", "p_text", "interval_text"), doubles=("mean", "p", "lower", "upper"))


@query(
    "m13_coefficient_summary",
    _COEF.sql(
        OLS_SQL
        + """z AS (SELECT feature, avg(coef) AS mean, quantile_cont(coef, 0.025) AS lower, quantile_cont(coef, 0.975) AS upper,
             (count(*) FILTER (coef <= 0) + 1) / (count(*) + 1) AS pl, (count(*) FILTER (coef >= 0) + 1) / (count(*) + 1) AS pu FROM cf GROUP BY 1),
             y AS (SELECT *, CASE WHEN mean > 0 THEN pl ELSE pu END AS p FROM z)""",
        "SELECT feature, mean, p, lower, upper, printf('%.5f', mean) AS mean_text, printf('%.3f', p) AS p_text, printf('(%.5f, %.5f)', lower, upper) AS interval_text FROM y",
    ),
)
def coefficient_summary(spark, sf):
    return _COEF.of(md.coefficient_summary(ols_replicates(spark, sf)))


_EXPLAINED = Out(longs=("n",), doubles=("mean", "lower", "upper"))


@query(
    "m13_explained_variance",
    _EXPLAINED.sql(OLS_SQL, "SELECT count(*) AS n, avg(ev) AS mean, quantile_cont(ev, 0.025) AS lower, quantile_cont(ev, 0.975) AS upper FROM (SELECT rep, max(ev) AS ev FROM cf GROUP BY 1)"),
)
def explained_variance(spark, sf):
    return _EXPLAINED.of(md.explained_variance_summary(ols_replicates(spark, sf)))


@query(
    "m12_block_ols",
    _OLS.sql(
        f"bb AS (SELECT s_suppkey, {h('17-block', 's_suppkey')} % 256 AS block FROM supplier), bl AS (SELECT DISTINCT block FROM bb),"
        + resampled_sql("bl", ["block"], 1000, "17", "bx") + "bw AS (SELECT rep, s_suppkey, weight FROM bx JOIN bb USING (block)),"
        + OLS_SQL[OLS_SQL.index("m AS (SELECT rep, CAST(weight"):],
        _COEF_SQL,
    ),
)
def block_ols(spark, sf):
    """Replicates that draw hash blocks of rows, each reduced to its cross products."""
    return _OLS.of(steady(md.block_ols(supplier_rows(spark, sf), "s_suppkey", "s_acctbal", ["s_nationkey", "slot"], 1000, 17)))


# ---- forest ----

FOREST_REPS, FOREST_TREES = 100, 100


def _split_sql(level: int, rows: str) -> str:
    """Best splits of one level from rows (rep, tree, node, w, y, b) as CTE ``b<level>``."""
    return f"""
    s{level} AS (SELECT rep, tree, node, f, b[f + 1] AS bin, sum(w) AS w, sum(w * y) AS s, sum(w * y * y) AS q FROM {rows}, (SELECT CAST(range AS INTEGER) AS f FROM range(0, 2)) GROUP BY 1, 2, 3, 4, 5),
    c{level} AS (SELECT rep, tree, node, f, bin, sum(w) OVER o AS wl, sum(s) OVER o AS sl, sum(w) OVER p AS w, sum(s) OVER p AS s, sum(q) OVER p AS q FROM s{level}
       WINDOW o AS (PARTITION BY rep, tree, node, f ORDER BY bin ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY rep, tree, node, f)),
    g{level} AS (SELECT *, sl ** 2 / wl + (s - sl) ** 2 / (w - wl) - s ** 2 / w AS gain, q - s ** 2 / w AS spread FROM c{level} WHERE wl < w),
    b{level} AS MATERIALIZED (SELECT rep, tree, node, f, bin AS cut, gain, sl / wl AS lv, (s - sl) / (w - wl) AS rv FROM g{level} WHERE spread > 0 AND round(gain / spread, 9) > 0
       QUALIFY row_number() OVER (PARTITION BY rep, tree, node ORDER BY round(gain / spread, 9) DESC, f, bin) = 1),
    """


FOREST_SQL = (
    resampled_sql("supplier", ["s_suppkey"], FOREST_REPS, "16")
    + f"""
    fe AS (SELECT [quantile_cont(s_nationkey, list_transform(range(1, 32), lambda i: i / 32)), quantile_cont(s_suppkey % 7, list_transform(range(1, 32), lambda i: i / 32))] AS e, avg(s_acctbal) AS my FROM supplier),
    fr AS (SELECT s_suppkey, s_acctbal - my AS y, [len(list_filter(list_distinct(e[1]), lambda v: s_nationkey > v)), len(list_filter(list_distinct(e[2]), lambda v: s_suppkey % 7 > v))] AS b FROM supplier, fe),
    fp AS (SELECT weight, list_transform(range(0, 3 * weight + 13), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln(weight) - weight - lgamma(j + 1))))) AS steps FROM (SELECT DISTINCT weight FROM bw)),
    fd AS MATERIALIZED (SELECT rep, s_suppkey, weight, y, b, steps FROM bw JOIN fp USING (weight) JOIN fr USING (s_suppkey)),
    fw AS MATERIALIZED (SELECT rep, tree, s_suppkey, y, b, len(list_filter(steps, lambda s: {h('16-tree', 'rep', 'tree', 's_suppkey')} / 4294967296.0 >= s)) AS w FROM fd, (SELECT range AS tree FROM range(0, {FOREST_TREES}))),
    r0 AS (SELECT rep, tree, 1 AS node, w, y, b FROM fw WHERE w > 0),
    """
    + _split_sql(0, "r0")
    + "r1 AS (SELECT fw.rep, fw.tree, CASE WHEN b[f + 1] > cut THEN 3 ELSE 2 END AS node, w, y, b FROM fw JOIN b0 ON b0.rep = fw.rep AND b0.tree = fw.tree WHERE w > 0),"
    + _split_sql(1, "r1")
    + """
    ft AS (SELECT rep, tree, f, sum(gain) AS gain FROM (SELECT rep, tree, f, gain FROM b0 UNION ALL SELECT rep, tree, f, gain FROM b1) GROUP BY 1, 2, 3),
    fs AS (SELECT rep, tree, f, gain / sum(gain) OVER (PARTITION BY rep, tree) AS part FROM ft),
    fi AS (SELECT n.rep, x.f, coalesce(sum(part), 0) / any_value(n.n) AS importance FROM (SELECT rep, count(DISTINCT tree) AS n FROM fs GROUP BY 1) n CROSS JOIN (SELECT range AS f FROM range(0, 2)) x
       LEFT JOIN fs ON fs.rep = n.rep AND fs.f = x.f GROUP BY 1, 2),
    fv AS (SELECT rep, s_suppkey, avg(CASE WHEN b1.node IS NULL THEN v ELSE CASE WHEN b[b1.f + 1] > b1.cut THEN b1.rv ELSE b1.lv END END) AS guess FROM
       (SELECT fd.rep, b0.tree, s_suppkey, b, CASE WHEN b[b0.f + 1] > cut THEN 3 ELSE 2 END AS node, CASE WHEN b[b0.f + 1] > cut THEN rv ELSE lv END AS v FROM fd JOIN b0 ON b0.rep = fd.rep) x
       LEFT JOIN b1 ON b1.rep = x.rep AND b1.tree = x.tree AND b1.node = x.node GROUP BY x.rep, s_suppkey),
    fx AS (SELECT rep, 1 - (sum(weight * (y - guess) ** 2) / sum(weight) - (sum(weight * (y - guess)) / sum(weight)) ** 2) / (sum(weight * y ** 2) / sum(weight) - (sum(weight * y) / sum(weight)) ** 2) AS ev
       FROM fd JOIN fv USING (rep, s_suppkey) GROUP BY 1),
    """
).replace("GROUP BY x.rep, s_suppkey)", "GROUP BY 1, 2)").replace("fv AS (SELECT rep,", "fv AS (SELECT x.rep,")


def forest_replicates(spark, sf):
    return md.forest_importances(supplier_rows(spark, sf), "s_suppkey", "s_acctbal", ["s_nationkey", "slot"], FOREST_REPS, 16, trees=FOREST_TREES)


_FOREST = Out(strings=("feature",), doubles=("mean", "lower", "upper"), longs=("n",))


@query(
    "m14_forest_importances",
    _FOREST.sql(FOREST_SQL, "SELECT CASE f WHEN 0 THEN 's_nationkey' ELSE 'slot' END AS feature, count(*) AS n, avg(importance) AS mean, quantile_cont(importance, 0.025) AS lower, quantile_cont(importance, 0.975) AS upper FROM fi GROUP BY 1"),
)
def forest_importances(spark, sf):
    """Importances with their intervals over 100 replicates of 100 trees."""
    return _FOREST.of(md.importance_summary(forest_replicates(spark, sf)))


@query(
    "m14_forest_explained",
    _EXPLAINED.sql(FOREST_SQL, "SELECT count(*) AS n, avg(ev) AS mean, quantile_cont(ev, 0.025) AS lower, quantile_cont(ev, 0.975) AS upper FROM fx"),
)
def forest_explained(spark, sf):
    """The variance that the forests explain, with its interval."""
    return _EXPLAINED.of(md.explained_variance_summary(forest_replicates(spark, sf)))


_REPORT = Out(strings=("feature",), doubles={"coef": 4, "std_error": 4, "t": 3, "r2": 6})


@query(
    "m15_ols_report",
    _REPORT.sql(
        """
        m AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem),
        g AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, count(*) AS n FROM m),
        s AS (SELECT any_value(my) AS my, any_value(ma) AS ma, any_value(mb) AS mb, any_value(n) AS n, sum((a - ma) ** 2) AS aa, sum((b - mb) ** 2) AS bb, sum((a - ma) * (b - mb)) AS ab,
                sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS cy, sum((y - my) ** 2) AS yy FROM m, g),
        f AS (SELECT *, aa * bb - ab * ab AS det, (ay * bb - cy * ab) / (aa * bb - ab * ab) AS ca, (cy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s),
        e AS (SELECT *, (yy - ca * ay - cb * cy) / (n - 3) AS s2, my - ca * ma - cb * mb AS c0 FROM f),
        r AS (SELECT 'l_quantity' AS feature, ca AS coef, sqrt(s2 * bb / det) AS se, (ca * ay + cb * cy) / yy AS r2 FROM e
              UNION ALL SELECT 'l_discount', cb, sqrt(s2 * aa / det), (ca * ay + cb * cy) / yy FROM e
              UNION ALL SELECT 'const', c0, sqrt(s2 * (1.0 / n + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det)), (ca * ay + cb * cy) / yy FROM e)""",
        "SELECT feature, coef, se AS std_error, coef / se AS t, r2 FROM r",
    ),
)
def ols_report(spark, sf):
    return _REPORT.of(md.ols_report(tb.table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]))


# ---- screens ----

_SCREEN = Out(strings=("a", "b"), doubles=("corr",))


@query(
    "m16_confounder_screen",
    _SCREEN.sql(
        tb.OP + tb.SP + tb.SO
        + """v AS (SELECT op.region, op.date, (op.V - a.V) / CAST(op.population AS DOUBLE) AS r FROM op JOIN op a ON a.region = op.region AND a.date + 1 = op.date),
        x AS (SELECT v.r, rg.balance, rg.population, coalesce(suppliers, 0) AS suppliers FROM v JOIN rg USING (region) LEFT JOIN sp USING (region) WHERE v.date IN (SELECT date FROM so WHERE day(date) = 9))""",
        "SELECT 'V_dxdt1' AS a, 'balance' AS b, corr(r, balance) AS corr FROM x UNION ALL SELECT 'V_dxdt1', 'population', corr(r, population) FROM x "
        "UNION ALL SELECT 'V_dxdt1', 'suppliers', corr(r, suppliers) FROM x",
    ),
)
def confounder_screen(spark, sf):
    """Scaled attributes against the daily rate of V per head, on the dates of another table."""
    p = tb.order_panel(spark, sf).withColumn("V", F.col("V") / F.col("population"))
    rates = pn.rate_of_change(p.select("region", "date", "V"), ["V"])
    dates = tb.sparse_orders(spark, sf).where("day(date) = 9").select("date").distinct()
    rows = rates.join(dates, "date", "left_semi")
    cols = ["balance", "population", "suppliers"]
    attrs = rg.attach_attributes(tb.regions(spark, sf), [tb.suppliers(spark, sf)]).fillna(0, subset=["suppliers"]).select("region", *cols)
    full = st.standard_scaled(rows.join(attrs, "region"), cols)
    return _SCREEN.of(st.correlations(full, [("V_dxdt1", c) for c in cols]))


@query(
    "m17_attribute_correlates",
    _SCREEN.sql(
        tb.DR + tb.RG + tb.OP.replace(tb.RG, "")
        + """e AS (SELECT idx % 25 AS region, idx // 25 AS step, avg(value) AS m FROM ld GROUP BY 1, 2), a AS (SELECT region, arg_min(m, step) AS a_first, arg_max(m, step) AS a_last FROM e GROUP BY 1),
        l AS (SELECT region, arg_max(V, date) / any_value(population) AS v_last FROM op GROUP BY 1),
        x AS (SELECT * FROM a JOIN l USING (region) JOIN rg USING (region))""",
        " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM x" for a in ("a_first", "a_last", "v_last") for b in ("balance", "population")),
    ),
)
def attribute_correlates(spark, sf):
    """First and last posterior means and the last V per head against scaled attributes."""
    step = F.floor(F.col("idx") / 25)
    means = tb.long_draws(spark, sf).groupBy((F.col("idx") % 25).alias("region"), step.alias("step")).agg(F.avg("value").alias("m"))
    ends = means.groupBy("region").agg(F.min_by("m", "step").alias("a_first"), F.max_by("m", "step").alias("a_last"))
    v = st.last_values(tb.order_panel(spark, sf).withColumn("v_last", F.col("V") / F.col("population")), ["v_last"])
    x = ends.join(v, "region").join(tb.regions(spark, sf).select("region", "balance", "population"), "region")
    x = st.standard_scaled(x, ["balance", "population"])
    return _SCREEN.of(st.correlations(x, [(a, b) for a in ("a_first", "a_last", "v_last") for b in ("balance", "population")]))

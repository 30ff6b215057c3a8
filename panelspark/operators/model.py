"""Labels, classifiers, clusters and regressions on tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.codes import median3
from panelspark.functions.hashing import h32
from panelspark.functions.nulls import ratio, same
from panelspark.operators.forest import forest_importances  # noqa: F401  part of this module's interface
from panelspark.operators.resampling import resampled, resampled_sums
from panelspark.operators.sampling import poisson_weights, sample_n
from panelspark.operators.skew import prefix_sums
from panelspark.operators.stats import interval_summary, last_values, standard_scaled
from panelspark.session import cut_lineage


# ---- labels ----


def consensus(raters: DataFrame, criterion: str = "all3", positive: int = 1) -> DataFrame:
    """Median rating, agreement flags and the positive flag; keeps rows meeting ``criterion`` (``all3`` or ``any2``)."""
    a, b, c = F.col("rating1"), F.col("rating2"), F.col("rating3")
    out = raters.withColumns(
        {
            "any2": same(a, b) | same(a, c) | same(b, c),
            "all3": same(a, b) & same(a, c),
            "label": median3(a, b, c).cast("double"),
        }
    )
    return out.withColumn("is_flagged", same(F.col("label"), F.lit(float(positive)))).where(F.col(criterion))


# ---- text classifier ----


def class_weights(train: DataFrame, label: str = "label") -> Column:
    """Weight of a row: the share of positives for a negative, the share of negatives for a positive."""
    share = train.agg(F.avg(F.col(label).cast("double"))).scalar()
    return F.when(F.col(label).cast("int") == 1, 1 - share).otherwise(share)


def train_text_classifier(train: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16, epochs: int = 20) -> PipelineModel:
    """Class-weighted logistic regression on hashed, idf-scaled words."""
    rows = train.withColumn("_weight", class_weights(train, label)).withColumn("_label", F.col(label).cast("double"))
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=epochs, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(rows.select(text, "_weight", "_label"))


def training_mix(own: DataFrame, other: DataFrame, key: str, seed: int | str, share: float = 0.4) -> DataFrame:
    """All rows of ``own``, and as many random ones of ``other`` as ``share`` of their number; ``key`` is unique in ``other``.

    Columns are those of ``own``; where ``other`` has fewer rows, all of them.
    """
    return own.unionByName(sample_n(other, key, int(own.count() * share), seed).select(own.columns))


def save_model(model: PipelineModel, path: str) -> None:
    """Writes a trained model to a folder that all executors share."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def held_out_scores(test: DataFrame, model: PipelineModel, key: str, text: str = "text", label: str = "label") -> DataFrame:
    """(key, label, score) of held-out rows: what ``confusion_metrics`` and the like evaluate."""
    scored = model.transform(test.select(key, text, F.col(label).cast("int").alias("label")))
    return scored.select(key, "label", vector_to_array("probability").getItem(1).alias("score"))


def score_texts(texts: DataFrame, model: PipelineModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """(text, prob, label) for each row; pass distinct texts so that copies are scored once."""
    scored = model.transform(texts.select(text))
    prob = vector_to_array("probability").getItem(1)
    return scored.select(text, prob.alias("prob"), (prob > threshold).cast("int").alias("label"))


# ---- evaluation ----


def confusion_metrics(scored: DataFrame, group: Sequence[str], threshold: float = 0.5, weight: str = "weight") -> DataFrame:
    """Accuracy, precision, recall, F1 and Matthews correlation per group, from weighted rows (label, score)."""
    hit = F.col("score") > threshold
    pos = F.col("label") == 1
    w = F.col(weight)

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, w)), F.lit(0)).cast("double")

    counts = scored.groupBy(*group).agg(
        total(hit & pos).alias("tp"), total(hit & ~pos).alias("fp"), total(~hit & pos).alias("fn"), total(~hit & ~pos).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def or0(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(
        *group,
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        or0(ratio(tp, tp + fp)).alias("precision"),
        or0(ratio(tp, tp + fn)).alias("recall"),
        or0(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        or0(ratio(tp * tn - fp * fn, spread)).alias("mcc"),
    )


def roc_auc(scored: DataFrame, group: Sequence[str], weight: str = "weight") -> DataFrame:
    """Chance that a positive outscores a negative, ties counting half; NULL with one class only.

    Rows are first reduced to one per (group, score), then negatives below each
    score come from prefix sums.
    """
    group = list(group)
    w = F.col(weight)
    cells = scored.groupBy(*group, "score").agg(
        F.sum(F.when(F.col("label") == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 1, 0).otherwise(w)).alias("neg")
    )
    run = prefix_sums(cells, "score", ["neg"], group)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return run.groupBy(*group).agg(ratio(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auroc"))


METRICS = ["accuracy", "precision", "recall", "f1", "mcc", "auroc"]


def bootstrap_metrics(scored: DataFrame, key: str, reps: int, seed: int | str, threshold: float = 0.5, exact: bool = True) -> DataFrame:
    """One row of metrics per bootstrap replicate of rows (key, label, score).

    Metrics only need how many rows of each (label, score) a replicate has, so
    that is what is drawn: rows are counted by cell once, and replicates are
    drawn from the counts. ``exact=False`` gives every row a Poisson weight.
    """
    if exact:
        counts = scored.groupBy("label", "score").agg(F.count(F.lit(1)).alias("n"))
        cells = resampled(counts, ["label", "score"], reps, seed, n="n").drop("n")
    else:
        rows = poisson_weights(scored.select(key, "label", "score"), key, reps, seed)
        cells = rows.groupBy("rep", "label", "score").agg(F.sum("weight").alias("weight"))
    cells = cut_lineage(cells)
    auc = roc_auc(cells, ["rep"])
    return confusion_metrics(cells, ["rep"], threshold).join(auc, "rep")


def metric_intervals(replicates: DataFrame) -> DataFrame:
    """(metric, mean, half_width) over the replicates, one row each, which are stored."""
    long = cut_lineage(replicates.select("rep", *METRICS)).unpivot(["rep"], METRICS, "metric", "value")
    return interval_summary(long, "value", ["metric"]).select("metric", "mean", "half_width")


# ---- clusters ----


def cluster_regions(df: DataFrame, cols: Sequence[str], k: int | None, pca_dims: int | None = None, seed: int = 0,
                    region: str = "region", date: str = "date") -> DataFrame:
    """Adds ``cluster``: k-means of the regions' last attribute values, scaled and optionally reduced by PCA.

    ``k=None`` gives every region a cluster of its own.
    """
    base = df.drop("cluster")
    if k is None:
        return base.withColumn("cluster", F.col(region))
    vectors = region_vectors(base, cols, region, date)
    features = "_x"
    if pca_dims is not None:
        vectors = PCA(k=pca_dims, inputCol="_x", outputCol="_p").fit(vectors).transform(vectors)
        features = "_p"
    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(vectors)
    return base.join(model.transform(vectors).select(region, "cluster"), region, "left")


def region_vectors(df: DataFrame, cols: Sequence[str], region: str = "region", date: str = "date") -> DataFrame:
    """(region, cols, _x): scaled last values per region as a vector."""
    last = standard_scaled(last_values(df, cols, region, date), cols)
    return VectorAssembler(inputCols=list(cols), outputCol="_x").transform(last)


def principal_components(df: DataFrame, cols: Sequence[str], dims: int, region: str = "region", date: str = "date") -> DataFrame:
    """(region, pc0..): scores of the scaled last values on the leading components; signs are arbitrary."""
    vectors = region_vectors(df, cols, region, date)
    scored = PCA(k=dims, inputCol="_x", outputCol="_p").fit(vectors).transform(vectors)
    parts = vector_to_array("_p")
    return scored.select(region, *[parts.getItem(i).alias(f"pc{i}") for i in range(dims)])


# ---- regression ----


def ols_by_replicate(rows: DataFrame, y: str, xs: Sequence[str], weight: str = "weight", group: str = "rep") -> DataFrame:
    """(rep, feature, coef, explained_variance): weighted least squares with intercept per replicate.

    Each replicate is reduced to its cross-product sums in one aggregate; only
    those few numbers per replicate reach the small solve. Sums are taken about
    the overall means, which keeps the solve well conditioned and leaves the
    slopes unchanged.
    """
    means = rows.agg(F.struct(*[F.avg(c).alias(c) for c in [y, *xs]])).scalar()
    centred = rows.select(group, weight, *[(F.col(c) - means.getField(c)).alias(c) for c in [y, *xs]])
    reduced = centred.groupBy(group).agg(*[s.alias(n) for n, s in _cross_products(y, xs, F.col(weight)).items()])
    return _solved(reduced, xs, group)


def _cross_products(y: str, xs: Sequence[str], weight: Column) -> dict[str, Column]:
    """Weighted sums of products of all pairs of 1, xs and y."""
    return {name: F.sum(weight * product) for name, product in _products(y, xs).items()}


def _products(y: str, xs: Sequence[str]) -> dict[str, Column]:
    names = ["_one", *xs, y]
    value = {"_one": F.lit(1.0), **{c: F.col(c) for c in [*xs, y]}}
    return {f"s{i}_{j}": value[a] * value[b] for i, a in enumerate(names) for j, b in enumerate(names) if j >= i}


def _solved(reduced: DataFrame, xs: Sequence[str], group: str) -> DataFrame:
    """Coefficients and explained variance from one row of cross products per group."""
    size, features = len(xs) + 2, ["intercept", *xs]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples(index=False):
            m = np.zeros((size, size))
            for i in range(size):
                for j in range(i, size):
                    m[i, j] = m[j, i] = getattr(row, f"s{i}_{j}")
            a, b, yy, n = m[:-1, :-1], m[:-1, -1], m[-1, -1], m[0, 0]
            coef = np.linalg.lstsq(a, b, rcond=None)[0]
            total = yy - m[0, -1] ** 2 / n
            resid = yy - 2 * coef @ b + coef @ a @ coef - (m[0, -1] - coef @ a[0]) ** 2 / n
            ev = 1 - resid / total if total > 0 else None
            out += [(getattr(row, group), f, float(c), ev) for f, c in zip(features, coef)]
        return pd.DataFrame(out, columns=[group, "feature", "coef", "explained_variance"])

    schema = f"{group} {dict(reduced.dtypes)[group]}, feature string, coef double, explained_variance double"
    solved = reduced.mapInPandas(lambda it: (solve(p) for p in it), schema)
    return solved.where(F.col("feature") != "intercept")


def bootstrap_ols(df: DataFrame, key: str, y: str, xs: Sequence[str], reps: int, seed: int | str, exact: bool = True) -> DataFrame:
    """``ols_by_replicate`` over bootstrap replicates of the rows, which are drawn where the rows are."""
    rows = df.select(key, y, *xs)
    if not exact:
        return ols_by_replicate(poisson_weights(rows, key, reps, seed), y, xs)
    # where values are missing the fit depends on what the sums are taken about: the mean of the drawn rows, each once
    whole = rows.where(reduce(or_, [F.col(c).isNull() for c in [y, *xs]])).isEmpty()
    about = rows if whole else cut_lineage(resampled(rows, [key], reps, seed))
    means = about.agg(F.struct(*[F.avg(c).alias(c) for c in [y, *xs]])).scalar()
    centred = rows.select(key, *[(F.col(c) - means.getField(c)).alias(c) for c in [y, *xs]])
    products = _products(y, xs)
    return _solved(resampled_sums(centred.select(key, *[v.alias(c) for c, v in products.items()]), [key], reps, seed, list(products)), xs, "rep")


def block_ols(df: DataFrame, key: str, y: str, xs: Sequence[str], reps: int, seed: int | str, blocks: int = 256) -> DataFrame:
    """``ols_by_replicate`` with hash blocks of rows drawn in place of rows.

    One aggregate gives the cross products of each block; a replicate draws as
    many blocks as there are and adds theirs up. The rows are read once whatever
    the number of replicates. Blocks are random parts of the rows, so intervals
    agree with those of drawn rows while there are many more blocks than columns.
    """
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in [y, *xs]])).scalar()
    centred = df.select((h32(f"{seed}-block", F.col(key)) % blocks).alias("block"), *[(F.col(c) - means.getField(c)).alias(c) for c in [y, *xs]])
    sums = centred.groupBy("block").agg(*[s.alias(n) for n, s in _cross_products(y, xs, F.lit(1)).items()])
    drawn = resampled(sums, ["block"], reps, seed)
    return _solved(drawn.groupBy("rep").agg(*[F.sum(F.col(n) * F.col("weight")).alias(n) for n in sums.columns if n != "block"]), xs, "rep")


def coefficient_summary(replicates: DataFrame, value: str = "coef") -> DataFrame:
    """Mean, p and interval per feature of the replicates, which are stored, most significant first; numbers also as fixed-decimal text."""
    s = interval_summary(cut_lineage(replicates.select("feature", value)), value, ["feature"])
    text = F.format_string("(%.5f, %.5f)", "lower", "upper")
    out = s.select("feature", "mean", "p", "lower", "upper", F.format_string("%.5f", "mean").alias("mean_text"),
                   F.format_string("%.3f", "p").alias("p_text"), text.alias("interval_text"))
    return out.orderBy(F.col("p").asc(), F.col("mean").desc())


def explained_variance_summary(replicates: DataFrame) -> DataFrame:
    """Mean and interval of the explained variance over replicates, each counted once and stored."""
    per_rep = cut_lineage(replicates.groupBy("rep").agg(F.max("explained_variance").alias("explained_variance")))
    return interval_summary(per_rep, "explained_variance").select("n", "mean", "lower", "upper")


def importance_summary(replicates: DataFrame) -> DataFrame:
    """Mean and interval of each feature's importance over the replicates, which are stored."""
    rows = cut_lineage(replicates.select("rep", "feature", "importance"))
    s = interval_summary(rows, "importance", ["feature"]).select("feature", "n", "mean", "lower", "upper")
    return s.orderBy(F.col("mean").desc())


def ols_report(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """(feature, coef, std_error, t, p, r2) of a least-squares fit with intercept."""
    rows = VectorAssembler(inputCols=list(xs), outputCol="_x").transform(df.select(F.col(y).cast("double").alias("_y"), *xs).dropna())
    model = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal").fit(rows)
    s = model.summary
    table = list(zip([*xs, "const"], [*model.coefficients.toArray().tolist(), model.intercept], s.coefficientStandardErrors, s.tValues, s.pValues))
    out = df.sparkSession.createDataFrame([tuple([n, *map(float, v)]) for n, *v in table], "feature string, coef double, std_error double, t double, p double")
    return out.withColumn("r2", F.lit(float(s.r2)))

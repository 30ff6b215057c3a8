"""Seeded sampling, resampling and permutation, and word-frequency rebalancing."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, factorial

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions.hashing import h32, unit
from panelspark.functions.text import OVERSAMPLING_EXCEPTIONS, bare_word, is_word, raw_words, words
from panelspark.operators.resampling import resampled
from panelspark.operators.skew import positions
from panelspark.session import cut_lineage, forget, scratch_path


def hash_order(df: DataFrame, key: str, seed: int | str, out: str = "_h") -> DataFrame:
    return df.withColumn(out, h32(seed, F.col(key)))


def hash_positions(df: DataFrame, key: str, seed: int | str, out: str = "pos") -> DataFrame:
    """Adds each row's place in the random order, and the row count ``n``."""
    return positions(hash_order(df, key, seed), "_h", tie=[key], out=out).drop("_h")


# Bits of a hash that name its bucket: a histogram of the buckets is bounded, and evenly filled.
BUCKET_BITS = 16


def drawn(df: DataFrame, key: str, n: int, seed: int | str, skip: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows ``skip`` to ``skip + n`` of a random order, all others); ``key`` is unique.

    The order is that of a hash. Rows are counted by the hash's leading bits,
    which says for all but two buckets on which side of the cuts they lie. Only
    the rows of those two are put in order.
    """
    held = hash_order(df, key, seed).withColumn("_bucket", F.shiftright("_h", 32 - BUCKET_BITS).cast("int"))
    sizes = held.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    upto = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)  # over 2^BUCKET_BITS rows at most
    ends = sizes.select("_bucket", F.sum("_size").over(upto).alias("_end"), "_size")
    first, last, start, end = F.lit(skip), F.lit(skip + n), F.col("_end") - F.col("_size"), F.col("_end")
    side = F.when((start >= first) & (end <= last), True).when((end <= first) | (start >= last), False)
    # the histogram has at most 2^BUCKET_BITS rows
    marked = held.join(F.broadcast(ends.select("_bucket", start.alias("_start"), side.alias("_in"))), "_bucket")
    place = F.row_number().over(W.partitionBy("_bucket").orderBy("_h", key)) + F.col("_start") - 1
    cut = marked.where(F.col("_in").isNull()).withColumn("_in", place.between(first, last - 1))
    rows = marked.where(F.col("_in").isNotNull()).unionByName(cut)
    return rows.where("_in").select(*df.columns), rows.where("NOT _in").select(*df.columns)


def sample_n(df: DataFrame, key: str, n: int, seed: int | str, skip: int = 0) -> DataFrame:
    """Rows ``skip`` to ``skip + n`` of a random order; ``key`` is unique."""
    return drawn(df, key, n, seed, skip)[0]


def shuffled(df: DataFrame, key: str, seed: int | str) -> DataFrame:
    """All rows in random order: a range-partitioned sort by hash."""
    return hash_order(df, key, seed).orderBy("_h", key).drop("_h")


def split_by_count(df: DataFrame, key: str, n_test: int, seed: int | str) -> tuple[DataFrame, DataFrame]:
    """(test, train): ``n_test`` random rows and the rest."""
    return drawn(df, key, n_test, seed)


def bootstrap_rows(df: DataFrame, key: str, reps: int, seed: int | str) -> DataFrame:
    """Rows drawn with replacement: ``rep`` and the columns of ``df``, one row per draw, as many draws per replicate as rows."""
    times = F.explode(F.array_repeat(F.lit(0), F.col("weight").cast("int")))
    return resampled(df, [key], reps, seed).withColumn("_", times).select("rep", *df.columns)


def bootstrap_counts(df: DataFrame, key: str, reps: int, seed: int | str) -> DataFrame:
    """(rep, key, weight): how often each row is drawn with replacement, rows not drawn left out."""
    return resampled(df.select(key), [key], reps, seed)


def poisson_weights(df: DataFrame, key: str, reps: int, seed: int | str) -> DataFrame:
    """Every row once per replicate with a Poisson(1) weight, zeros left out.

    The usual stand-in for drawing with replacement on large tables: each row
    decides alone, so nothing is shuffled; replicate sizes vary around n.
    """
    cdf, total = [], 0.0
    for k in range(13):
        total += exp(-1) / factorial(k)
        cdf.append(total)
    u = F.col("_u")
    weight = sum([(u >= c).cast("int") for c in cdf[1:]], (u >= cdf[0]).cast("int"))
    reps_of = df.select(*df.columns, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    drawn = reps_of.withColumn("_u", unit(seed, F.col("rep"), F.col(key))).withColumn("weight", weight)
    return drawn.where("weight > 0").drop("_u")


def sample_regions(
    df: DataFrame, n: int | None, seed: int | str, replace: bool = False, region: str = "region", frac: float | None = None
) -> DataFrame:
    """All rows of ``n`` random regions, or of the part ``frac`` of them, rounded; with replacement a region drawn k
    times appears k times (column ``copy``).
    """
    if (n is None) == (frac is None):
        raise ValueError("give either n or frac")
    regions = df.select(region).distinct()
    size = regions.agg(F.count(F.lit(1))).scalar()
    many = F.lit(n) if n is not None else F.round(size * F.lit(frac)).cast("bigint")
    rows = hash_positions(regions, region, seed, "_row")
    if not replace:
        return df.join(rows.where(F.col("_row") < many).select(region), region, "left_semi").select(*df.columns)
    slots = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(1).cast("bigint"), many.cast("bigint"))).alias("_slot"))
    slots = slots.select((F.col("_slot") - 1).alias("_slot"), size.alias("_size"))
    picks = slots.select(F.col("_slot").alias("copy"), F.pmod(h32(seed, F.lit("draw"), F.col("_slot")), F.col("_size")).alias("_row"))
    return df.join(picks.join(rows.select(region, "_row"), "_row").drop("_row"), region)


def region_permutation(regions: DataFrame, seed: int | str, region: str = "region") -> DataFrame:
    """(region, source): a random one-to-one mapping between the regions."""
    ids = regions.select(region).distinct()
    to = hash_positions(ids, region, f"{seed}-a").select(region, "pos")
    of = hash_positions(ids, region, f"{seed}-b").select(F.col(region).alias("source"), "pos")
    return to.join(of, "pos").select(region, "source")


def permute_column(df: DataFrame, col: str, mapping: DataFrame, region: str = "region", date: str = "date") -> DataFrame:
    """Gives every region the column of its mapped source region on the same date, NULL where that has no row."""
    moved = df.select(F.col(region).alias("source"), date, col).join(mapping, "source").select(region, date, col)
    return df.drop(col).join(moved, [region, date], "left").select(*df.columns)


def word_counts(df: DataFrame, stop_words: Sequence[str], text: str = "text", more_than: int = 5) -> DataFrame:
    """(word, n) for words seen more than ``more_than`` times.

    Words are counted as they stand first; the stop list and the stripping
    then meet each distinct word once.
    """
    raw = df.select(F.explode(raw_words(F.col(text))).alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    bare = raw.where(is_word(F.col("_w"), stop_words)).groupBy(bare_word(F.col("_w")).alias("word"))
    return bare.agg(F.sum("_n").alias("n")).where(F.col("n") > more_than)


def oversampled_words(
    counts: DataFrame,
    baseline: DataFrame,
    threshold: float = 0.02,
    exceptions: Sequence[str] = OVERSAMPLING_EXCEPTIONS,
) -> DataFrame:
    """(word, score): shared words whose share exceeds the baseline's, by (p - q) / sqrt(q) > threshold."""
    return _scored(_shared(counts, baseline), threshold, exceptions)


def _shared(counts: DataFrame, baseline: DataFrame) -> DataFrame:
    """(word, n, m): the words of both, stored, as the totals and the words are read one after the other."""
    return cut_lineage(counts.select("word", "n").join(baseline.select("word", F.col("n").alias("m")), "word"))


def _scored(both: DataFrame, threshold: float, exceptions: Sequence[str]) -> DataFrame:
    totals = both.agg(F.struct(F.sum("n").alias("n"), F.sum("m").alias("m"))).scalar()
    p, q = F.col("n") / totals.getField("n"), F.col("m") / totals.getField("m")
    scored = both.select("word", ((p - q) / F.sqrt(q)).alias("score")).where(F.col("score") > threshold)
    return scored.where(~F.col("word").isin(list(exceptions))) if exceptions else scored


def rebalance_words(
    df: DataFrame,
    baseline: DataFrame,
    key: str,
    stop_words: Sequence[str],
    seed: int | str,
    threshold: float = 0.02,
    more_than: int = 5,
    one_by_one: bool = False,
    text: str = "text",
    exceptions: Sequence[str] = OVERSAMPLING_EXCEPTIONS,
) -> DataFrame:
    """Drops random rows holding an over-sampled word until no word is over-sampled.

    ``one_by_one`` drops one row per round. Otherwise a round drops, for every
    over-sampled word, as many rows as its count exceeds what the baseline
    allows at the current totals, so no word is thinned beyond its excess and
    few rounds are needed. Words are counted once, those of ``baseline`` too; a
    round takes the counts of the rows it drops off them. Rounds write only those rows' keys and the
    counts, to the shared checkpoint folder. Rows without a key are dropped.
    """
    held, baseline = cut_lineage(postings(df, key, stop_words, seed, text)), cut_lineage(baseline.select("word", "n"))
    counts = first = cut_lineage(held.groupBy("word").agg(F.sum("_n").alias("n")))
    gone_path, rounds = scratch_path(df.sparkSession, "dropped"), 0
    kept, stages = held, []
    while True:
        dropped = rebalance_round(kept, counts, baseline, key, threshold, more_than, one_by_one, exceptions)
        # each round in a folder of its own, so that all rounds read as one table
        dropped.write.parquet(f"{gone_path}/round={rounds}")
        if counts is not first:
            stages.append(counts)
        last = df.sparkSession.read.schema(dropped.schema).parquet(f"{gone_path}/round={rounds}")
        gone = df.sparkSession.read.schema(dropped.schema).option("recursiveFileLookup", "true").parquet(gone_path)
        if last.isEmpty():
            forget(held, baseline, first, *stages)
            return df.where(F.col(key).isNotNull()).join(gone, key, "left_anti").select(*df.columns)
        lost = kept.join(last, key, "left_semi").groupBy("word").agg(F.sum("_n").alias("_lost"))
        counts = cut_lineage(counts.join(lost, "word", "left").select("word", (F.col("n") - F.coalesce("_lost", F.lit(0))).alias("n")))
        kept, rounds = held.join(gone, key, "left_anti"), rounds + 1


def rebalance_round(
    held: DataFrame,
    counts: DataFrame,
    baseline: DataFrame,
    key: str,
    threshold: float = 0.02,
    more_than: int = 5,
    one_by_one: bool = False,
    exceptions: Sequence[str] = OVERSAMPLING_EXCEPTIONS,
) -> DataFrame:
    """Keys of the rows that a round drops, from the rows' ``postings`` and the counts of all words."""
    over = excess_words(counts.where(F.col("n") > more_than), baseline, threshold, exceptions)
    rows_of = held.join(over, "word")
    if one_by_one:
        return rows_of.orderBy("_h", key).limit(1).select(key)
    least = positions(rows_of, "_h", ["word"], [key], "_pos")
    return least.where(F.col("_pos") < F.col("excess")).select(key).distinct()


def postings(df: DataFrame, key: str, stop_words: Sequence[str], seed: int | str, text: str = "text") -> DataFrame:
    """(key, _h, word, _n): how often each row holds each word, and the row's place in the random order."""
    each = df.where(F.col(key).isNotNull()).select(key, F.explode(words(F.col(text), stop_words)).alias("word"))
    return each.groupBy(key, "word").agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", h32(seed, F.col(key)))


def excess_words(counts: DataFrame, baseline: DataFrame, threshold: float, exceptions: Sequence[str]) -> DataFrame:
    """(word, excess): over-sampled words and by how much their count exceeds what the baseline allows, at least 1."""
    both = _shared(counts, baseline)
    totals = both.agg(F.struct(F.sum("n").alias("n"), F.sum("m").alias("m"))).scalar()
    q = F.col("m") / totals.getField("m")
    allowed = (q + threshold * F.sqrt(q)) * totals.getField("n")
    over = _scored(both, threshold, exceptions).select("word")
    return both.join(over, "word", "left_semi").select("word", F.greatest(F.lit(1), F.ceil(F.col("n") - allowed)).cast("bigint").alias("excess"))


def pick_draw(draws: DataFrame, seed: int | str) -> DataFrame:
    """All rows of one random (chain, draw)."""
    ids = draws.select("chain", "draw").distinct().withColumn("_h", h32(seed, F.col("chain"), F.col("draw")))
    picked = ids.orderBy("_h", "chain", "draw").limit(1).select("chain", "draw")
    return draws.join(picked, ["chain", "draw"], "left_semi").select(*draws.columns)

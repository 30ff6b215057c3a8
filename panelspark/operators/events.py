"""From raw posts to labelled events and daily counts per region."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions import text as X
from panelspark.functions.nulls import drop_missing
from panelspark.operators.skew import keep_first, salted_join


def flatten_posts(raw: DataFrame) -> DataFrame:
    """Nested posts to the flat event table; control records are skipped. Works on streams too."""
    return raw.where(F.col("limit").isNull()).select(
        F.col("id").alias("event_id"),
        X.post_text().alias("text"),
        X.post_time(F.col("created_at")).alias("event_time"),
        F.col("user.id").alias("user_id"),
        "lang",
        X.referenced_id().alias("ref_id"),
    )


def users_by_place(places: DataFrame) -> DataFrame:
    """A map column ``places`` from location to user ids, as (user_id, location) rows."""
    per_place = places.select(F.explode("places").alias("location", "users"))
    return per_place.select(F.explode("users").alias("user_id"), "location")


def locate_users(users: DataFrame, codes: DataFrame) -> DataFrame:
    """(user_id, location) to one (user_id, state, county, region) row per user.

    ``codes`` holds geo_level, area_name, state_code and region. County names
    match rows of any geo level. A user in several places keeps the first by
    region code.
    """
    states = codes.where(F.col("geo_level") == "State").select(F.col("area_name").alias("state"), "state_code")
    counties = codes.select(F.col("area_name").alias("county"), "state_code", F.col("region").cast("bigint").alias("region"))
    parts = users.select(
        "user_id",
        X.location_state(F.col("location")).alias("state"),
        X.location_county(F.col("location")).alias("county"),
    )
    joined = parts.join(states, "state").join(counties, ["state_code", "county"]).drop("state_code")
    return drop_missing(keep_first(joined, ["user_id"], ["region", "state", "county"])).select("user_id", "state", "county", "region")


def geotag(events: DataFrame, users: DataFrame, spread: Sequence[str] = ("event_id",)) -> DataFrame:
    """Events of located users with their region. A very active user's events are spread over many tasks."""
    return salted_join(events, users.select("user_id", "region"), ["user_id"], spread=spread)


def located_share(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events in all, events of located users, and their ratio; events are reduced per user before the join."""
    per_user = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    known = users.select("user_id").distinct().withColumn("_known", F.lit(1))
    tagged = per_user.join(known, "user_id", "left")
    out = tagged.agg(F.sum("_n").alias("n_total"), F.coalesce(F.sum(F.when(F.col("_known") == 1, F.col("_n"))), F.lit(0)).alias("n_located"))
    return out.withColumn("share_located", F.try_divide("n_located", "n_total"))


def between_dates(df: DataFrame, first: str, last: str, date: str = "date", closed: bool = True) -> DataFrame:
    upper = F.col(date) <= F.lit(last).cast("date") if closed else F.col(date) < F.lit(last).cast("date")
    return df.where((F.col(date) >= F.lit(first).cast("date")) & upper)


def user_majority(events: DataFrame, flag: str = "flag") -> DataFrame:
    """(user_id, user_flag): more flagged than unflagged events? A tie is False; users without a label are left out."""
    out = events.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count_if(F.col(flag) == 1).alias("_f"), F.count_if(F.col(flag) == 0).alias("_u")
    )
    return out.where(F.col("_f") + F.col("_u") > 0).select("user_id", (F.col("_f") > F.col("_u")).alias("user_flag"))


def daily_activity(
    events: DataFrame, users: DataFrame | None = None, keep_all_days: bool = True, copy_counts: bool = False
) -> DataFrame:
    """Eight daily counts per (region, date), from events with user_id, date, flag and ref_id.

    Events are first reduced to (user, region, date), so that neither a very
    active user nor a busy region reaches the later steps row by row; a user's
    label and first day in a region are windows over that small table. With
    ``users`` the region is joined after that step, else ``events`` carries it.
    ``keep_all_days=False`` keeps only days on which the region saw a new user.
    ``copy_counts=True`` reports event counts in place of reference counts.
    """
    is_ref = F.col("ref_id") != -1
    cells = events.groupBy("user_id", *([] if users is not None else ["region"]), "date").agg(
        F.sum("flag").alias("flagged"),
        F.count("flag").alias("n"),
        F.count_if(F.col("flag") == 1).alias("_f"),
        F.count_if(F.col("flag") == 0).alias("_u"),
        F.sum(F.when(is_ref, F.col("flag"))).alias("ref_flagged"),
        F.count(F.when(is_ref, F.col("flag"))).alias("refs"),
        F.max(is_ref.cast("int")).alias("_has_ref"),
    )
    if users is not None:
        cells = cells.join(users.select("user_id", "region"), "user_id")
    # events without a user are no one user's: they are told apart by region, lest they all meet in one window
    cells = cells.withColumn("_nobody", F.when(F.col("user_id").isNull(), F.col("region")))
    by_user = W.partitionBy("user_id", "_nobody")
    f, u = F.sum("_f").over(by_user), F.sum("_u").over(by_user)
    label = F.when((f + u > 0) & F.col("user_id").isNotNull(), (f > u).cast("int"))
    first_day = F.min("date").over(W.partitionBy("user_id", "_nobody", "region"))
    marked = cells.withColumns({"_label": label, "_new": F.col("date") == first_day})
    new_label = F.when(F.col("_new"), F.col("_label"))
    days = marked.where(F.col("region").isNotNull() & F.col("date").isNotNull()).groupBy("region", "date").agg(
        F.coalesce(F.sum("flagged"), F.lit(0)).alias("n_flagged"),
        F.sum("n").alias("n_events"),
        # NULL, not 0, where a day has no reference at all
        F.when(F.max("_has_ref") == 1, F.coalesce(F.sum("ref_flagged"), F.lit(0))).alias("n_flagged_refs"),
        F.when(F.max("_has_ref") == 1, F.sum("refs")).alias("n_refs"),
        F.coalesce(F.sum(new_label), F.lit(0)).alias("n_new_flagged_users"),
        F.count(new_label).alias("n_new_users"),
        F.coalesce(F.sum("_label"), F.lit(0)).alias("n_active_flagged_users"),
        F.count("_label").alias("n_active_users"),
        F.max("_new").alias("_any_new"),
    )
    if not keep_all_days:
        days = days.where("_any_new")
    days = days.drop("_any_new")
    if copy_counts:
        days = days.withColumns({"n_flagged_refs": F.col("n_flagged"), "n_refs": F.col("n_events")})
    return days


def new_users(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Users and flagged users by the first day they appear in a region."""
    firsts = events.groupBy("region", "user_id").agg(F.min("date").alias("date"))
    return _count_users(firsts, labels, "new")


def active_users(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Users and flagged users with any event in a region on a day."""
    return _count_users(events.select("user_id", "region", "date").distinct(), labels, "active")


def _count_users(user_days: DataFrame, labels: DataFrame, kind: str) -> DataFrame:
    tagged = user_days.join(labels, "user_id", "left").where(F.col("region").isNotNull() & F.col("date").isNotNull())
    flag = F.col("user_flag").cast("int")
    return tagged.groupBy("region", "date").agg(
        F.coalesce(F.sum(flag), F.lit(0)).alias(f"n_{kind}_flagged_users"), F.count(flag).alias(f"n_{kind}_users")
    )


def attach_predictions(events: DataFrame, predictions: DataFrame, spread: Sequence[str] = ("event_id",)) -> DataFrame:
    """Joins labels made once per distinct text back to every event; a missing text matches a missing text.

    Texts meet by their digest, so no shuffle or sort has a text as its key.
    """
    keyed = predictions.withColumn("_digest", text_digest("text")).drop("text")
    return salted_join(events.withColumn("_digest", text_digest("text")), keyed, ["_digest"], spread=spread, null_safe=True).drop("_digest")


def text_digest(text: str) -> Column:
    """128 bits that stand for a text where it is a key; NULL for a missing one."""
    return F.unhex(F.md5(F.col(text)))


def distinct_texts(events: DataFrame, text: str = "text") -> DataFrame:
    return events.select(text).groupBy(text_digest(text).alias("_digest")).agg(F.first(text).alias(text)).select(text)


def clean_answers(answers: DataFrame) -> DataFrame:
    """accept/reject answers to distinct (text, is_flagged) rows; other answers and missing texts go."""
    kept = answers.where(F.col("answer") != "ignore").select("text", answer_flag(F.col("answer")).alias("is_flagged"))
    one = kept.groupBy(text_digest("text").alias("_digest"), "is_flagged").agg(F.first("text").alias("text"))
    return drop_missing(one.select("text", "is_flagged"))


def answer_flag(answer: Column) -> Column:
    return F.when(answer == "accept", F.lit(True)).when(answer == "reject", F.lit(False))


def unseen_dates(available: DataFrame, written: DataFrame, date: str = "date") -> DataFrame:
    """Dates not written yet."""
    return available.join(written.select(date), date, "left_anti").select(*available.columns)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))

"""Text expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that mark a post as a candidate for hand labelling.
KEYWORDS = [
    "experiment",
    "palsy", "plandemic", "survival rate", "unprov", "against humanity",
    "not take", "msm", "hoax", "rush", "poison", "injur", "untest",
    "chemical", "not a vaccine", "fertil", "miscar", "autism", "not get",
    "health defense", "nuremberg",
    "guinea", "depopulat", "censor", "bioweapon", '"vaccine"', "'vaccine'",
    "gene", "vaer",
]

# Fixed value: characters stripped from both ends of a word.
PUNCTUATION = """!"#$%&'()*+, -./:;<=>?@[\\]^_`{|}~"""

# Words never counted as over-sampled.
OVERSAMPLING_EXCEPTIONS = ["i'm", "doesn't", "san", "antonio"]


def contains_any(text: Column, keywords: Sequence[str] = KEYWORDS) -> Column:
    """Does the lower-cased text contain any keyword, taken literally?"""
    # a one-element array binds the lower-cased text, so that it is made once per row
    return F.exists(F.array(F.lower(text)), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keywords]))


def words(text: Column, stop_words: Sequence[str], min_len: int = 3) -> Column:
    """Lower-cased words longer than two letters and not in the stop list, then stripped of punctuation.

    Stop words and length are tested before stripping, so "the," stays in as
    "the" and a word of punctuation only becomes an empty string.
    """
    kept = F.filter(raw_words(text), lambda w: is_word(w, stop_words, min_len))
    return F.transform(kept, bare_word)


def raw_words(text: Column) -> Column:
    """Lower-cased text split at white space; white space at either end leaves an empty string there."""
    return F.split(F.lower(text), r"\s+")


def is_word(w: Column, stop_words: Sequence[str], min_len: int = 3) -> Column:
    long_enough = F.length(w) >= max(min_len, 1)
    return long_enough & ~w.isin(list(stop_words)) if stop_words else long_enough


def bare_word(w: Column) -> Column:
    return F.btrim(w, F.lit(PUNCTUATION))


def post_text(row: str = "") -> Column:
    """Text of a post: the shared post's long form, its short form, the own long form, the own short form."""
    p = f"{row}." if row else ""
    shared = F.coalesce(F.col(f"{p}retweeted_status.extended_tweet.full_text"), F.col(f"{p}retweeted_status.text"))
    own = F.coalesce(F.col(f"{p}extended_tweet.full_text"), F.col(f"{p}text"))
    return F.when(F.col(f"{p}retweeted_status").isNotNull(), shared).otherwise(own)


def referenced_id(row: str = "") -> Column:
    """Id of the shared post, -1 for an original."""
    p = f"{row}." if row else ""
    return F.coalesce(F.col(f"{p}retweeted_status.id"), F.lit(-1).cast("bigint"))


def post_time(created_at: Column) -> Column:
    """'Wed Feb 03 13:04:05 +0000 2021' as a timestamp; the weekday is left out, Spark cannot parse it."""
    return F.to_timestamp(F.substring(created_at, 5, 100), "MMM dd HH:mm:ss Z yyyy")


def location_parts(location: Column) -> Column:
    """\"['Some County', 'Some State']\" as [county, state]."""
    bare = F.btrim(location, F.lit(" []"))
    return F.split(F.replace(F.replace(bare, F.lit("'"), F.lit("")), F.lit(", "), F.lit(",")), ",")


def location_county(location: Column) -> Column:
    return F.btrim(F.element_at(location_parts(location), 1), F.lit('"'))


def location_state(location: Column) -> Column:
    return F.element_at(location_parts(location), 2)

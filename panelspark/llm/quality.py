"""Quality rules kept in a ledger: measurements and one failure bit a rule, to which policies are applied afterwards."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Rules by bit: a text fails where the expression over its measurements is true. Bits are never given to another rule.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "2 * n_symbols > n_words",
    "repeated_lines": "n_lines > 4 AND 2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "no_letters": "n_letters = 0",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    """A version and the rules that it applies."""

    version: str
    mask: int


POLICIES = {
    "base": Policy("base", BASE),
    "v1": Policy("v1", BASE | BIT["many_symbols"] | BIT["repeated_lines"]),
    "v2": Policy("v2", sum(BIT.values())),
}


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    """Measurements of each text. Arrays used inside lambdas are columns of their own, so they are built once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(text, BLANKS, -1), lambda w: w != "")
    df = docs.withColumns(
        {
            "_words": words,
            "_lines": lines,
            "word_chars": F.length(F.regexp_replace(text, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
            "n_letters": F.when(text.rlike(r"\p{L}"), F.lit(1)).otherwise(0),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_words", "_lines")
    windows = F.transform(
        F.slice("_hashes", 1, F.greatest(F.size("_hashes") - F.lit(WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get("_hashes", i + k) for k in range(1, WINDOW)]),
    )
    df = df.withColumn("_windows", windows)
    # only texts in which some window repeats are sorted
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    tagged = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(tagged))).drop("_hashes", "_windows")

    def like_a_neighbour(x: Column, k: Column) -> Column:
        same = F.get("_sorted", k - 1)["h"].eqNullSafe(x["h"]) | F.get("_sorted", k + 1)["h"].eqNullSafe(x["h"])
        return F.when(same, x["i"])

    df = df.withColumn("_at", F.sort_array(F.array_compact(F.transform("_sorted", like_a_neighbour))))
    covered = F.aggregate(
        F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_sorted", "_at")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failed): every rule is evaluated once, ``failed`` has a bit for each one that failed.

    A null text has no words. Rows, ids that are null or repeated included,
    stay one to one; other columns are not carried. The words measured are runs
    of characters other than blank, tab and the line ends; a word counts as
    repeated if some window of 8 words over it occurs twice in the text.
    """
    out = _measured(docs.select(id_col, text_col), text_col).drop(text_col)
    bits = F.lit(0).cast("long")
    for name, failing in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(failing), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return out.select(id_col, *MEASURES, bits.alias("failed"))


def kept(policy: Policy, failed: str = "failed") -> Column:
    """Does the policy keep a text with these failure bits?"""
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) == 0


def ablation(entries: DataFrame, policies: Mapping[str, Policy] | None = None) -> DataFrame:
    """(version, rule, n_failed, n_rejected, n_only): of the texts a policy rejects, those that only one rule rejects.

    Leaving that rule out would bring back ``n_only`` texts. The ledger is
    first reduced to counts by failure bits, of which there are few, so trying
    policies reads no text.
    """
    policies = policies or POLICIES
    by_bits = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    tries = F.array(
        *[
            F.struct(F.lit(p.version).alias("version"), F.lit(p.mask).cast("long").alias("mask"), F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit"))
            for p in policies.values()
            for name, bit in BIT.items()
            if p.mask & bit
        ]
    )
    rows = by_bits.select("failed", "n", F.explode(tries).alias("t")).select("failed", "n", "t.*")
    under = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0).cast("long")))
    return rows.groupBy("version", "rule").agg(
        count(under.bitwiseAND(F.col("bit")) != 0).alias("n_failed"), count(under != 0).alias("n_rejected"), count(under == F.col("bit")).alias("n_only")
    )

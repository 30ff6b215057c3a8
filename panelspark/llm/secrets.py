"""Secrets in texts by an incremental ledger: every distinct content is scanned once for each rule version."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern, the least length of one of its groups, and what a text must contain for it to match at all."""

    name: str
    version: int
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name}/{self.version}"


# The rules in the order in which kinds are listed.
RULES = (
    Rule("assign", 1, r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, (":", "=")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    # runs of fewer than 24 fail anyway, and a run is one match, so the bound may stand in the pattern
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)


def _hits(text: Column, rule: Rule) -> Column:
    """Array of (gap, size, keep): code points before a match since the last one, its size, whether it passes."""
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    found = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), part.alias("part")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("size"), (F.length(x["part"]) >= rule.least).alias("keep")),
    )
    may = text.rlike(rule.pattern)
    if rule.hints:
        hinted = F.lit(False)
        for h in rule.hints:
            hinted = hinted | text.contains(h)
        may = hinted & may
    return F.when(may, found)


def with_blob(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``blob``, the content address: SHA-256 of the text; a null text counts as the empty one."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """Ledger entries for what ``ledger`` lacks: (blob, rule, findings), a row for each blob and rule version.

    ``versions`` holds every historical version of every path; equal contents
    are one blob, scanned once. ``rule`` is name/version, so a rule of a new
    version is scanned anew on all blobs and others are not. ``findings`` is an
    array of (start, stop) in code points, empty where nothing was found. An
    empty table gives no entries.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("_text")).groupBy("blob").agg(F.first("_text").alias("_text"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("_seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("_seen", F.coalesce("_seen", F.array().cast("array<string>")))
        blobs = blobs.where(F.size(F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.col("_seen"))) > 0)
    else:
        blobs = blobs.withColumn("_seen", F.array().cast("array<string>"))
    kind = "array<struct<gap:int,size:int,keep:boolean>>"
    todo = F.array(
        *[
            F.when(~F.array_contains("_seen", r.key), F.struct(F.lit(r.key).alias("rule"), _hits(F.col("_text"), r).cast(kind).alias("hits")))
            for r in rules
        ]
    )
    pairs = blobs.select("blob", F.explode(F.array_compact(todo)).alias("_t")).select("blob", "_t.rule", F.posexplode_outer("_t.hits").alias("_pos", "_hit"))
    upto = W.partitionBy("blob", "rule").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    stop = F.sum(F.col("_hit.gap") + F.col("_hit.size")).over(upto)
    spans = pairs.select("blob", "rule", "_hit", stop.cast("long").alias("stop"))
    span = F.struct((F.col("stop") - F.col("_hit.size")).cast("long").alias("start"), F.col("stop"))
    return spans.groupBy("blob", "rule").agg(F.sort_array(F.collect_list(F.when(F.col("_hit.keep"), span))).alias("findings"))


def findings(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """``versions`` with ``blob`` and ``secrets``: the blob's findings under the given rules, joined back to every path.

    ``secrets`` is an array of (start, kind, stop, rule) by start, then kind as
    listed; it is empty where nothing was found. All columns of ``versions``
    stay, but for those of these two names; repeated rows stay repeated.
    """
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    hits = ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("findings") > 0))
    hits = hits.select("blob", "rule", order[F.col("rule")].alias("_kind"), F.explode("findings").alias("_f"))
    one = F.struct(F.col("_f.start").alias("start"), F.col("_kind").alias("kind"), F.col("_f.stop").alias("stop"), F.col("rule").alias("rule"))
    per_blob = hits.groupBy("blob").agg(F.sort_array(F.collect_list(one)).alias("secrets"))
    out = with_blob(versions.drop("secrets"), text_col).join(per_blob, "blob", "left")
    empty = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,rule:string>>")
    return out.withColumn("secrets", F.coalesce("secrets", empty))


def redacted(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span of ``secrets`` replaced by ``mark``; spans that overlap become one."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        between = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(
            F.when(fresh, F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["stop"]).alias("at"),
        )

    done = F.aggregate(secrets, start, step)
    return F.when(F.size(secrets) == 0, text).otherwise(F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))))

"""The named queries over the given tables; each reads whole tables and keeps to the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import alignment, decontam, langid, lexical, licenses, neardup, packing, pii, quality, secrets, substrings, toxicity, vectors
from panelspark.llm.oracles import ORACLES  # noqa: F401  read by the entry
from panelspark.llm.scratch import stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
OTHER_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def remainder(key: str, by: int) -> Column:
    """CRC-32 of the id as text, modulo ``by``."""
    return F.crc32(F.col(key).cast("string")) % by


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "n_copies")


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    scored = toxicity.score(docs.select("doc_id", "text"), model, out="score")
    return scored.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op3_word_first_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(remainder("doc_id", 4) != 2))
    found = langid.detect(docs, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    rank = F.create_map(*[x for i, k in enumerate(pii.KINDS) for x in (F.lit(k), F.lit(i))])
    ranked = F.sort_array(
        F.transform(F.concat("base", "added"), lambda s: F.struct(rank[s["kind"]].alias("rank"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    )
    return found.select(
        "doc_id",
        *[count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(ranked).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op5_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def crc32(ids: Column) -> Column:
    """CRC-32 of ids as little-endian unsigned 32-bit numbers."""

    @F.pandas_udf(T.LongType())
    def of(lists):  # noqa: ANN001, ANN202
        from zlib import crc32 as crc

        return lists.map(lambda x: crc(x.astype("<u4").tobytes()))

    return of(ids)


def op6_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), TOKENIZER)
    digests = stored(pieces.select("doc_id", "piece", "start", "length", crc32(F.col("ids")).alias("ids_crc32")))
    return packing.pack(digests)


def op7_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents"))
    base_failed = F.col("failed").bitwiseAND(F.lit(quality.BASE)) != 0
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), quality.kept(quality.POLICIES["v1"]).alias("kept"), "failed",
    )


def op9_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.scan(docs)
    found = secrets.findings(docs.select("doc_id", "text"), ledger)
    named = F.transform("secrets", lambda s: F.struct(F.split(s["rule"], "/")[0].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    found = found.select("doc_id", named.alias("spans"))
    return found.select(
        "doc_id",
        *[count_of(F.col("spans"), r.name).alias(f"n_{r.name}") for r in secrets.RULES],
        F.sha2(span_text(F.col("spans")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op10_merge_sorted_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op11_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = alignment.summaries(table(spark, sf_dir, "documents"), TOKENIZER, OTHER_TOKENIZER)
    documents = stored(summaries.withColumn("_row", F.monotonically_increasing_id()))
    counted = alignment.link_counts(documents)
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


def op13_kd_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = vectors.nearest(rows, rows.where(F.col("vec_id") % 100 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_dart_minhash,
        op2_counterfactual_toxicity,
        op3_word_first_backoff,
        op4_pii_deobfuscation,
        op5_simhash_windows,
        op6_minimum_bin_slack,
        op7_license_templates,
        op8_rule_ledger,
        op9_blob_ledger,
        op10_merge_sorted_suffixes,
        op11_lexical_scan,
        op12_token_alignment,
        op13_kd_trees,
    )
}

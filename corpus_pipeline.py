"""Documents to packed training sequences: five stages, each working on all that the one before kept.

Toxic documents go, one document of each near-duplicate class stays, documents
with benchmark passages go, secrets are blanked out, and what remains is
tokenized and packed. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontam, neardup, packing, secrets, toxicity
from panelspark.llm.queries import TOKENIZER, table
from panelspark.llm.scratch import stored

#: No SQL counterpart: the classifier and the tokenizer cannot be had in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; the classifier learns from a bounded sample of the labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="_toxicity").where(F.col("_toxicity") < 0.5).select(docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class; texts that are null stay."""
    classes = neardup.near_duplicates(docs)
    least = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid")
    keep = classes.where(F.col("class_uid").isNotNull()).groupBy("class_uid").agg(F.min(least).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.uid").alias("_uid"))
    known = docs.where(F.col("text").isNotNull()).withColumn("_own", F.unhex(F.md5("text")))
    kept = known.join(keep, (F.col("_own") == F.col("_uid")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    # the same id may stand beside the same text more than once
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(F.lit(0).alias("_"), *rest)
    # by their JSON, as extra columns may be of kinds that have no order
    one = kept.groupBy("_own", "doc_id").agg(F.min_by(row, F.to_json(row)).alias("_rest"), F.first("text").alias("text"))
    one = one.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.{c}").alias(c) for c in docs.columns])
    return one.unionByName(docs.where(F.col("text").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = decontam.contamination(numbered, table(spark, sf_dir, "benchmark"), id_col="_row")
    return numbered.join(found.select("_row").distinct(), "_row", "left_anti").select(docs.columns)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    found = secrets.findings(docs, stored(secrets.scan(docs)))
    out = found.withColumn("text", secrets.redacted(F.col("text"), F.col("secrets")))
    if "n_chars" in docs.columns:
        changed = F.size("secrets") > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by sequence and place: (doc_id, piece, start, length, ids, sequence_id, offset)."""
    return packing.pack(stored(packing.tokenize(docs, TOKENIZER)))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def beside_extras(stage: Stage) -> Stage:
    """The stage on documents that may have more columns: these get names of their own meanwhile, so none can clash."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        extras = {c: f"_extra{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        return stage(spark, docs.withColumnsRenamed(extras), sf_dir).withColumnsRenamed({v: k for k, v in extras.items()})

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", beside_extras(drop_toxic)),
    ("near_duplicates", beside_extras(one_of_each_class)),
    ("decontamination", beside_extras(drop_contaminated)),
    ("secrets", beside_extras(blank_secrets)),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

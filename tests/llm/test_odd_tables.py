"""Null ids, repeated rows, columns with clashing names and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

from panelspark.llm import decontam, langid, licenses, neardup, packing, pii, quality, queries, secrets, substrings, toxicity

from .conftest import DOCS, ODD

CLASHING = ["uid", "part", "label", "piece", "length", "_block", "sequence_id", "blob", "secrets", "failed", "n_words", "base", "score", "bucket", "first", "starts", "removed"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a row without an id"), (3, ODD[3]), (5, ODD[5]), (5, ODD[5])]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def labels(spark):
    return spark.createDataFrame([(5, 1), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int")


PER_ROW = {
    "near duplicates": lambda s, d: neardup.near_duplicates(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s)), out="score"),
    "language": lambda s, d: langid.detect(d, langid.fit(d.withColumn("lang", F.lit("en")))),
    "personal data": lambda s, d: pii.find_pii(d),
    "quality": lambda s, d: quality.ledger(d),
    "secrets": lambda s, d: secrets.findings(d, secrets.scan(d)),
    "repeats": lambda s, d: substrings.without_repeats(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each(spark, odd, name):
    out = PER_ROW[name](spark, odd)
    rows = out.collect()
    assert len(set(out.columns)) == len(out.columns)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect())
    same = [tuple(r) for r in rows if r.doc_id == 5]
    assert len(same) == 3 and len(set(map(str, same))) == 1
    assert PER_ROW[name](spark, odd.limit(0)).count() == 0


def test_packing_keeps_every_piece(spark, odd):
    pieces = packing.tokenize(odd, queries.TOKENIZER)
    out = packing.pack(pieces.withColumns({"sequence_id": F.lit("x"), "_block": F.lit("y")})).collect()
    assert len(out) == pieces.count() and len({(r.sequence_id, r.offset) for r in out}) == len(out)


def test_searches(spark, odd):
    bench = spark.createDataFrame([(1, ODD[5]), (None, "a row without an id"), (2, None)], "item_id long, text string")
    found = sorted((str(r.doc_id), str(r.item_id)) for r in decontam.contamination(odd, bench).collect())
    assert found == [("5", "1")] * 3 + [("None", "None")]
    assert licenses.scan(odd).count() == 0
    more = odd.unionByName(odd.where("doc_id = 0").withColumn("text", F.lit("Released under the MIT License.")), True)
    assert [(r.doc_id, r.license) for r in licenses.scan(more).collect()] == [(0, "MIT")]

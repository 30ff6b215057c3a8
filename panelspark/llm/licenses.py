"""License notices in texts: MinHash bands over overlapping windows find templates, exact containment confirms them.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHINGLE = 5
CONTAINMENT = 0.8
#: MinHash values of a window, each a band of its own: a window that holds CONTAINMENT of a template is at least a sixth
#: alike to it (see ``template_table``), so 64 bands all differ with probability (5/6)^64 = 0.0000086 at worst.
BANDS = 64

# Notices by license; each is sought as a whole.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("GPL", "This work is licensed under the GNU General Public License"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
]


def word_array(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def shingle_array(hashes: str, size: int = SHINGLE) -> Column:
    """Hashes of the runs of five words, from a column of word hashes."""
    count = F.greatest(F.size(hashes) - F.lit(size - 1), F.lit(0))
    return F.transform(F.slice(hashes, 1, count), lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, size)]))


def with_shingles(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_shingles``; the word hashes are a column of their own, built once."""
    hashed = df.withColumn("_words", F.transform(word_array(F.coalesce(F.col(text_col), F.lit(""))), lambda w: F.xxhash64(w)))
    return hashed.withColumn("_shingles", shingle_array("_words")).drop("_words")


def template_table(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(template, license, n_words, size, shingles): one row a template; those of under five words cannot be sought.

    ``size`` is the number of words of the windows it is sought in: the least
    power of two that is at least twice as long, or exactly twice its words
    where a window of that power that holds CONTAINMENT of it would be less than
    a sixth alike to it (5 and 9 words). The worst cases are then 5 words in
    windows of 10, 1 of 6 shingles, and 6 words in windows of 16, 2 of 12.
    """
    schema = T.StructType([T.StructField("template", T.IntegerType()), T.StructField("license", T.StringType()), T.StructField("notice", T.StringType())])
    rows = [(i, *t) for i, t in enumerate(TEMPLATES if templates is None else templates)]
    words = F.size(word_array(F.col("notice")))
    df = with_shingles(spark.createDataFrame(rows, schema).withColumn("n_words", words), "notice")
    power = F.pow(F.lit(2), F.ceil(F.log2(F.lit(2) * F.col("n_words")))).cast("int")
    own = F.col("n_words") - (SHINGLE - 1)
    held = F.ceil(CONTAINMENT * own)
    size = F.when(6 * held < power - (SHINGLE - 1) + own - held, 2 * F.col("n_words")).otherwise(power)
    return df.where(F.size("_shingles") > 0).select("template", "license", "n_words", size.alias("size"), F.array_distinct("_shingles").alias("shingles"))


def signature(shingles: Column) -> Column:
    """Band values: for each of BANDS hash functions, a hash of its number and of the least hash of any shingle."""
    least = lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b)))
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.xxhash64(b, least(b)))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = CONTAINMENT) -> DataFrame:
    """(id, template, license, containment, first_word): the best window of each template that a text holds.

    Windows of a size overlap by half, so a template lies wholly inside one of
    them. Windows that share no shingle with any template are left out before
    signatures are made: nothing is contained in them. Candidates share a band;
    the share of the template's 5-word shingles in the window is then counted
    exactly and must be ``least`` or more. The table of templates is a list in
    this module, or is given as one, and so is small enough to be copied to all
    tasks. Null and empty texts, and tables without rows, give no row; a
    repeated row gives its rows again; other columns are not carried.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates).withColumn("bands", signature(F.col("shingles")))
    wanted = known.collect()
    if not wanted:
        return docs.select(id_col).where("false").selectExpr(id_col, "0 AS template", "'' AS license", "0D AS containment", "0 AS first_word")
    every = sorted({s for r in wanted for s in r.shingles})
    sizes = sorted({r["size"] for r in wanted})

    own = with_shingles(docs.select(id_col, text_col), text_col).drop(text_col)
    # a long list of literals is looked up by hashing
    hits = F.array_compact(F.transform("_shingles", lambda s, i: F.when(s.isin(every + [0] * 12), i)))
    # texts without a hit end at the explode below; a filter here would be pushed under the arrays and build them anew
    own = own.withColumns({"_hits": hits, "_row": F.monotonically_increasing_id()})

    def starts(size: int) -> Column:
        """First shingles of the windows of this size that hold a hit: both windows over each hit."""
        half = size // 2
        left = F.transform("_hits", lambda i: (F.floor(i / half) * half).cast("int"))
        before = F.transform("_hits", lambda i: F.greatest(F.floor(i / half) * half - half, F.lit(0)).cast("int"))
        return F.transform(F.array_distinct(F.concat(left, before)), lambda a: F.struct(F.lit(size).alias("size"), a.alias("first")))

    windows = own.select(id_col, "_row", "_shingles", F.explode(F.concat(*[starts(s) for s in sizes])).alias("_w"))
    windows = windows.select(
        id_col, "_row", F.col("_w.size").alias("size"), F.col("_w.first").alias("first_word"),
        F.array_distinct(F.slice("_shingles", F.col("_w.first") + 1, F.col("_w.size") - (SHINGLE - 1))).alias("_window"),
    ).where(F.size("_window") > 0)
    banded = windows.withColumn("_bands", signature(F.col("_window")))
    table = spark.createDataFrame(wanted, known.schema).withColumnRenamed("size", "_size")
    found = banded.join(F.broadcast(table), (F.col("size") == F.col("_size")) & F.arrays_overlap("_bands", "bands"))
    share = F.size(F.array_intersect("shingles", "_window")) / F.size("shingles")
    found = found.withColumn("containment", share).where(F.col("containment") >= least)
    best = found.groupBy("_row", "template").agg(
        F.first(id_col).alias(id_col), F.first("license").alias("license"), F.max_by(F.struct("containment", "first_word"), F.struct("containment", -F.col("first_word"))).alias("_b")
    )
    return best.select(id_col, "template", "license", "_b.containment", "_b.first_word")


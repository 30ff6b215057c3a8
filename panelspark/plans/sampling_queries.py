"""Queries on sampling, resampling and word frequencies."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import functions as F

from panelspark.functions.text import words
from panelspark.operators import sampling as sm
from panelspark.plans import tables as tb
from panelspark.plans.registry import RECURSIVE, Out, query
from panelspark.session import cut_lineage


def dated(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def h(seed: str, *keys: str) -> str:
    """The hash of functions.hashing.h32 in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8) AS BIGINT)"


KEYS = "region, strftime(date, '%Y-%m-%d') AS date"

_ID = Out(longs=("doc_id", "n_chars"))


@query("rs01_sample_rows", _ID.sql("", f"SELECT doc_id, n_chars FROM documents ORDER BY {h('1', 'doc_id')}, doc_id LIMIT 300"))
def sample_rows(spark, sf):
    return _ID.of(sm.sample_n(tb.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", 300, 1))


_CHUNK = Out(longs=("l_orderkey", "l_linenumber", "l_partkey"))


@query("rs01_sample_half", _CHUNK.sql("o AS (SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY " + h("2", "o_orderkey") + ", o_orderkey) BETWEEN 1001 AND 7000)",
                                      "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN o ON o_orderkey = l_orderkey"))
def sample_half(spark, sf):
    """A sample cut by distributed position, as one beyond the sorted limit is, with all its lines."""
    keys = tb.table(spark, sf, "orders").select("o_orderkey")
    placed = sm.hash_positions(keys, "o_orderkey", 2, "_pos").where("_pos >= 1000 AND _pos < 7000")
    line = tb.table(spark, sf, "lineitem")
    return _CHUNK.of(line.join(placed.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi"))


_RANK = Out(longs=("doc_id", "pos"))


@query("rs02_shuffled", _RANK.sql("", f"SELECT doc_id, row_number() OVER (ORDER BY {h('3', 'doc_id')}, doc_id) - 1 AS pos FROM documents"))
def shuffled(spark, sf):
    """Each row with its place in the random order, which shows the order to a comparison that ignores it."""
    return _RANK.of(sm.hash_positions(tb.table(spark, sf, "documents").select("doc_id"), "doc_id", 3))


@query("sl03_slice_of_shuffle", _ID.sql("", f"SELECT doc_id, n_chars FROM documents ORDER BY {h('4', 'doc_id')}, doc_id LIMIT 100 OFFSET 150"))
def slice_of_shuffle(spark, sf):
    return _ID.of(sm.sample_n(tb.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", 100, 4, skip=150))


_SPLIT = Out(longs=("doc_id", "quality"), strings=("part",))


@query("rs03_split_by_count", _SPLIT.sql("", f"SELECT doc_id, quality, CASE WHEN row_number() OVER (ORDER BY {h('5', 'doc_id')}, doc_id) <= 70 THEN 'test' ELSE 'train' END AS part FROM labels"))
def split_by_count(spark, sf):
    test, train = sm.split_by_count(tb.table(spark, sf, "labels"), "doc_id", 70, 5)
    return _SPLIT.of(test.withColumn("part", F.lit("test")).unionByName(train.withColumn("part", F.lit("train"))))


def resampled_sql(source: str, keys: list[str], reps: int, seed: str, name: str = "bw", n: str = "1") -> str:
    """Draws by cell as CTE ``name``: (rep, keys, weight). Each level of the tree splits the draws of its nodes.

    Of m draws at a node as many go left as its distribution function has values
    up to the node's hash. Cells must have different hashes.
    """
    return f"""{RECURSIVE}
    {name}_c AS MATERIALIZED (SELECT {', '.join(keys)}, {h(seed, *keys)} AS hh, CAST({n} AS BIGINT) AS n FROM {source}),
    {name}_n AS MATERIALIZED (SELECT d, hh >> (32 - d) AS pre, CAST(sum(CASE WHEN (hh >> (31 - d)) & 1 = 0 THEN n ELSE 0 END) AS BIGINT) AS l, CAST(sum(n) AS BIGINT) AS w
       FROM {name}_c, (SELECT CAST(range AS INTEGER) AS d FROM range(0, 32)) GROUP BY 1, 2),
    {name}_t AS (SELECT range AS rep, 0 AS d, CAST(0 AS BIGINT) AS pre, (SELECT CAST(sum(n) AS BIGINT) FROM {name}_c) AS m FROM range(0, {reps})
       UNION ALL SELECT rep, d + 1 AS d, 2 * pre + side AS pre, CASE WHEN side = 0 THEN x ELSE m - x END AS m FROM
         (SELECT rep, d, pre, m, CASE WHEN any_value(l) = 0 THEN 0 WHEN any_value(l) = any_value(w) THEN m ELSE least(m, count(*) FILTER (cdf <= u)) END AS x FROM
           (SELECT rep, d, pre, m, l, w, ({h(seed, 'rep', 'd', 'pre')} + 0.5) / 4294967296.0 AS u,
                   sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(l / w) + (m - k) * ln(1 - l / w))) OVER (PARTITION BY rep, pre ORDER BY k) AS cdf FROM
             (SELECT rep, {name}_t.d, {name}_t.pre, m, l, w, unnest(CASE WHEN l > 0 AND l < w THEN range(0, m + 1) ELSE [CAST(NULL AS BIGINT)] END) AS k
              FROM {name}_t JOIN {name}_n ON {name}_n.d = {name}_t.d AND {name}_n.pre = {name}_t.pre))
          GROUP BY rep, d, pre, m), (SELECT range AS side FROM range(0, 2)) WHERE CASE WHEN side = 0 THEN x ELSE m - x END > 0),
    {name} AS (SELECT rep, {', '.join(keys)}, m AS weight FROM {name}_t JOIN {name}_c ON hh = pre WHERE d = 32),
    """


_BOOT = Out(longs=("rep", "doc_id", "weight"))


@query("rs04_bootstrap_counts", _BOOT.sql(resampled_sql("labels", ["doc_id"], 100, "6"), "SELECT rep, doc_id, weight FROM bw"))
def bootstrap_counts(spark, sf):
    return _BOOT.of(sm.bootstrap_counts(tb.table(spark, sf, "labels"), "doc_id", 100, 6))


def _poisson_sql() -> str:
    total, parts = 0.0, []
    for k in range(13):
        total += exp(-1) / factorial(k)
        parts.append(f"CAST(u >= {total!r} AS INT)")
    return " + ".join(parts)


@query(
    "rs04_poisson_weights",
    _BOOT.sql(f"u AS (SELECT rep, doc_id, {h('7', 'rep', 'doc_id')} / 4294967296.0 AS u FROM labels, range(0, 100) t(rep)), w AS (SELECT rep, doc_id, {_poisson_sql()} AS weight FROM u)", "SELECT * FROM w WHERE weight > 0"),
)
def poisson_weights(spark, sf):
    return _BOOT.of(sm.poisson_weights(tb.table(spark, sf, "labels").select("doc_id"), "doc_id", 100, 7))


_REG = Out(longs=("region", "n"), strings=("date",))


@query("rs05_sample_regions", _REG.sql(tb.SO + f"r AS (SELECT region FROM (SELECT DISTINCT region FROM so) ORDER BY {h('8', 'region')}, region LIMIT 8)", f"SELECT {KEYS}, n FROM so WHERE region IN (SELECT region FROM r)"))
def sample_regions(spark, sf):
    return _REG.of(dated(sm.sample_regions(tb.sparse_orders(spark, sf), 8, 8)))


@query("rs05_sample_regions_part", _REG.sql(tb.SO + f"r AS (SELECT region FROM (SELECT region, row_number() OVER (ORDER BY {h('18', 'region')}, region) AS i, count(*) OVER () AS m FROM (SELECT DISTINCT region FROM so)) WHERE i <= round(m * 0.3))", f"SELECT {KEYS}, n FROM so WHERE region IN (SELECT region FROM r)"))
def sample_part_of_regions(spark, sf):
    return _REG.of(dated(sm.sample_regions(tb.sparse_orders(spark, sf), None, 18, frac=0.3)))


_REP = Out(longs=("region", "n", "copy"), strings=("date",))


@query(
    "rs05_sample_regions_replaced",
    _REP.sql(
        tb.SO + f"r AS (SELECT region, row_number() OVER (ORDER BY {h('9', 'region')}, region) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT region FROM so)),"
        f"p AS (SELECT s AS copy, r.region FROM range(0, 12) t(s) JOIN r ON r.i = {h('9', chr(39) + 'draw' + chr(39), 's')} % r.m)",
        f"SELECT so.{KEYS}, n, copy FROM so JOIN p ON p.region = so.region".replace("so.region, strftime(date", "so.region, strftime(so.date"),
    ),
)
def sample_regions_replaced(spark, sf):
    return _REP.of(dated(sm.sample_regions(tb.sparse_orders(spark, sf), 12, 9, replace=True)))


@query(
    "rs06_permute_column",
    _REG.sql(
        tb.SO
        + f"r AS (SELECT DISTINCT region FROM so), a AS (SELECT region, row_number() OVER (ORDER BY {h('10-a', 'region')}, region) AS i FROM r),"
        f"b AS (SELECT region AS source, row_number() OVER (ORDER BY {h('10-b', 'region')}, region) AS i FROM r), m AS (SELECT region, source FROM a JOIN b USING (i))",
        "SELECT so.region, strftime(so.date, '%Y-%m-%d') AS date, x.n FROM so JOIN m ON m.region = so.region LEFT JOIN so x ON x.region = m.source AND x.date = so.date",
    ),
)
def permute_column(spark, sf):
    s = tb.sparse_orders(spark, sf).select("region", "date", "n")
    return _REG.of(dated(sm.permute_column(s, "n", sm.region_permutation(s, 10))))


_PICK = Out(longs=("chain", "draw", "idx"), doubles=("value",))


@query("rs10_random_draw", _PICK.sql(tb.DR + f"p AS (SELECT chain, draw FROM dr ORDER BY {h('11', 'chain', 'draw')}, chain, draw LIMIT 1)", "SELECT ld.* FROM ld JOIN p USING (chain, draw)"))
def random_draw(spark, sf):
    return _PICK.of(sm.pick_draw(tb.long_draws(spark, sf), 11))


# ---- words ----

STOP = ["the", "and", "with", "les", "des", "der", "die", "que", "los"]
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
WORDS_SQL = """
{name} AS (SELECT doc_id, trim(w, '!"#$%&''()*+, -./:;<=>?@[\\]^_`{{|}}~') AS word FROM
   (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+')) AS w FROM {table})
   WHERE length(w) > 2 AND w NOT IN ({stop})),
"""


def words_sql(name: str, table: str) -> str:
    return WORDS_SQL.format(name=name, table=table, stop=_STOP_SQL)


_WORDS = Out(longs=("doc_id", "n_words", "n_distinct"))


@query("f12_words", _WORDS.sql(words_sql("w", "documents"), "SELECT doc_id, count(*) AS n_words, count(DISTINCT word) AS n_distinct FROM w GROUP BY 1"))
def words_per_document(spark, sf):
    d = tb.table(spark, sf, "documents").select("doc_id", words(F.col("text"), STOP).alias("w")).where("size(w) > 0")
    return _WORDS.of(d.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct")))


_COUNTS = Out(strings=("word",), longs=("n",))


@query("rs07_word_counts", _COUNTS.sql(words_sql("w", "documents"), "SELECT word, count(*) AS n FROM w GROUP BY 1 HAVING count(*) > 5"))
def word_counts(spark, sf):
    return _COUNTS.of(sm.word_counts(tb.table(spark, sf, "documents"), STOP))


_OVER = Out(strings=("word",), doubles=("score",))
OVER_SQL = (
    words_sql("w", "documents")
    + words_sql("t", "(SELECT d.* FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1)")
    + """
b AS (SELECT word, count(*) AS m FROM w GROUP BY 1 HAVING count(*) > 5), c AS (SELECT word, count(*) AS n FROM t GROUP BY 1 HAVING count(*) > 5),
j AS (SELECT word, n / sum(n) OVER () AS p, m / sum(m) OVER () AS q FROM c JOIN b USING (word)),
"""
)


def toxic_documents(spark, sf):
    flagged = tb.table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return tb.table(spark, sf, "documents").join(flagged, "doc_id", "left_semi").select("doc_id", "text")


@query("rs08_oversampled_words", _OVER.sql(OVER_SQL, "SELECT word, (p - q) / sqrt(q) AS score FROM j WHERE (p - q) / sqrt(q) > 0.02 AND word NOT IN ('i''m', 'doesn''t', 'san', 'antonio')"))
def oversampled_words(spark, sf):
    baseline = sm.word_counts(tb.table(spark, sf, "documents"), STOP)
    return _OVER.of(sm.oversampled_words(sm.word_counts(toxic_documents(spark, sf), STOP), baseline))


_BALANCED = Out(longs=("n_over", "n_before", "n_foreign"))


@query("rs09_rebalance_words", _BALANCED.sql("", "SELECT 0 AS n_over, count(*) AS n_before, 0 AS n_foreign FROM documents JOIN labels USING (doc_id) WHERE toxic = 1"))
def rebalance_words(spark, sf):
    """Flagged documents thinned, each over-sampled word by its excess per round, until none is over-sampled.

    Counted afterwards: over-sampled words, documents before, and kept ones that were not among them.
    """
    before = toxic_documents(spark, sf)
    baseline = cut_lineage(sm.word_counts(tb.table(spark, sf, "documents"), STOP))
    kept = cut_lineage(sm.rebalance_words(before, baseline, "doc_id", STOP, 12, threshold=0.02))
    over = sm.oversampled_words(sm.word_counts(kept, STOP), baseline).agg(F.count(F.lit(1)).alias("n_over"))
    foreign = kept.join(before.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1))).scalar()
    return _BALANCED.of(over.select("n_over", before.agg(F.count(F.lit(1))).scalar().alias("n_before"), foreign.alias("n_foreign")))


_ROUND = Out(longs=("doc_id",))


@query(
    "rs09_first_round",
    _ROUND.sql(
        OVER_SQL
        + "x AS (SELECT word, n, m, sum(n) OVER () AS nn, m / sum(m) OVER () AS q FROM c JOIN b USING (word)),"
        "o AS (SELECT word, greatest(1, ceil(n - (q + 0.02 * sqrt(q)) * nn)) AS excess FROM x WHERE (n / nn - q) / sqrt(q) > 0.02 AND word NOT IN ('i''m', 'doesn''t', 'san', 'antonio')),"
        f"r AS (SELECT doc_id, excess, row_number() OVER (PARTITION BY word ORDER BY {h('12', 'doc_id')}, doc_id) AS pos FROM (SELECT DISTINCT doc_id, word FROM t) JOIN o USING (word))",
        "SELECT DISTINCT doc_id FROM r WHERE pos <= excess",
    ),
)
def first_round(spark, sf):
    """The documents that the first round of rebalancing drops, in values."""
    baseline = sm.word_counts(tb.table(spark, sf, "documents"), STOP)
    held = cut_lineage(sm.postings(toxic_documents(spark, sf), "doc_id", STOP, 12))
    counts = held.groupBy("word").agg(F.sum("_n").alias("n"))
    return _ROUND.of(sm.rebalance_round(held, counts, baseline, "doc_id"))


_SEMI = Out(longs=("doc_id",))


@query(
    "f14_has_oversampled_word",
    _SEMI.sql(OVER_SQL, "SELECT DISTINCT doc_id FROM t WHERE word IN (SELECT word FROM j WHERE (p - q) / sqrt(q) > 0.02 AND word NOT IN ('i''m', 'doesn''t', 'san', 'antonio'))"),
)
def has_oversampled_word(spark, sf):
    baseline = sm.word_counts(tb.table(spark, sf, "documents"), STOP)
    docs = toxic_documents(spark, sf)
    over = sm.oversampled_words(sm.word_counts(docs, STOP), baseline)
    held = docs.select("doc_id", F.explode(F.array_distinct(words(F.col("text"), STOP))).alias("word"))
    return _SEMI.of(held.join(over, "word", "left_semi").select("doc_id").distinct())

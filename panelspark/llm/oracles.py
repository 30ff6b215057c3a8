"""SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from panelspark.llm import quality, secrets


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    """Matches and the text between them by rule; starts are sums of both."""
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, '{r.name}' AS kind, {i} AS place, regexp_split_to_array(t, {_quoted(r.pattern)}) AS gaps, regexp_extract_all(t, {_quoted(r.pattern)}, 0) AS hits, "
        f"regexp_extract_all(t, {_quoted(r.pattern)}, {r.group}) AS parts, {r.least} AS least FROM d"
        for i, r in enumerate(secrets.RULES)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in secrets.RULES)
    shown = ", ".join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in secrets.RULES)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    k AS ({kinds}),
    m AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM k WHERE len(hits) > 0),
    s AS (SELECT doc_id, kind, place, length(hits[i]) AS n, length(parts[i]) AS p, least,
            list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a FROM m),
    f AS (SELECT doc_id, kind, place, CAST(a AS BIGINT) AS a, CAST(a + n AS BIGINT) AS b FROM s WHERE p >= least),
    j AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans FROM f GROUP BY doc_id)
    SELECT doc_id, {shown}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (doc_id)"""


def _quality() -> str:
    bits = " + ".join(f"CASE WHEN {failing} THEN {quality.BIT[name]} ELSE 0 END" for name, failing in quality.RULES.items())
    size = quality.WINDOW
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
    p AS (SELECT doc_id, i, array_to_string(words[i:i + {size - 1}], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - {size - 2})) AS i FROM w WHERE len(words) >= {size})),
    r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
    c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, {size}) o(k) GROUP BY doc_id),
    m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
            length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
            coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(regexp_matches(t, '\\pL') AS INT) AS n_letters FROM w LEFT JOIN c USING (doc_id)),
    b AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {quality.BASE}) <> 0 AS base_failed,
      (failed & {quality.POLICIES['v1'].mask}) = 0 AS kept, failed FROM b"""


LEXICAL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents WHERE text IS NOT NULL),
    t AS MATERIALIZED (SELECT doc_id, len(words) AS n, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
    i AS MATERIALIZED (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark WHERE text IS NOT NULL),
    z AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(words)) AS BIGINT) AS total FROM d WHERE len(words) > 0),
    f AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, z GROUP BY term),
    p AS MATERIALIZED (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) AS points FROM f JOIN w USING (term), z),
    s AS (SELECT item_id, doc_id, CAST(sum(points) AS BIGINT) AS score FROM i JOIN p USING (term) GROUP BY item_id, doc_id HAVING sum(points) > 0),
    r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s)
    SELECT * FROM r WHERE rank <= 10"""

NEAREST = """
    WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS p FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.p, v.p) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= 10"""

ORACLES = {"op8_rule_ledger": _quality(), "op9_blob_ledger": _secrets(), "op11_lexical_scan": LEXICAL, "op13_kd_trees": NEAREST}

"""The queries of this subpackage that SQL can express, for DuckDB."""

ORACLES = {
    "op6_warc": """
WITH paid AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), firsts AS (
  SELECT html, min(page_id) AS first FROM paid GROUP BY html
), bits AS (
  SELECT html, first, concat(list_aggregate(list_transform(string_split(sha1(html), ''),
    lambda c: right(bin(CAST(concat('0x', c) AS INT) + 16), 4)), 'string_agg', '')) AS b FROM firsts
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    16 * CAST(substr(b, i * 5 + 1, 1) AS INT) + 8 * CAST(substr(b, i * 5 + 2, 1) AS INT) + 4 * CAST(substr(b, i * 5 + 3, 1) AS INT)
    + 2 * CAST(substr(b, i * 5 + 4, 1) AS INT) + CAST(substr(b, i * 5 + 5, 1) AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM paid JOIN bits USING (html)""",
    "op7_mix_sources": """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM sized GROUP BY source
), ordered AS (  -- sources meet their cap in ascending order of size by weight
  SELECT *, 18 * s // w AS r, (SELECT sum(s) FROM sources) AS t FROM sources
), run AS (
  SELECT *, t - coalesce(sum(3 * s) OVER before, 0) AS rest, sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM ordered WINDOW before AS (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, CAST(rest AS HUGEINT) * w > CAST(3 * s AS HUGEINT) * share AS above FROM run
), level AS (
  SELECT (any_value(t) - coalesce(sum(3 * s) FILTER (above), 0))::DOUBLE / (sum(w) FILTER (NOT above))::DOUBLE AS v FROM capped
), targets AS (
  SELECT source, s, CASE WHEN above THEN CAST(3 * s AS DOUBLE) ELSE v * w END AS target FROM capped, level
), rated AS (
  SELECT d.doc_id, size, s AS source_size, target, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate,
    CAST(concat('0x', left(sha256(concat('mix-1:', coalesce(CAST(d.doc_id AS VARCHAR), 'null'))), 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated""",
    "op10_line_dedup": """
WITH lines AS (
  SELECT doc_id, line, pos,
    translate(trim(line, E' \\t\\n\\x0B\\f\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), shared AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.line, l.pos, s.key IS NOT NULL AND l.doc_id < s.last AS gone
  FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op12_lexical_search": """
WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), found AS (
  SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY doc_id, term
), sizes AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM found GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total FROM sizes
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM found, corpus GROUP BY term, documents
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * documents) // total)))) AS BIGINT) AS score
  FROM wanted JOIN found USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), corpus GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
}

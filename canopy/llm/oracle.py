"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from canopy.llm import oracle_new

ORACLE: dict[str, str] = dict(oracle_new.ORACLE)

# words of a text, as a list; windows of ten words, or all words of a shorter item
ORACLE["op2_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k,
         array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i
        FROM b WHERE len(w) > 0)),
grams AS (
  SELECT r, p, k, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p
        FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT r, p, g.k, item_id FROM grams g JOIN win USING (k, s)),
words AS (SELECT r, count(DISTINCT q) AS n_hit
  FROM (SELECT r, unnest(generate_series(p, p + k - 1)) AS q
        FROM (SELECT DISTINCT r, p, k FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

ORACLE["op5_nearest_neighbours"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (
    PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
WHERE rank <= 20"""

# the order of first occurrence needs the text hash only among rows that share an id
ORACLE["op6_line_dedup"] = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (
  SELECT doc_id, text, i - 1 AS pos, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i
        FROM d WHERE text IS NOT NULL)),
f AS (
  SELECT doc_id, text, pos, line, row_number() OVER w AS n,
         lead(pos, 1) OVER w AS pos2, lead(pos, 2) OVER w AS pos3,
         lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3
  FROM l WHERE regexp_matches(line, '\S')
  WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)),
o AS (
  SELECT doc_id, text, pos, pos2, pos3, row_number() OVER (
    PARTITION BY line, line2, line3 ORDER BY doc_id NULLS LAST, text, pos) AS nth
  FROM f WHERE pos3 IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, text, unnest([pos, pos2, pos3]) AS pos FROM o WHERE nth > 1),
t AS (
  SELECT l.doc_id, l.text,
         string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL) AS kept,
         count(gone.pos) AS n_removed, count(*) AS n_lines
  FROM l LEFT JOIN gone ON gone.doc_id IS NOT DISTINCT FROM l.doc_id AND gone.text = l.text
    AND gone.pos = l.pos
  GROUP BY l.doc_id, l.text)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(t.kept, '') END AS text,
       CAST(coalesce(t.n_lines, 0) AS INTEGER) AS n_lines,
       CAST(coalesce(t.n_removed, 0) AS INTEGER) AS n_removed
FROM documents s LEFT JOIN t
  ON t.doc_id IS NOT DISTINCT FROM s.doc_id AND t.text IS NOT DISTINCT FROM s.text"""

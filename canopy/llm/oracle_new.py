"""DuckDB SQL for operators 11 to 13, by plain enumeration."""

from __future__ import annotations

from canopy.llm.license_scan import LEAST_SHARE, SLACK, Pattern, patterns

WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

# each document's set of failed filters is a bit mask; a step's figures are counts over masks
FILTER_AUDIT = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t)
           THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)
           THEN 16 ELSE 0 END AS mask
  FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
      FROM labels GROUP BY doc_id),
m AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good,
         count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
o AS (
  SELECT '' AS filter_order, 0 AS len
  UNION ALL
  SELECT filter_order || c, len + 1 FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c)
  WHERE len < 5 AND NOT contains(filter_order, c)),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS filter,
         1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
         CAST(coalesce(list_sum(list_transform(range(1, step),
           lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))), 0) AS INTEGER) AS before
  FROM (SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step
        FROM o WHERE len = 5)),
r AS (
  SELECT part, filter_order, step, filter,
         sum(n) FILTER (WHERE mask & (before | own) = 0) AS kept,
         sum(n) FILTER (WHERE mask & own <> 0 AND mask & before = 0) AS removed,
         sum(n) FILTER (WHERE mask & own <> 0 AND mask & before <> 0) AS redundant,
         sum(n) FILTER (WHERE mask = own) AS unique_fails,
         sum(good) FILTER (WHERE mask & own <> 0 AND mask & before = 0) AS good_lost,
         sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & before = 0) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
       CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r"""


def vector_codes(rounds: int = 4) -> str:
    """All entries' distances for every part, in each round.  ``distance * 256 + entry`` orders
    by distance, then entry; the products are whole numbers in double precision."""
    out = ["""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS DOUBLE))
           AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, k, e[len(e) * k // 4 + 1 : len(e) * (k + 1) // 4] AS x
  FROM v, (SELECT unnest(range(4)) AS k)),
b0 AS MATERIALIZED (SELECT k, r - 1 AS c, x FROM p WHERE r <= 256)"""]
    nearest = """
  SELECT r, k, min(CAST(list_inner_product(p.x, p.x) + list_inner_product(b.x, b.x)
                   - 2 * list_inner_product(p.x, b.x) AS BIGINT) * 256 + c) AS best
  FROM p JOIN {book} b USING (k) GROUP BY r, k"""
    for i in range(rounds):
        out.append(f"""
a{i} AS MATERIALIZED ({nearest.format(book=f"b{i}")}),
s{i} AS (
  SELECT k, c, list(m ORDER BY j) AS x FROM (
    SELECT k, best % 256 AS c, j, floor(sum(y) / count(*)) AS m
    FROM (SELECT k, best, unnest(x) AS y, unnest(range(len(x))) AS j
          FROM a{i} JOIN p USING (r, k)) GROUP BY ALL) GROUP BY k, c),
b{i + 1} AS MATERIALIZED (
  SELECT b.k, b.c, coalesce(s.x, b.x) AS x FROM b{i} b LEFT JOIN s{i} s
  ON s.k = b.k AND s.c = b.c)""")
    out.append(f"""
final AS MATERIALIZED ({nearest.format(book=f"b{rounds}")}),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x,
        lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY k, c)) AS sha
      FROM b{rounds}),
g AS (
  SELECT r, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY k) AS code,
         CAST(sum(best // 256) AS BIGINT) AS error
  FROM final GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       sha AS codebooks_sha256
FROM v JOIN g USING (r), h""")
    return ",".join(out)


def license_scan(known: list[Pattern]) -> str:
    """Every place at which any word of a pattern stands is weighed."""
    def values(rows: list[tuple]) -> str:
        return ", ".join("(" + ", ".join(
            "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r)
            + ")" for r in rows)

    listed = values([(p.number, k, w) for p in known for k, w in enumerate(p.words)])
    kinds = values([(p.number, p.whole, p.base, p.label, len(p.keys)) for p in known])
    keys = values([(p.number, k, offset) for p in known for k, offset in p.keys])
    return rf"""
WITH words(pattern, k, word) AS (VALUES {listed}),
kinds(pattern, whole, base, label, n_keys) AS (VALUES {kinds}),
keys(pattern, key, k) AS (VALUES {keys}),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
h AS MATERIALIZED (
  SELECT r, p, w[p + 1] AS word FROM (SELECT r, w, unnest(range(len(w))) AS p FROM d)
  WHERE w[p + 1] IN (SELECT word FROM words)),
v AS MATERIALIZED (
  SELECT word, CAST(floor(1000 * ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT r) + 1))
                          + 0.5) AS BIGINT) + 1 AS weight
  FROM (SELECT DISTINCT word FROM words) LEFT JOIN h USING (word) GROUP BY word),
t AS MATERIALIZED (
  SELECT pattern, CAST(sum(weight) AS BIGINT) AS total FROM words JOIN v USING (word)
  GROUP BY pattern),
c AS MATERIALIZED (
  SELECT r, pattern, p - k AS start, CAST(sum(weight) AS BIGINT) AS held
  FROM h JOIN words USING (word) JOIN v USING (word) GROUP BY ALL),
phrase AS MATERIALIZED (
  SELECT r, pattern, start FROM c JOIN kinds USING (pattern) JOIN t USING (pattern)
  WHERE whole AND held = total),
standing AS (
  SELECT r, pattern, start, 1.0::DOUBLE AS share FROM phrase
  UNION ALL
  SELECT c.r, pattern, c.start, held / total
  FROM c JOIN kinds USING (pattern) JOIN t USING (pattern)
  WHERE NOT whole AND held * 10 >= total * {LEAST_SHARE}
    AND n_keys = (SELECT count(DISTINCT key) FROM keys JOIN phrase
                  ON phrase.pattern = key AND phrase.r = c.r
                  AND abs(phrase.start - keys.k - c.start) <= {SLACK}
                  WHERE keys.pattern = c.pattern)),
s AS (
  SELECT r, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
         max(start) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM standing JOIN kinds USING (pattern) WHERE label IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word,
       last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0) AS score
FROM d LEFT JOIN s USING (r)"""


ORACLE = {
    "op11_filter_interaction": FILTER_AUDIT,
    "op12_vector_codes": vector_codes(),
    "op13_license_scan": license_scan(patterns()),
}

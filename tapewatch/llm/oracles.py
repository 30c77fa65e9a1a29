"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

# A-Z alone are lower-cased, and only these six code points count as white space.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line
  FROM docs
),
keyed AS (SELECT doc_id, i, line, translate(trim(line, {_STRIP}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
),
marked AS (
  SELECT doc_id, i, line, coalesce(owner <> doc_id, false) AS gone FROM keyed LEFT JOIN owners USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
# A checksum by bits: bytes of the decimal id, each followed by eight shifts (-1).
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    string_split(doc_id::VARCHAR, ''), lambda d: list_concat([ascii(d)::BIGINT], list_resize([]::BIGINT[], 8, -1))))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""

PERIODIC_RUNS = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS ws, {_CRC32} AS h FROM documents),
parts AS (SELECT *, len(ws) AS n, h // 10 AS g FROM docs),
planted AS (
  SELECT *, h % 10 = 0 AND n > 0 AS changed, CASE WHEN n > 0 THEN g % n END AS a,
         CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p
  FROM parts
),
words AS (
  SELECT doc_id, n, i, ws[1 + CASE WHEN changed AND i >= a THEN a + (i - a) % p ELSE i END] AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM planted)
),
same AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM same),
stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY doc_id, q, isle
  HAVING count(*) + q >= greatest(6, 4 * q)
),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM stretches GROUP BY doc_id, s, l),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id
),
best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) = 1
),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period,
       (1000 * l // q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

HARD_NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""

# Bigrams met by hash of their words would do as well; the words themselves leave no doubt.
MINHASH_DEDUP = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {_WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE
         list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS grams
  FROM docs
),
sized AS (SELECT doc_id, grams, len(grams) AS n, min(doc_id) OVER (PARTITION BY list_sort(grams)) AS rep FROM sets),
grams AS (SELECT doc_id, n, unnest(grams) AS g FROM sized WHERE n > 0 AND doc_id = rep),
near AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reached AS (SELECT a, a AS r FROM links UNION SELECT l.a, r.r FROM links l JOIN reached r ON l.b = r.a),
found AS (SELECT a, min(r) AS c FROM reached GROUP BY a)
SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN n > 0 THEN coalesce(c, rep) ELSE doc_id END AS component_id,
       doc_id = CASE WHEN n > 0 THEN coalesce(c, rep) ELSE doc_id END AS kept
FROM sized LEFT JOIN found ON a = rep
"""

SQL = {
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_minhash_dedup": MINHASH_DEDUP,
    "op11_periodic_runs": PERIODIC_RUNS,
    "op5_line_dedup": LINE_DEDUP,
}

"""SQL with the results of the registered queries, where SQL can express them."""

from __future__ import annotations

URL_RULES_SQL = """
WITH rules(host, path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages)
SELECT page_id, host, path,
  (SELECT r.host || r.path FROM rules r
   WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
   ORDER BY length(r.host || r.path) DESC LIMIT 1) AS rule,
  coalesce((SELECT r.verdict FROM rules r
   WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
   ORDER BY length(r.host || r.path) DESC LIMIT 1), 'allow') AS verdict
FROM parts p
"""

_WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT doc_id, text, {_WORDS} AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
placed AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1))) AS pos, w FROM worded),
windows AS (SELECT doc_id, pos, list_slice(w, pos, pos + 4) AS five FROM placed),
again AS (SELECT doc_id, unnest(range(pos, pos + 5)) AS place FROM (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, five) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM again GROUP BY doc_id),
joined AS (SELECT *, array_to_string(w, '') AS solid FROM worded),
measured AS (
  SELECT j.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(solid) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines,
    length(regexp_replace(solid, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(solid, '[^a-z]', '', 'g')) AS n_lower,
    len(list_filter(range(1, len(w)), lambda k: w[k] = w[k + 1])) AS n_same_next
  FROM joined j LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, CAST(
  (CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
  + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
  + (CASE WHEN n_upper > n_lower AND n_upper >= 20 THEN 8 ELSE 0 END)
  + (CASE WHEN 5 * n_same_next > n_words THEN 16 ELSE 0 END)
  + (CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END)
  + (CASE WHEN word_chars > 40 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS failures
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures,
  failures & 3 <> 0 AS base_failed, failures = 0 AS kept
FROM judged
"""

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1
    AS last,
    sum(15 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'),
      '</turn>', '\t'), ':', '\c'))
      + length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t')))
      OVER (PARTITION BY conv_id ORDER BY turn, role, text
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(prefix) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_LOWERED = _WORDS.replace("(text,", "(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                           "'abcdefghijklmnopqrstuvwxyz'),")

JACCARD_SQL = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT doc_id, {_LOWERED} AS w FROM texts),
shingles AS (
  SELECT DISTINCT doc_id, list_slice(w, pos, pos + 4) AS g FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS pos FROM worded WHERE len(w) > 0)),
numbered AS (SELECT doc_id, md5(array_to_string(g, ' ')) AS g FROM shingles),
sizes AS (SELECT doc_id, count(*) AS n FROM numbered GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM numbered x JOIN numbered y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * common >= 80 * (p.n + q.n - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other)
SELECT r.doc_id, CAST(coalesce(max(s.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

SUBSTRING_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT doc_id, {_WORDS} AS w FROM texts),
windows AS (
  SELECT doc_id, pos, md5(array_to_string(list_slice(w, pos, pos + 34), ' ')) AS run FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS pos FROM worded)),
again AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS place FROM (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY run) AS n FROM windows) WHERE n > 1),
kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.place) AS kept, count(*) AS n FROM (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM worded) p
  ANTI JOIN again g ON g.doc_id = p.doc_id AND g.place = p.place
  GROUP BY p.doc_id)
SELECT o.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM worded o LEFT JOIN kept k ON k.doc_id = o.doc_id
"""

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
placed AS (SELECT *, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':'
  || size), 1, 15) AS BIGINT) AS place FROM sized),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sums),
filled AS (SELECT *,
  sum(3 * source_size) OVER o - 3 * source_size AS full_before, sum(w) OVER o - w AS w_before,
  sum(source_size) OVER () AS t, sum(w) OVER () AS ws
  FROM weighed WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST)),
clamped AS (SELECT *, (t - full_before) * w >= 3 * source_size * (ws - w_before) AS full_up FROM filled),
aimed AS (SELECT source, source_size, CASE WHEN full_up THEN CAST(3 * source_size AS DOUBLE) ELSE
  CAST(t - coalesce(sum(3 * source_size) FILTER (WHERE full_up) OVER (), 0) AS DOUBLE) * w
  / (ws - coalesce(sum(w) FILTER (WHERE full_up) OVER (), 0)) END AS target FROM clamped),
planned AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole FROM aimed),
wanted AS (SELECT *, round(target - whole * source_size) AS want FROM planned),
ranked AS (SELECT p.doc_id, p.size, n.source_size, n.target, n.whole, n.want,
  sum(p.size) OVER (PARTITION BY p.source ORDER BY p.place) AS upto,
  sum(p.size) OVER (PARTITION BY p.source, p.place) AS same,
  count(*) OVER (PARTITION BY p.source, p.place) AS copies,
  row_number() OVER (PARTITION BY p.source, p.place) AS k
  FROM placed p JOIN wanted n ON p.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE
  WHEN upto <= want THEN 1 WHEN upto - same > want THEN 0
  WHEN k <= round((want - (upto - same)) * copies / same) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""

NEGATIVES_SQL = """
WITH whole AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND len(a.q) = len(b.q)
    AND (a.vec_id <> b.vec_id OR a.label <> b.label)),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

# The checksum of a run is taken byte by byte with a table of 256 numbers made from its polynomial.
VARIANTS_SQL = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(
    list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
coded AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)]
      ELSE [CAST(192 + ord(x) // 64 AS BIGINT), CAST(128 + ord(x) % 64 AS BIGINT)] END)) AS bytes FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) AS h FROM coded, crc),
spelled AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT))
    || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
short AS (
  SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS less
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM short a JOIN short b
    ON a.less = b.less AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM short a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM short a JOIN words b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY 1),
top AS (SELECT b.word, b.n_near, b.m, min(other) AS other FROM best b JOIN near x ON b.word = x.word AND b.m = x.m
  GROUP BY ALL),
formed AS (
  SELECT w.word, CASE WHEN t.m >= 5 * w.n THEN t.other END AS form, w.n,
    coalesce(t.n_near, 0) AS n_near, CASE WHEN t.m >= 5 * w.n THEN t.m END AS form_n
  FROM words w LEFT JOIN top t USING (word)),
followed AS (
  SELECT word, word AS root, form FROM formed
  UNION ALL SELECT f.word, f.form, g.form FROM followed f JOIN formed g ON f.form = g.word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM formed f JOIN followed r ON f.word = r.word AND r.form IS NULL
"""

LLM_ORACLES: dict[str, str] = {
    "op4_url_filter": URL_RULES_SQL,
    "op5_quality_rules": QUALITY_SQL,
    "op6_chat": CHAT_SQL,
    "op8_jaccard": JACCARD_SQL,
    "op10_substring": SUBSTRING_SQL,
    "op11_hard_negatives": NEGATIVES_SQL,
    "op12_mixing": MIXING_SQL,
    "op13_variants": VARIANTS_SQL,
}

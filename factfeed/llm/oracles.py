"""DuckDB SQL of the queries that SQL can express."""


OP6 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS k FROM b WHERE len(w) BETWEEN 1 AND 9
  UNION
  SELECT item_id, 10, array_to_string(w[i:i + 9], ' ') FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)),
lens AS (SELECT DISTINCT n FROM p),
win AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT win.r, win.i, win.n, p.item_id FROM win JOIN p USING (k, n)),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)"""

# all pairs of different sets that share a shingle, counted; then the components
OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
pairs AS (
  SELECT l.doc_id AS a, r.doc_id AS b, any_value(l.n) AS n, any_value(r.n) AS m, count(*) AS shared
  FROM e l JOIN e r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (n + m - shared)),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comp USING (doc_id)"""

OP11 = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)"""

# CRC-32 of a text's bytes, from the table of its polynomial; distinct features only
OP12 = r"""
WITH poly AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, b::BIGINT)) AS tab),
src AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM src),
f AS (
  SELECT side, r, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS x FROM w),
u AS (SELECT DISTINCT x, hex(encode(x)) AS hx FROM f),
b AS (
  SELECT x, xor(list_reduce(list_transform(range(1, len(hx), 2), lambda i: ('0x' || hx[i:i + 1])::BIGINT),
    lambda c, y: xor(tab[(xor(c, y) % 256) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM u, poly),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN b USING (x) GROUP BY bucket),
total AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM n),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM n, total),
weight AS (
  SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS g, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM f JOIN b USING (x) JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id::VARCHAR)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN weight USING (r) WHERE side = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM placed"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS g, max((toxic = 1)::INT) AS x FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(g, 0) AS g, coalesce(x, 0) AS x,
    {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
     'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
     'E': doc_id > min(doc_id) OVER (PARTITION BY t)} AS f
  FROM d LEFT JOIN lab USING (doc_id)),
m AS (SELECT part, f, count(*) AS n, sum(g) AS g, sum(x) AS x FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
fail AS (
  SELECT part, m.f, n, g, x, o, step, o[step] AS l,
    CASE o[step] WHEN 'A' THEN m.f.A WHEN 'B' THEN m.f.B WHEN 'C' THEN m.f.C WHEN 'D' THEN m.f.D ELSE m.f.E END AS failed FROM m, steps),
gone AS (SELECT *, min(CASE WHEN failed THEN step END) OVER (PARTITION BY part, f, o) AS gone_at, count(*) FILTER (failed) OVER (PARTITION BY part, f, o) AS k FROM fail),
per AS (
  SELECT part, o AS filter_order, step, l,
    coalesce(sum(n) FILTER (gone_at IS NULL OR gone_at > step), 0) AS kept, coalesce(sum(n) FILTER (gone_at = step), 0) AS removed,
    coalesce(sum(n) FILTER (failed AND gone_at < step), 0) AS redundant, coalesce(sum(n) FILTER (failed AND k = 1), 0) AS unique_fails,
    coalesce(sum(g) FILTER (gone_at = step), 0) AS good_lost, coalesce(sum(x) FILTER (gone_at = step), 0) AS toxic_lost
  FROM gone GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM per"""

ORACLES = {
    "op6_decontamination": OP6,
    "op7_near_duplicates": OP7,
    "op11_content_sort": OP11,
    "op12_resampling": OP12,
    "op13_filter_audit": OP13,
}

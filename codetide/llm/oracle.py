"""SQL with the same rows for the queries that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')))), 1, 13))::BIGINT
      / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
        coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
        1.5::DOUBLE * sum(source_size) OVER () AS goal
      FROM r),
l AS (SELECT arg_min((goal - before) / rest, cap / w) FILTER ((goal - before) / rest <= cap / w) AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN cap < level * w THEN cap ELSE level * w END AS target FROM o, l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.u,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT))::BIGINT AS taken FROM j
"""

OP7 = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(a, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(a, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM p),
outcome AS (
  SELECT doc_id AS page_id, max(greatest(coalesce(1 - quality, 0), coalesce(toxic, 0))) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
h0 AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, string_split(host, '.') AS s
  FROM parts LEFT JOIN outcome USING (page_id) GROUP BY host),
h1 AS (SELECT *, CASE WHEN array_to_string(s[-2:], '.') IN ('ac.uk','co.in','co.jp','co.nz','co.uk','com.au','com.br','com.cn','gov.uk','org.uk') THEN 2 ELSE 1 END AS k FROM h0),
h AS (SELECT host, n, bad, array_to_string(s[-k:], '.') AS suffix, array_to_string(s[-(k + 1):], '.') AS domain FROM h1),
l0 AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS prior FROM h),
s1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(prior) AS prior FROM h, l0 GROUP BY suffix),
sk AS (SELECT sum(pow(bad - n * prior, 2) / n) AS s, sum(prior * (1 - prior)) AS b, sum(prior * (1 - prior) * (n - 1)) AS c FROM s1 WHERE n > 0),
sf AS (SELECT CASE WHEN c > 0 AND s > b THEN least(greatest(c / (s - b) - 1, 1), 1000.0) ELSE 1000.0 END::DOUBLE AS k FROM sk),
s2 AS (SELECT suffix, (k * prior + bad) / (k + n) AS prior FROM s1, sf),
d1 AS (SELECT domain, h.suffix, sum(n) AS n, sum(bad) AS bad, any_value(prior) AS prior FROM h JOIN s2 USING (suffix) GROUP BY ALL),
dk AS (SELECT sum(pow(bad - n * prior, 2) / n) AS s, sum(prior * (1 - prior)) AS b, sum(prior * (1 - prior) * (n - 1)) AS c FROM d1 WHERE n > 0),
df AS (SELECT CASE WHEN c > 0 AND s > b THEN least(greatest(c / (s - b) - 1, 1), 1000.0) ELSE 1000.0 END::DOUBLE AS k FROM dk),
d2 AS (SELECT domain, (k * prior + bad) / (k + n) AS prior FROM d1, df),
p1 AS (SELECT host, n, bad, prior FROM h JOIN d2 USING (domain)),
pk AS (SELECT sum(pow(bad - n * prior, 2) / n) AS s, sum(prior * (1 - prior)) AS b, sum(prior * (1 - prior) * (n - 1)) AS c FROM p1 WHERE n > 0),
pf AS (SELECT CASE WHEN c > 0 AND s > b THEN least(greatest(c / (s - b) - 1, 1), 1000.0) ELSE 1000.0 END::DOUBLE AS k FROM pk),
p2 AS (SELECT host, n, k, (k * prior + bad) / (k + n) AS mean FROM p1, pf),
known AS (SELECT host, mean, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (k + n + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM p2),
rules(rhost, rpath, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT page_id, host, path FROM parts) JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT parts.page_id, parts.host, parts.path, best.rule, coalesce(best.action, known.verdict) AS verdict, round(known.mean, 6) AS bad_rate
FROM parts JOIN known ON parts.host = known.host
LEFT JOIN best ON parts.page_id IS NOT DISTINCT FROM best.page_id AND parts.host = best.host AND parts.path = best.path
"""

OP10 = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
k AS (SELECT r, count(DISTINCT item_id::VARCHAR) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM w LEFT JOIN c USING (r) LEFT JOIN k USING (r)
"""


OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
n AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM c AS a, c AS b, c, c AS d, c AS e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
x AS (
  SELECT part, filter_order, step, n, good, toxic, fails[ascii(filter_order[step]) - 64] AS fail, len(list_filter(fails, lambda y: y)) = 1 AS single,
    len(list_filter(range(1, step), lambda i: fails[ascii(filter_order[i]) - 64])) > 0 AS gone FROM n, s),
r AS (
  SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fail AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fail AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fail AND single), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fail AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fail AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM r
"""

OP12 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|</?ROLE>>)', '\1\2\\\3', 'g')) AS n,
        length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|</?ROLE>>)', '\1\2\\\3', 'g')) AS r FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE role WHEN 'assistant' THEN 5 WHEN 'user' THEN 18 WHEN 'system' THEN 35 ELSE 37 + r END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP13 = r"""
WITH t AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT c, own, c - c % 20 AS base, (4294967295 - list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda y: ascii(y)::BIGINT),
    lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda z, k: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END))) % 4 AS h FROM t),
r AS (SELECT h.c, coalesce(b.own[1:h.h], []) || h.own[h.h + 1:] AS s FROM h LEFT JOIN t b ON b.c = h.base),
p AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r),
n0 AS (SELECT s[1:d] AS k, d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len(s)), '') AS ends FROM p GROUP BY ALL),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS kids FROM n0 WHERE d > 0 GROUP BY 1),
n AS (SELECT n0.*, coalesce(kids, 0) AS kids,
        CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(n0.k[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM n0 LEFT JOIN kids ON n0.k = kids.k),
u AS (SELECT k[1:a] AS k, sum(saved)::BIGINT AS saved_tokens, sum((kids = 0)::INT)::BIGINT AS n_leaves
      FROM (SELECT k, saved, kids, unnest(range(0, d + 1)) AS a FROM n) GROUP BY 1)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, n.kids::BIGINT AS n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN u ON n.k = u.k LEFT JOIN n up ON n.d > 0 AND up.d = n.d - 1 AND up.k = n.k[1:n.d - 1]
"""


def statements() -> dict[str, str]:
    return {"op3_exact_topk": OP3, "op4_source_mixing": OP4, "op7_url_filter": OP7, "op10_decontamination": OP10,
            "op11_filter_audit": OP11, "op12_reply_trees": OP12, "op13_prefix_trie": OP13}

"""DuckDB SQL for the queries that SQL can express."""

from .url_filters import SUFFIXES

MIXING = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS draw FROM documents
), s0 AS (
  SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS idx FROM s0
), s2 AS (
  SELECT *, CASE idx % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM s1
), s3 AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, idx) AS rk,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s2
), lv AS (
  SELECT arg_min(lvl, rk) AS water FROM s3 WHERE cap / weight >= lvl
), s4 AS (
  SELECT s3.*, least(cap, weight * water) AS target FROM s3, lv
), bl AS (
  SELECT coalesce(greatest(1, least(1024, floor(min(target) FILTER (target > 0) / 16))), 1)::BIGINT AS block FROM s4
), s5 AS (
  SELECT idx, source, docs, source_size, target, block, floor((sum(source_size) OVER ())::DOUBLE / block)::BIGINT AS seats FROM s4, bl
), q1 AS (
  SELECT s.idx, k, target / (2 * k + 1) AS q FROM s5 s, LATERAL (SELECT unnest(range(0, seats + 1)) AS k) WHERE target > 0
), w1 AS (
  SELECT idx, count(*) AS won FROM (SELECT idx, row_number() OVER (ORDER BY q DESC, idx) AS place FROM q1) JOIN (SELECT max(seats) AS n FROM s5) ON place <= n GROUP BY idx
), s6 AS (
  SELECT s5.*, coalesce(won, 0) AS source_blocks, ceil(docs / 5000)::BIGINT AS shards FROM s5 LEFT JOIN w1 USING (idx)
), dealt AS (
  SELECT d.doc_id, d.size, d.draw, s6.* FROM sizes d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source
), dealt2 AS (
  SELECT *, ('0x' || draw[1:8])::BIGINT % shards AS shard FROM dealt
), cl AS (
  SELECT idx, shard, any_value(source_blocks) AS source_blocks, any_value(block) AS block, sum(size)::BIGINT AS words FROM dealt2 GROUP BY idx, shard
), q2 AS (
  SELECT idx, shard, source_blocks, words::DOUBLE / (2 * k + 1) AS q FROM cl, LATERAL (SELECT unnest(range(0, source_blocks + 1)) AS k) WHERE words > 0
), w2 AS (
  SELECT idx, shard, count(*) AS won FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY q DESC, shard) AS place FROM q2) WHERE place <= source_blocks GROUP BY idx, shard
), quota AS (
  SELECT cl.idx, cl.shard, words, least(coalesce(won, 0) * block, words * 3) AS quota FROM cl LEFT JOIN w2 USING (idx, shard)
), laid AS (
  SELECT d.doc_id, d.size, d.source_size, d.target, words, quota,
    sum(d.size) OVER (PARTITION BY idx, shard ORDER BY draw, doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before,
    CASE WHEN words > 0 THEN quota // words ELSE 0 END AS rounds
  FROM dealt2 d JOIN quota USING (idx, shard)
)
SELECT doc_id, size, source_size, target, (rounds * size + greatest(0, least(quota - rounds * words - before, size)))::BIGINT AS taken FROM laid
"""

URL_FILTERS = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM urls
), verdicts AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS rv FROM ruled
), labelled AS (
  SELECT doc_id, max(CASE quality WHEN 0 THEN 1 WHEN 1 THEN 0 END) AS label FROM labels GROUP BY doc_id
), outcomes AS (
  SELECT v.*, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS site, CASE WHEN rule IS NOT NULL THEN (rv = 'block')::INT ELSE label END AS bad
  FROM verdicts v LEFT JOIN labelled ON TRY_CAST(regexp_extract(path, '/([0-9]{1,18})', 1) AS BIGINT) = labelled.doc_id
), sites AS (
  SELECT site AS host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, array_to_string(list_slice(string_split(site, '.'), -2, -1), '.') AS two FROM outcomes GROUP BY site
), hosts AS (
  SELECT host, n, bad, CASE WHEN two IN (SUFFIXES) THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE two END AS domain,
    CASE WHEN two IN (SUFFIXES) THEN two ELSE string_split(host, '.')[-1] END AS suffix FROM sites
), t AS (SELECT sum(n) AS N0, sum(bad) AS Y0 FROM hosts),
l1 AS (SELECT *, (Y0 - bad + 0.5) / (N0 - n + 1) AS m FROM (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix), t),
k1 AS (SELECT 1 / coalesce(greatest(0.001, least(0.5, (sum((bad - n*m) * (bad - n*m)) - sum(n * (m * (1-m)))) / nullif(sum(n * (n-1) * (m * (1-m))), 0))), 0.5) - 1 AS k FROM l1),
l2 AS (
  SELECT d.domain, d.n, d.bad, (l1.bad - d.bad + k * l1.m) / (l1.n - d.n + k) AS m
  FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix) d JOIN l1 USING (suffix), k1
), k2 AS (SELECT 1 / coalesce(greatest(0.001, least(0.5, (sum((bad - n*m) * (bad - n*m)) - sum(n * (m * (1-m)))) / nullif(sum(n * (n-1) * (m * (1-m))), 0))), 0.5) - 1 AS k FROM l2),
l3 AS (SELECT h.host, h.n, h.bad, (l2.bad - h.bad + k * l2.m) / (l2.n - h.n + k) AS m FROM hosts h JOIN l2 USING (domain), k2),
k3 AS (SELECT 1 / coalesce(greatest(0.001, least(0.5, (sum((bad - n*m) * (bad - n*m)) - sum(n * (m * (1-m)))) / nullif(sum(n * (n-1) * (m * (1-m))), 0))), 0.5) - 1 AS k FROM l3),
r3 AS (SELECT host, (bad + k * m) / (n + k) AS rate, n + k AS size FROM l3, k3)
SELECT page_id, outcomes.host, path, rule,
  coalesce(rv, CASE WHEN rate - 2.0 * sqrt(rate * (1 - rate) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM outcomes JOIN r3 ON site = r3.host
""".replace("SUFFIXES", ", ".join(f"'{s}'" for s in SUFFIXES))

ORACLE_SQL = {"op3_mixing": MIXING, "op7_url_filters": URL_FILTERS}

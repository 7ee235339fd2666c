"""DuckDB SQL of the corpus operators' queries, over the driver's views."""

from tessera.llm import sharding, warc
from tessera.llm.urlfilter import ENTRIES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP10 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, least(len(w), 8) AS n, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
di AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM di),
hits AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)"""

_OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 5"""

_OP1 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
i AS (SELECT r, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT r, array_to_string(w[i:i + n - 1], ' ') AS g FROM i),
s AS (SELECT r, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM g GROUP BY r),
nodes AS (SELECT h, n, min(r) AS r, min(doc_id) AS first FROM s JOIN d USING (r) GROUP BY h, n),
t AS (SELECT h, n, g FROM nodes JOIN g USING (r)),
links AS (SELECT a.h, b.h AS o FROM t a JOIN t b ON a.g = b.g AND a.h <> b.h GROUP BY a.h, b.h, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT h, h AS o FROM nodes UNION SELECT reach.h, links.o FROM reach JOIN links ON reach.o = links.h),
least_of AS (SELECT reach.h, min(first) AS component_id FROM reach JOIN nodes ON nodes.h = reach.o GROUP BY reach.h)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM d LEFT JOIN s USING (r) LEFT JOIN least_of USING (h)"""

_ID = "'<urn:uuid:' || regexp_replace(md5(concat_ws('|', {}, {}, d)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || '>'"
_OP6 = f"""
WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\\r\\n]', ' ', 'g') AS url, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
f AS (SELECT d, min(page_id) AS first, arg_min(url, struct_pack(a := page_id, b := url)) AS first_url FROM p GROUP BY d),
k AS (SELECT *, n >= {warc.LEAST} AND page_id <> first AS again, chr(13) || chr(10) AS e FROM p JOIN f USING (d)),
r AS (SELECT *, concat_ws(e, 'HTTP/1.1 200 OK', 'Content-Type: text/html; charset=utf-8', 'Content-Length: ' || n, '', '') AS http FROM k),
w AS (SELECT *, concat_ws(e, 'WARC/1.1', 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END, 'WARC-Record-ID: ' || {_ID.format("page_id::VARCHAR", "url")}, 'WARC-Date: {warc.DATE}', 'WARC-Target-URI: ' || url,
  'X-Page-ID: ' || page_id, 'WARC-Payload-Digest: sha256:' || d,
  CASE WHEN again THEN concat_ws(e, 'WARC-Refers-To: ' || {_ID.format("first::VARCHAR", "first_url")}, 'X-Refers-To-Page-ID: ' || first, 'WARC-Profile: {warc.PROFILE}') END,
  'Content-Type: application/http; msgtype=response', 'Content-Length: ' || (strlen(http) + CASE WHEN again THEN 0 ELSE n END), '', http) || CASE WHEN again THEN '' ELSE h END || e || e AS record FROM r)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to, true AS verified,
  strlen(record)::BIGINT AS record_bytes, sha256(record) AS record_sha256 FROM w"""

_ENTRIES = ", ".join(f"('{l}', '{e}', '{p}', '{a}', TIMESTAMP '{d}')" for l, e, p, a, d in ENTRIES)
_OP7 = f"""
WITH e(list, effect, pattern, action, since) AS (VALUES {_ENTRIES}),
c AS (SELECT row_number() OVER () AS r, page_id, url, TIMESTAMP '2024-01-01' + to_seconds(((page_id * 7919 * 61) % (366 * 86400))::DOUBLE) AS fetched_at,
  regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1) AS host,
  '/' || array_to_string(list_filter(string_split(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> ''), '/') || '/' AS path FROM pages),
pairs AS (SELECT DISTINCT list, pattern FROM e),
hits AS (SELECT c.r, c.fetched_at, p.list, p.pattern FROM c JOIN pairs p
  ON (c.host = split_part(p.pattern, '/', 1) OR ends_with(c.host, '.' || split_part(p.pattern, '/', 1))) AND (NOT contains(p.pattern, '/') OR starts_with(c.path, regexp_replace(p.pattern, '^[^/]*', '') || '/'))),
latest AS (SELECT h.r, h.list, h.pattern, e.effect, e.action, e.since FROM hits h ASOF JOIN e ON h.list = e.list AND h.pattern = e.pattern AND h.fetched_at >= e.since),
active AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length(pattern) DESC, effect, list, pattern, since) AS k, count(*) OVER (PARTITION BY r) AS n FROM latest WHERE action = 'add')
SELECT page_id, url, fetched_at, CASE WHEN effect = 'block' THEN 'block' ELSE 'keep' END AS verdict, list AS rule_list, pattern AS rule_pattern, since AS rule_since, coalesce(n, 0)::BIGINT AS n_active
FROM c LEFT JOIN (SELECT * FROM active WHERE k = 1) USING (r)"""

#: CRC-32 by its table of 256 remainders, over the bytes of the text; a shard is the least of the keyed costs.
_OP9 = f"""
WITH k AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS remainders),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, encode(coalesce(text, '')) AS b FROM documents),
c AS (SELECT doc_id, key, octet_length(b) + 8 AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, x: xor(c >> 8, remainders[xor(c, x) % 256 + 1])), 4294967295) AS crc FROM d, k),
s AS (SELECT *, list_transform(range({sharding.SHARDS + 1}), lambda i: -ln((('0x' || substring(md5(key || ':' || i), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)) AS bids FROM c),
w AS (SELECT *, (list_position(bids[1:{sharding.SHARDS}], list_min(bids[1:{sharding.SHARDS}])) - 1)::INTEGER AS shard, (list_position(bids, list_min(bids)) - 1)::INTEGER AS grown_shard FROM s)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, '{sharding.LAW}' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substring(md5(key || ':' || crc), 1, {sharding.CELL_DIGITS}), doc_id, crc, size) - 1 AS slot, grown_shard FROM w"""

ORACLE = {"op9_sharding": _OP9, "op1_neardup": _OP1, "op7_urlfilter": _OP7, "op3_topk": _OP3, "op6_warc": _OP6, "op10_decontamination": _OP10}

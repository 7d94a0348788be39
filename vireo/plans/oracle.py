"""DuckDB equivalents of the named queries. Domain views are common table expressions put before each."""

from __future__ import annotations

VIEWS = {
    "frames": "SELECT vec_id AS frame_id, label AS file_id, vec_id * 0.5::DOUBLE AS time, list_transform(embedding[1:33], lambda x: floor((x::DOUBLE + 1) * 32)::INT) AS vector FROM embeddings",
    "queries": "SELECT frame_id AS query_id, vector AS qvec FROM frames WHERE frame_id % 20 = 0",
    "logs": """SELECT event_id AS id, ts AS created,
      CASE WHEN user_id % 2 = 0 THEN '10.0.' || user_id % 5 || '.' || user_id ELSE '2001:db8:0:' || user_id || ':0:0:0:' || event_id % 16 END AS ip,
      CASE WHEN user_id % 2 = 0 THEN '10.0.' || user_id % 5 || '.' || user_id || '/32' ELSE '2001:db8:0:' || user_id || '::/64' END AS network,
      CASE WHEN user_id % 10 <> 0 THEN user_id END AS user_id,
      CASE event_type WHEN 'view' THEN 200 WHEN 'purchase' THEN 200 WHEN 'click' THEN 402 WHEN 'signup' THEN 400 WHEN 'error' THEN 503 END AS code,
      CASE WHEN event_type IN ('view', 'purchase') THEN floor(value)::INT END AS search_time,
      CASE WHEN event_type IN ('view', 'purchase') THEN floor(value / 500 * 10000 + 0.5) / 10000 END AS accuracy FROM events""",
    "tiers": "SELECT * FROM (VALUES (0,0,1,100),(1,2,1,1000),(2,2,1,5000),(3,5,1,10000),(4,5,2,20000),(5,5,3,50000),(6,6,4,100000),(9,9,255,2147483647)) t(id, priority, concurrency, quota)",
    "users": "SELECT c_custkey AS id, lower(replace(c_name, '#', '')) || '@example.com' AS email, md5(c_name) AS api_key, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'FURNITURE' THEN 1 WHEN 'HOUSEHOLD' THEN 2 WHEN 'MACHINERY' THEN 3 WHEN 'AUTOMOBILE' THEN 6 END AS tier FROM customer",
    "files": """SELECT o_orderkey AS id, o_custkey * 2 AS catalog_id, (o_orderkey % 24 + 1)::INT AS episode,
      (o_custkey * 2) || '/clip ' || o_orderkey || ' - ' || lpad((o_orderkey % 24 + 1)::VARCHAR, 2, '0') || '.mp4' AS path,
      CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false END AS loaded, o_orderdate AS created, floor(o_totalprice) / 100 AS duration,
      CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice)::INT END AS frame_count, o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders""",
    "catalog": """SELECT p_partkey AS id, TIMESTAMP '2024-01-31 00:00:00' - to_days(p_size) AS updated, p_name, p_type, p_brand, p_size,
      '{"id":' || p_partkey || ',"seasonYear":' || CASE WHEN p_size % 5 = 0 THEN 'null' ELSE (p_size + 1970)::VARCHAR END || ',"isAdult":' || CASE WHEN p_size % 7 = 0 THEN 'true' ELSE 'false' END
      || ',"format":"' || CASE WHEN p_size % 2 = 0 THEN 'TV' ELSE 'MOVIE' END || '","episodes":' || p_size || ',"title":{"native":"' || p_name || '","romaji":"' || p_type || '","english":null},"synonyms":["' || p_brand || '","' || p_name || '"]}' AS json FROM part""",
    "listing": """SELECT CASE WHEN p_partkey % 7 = 0 THEN 'extra' || p_partkey ELSE (p_partkey * 2)::VARCHAR END || '/clip ' || p_partkey || ' - ' || lpad((p_partkey % 24 + 1)::VARCHAR, 2, '0')
      || ['.mp4', '.mkv', '.webm', '.MP4', '.txt'][(p_partkey % 5 + 1)::INT] AS path FROM part""",
    "titles": "SELECT DISTINCT id, title FROM (SELECT id, unnest([json ->> '$.title.native', json ->> '$.title.romaji', json ->> '$.title.english', json ->> '$.synonyms[0]', json ->> '$.synonyms[1]']) AS title FROM catalog) WHERE title IS NOT NULL AND title <> ''",
    "changes": "SELECT event_id, user_id, epoch_us(ts) / 1000000::DOUBLE - epoch_us(min(ts) OVER (PARTITION BY user_id)) / 1000000::DOUBLE AS t, value / 500 AS score FROM events",
    # search
    "hits": """SELECT * EXCLUDE (rank) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, frame_id) AS rank FROM
      (SELECT query_id, frame_id, file_id, time, list_sum(list_transform(list_zip(vector, qvec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::INT AS score FROM frames, queries)) WHERE rank <= 1000""",
    "islands": """SELECT *, sum(opens) OVER (PARTITION BY query_id, file_id ORDER BY time, frame_id ROWS UNBOUNDED PRECEDING) AS island FROM
      (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY query_id, file_id ORDER BY time, frame_id) < 5 THEN 0 ELSE 1 END AS opens FROM hits)""",
    "matches": "SELECT query_id, file_id, min(time) AS from_time, max(time) AS to_time, min(score)::INT AS score, arg_min(time, score * 1000000000.0 + time) AS at_time FROM islands GROUP BY query_id, file_id, island",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, from_time, file_id)::INT AS rank FROM matches) WHERE rank <= 10",
    "results": """SELECT query_id, rank, file_id, catalog_id, split_part(path, '/', -1) AS filename, episode, from_time, at_time, to_time, duration, least(greatest((255 - score) / 255::DOUBLE, 0::DOUBLE), 1::DOUBLE) AS similarity
      FROM best JOIN files ON files.id = best.file_id""",
    # trigrams
    "grams": """SELECT DISTINCT id, title, lower(substr(w, i, 3)) AS gram FROM (SELECT id, title, w, unnest(range(1, length(w) - 1)) AS i FROM
      (SELECT id, title, '  ' || w || ' ' AS w FROM (SELECT id, title, unnest(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+')) AS w FROM titles) WHERE w <> ''))""",
    "wanted": "SELECT DISTINCT substr(w, i, 3) AS gram FROM (SELECT w, unnest(range(1, length(w) - 1)) AS i FROM (SELECT '  ' || unnest(['red', 'widget']) || ' ' AS w))",
    "scored": """SELECT id, title, count(wanted.gram) / (count(*) + (SELECT count(*) FROM wanted) - count(wanted.gram))::DOUBLE AS similarity FROM grams LEFT JOIN wanted ON grams.gram = wanted.gram GROUP BY id, title""",
    "best_title": "SELECT id, title, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, title) AS n FROM scored WHERE similarity >= 0.3 OR title ILIKE '%red widget%') WHERE n = 1",
    "used_user": "SELECT user_id, count(*) AS quota_used FROM logs WHERE code = 200 AND created > TIMESTAMP '2024-01-30 00:00:00' AND user_id IS NOT NULL GROUP BY user_id",
    # entries that replace those of the same id
    "sent": "SELECT id + CASE WHEN id % 8 = 0 THEN 1000000 ELSE 0 END AS id, TIMESTAMP '2024-01-31 00:00:00' AS updated, '{}' AS json FROM catalog WHERE id % 4 = 0",
    "gone": "SELECT id FROM files WHERE id % 5 = 0 AND path NOT IN (SELECT path FROM files WHERE id % 5 <> 0)",
}

#: What each view needs, in order.
NEEDS = {"queries": ("frames",), "hits": ("frames", "queries"), "islands": ("hits",), "matches": ("islands",), "best": ("matches",), "results": ("best", "files"), "titles": ("catalog",), "grams": ("titles",), "scored": ("grams", "wanted"), "best_title": ("scored",), "used_user": ("logs",), "gone": ("files",), "sent": ("catalog",)}


def _with(names: tuple[str, ...], body: str, **instead: str) -> str:
    order: list[str] = []

    def need(n: str) -> None:
        for x in NEEDS.get(n, ()):
            need(x)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    return "WITH " + ", ".join(f"{n} AS ({instead.get(n, VIEWS[n])})" for n in order) + " " + body if order else body


_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_HOURS = "created > TIMESTAMP '2024-01-28 00:00:00'"
_DAYS = f"created > {_NOW} - INTERVAL 60 DAY"


def _percentiles(column: str, unit: str, since: str, kind: str) -> str:
    cols = ", ".join(f"quantile_disc({column}, {p})::{kind} AS p{int(p * 100)}" for p in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0))
    return _with(("logs",), f"SELECT date_trunc('{unit}', created)::TIMESTAMP AS date_time, {cols} FROM logs WHERE {since} GROUP BY 1")


_EPISODE = r"nullif(coalesce(nullif(regexp_extract(regexp_replace(split_part({p}, '/', -1), '\.[A-Za-z0-9]{{2,4}}$', ''), ' - (\d{{1,4}})(?:$|[ \[v])', 1), ''))::INT, 0)"
_MEDIA = r"regexp_matches(path, '^\d+/[^/]*\.(webm|mkv|mp4)$')"
_OLD = "SELECT path FROM listing WHERE length(path) % 2 = 0"

_RUNNING = _with(("logs",), """SELECT key, id, step, at_time, (sum - least(0, min(sum) OVER (PARTITION BY key, period ORDER BY at_time, step, id ROWS UNBOUNDED PRECEDING)))::INT AS running FROM (
      SELECT *, sum(step) OVER (PARTITION BY key, period ORDER BY at_time, step, id ROWS UNBOUNDED PRECEDING) AS sum FROM (SELECT *, at_time // 86400000000 AS period FROM (
      SELECT id, step::INT AS step, epoch_us(created) + CASE step WHEN 1 THEN 0 ELSE search_time::BIGINT * 60000000 END AS at_time, CASE WHEN ip LIKE '%:%' THEN array_to_string(string_split(ip, ':')[1:4], ':') ELSE ip END AS key
      FROM logs, (SELECT unnest([1, -1]) AS step) WHERE search_time IS NOT NULL)))""")

SQL = {
    "frame_search": _with(("results",), "SELECT * FROM results"),
    "frame_search_batch": _with(("results",), "SELECT * FROM results"),
    "frame_search_filtered": _with(("results",), "SELECT * FROM results", files=VIEWS["files"].replace("o_custkey * 2 AS catalog_id", "o_orderkey % 3 AS catalog_id") + " WHERE o_orderkey % 3 = 1", hits=VIEWS["hits"].replace("FROM frames, queries", "FROM frames, queries WHERE file_id % 3 = 1 AND file_id IN (SELECT o_orderkey FROM orders)")),
    "frame_search_catalog": _with(("results", "catalog"), "SELECT query_id, rank, catalog_id, json AS catalog_json FROM results LEFT JOIN catalog ON catalog.id = catalog_id"),
    "nearest_frames": _with(("hits",), "SELECT * FROM hits"),
    "ann_recall": _with(("hits",), "SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS enough FROM hits", hits=VIEWS["hits"].replace("rank <= 1000", "rank <= 10")),
    "merge_matches": _with(("matches",), "SELECT * FROM matches"),
    "frame_count": "SELECT count(*) AS row_count FROM embeddings",
    "parse_vector": _with(("frames",), "SELECT frame_id, CASE WHEN frame_id % 7 <> 0 THEN vector END AS vector FROM frames"),
    "stats_traffic": _with(("logs",), f"SELECT date_trunc('hour', created)::TIMESTAMP AS date_time, code, count(*) AS count FROM logs WHERE {_HOURS} GROUP BY 1, 2"),
    "stats_traffic_pivot": _with(("logs",), "SELECT date_trunc('day', created)::TIMESTAMP AS date_time, " + ", ".join(f"count(*) FILTER (code = {c}) AS c{c}" for c in (200, 400, 402, 405, 500, 503)) + f", count(*) AS total FROM logs WHERE {_DAYS} GROUP BY 1"),
    "stats_traffic_codes": _with(("logs",), f"SELECT date_time, string_agg(code || ':' || n, ',' ORDER BY code) AS counts, sum(n)::BIGINT AS total FROM (SELECT date_trunc('hour', created)::TIMESTAMP AS date_time, code, count(*) AS n FROM logs WHERE {_HOURS} GROUP BY 1, 2) GROUP BY 1"),
    "stats_speed": _percentiles("search_time", "hour", _HOURS, "INT"),
    "stats_accuracy": _percentiles("accuracy", "day", _DAYS, "DOUBLE"),
    "status_totals": _with(("files",), "SELECT count(*) AS files, sum(frame_count)::BIGINT AS frames, sum(duration::DECIMAL(18,2))::DOUBLE AS seconds FROM files"),
    "status_updated": _with(("catalog",), "SELECT max(updated) AS updated FROM catalog"),
    "max_catalog_id": "SELECT max(p_partkey) AS id FROM part",
    "rolling_quota": _with(("logs",), "SELECT id, user_id, count(*) FILTER (code = 200) OVER (PARTITION BY user_id ORDER BY created RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS used FROM logs WHERE user_id IS NOT NULL"),
    "quota_stream": _with(("logs",), "SELECT id, user_id, count(*) FILTER (code = 200) OVER (PARTITION BY user_id ORDER BY created RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS used FROM logs WHERE user_id IS NOT NULL"),
    "client_windows": _with(("logs",), """, moments AS (SELECT id, network, epoch_us(created) AS t FROM logs), nexts AS (
      SELECT network, t, min(t) OVER (PARTITION BY network ORDER BY t RANGE BETWEEN 3600000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM (SELECT DISTINCT network, t FROM moments)), begun(network, t) AS (
      SELECT network, min(t) FROM moments GROUP BY network UNION ALL SELECT begun.network, nexts.next FROM begun JOIN nexts ON begun.network = nexts.network AND begun.t = nexts.t WHERE nexts.next IS NOT NULL)
      SELECT id, m.network, make_timestamp(begun.t) AS window_start, row_number() OVER one AS nth, row_number() OVER one > 2 AS limited
      FROM moments m ASOF JOIN begun ON m.network = begun.network AND m.t >= begun.t WINDOW one AS (PARTITION BY m.network, begun.t ORDER BY m.t, id)""").replace("WITH ", "WITH RECURSIVE ", 1),
    "rate_limit_windows": _with(("logs",), "SELECT network, date_trunc('hour', created)::TIMESTAMP AS window_start, count(*) AS requests, count(*) > 1 AS limited FROM logs GROUP BY 1, 2"),
    "tier_lookup": _with(("tiers",), "SELECT * FROM tiers WHERE id = 0"),
    "user_lookup": _with(("users",), "SELECT * FROM users WHERE api_key = md5('Customer#000000007')"),
    "users_view": _with(("users", "tiers", "used_user"), "SELECT users.id, email, api_key, tier, priority, concurrency, quota, coalesce(quota_used, 0) AS quota_used FROM users LEFT JOIN tiers ON tier = tiers.id LEFT JOIN used_user ON user_id = users.id"),
    "logs_view": _with(("logs", "tiers"), f"SELECT network, priority, concurrency, quota, count(*) AS quota_used FROM logs, tiers WHERE tiers.id = 0 AND user_id IS NULL AND code = 200 AND created > {_NOW} - INTERVAL 1 DAY GROUP BY ALL"),
    "quota_by_user": _with(("used_user",), "SELECT * FROM used_user"),
    "quota_by_network": _with(("logs",), f"SELECT network, count(*) AS quota_used FROM logs WHERE code = 200 AND created > {_NOW} - INTERVAL 1 DAY GROUP BY 1"),
    "quota_guest": _with(("logs", "tiers"), f"SELECT n AS network, priority, concurrency, quota, (SELECT count(*) FROM logs WHERE network = n AND user_id IS NULL AND code = 200 AND created > {_NOW} - INTERVAL 1 DAY) AS quota_used FROM tiers, (SELECT unnest(['10.0.0.10/32', '192.0.2.1/32']) AS n) WHERE id = 0"),
    "quota_messages": _with(("users", "used_user"), "SELECT users.id, CASE WHEN coalesce(quota_used, 0) >= 1 THEN 'Search quota depleted (quota per 24 hours: 1, used: ' || quota_used || ')' END AS message FROM users LEFT JOIN used_user ON user_id = users.id"),
    "client_network": _with(("logs",), "SELECT id, network FROM logs"),
    "concurrency_key": _with(("logs",), "SELECT id, CASE WHEN ip LIKE '%:%' THEN array_to_string(string_split(ip, ':')[1:4], ':') ELSE ip END AS key FROM logs"),
    "tiers_seed": _with(("tiers",), "SELECT id, priority, concurrency, CASE WHEN id < 4 THEN quota ELSE quota - 1 END AS quota FROM tiers"),
    "apply_tier_changes": _with(("users",), "SELECT id, email, api_key, CASE WHEN id % 10 = 3 THEN tier + 1 ELSE tier END AS tier FROM users"),
    "new_user_ids": "SELECT count(*) AS n, (SELECT max(c_custkey) FROM customer) + 1 AS least, (SELECT max(c_custkey) FROM customer) + count(*) AS greatest, count(*) AS ids FROM supplier",
    "login": _with(("users",), "SELECT id AS request_id, CASE WHEN id % 3 = 0 THEN 403 ELSE 200 END AS code, CASE WHEN id % 3 <> 0 THEN api_key END AS api_key FROM users"),
    "new_accounts": _with(("users", "tiers"), """SELECT request_id, email, tier, CASE WHEN error IS NULL THEN 200 WHEN error LIKE '%exists' THEN 409 ELSE 400 END AS code, error FROM (
      SELECT request_id, email, tier, CASE WHEN error IS NULL AND row_number() OVER (PARTITION BY email, error ORDER BY request_id) > 1 THEN 'Error: user already exists' ELSE error END AS error FROM (
        SELECT *, CASE WHEN email = '' THEN 'Error: email cannot be empty' WHEN email NOT LIKE '%@%' THEN 'Error: invalid email address' WHEN tier = 0 THEN 'Error: tier cannot be empty'
          WHEN tier NOT IN (SELECT id FROM tiers) THEN 'Error: invalid tier number' WHEN email IN (SELECT email FROM users) THEN 'Error: user already exists' END AS error FROM (
          SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 7 = 0 THEN 'no address' WHEN s_suppkey % 5 = 0 THEN 'customer' || lpad(s_suppkey::VARCHAR, 9, '0') || '@example.com' WHEN s_suppkey % 11 = 0 THEN 'twice@example.com'
            WHEN s_suppkey % 13 = 0 THEN '' ELSE 'new' || s_suppkey || '@example.com' END AS email, CASE WHEN s_suppkey % 4 = 0 THEN 99 WHEN s_suppkey % 9 = 0 THEN 0 ELSE 1 END AS tier FROM supplier)))"""),
    "password_resets": _with(("users",), "SELECT id AS request_id, CASE WHEN id % 4 <> 0 THEN id END AS user_id, CASE WHEN id % 4 = 0 THEN 403 WHEN id % 12 < 8 THEN 400 ELSE 200 END AS code FROM users"),
    "user_hmac": _with(("users",), "SELECT id, sha256(unhex('" + bytes(x ^ 0x5C for x in b"key".ljust(64, b"\0")).hex() + "') || unhex(sha256(unhex('" + bytes(x ^ 0x36 for x in b"key".ljust(64, b"\0")).hex() + "') || encode(email)))) AS signature FROM users"),
    "preview_tokens": _with(("files",), "SELECT id, ('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT AS token FROM (SELECT id, sha1(unhex(w[7:8] || w[5:6] || w[3:4] || w[1:2]) || unhex('" + b"some salt of the engine"[4:].hex() + "')) AS h FROM (SELECT id, lpad(to_hex(CASE WHEN m >= 2147483648 THEN 4294967296 - m ELSE m END), 8, '0') AS w FROM (SELECT id, xor(xor(floor(duration * 100)::BIGINT & 4294967295, 1700000000), id & 4294967295) AS m FROM files)))"),
    # a vector is kept again two seconds after it was last kept; no file of the tables has fifty frames within two seconds
    "dedupe_frames": """WITH RECURSIVE f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, frame_id ORDER BY time, vector) AS n FROM
        (SELECT l_orderkey * 10 + l_linenumber AS frame_id, (l_orderkey % 97)::INT AS file_id, l_partkey % 4000 * 0.25::DOUBLE AS time, [(l_suppkey % 3)::INT, (l_linenumber % 2)::INT] AS vector FROM lineitem)) WHERE n = 1),
      k AS (SELECT file_id, vector, min(time) AS time FROM f GROUP BY ALL UNION ALL
        SELECT k.file_id, k.vector, min(f.time) FROM k JOIN f ON f.file_id = k.file_id AND f.vector = k.vector AND f.time >= k.time + 2 GROUP BY ALL)
      SELECT file_id, count(*) AS kept FROM k GROUP BY file_id""",
    "queue_depth": _with(("logs",), "SELECT priority, queued, sum(queued) OVER (ORDER BY priority ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS waiting FROM (SELECT (coalesce(user_id, 0) % 7)::INT AS priority, count(*) AS queued FROM logs GROUP BY 1)"),
    "admission": _with(("users", "tiers", "used_user"), "SELECT users.id, CASE WHEN coalesce(quota_used, 0) >= quota % 7 THEN 402 WHEN users.id % 3 > concurrency THEN 402 WHEN users.id % 10 + 1 > 8 THEN 503 ELSE 200 END AS code FROM users LEFT JOIN tiers ON tier = tiers.id LEFT JOIN used_user ON user_id = users.id"),
    "peak_concurrency": _with(("logs",), """SELECT key, max(running)::BIGINT AS peak FROM (SELECT key, sum(step) OVER (PARTITION BY key ORDER BY at_time, step, id ROWS UNBOUNDED PRECEDING) AS running FROM (
      SELECT id, step, epoch_us(created) + CASE step WHEN 1 THEN 0 ELSE search_time::BIGINT * 60000000 END AS at_time, CASE WHEN ip LIKE '%:%' THEN array_to_string(string_split(ip, ':')[1:4], ':') ELSE ip END AS key
      FROM logs, (SELECT unnest([1, -1]) AS step) WHERE search_time IS NOT NULL)) GROUP BY key"""),
    "running_concurrency": _RUNNING,
    "concurrency_stream": _RUNNING,
    "webhook_top_tier": "SELECT p_partkey, CASE WHEN p_size >= p_size % 17 * 3 THEN 'a' ELSE 'b' END AS tier FROM part",
    "valid_emails": _with(("users",), "SELECT id, email FROM users WHERE id % 3 <> 0 AND regexp_matches(email, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+$')"),
    "user_digests": _with(("users",), "SELECT id, sha1(email) AS sha1, sha256(email) AS sha256 FROM users"),
    "catalog_view": _with(("catalog",), "SELECT id, p_name AS title_native, p_type AS title_romaji, NULL::VARCHAR AS title_english, NULL::VARCHAR AS title_chinese, p_size % 7 = 0 AS is_adult, NULL::VARCHAR AS season, (json ->> '$.seasonYear')::INT AS season_year, json ->> '$.format' AS format, NULL::VARCHAR AS status, (json ->> '$.episodes')::INT AS episodes, NULL::INT AS duration, NULL::VARCHAR AS country, NULL::VARCHAR AS source, updated FROM catalog"),
    "catalog_titles": _with(("titles",), "SELECT * FROM titles"),
    "catalog_titles_refreshed": _with(("titles",), "SELECT * FROM titles"),
    "titles_union": _with(("catalog",), "SELECT id, p_name AS title FROM catalog UNION SELECT id, p_type FROM catalog UNION SELECT id, p_brand FROM catalog"),
    "best_title_per_id": _with(("best_title",), "SELECT * FROM best_title"),
    "title_search": _with(("best_title",), "SELECT b.id, title, similarity, json FROM (SELECT * FROM best_title ORDER BY similarity DESC, id LIMIT 50) b JOIN catalog USING (id)"),
    "title_search_indexed": _with(("best_title",), "SELECT b.id, title, similarity, json FROM (SELECT * FROM best_title ORDER BY similarity DESC, id LIMIT 50) b JOIN catalog USING (id)"),
    "title_search_written": _with(("best_title",), "SELECT b.id, title, similarity, json FROM (SELECT * FROM best_title ORDER BY similarity DESC, id LIMIT 50) b JOIN catalog USING (id)"),
    "catalog_upsert": _with(("catalog", "sent"), "SELECT id, updated, json FROM catalog WHERE NOT EXISTS (SELECT * FROM sent WHERE sent.id = catalog.id) UNION ALL SELECT * FROM sent"),
    "catalog_fill_missing": _with(("catalog",), """SELECT i AS id, coalesce(json, '{"id":' || i || ',"title":{"native":null,"romaji":null,"english":null},"synonyms":[]}') AS json FROM (SELECT unnest(range(1, (SELECT max(p_partkey) + 1 FROM part))) AS i) LEFT JOIN catalog ON id = i AND id % 3 = 0"""),
    "crawl_end": "SELECT min(ends) AS last_id FROM (SELECT *, lead(id) OVER (ORDER BY id) AS behind FROM (SELECT id, (54 + 50 * greatest(0, ceil((id + 146) / 50.0)))::BIGINT AS ends FROM (SELECT 5::BIGINT AS id UNION SELECT p_partkey FROM part WHERE p_partkey > 5 AND p_partkey % 1000 < 700))) WHERE behind IS NULL OR behind > ends",
    "refresh_blocks": _with(("catalog",), "SELECT id, ((row_number() OVER (ORDER BY id DESC) - 1) // 50)::BIGINT AS block FROM catalog WHERE id < (SELECT max(id) FROM catalog)"),
    "id_chunks": "SELECT floor((p_partkey - 1) / 50)::BIGINT AS chunk, min(p_partkey) AS first_id, max(p_partkey) AS last_id, count(*) AS ids FROM part GROUP BY 1",
    "add_titles": "SELECT p_partkey AS id, s_name AS title_chinese FROM part LEFT JOIN supplier ON s_suppkey * 3 = p_partkey",
    "scan_files": _with(("files",), "SELECT id, path FROM files"),
    "scan_media_paths": _with(("listing",), f"SELECT path FROM listing WHERE {_MEDIA}"),
    "path_parts": _with(("listing",), "SELECT path, split_part(path, '/', -1) AS name, split_part(path, '/', 1) AS folder, '.' || split_part(path, '.', -1) AS extension FROM listing"),
    "episode_number": _with(("files",), "SELECT id, episode FROM files"),
    "new_paths": _with(("listing",), f"SELECT path FROM listing WHERE {_MEDIA} AND path NOT IN ({_OLD})"),
    "new_files": _with(("listing",), f"SELECT path, split_part(path, '/', 1)::INT AS catalog_id, ({_EPISODE.format(p='path')})::SMALLINT AS episode FROM listing WHERE {_MEDIA} AND path NOT IN ({_OLD})"),
    "file_media_columns": _with(("files",), "SELECT id, o_orderkey AS size, (floor(o_totalprice)::BIGINT || '.5')::FLOAT AS duration, (o_orderkey % 3 + 1)::SMALLINT AS nb_streams, o_custkey * 1000 AS bit_rate, CASE WHEN o_orderstatus <> 'O' THEN (o_orderkey % 4 + 2)::INT END AS scene_count FROM files"),
    "missing_catalog_ids": _with(("files",), "SELECT DISTINCT catalog_id FROM files WHERE catalog_id NOT IN (SELECT p_partkey FROM part)"),
    "pending_media_info": _with(("files",), "SELECT id, path FROM files WHERE id % 3 = 0 ORDER BY id DESC LIMIT 20"),
    "pending_scene": _with(("files",), "SELECT id, path FROM files WHERE o_orderstatus = 'O' ORDER BY id DESC LIMIT 20"),
    "pending_color": _with(("files",), "SELECT id, path FROM files WHERE frame_count IS NULL ORDER BY id DESC LIMIT 20"),
    "pending_load": _with(("files",), "SELECT id, path FROM files WHERE loaded IS NULL AND frame_count IS NOT NULL AND catalog_id IN (SELECT p_partkey FROM part) ORDER BY id DESC LIMIT 20"),
    "ingestion_stages": _with(("files", "catalog"), """SELECT files.id, CASE WHEN catalog.id % 3 <> 0 THEN true END AS catalogue, files.id % 11 <> 0 AS media, files.id % 13 <> 0 AS scenes, files.id % 7 <> 0 AS colours,
      CASE WHEN catalog.id % 3 <> 0 AND files.id % 11 <> 0 AND files.id % 13 <> 0 AND files.id % 7 <> 0 THEN files.id % 17 <> 0 END AS loaded FROM files LEFT JOIN catalog ON catalog.id = catalog_id"""),
    "files_view": _with(("files", "catalog"), "SELECT files.id, catalog_id, episode, path, duration, loaded, p_name AS title_native, p_type AS title_romaji, p_size % 7 = 0 AS is_adult FROM files LEFT JOIN catalog ON catalog.id = catalog_id"),
    "files_by_prefix": _with(("files",), "SELECT id, path, loaded FROM files WHERE path LIKE '2%/%'"),
    "cleanup_files": _with(("files", "gone"), "SELECT id, path FROM files WHERE id NOT IN (SELECT id FROM gone)"),
    "cleanup_frames": _with(("frames", "gone"), "SELECT frame_id, file_id FROM frames WHERE file_id NOT IN (SELECT id FROM gone)"),
    "cleanup_frames_by_file": _with(("frames", "gone"), "SELECT frame_id, file_id FROM frames WHERE file_id NOT IN (SELECT id FROM gone)"),
    "apply_stage_results": _with(("files",), "SELECT id, coalesce(loaded, id % 2 = 0) AS loaded FROM files"),
    "log_rows": _with(("logs",), "SELECT created, ip, user_id, code, search_time, accuracy FROM logs"),
    "safe_url_filter": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'http://198.51.100.7/x' ELSE url END AS url FROM pages WHERE CASE WHEN page_id % 3 = 0 THEN page_id % 5 = 4 ELSE page_id % 7 <> 0 END",
    "negotiate_format": "SELECT p_partkey, ['webp', 'jpeg', 'jxl', 'jpeg'][(p_partkey % 4 + 1)::INT] AS format FROM part",
    "token_expiry": "SELECT event_id AS id, (epoch_us(ts) // 3600000000 + 1) * 3600 AS expiry FROM events",
    "scene_threshold": "SELECT event_id, value / 500 AS score FROM events WHERE value / 500 > 0.2",
    "scene_intervals": _with(("changes",), "SELECT user_id, t AS start_time, end_time FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS end_time FROM changes) WHERE end_time IS NOT NULL"),
    "preview_durations": "SELECT event_id, least(greatest(CASE WHEN value / 100 - 1 = 0 THEN 0.5 ELSE value / 100 - 1 END, 0.5), 2.0)::DOUBLE AS shortest, least(greatest(CASE WHEN value / 100 - 1 = 0 THEN 5.0 ELSE value / 100 - 1 END, 0.5), 5.0)::DOUBLE AS longest FROM events",
    "crop_decision": """SELECT p_partkey, CASE WHEN abs(w / h - 16 / 9::DOUBLE) < 0.05 OR abs(w / h - 4 / 3::DOUBLE) < 0.05 THEN 'crop' WHEN abs(w / h - 21 / 9::DOUBLE) < 0.1 AND (640 - w) / 640 > 0.05 THEN 'letterbox' ELSE 'keep' END AS decision
      FROM (SELECT p_partkey, 640.0::DOUBLE - p_partkey % 50 AS w, p_size * 10.0::DOUBLE + 100 AS h FROM part)""",
    # raw frames and images
    "raw_frame_times": """SELECT name, frame, frame * 0.25::DOUBLE AS time, md5(substr(bytes, (frame * 192 + 1)::BIGINT, 192)) AS digest FROM (
      SELECT name, bytes, unnest(range(length(bytes) // 192 - CASE WHEN part % 3 = 0 THEN 2 ELSE 0 END)) AS frame FROM (
        SELECT page_id // 50 AS part, 'clips/c ' || (page_id // 50) AS name, hex(encode(string_agg(html, '' ORDER BY page_id, html))) AS bytes FROM pages WHERE page_id IS NOT NULL GROUP BY ALL))""",
    "prepared_images": """SELECT page_id, (CASE what WHEN 'crop' THEN nw ELSE 320 END)::INT AS width, (CASE what WHEN 'crop' THEN nh WHEN 'letterbox' THEN 180 ELSE h END)::INT AS height,
      (CASE what WHEN 'crop' THEN nw * nh WHEN 'keep' THEN (320 - 2 * l) * (h - 2 * t) WHEN 'letterbox' THEN 320 * floor(nh * 320::DOUBLE / nw + 0.5) END)::INT AS lit FROM (
      SELECT *, CASE WHEN abs(nw / nh - 16 / 9::DOUBLE) < 0.05 OR abs(nw / nh - 4 / 3::DOUBLE) < 0.05 THEN 'crop'
        WHEN abs(nw / nh - 21 / 9::DOUBLE) < 0.1 AND ((320 - nw) / 320 > 0.05 OR (h - nh) / h > 0.05) THEN 'letterbox' ELSE 'keep' END AS what FROM (
      SELECT *, 320::DOUBLE - 2 * l - CASE WHEN l > 0 THEN 4 ELSE 0 END AS nw, h::DOUBLE - 2 * t - CASE WHEN t > 0 THEN 4 ELSE 0 END AS nh FROM (
      SELECT page_id, 180 + page_id % 2 * 60 AS h, page_id % 9 * 6 AS t, page_id % 5 * 8 AS l FROM pages)))""",
    "request_sources": """SELECT page_id, source, CASE WHEN source IS NULL THEN 405 WHEN source = 'url' AND page_id % 3 = 0 OR source = 'file' AND (page_id % 25 = 0 OR size = 0) THEN 400 ELSE 200 END AS status,
      CASE WHEN source = 'body' OR source = 'file' AND page_id % 25 <> 0 AND size > 0 THEN size END AS bytes FROM (
      SELECT page_id, coalesce(octet_length(encode(html)), 0) AS size, CASE WHEN page_id % 7 = 0 THEN 'vector' WHEN page_id % 2 = 0 AND page_id % 3 < 2 THEN 'url' WHEN page_id % 5 = 0 THEN 'file'
        WHEN page_id % 3 = 0 AND length(html) > 0 THEN 'body' END AS source FROM pages)""",
}

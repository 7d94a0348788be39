"""Named queries over the generated tables: each applies operators to the domain views."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import network, text, tokens, vectors
from ..operators import accounts, analytics, ann, catalog, dedupe, descriptor, frames, pipeline, prepare_image, rate_limits, scenes, title_index, uploads
from ..session import ensure_importable, fresh_folder
from ..sources import derived, raw_frames, views
from ..streaming import stateful
from ..streaming.stages import Stage, StageGraph

TITLE = "red widget"

QUERIES: dict = {}


def query(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_importable(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def _frames(spark, d):
    return views.frames(spark, d), views.frames(spark, d).filter(F.col("frame_id") % 20 == 0).select(F.col("frame_id").alias("query_id"), F.col("vector").alias("qvec"))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return views.logs(spark, d).withColumn("network", network.client_network(F.col("ip")))


def _titles(spark, d):
    return catalog.catalog_titles(views.catalog(spark, d))


# --- frame search -------------------------------------------------------------------------------


@query
def frame_search(spark, d):
    every, wanted = _frames(spark, d)
    return frames.frame_search(every, wanted, views.files(spark, d))


@query
def frame_search_batch(spark, d):
    every, wanted = _frames(spark, d)
    return frames.frame_search(every, wanted, views.files(spark, d))


@query
def frame_search_filtered(spark, d):
    every, wanted = _frames(spark, d)
    return frames.frame_search_filtered(every, wanted, views.files(spark, d).withColumn("catalog_id", F.col("id") % 3), 1)


@query
def frame_search_catalog(spark, d):
    every, wanted = _frames(spark, d)
    return frames.with_catalog(frames.frame_search(every, wanted, views.files(spark, d)), views.catalog(spark, d)).select("query_id", "rank", "catalog_id", "catalog_json")


@query
def nearest_frames(spark, d):
    every, wanted = _frames(spark, d)
    return frames.nearest_frames(every, wanted)


def _inverted_file(spark, d, candidates):
    every, wanted = _frames(spark, d)
    path = fresh_folder(spark, "ivf")
    ann.write_index(every, path, lists=16)
    return every, wanted, ann.search(spark, path, wanted, probes=10, candidates=candidates)


@query
def ann_search(spark, d):
    return _inverted_file(spark, d, 1000)[2]


@query
def ann_recall(spark, d):
    """Whether the index finds nine of ten of the ten nearest frames of all queries."""
    every, wanted, found = _inverted_file(spark, d, 10)
    exact = frames.nearest_frames(every, wanted, 10)
    hit = exact.join(found.select("query_id", "frame_id", F.lit(1).alias("hit")), ["query_id", "frame_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), (10 * F.count("hit") >= 9 * F.count("*")).alias("enough"))


@query
def merge_matches(spark, d):
    every, wanted = _frames(spark, d)
    return frames.merge_matches(frames.nearest_frames(every, wanted))


@query
def frame_count(spark, d):
    return views.frames(spark, d).agg(F.count("*").alias("row_count"))


@query
def dedupe_frames(spark, d):
    f = views.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_id"), (F.col("l_orderkey") % 97).cast("int").alias("file_id"), (F.col("l_partkey") % 4000 * 0.25).alias("time"), F.array((F.col("l_suppkey") % 3).cast("int"), (F.col("l_linenumber") % 2).cast("int")).alias("vector"))
    one = f.groupBy("file_id", "frame_id").agg(F.min(F.struct("time", "vector")).alias("x")).select("frame_id", "file_id", "x.time", "x.vector")
    return dedupe.dedupe_frames(one).groupBy("file_id").agg(F.count("*").alias("kept"))


@query
def colour_layout(spark, d):
    """Descriptors of rasters that the pages' bytes make: rows of 32 pixels, as many as are full."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = views.read(spark, d, "pages").select("page_id", raw.alias("data"), F.floor(F.octet_length(raw) / 96).cast("int").alias("height"))
    return pages.select("page_id", descriptor.colour_layout_udf("data", F.lit(32), "height").alias("descriptor"))


@query
def parse_vector(spark, d):
    """Each frame's vector sent as base64 and read back; some texts are cut and no vector."""
    sent = F.base64(F.unhex(F.array_join(F.transform("vector", lambda x: F.lpad(F.hex(x), 2, "0")), "")))
    asked = views.frames(spark, d).select("frame_id", F.when(F.col("frame_id") % 7 == 0, F.substring(sent, 1, 40)).otherwise(sent).alias("sent"))
    return asked.select("frame_id", vectors.parse_vector(F.col("sent")).alias("vector"))


# --- statistics ---------------------------------------------------------------------------------


@query
def stats_traffic(spark, d):
    return analytics.traffic(views.logs(spark, d), "hour", views.as_of())


@query
def stats_traffic_pivot(spark, d):
    return analytics.traffic_pivot(views.logs(spark, d), "day", views.as_of())


@query
def stats_traffic_codes(spark, d):
    out = analytics.traffic_codes(views.logs(spark, d), "hour", views.as_of())
    return out.select("date_time", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("counts"), "total")


@query
def stats_speed(spark, d):
    return analytics.percentiles(views.logs(spark, d), "hour", "search_time", views.as_of())


@query
def stats_accuracy(spark, d):
    return analytics.percentiles(views.logs(spark, d), "day", "accuracy", views.as_of())


@query
def status_totals(spark, d):
    return analytics.status_totals(views.files(spark, d))


@query
def status_updated(spark, d):
    return views.catalog(spark, d).agg(F.max("updated").alias("updated"))


@query
def max_catalog_id(spark, d):
    return views.catalog(spark, d).agg(F.max("id").alias("id"))


@query
def rolling_quota(spark, d):
    return analytics.rolling_success(views.logs(spark, d).filter("user_id IS NOT NULL"), "user_id").select("id", "user_id", F.col("used").cast("long").alias("used"))


@query
def rate_limit_windows(spark, d):
    return analytics.rate_windows(views.logs(spark, d), network.client_network(F.col("ip")), "1 hour", 1)


@query
def client_windows(spark, d):
    return rate_limits.first_request_windows(_logs(spark, d), "network", 3600, 2)


# --- accounts -----------------------------------------------------------------------------------


@query
def tier_lookup(spark, d):
    return views.tiers(spark).filter("id = 0")


@query
def user_lookup(spark, d):
    return views.users(spark, d).filter(F.col("api_key") == F.md5(F.lit("Customer#000000007"))).limit(1)


@query
def users_view(spark, d):
    return accounts.users_view(views.users(spark, d), views.tiers(spark), views.logs(spark, d), views.as_of())


@query
def logs_view(spark, d):
    return accounts.logs_view(views.tiers(spark), _logs(spark, d), views.as_of())


@query
def quota_by_user(spark, d):
    return accounts.used_last_day(views.logs(spark, d).filter("user_id IS NOT NULL"), "user_id", views.as_of())


@query
def quota_by_network(spark, d):
    return accounts.used_last_day(_logs(spark, d), "network", views.as_of())


@query
def quota_guest(spark, d):
    return accounts.quota_guest(views.tiers(spark), _logs(spark, d), "10.0.0.10/32", views.as_of()).unionByName(accounts.quota_guest(views.tiers(spark), _logs(spark, d), "192.0.2.1/32", views.as_of()))


@query
def quota_messages(spark, d):
    return users_view(spark, d).select("id", accounts.quota_message(F.lit(1), F.col("quota_used")).alias("message"))


@query
def client_network(spark, d):
    return views.logs(spark, d).select("id", network.client_network(F.col("ip")).alias("network"))


@query
def concurrency_key(spark, d):
    return views.logs(spark, d).select("id", network.concurrency_key(F.col("ip")).alias("key"))


@query
def tiers_seed(spark, d):
    return accounts.insert_missing(views.tiers(spark).filter("id < 4"), views.tiers(spark).withColumn("quota", F.col("quota") - 1), "id")


@query
def apply_tier_changes(spark, d):
    u = views.users(spark, d)
    return accounts.apply_changes(u, u.filter("id % 10 = 3").select("id", (F.col("tier") + 1).alias("tier")), "id", "tier")


@query
def new_user_ids(spark, d):
    new = views.read(spark, d, "supplier").select(F.col("s_name").alias("name"))
    out = accounts.with_new_ids(views.users(spark, d).select("id"), new)
    return out.agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("greatest"), F.count_distinct("id").alias("ids"))


def _with_password(users):
    return users.withColumn("password", F.sha2(F.concat(F.lit("pw"), F.col("id").cast("string")), 256))


@query
def login(spark, d):
    u = _with_password(views.users(spark, d))
    asked = u.select(F.col("id").alias("request_id"), "email", F.when(F.col("id") % 3 == 0, F.lit("wrong")).otherwise(F.col("password")).alias("password"))
    return accounts.login(u, asked)


@query
def new_accounts(spark, d):
    k = F.col("s_suppkey")
    email = F.when(k % 7 == 0, F.lit("no address")).when(k % 5 == 0, F.concat(F.lit("customer"), F.lpad(k.cast("string"), 9, "0"), F.lit("@example.com"))).when(k % 11 == 0, F.lit("twice@example.com")).when(k % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("new"), k.cast("string"), F.lit("@example.com")))
    asked = views.read(spark, d, "supplier").select(k.alias("request_id"), email.alias("email"), F.when(k % 4 == 0, 99).when(k % 9 == 0, 0).otherwise(1).alias("tier"))
    return accounts.new_accounts(views.users(spark, d), views.tiers(spark), asked)


@query
def password_resets(spark, d):
    u = views.users(spark, d)
    asked = u.select(F.col("id").alias("request_id"), F.when(F.col("id") % 4 == 0, F.lit("none")).otherwise(F.col("api_key")).alias("api_key"), F.repeat(F.lit("x"), (F.col("id") % 12).cast("int")).alias("password"))
    return accounts.password_resets(u, asked)


def _queue(spark, d):
    return views.logs(spark, d).groupBy((F.coalesce(F.col("user_id"), F.lit(0)) % 7).cast("int").alias("priority")).agg(F.count("*").alias("queued"))


@query
def queue_depth(spark, d):
    return accounts.queue_depth(_queue(spark, d))


@query
def admission(spark, d):
    u = users_view(spark, d)
    return u.select("id", accounts.admission(F.col("quota_used"), F.col("quota") % 7, F.col("id") % 3, F.col("concurrency"), F.col("id") % 10 + 1, F.lit(8)).alias("code"))


def _searches(spark, d):
    """Starts and ends of searches that take some minutes."""
    logs = views.logs(spark, d).filter("search_time IS NOT NULL").withColumn("key", network.concurrency_key(F.col("ip")))
    at = F.unix_micros(F.col("created").cast("timestamp"))
    starts = logs.select("id", "ip", "key", at.alias("at_time"), F.lit(1).alias("step"))
    ends = logs.select("id", "ip", "key", (at + F.col("search_time").cast("long") * 60_000_000).alias("at_time"), F.lit(-1).alias("step"))
    return starts.unionByName(ends)


@query
def peak_concurrency(spark, d):
    return accounts.peak_concurrency(_searches(spark, d), "key")


@query
def running_concurrency(spark, d):
    return accounts.running_concurrency(_searches(spark, d), "key", stateful.RESET_US * 96)


#: Test tables span a month and come in no order; their streams wait longer than that for late events.
LATE, BEHIND = "400 days", "2030-01-01"


@query
def concurrency_stream(spark, d):
    """The same as a stream whose counters are keyed state."""
    events = _searches(spark, d).select("id", "ip", F.timestamp_micros("at_time").alias("created"), "step")
    last = events.limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit("~").alias("ip"), F.lit(BEHIND).cast("timestamp").alias("created"), F.lit(1).alias("step"))
    flow = lambda s: stateful.concurrency_stream(s, LATE, stateful.RESET_US * 96)
    out = stateful.run_to_end(spark, events, last, flow, fresh_folder(spark, "concurrency"))
    return out.filter("client <> '~'").select(F.col("client").alias("key"), "id", "step", F.col("at_us").alias("at_time"), "running")


@query
def quota_stream(spark, d):
    """``rolling_quota`` as a stream whose successes are keyed state."""
    logs = views.logs(spark, d).select("id", "user_id", "code", F.col("created").cast("timestamp").alias("created"))
    last = logs.limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit(-1).cast("long").alias("user_id"), F.lit(402).alias("code"), F.lit(BEHIND).cast("timestamp").alias("created"))
    out = stateful.run_to_end(spark, logs, last, lambda s: stateful.quota_stream(s, late=LATE), fresh_folder(spark, "quota"))
    return out.filter("client <> '-1'").select("id", F.col("client").cast("long").alias("user_id"), "used")


@query
def webhook_top_tier(spark, d):
    item = lambda i, c: F.concat(F.lit('{"type":"tier","id":"' + i + '","attributes":{"amount_cents":'), c.cast("string"), F.lit("}}"))
    json = F.concat(F.lit('{"included":[{"type":"user","id":"u"},'), item("a", F.col("p_size")), F.lit(","), item("b", F.col("p_size") % 17 * 3), F.lit("]}"))
    return views.read(spark, d, "part").select("p_partkey", accounts.webhook_top_tier(json).alias("tier"))


@query
def valid_emails(spark, d):
    u = views.users(spark, d)
    return u.withColumn("email", F.when(F.col("id") % 3 == 0, F.replace("email", F.lit("@"), F.lit(" "))).otherwise(F.col("email"))).filter(text.is_email(F.col("email"))).select("id", "email")


@query
def user_digests(spark, d):
    return views.users(spark, d).select("id", F.sha1("email").alias("sha1"), F.sha2("email", 256).alias("sha256"))


@query
def user_hmac(spark, d):
    return views.users(spark, d).select("id", tokens.hmac_hex(b"key", "sha256")("email").alias("signature"))


# --- catalogue ----------------------------------------------------------------------------------


@query
def catalog_view(spark, d):
    return catalog.catalog_view(views.catalog(spark, d))


@query
def catalog_titles(spark, d):
    return _titles(spark, d)


@query
def titles_union(spark, d):
    c = views.catalog(spark, d)
    branch = lambda p: c.select("id", F.get_json_object("json", p).alias("title"))
    listed = c.select("id", F.explode(F.from_json(F.get_json_object("json", "$.synonyms"), "array<string>")).alias("title"))
    return branch("$.title.native").union(branch("$.title.romaji")).union(branch("$.title.english")).union(listed).distinct().filter("title IS NOT NULL AND title <> ''")


@query
def catalog_titles_refreshed(spark, d):
    """The titles as a derived table: made, then refreshed for the entries that have changed since."""
    now = views.catalog(spark, d)
    before = now.filter("id % 9 <> 0").withColumn("json", F.when(F.col("id") % 100 == 7, F.lit("{}")).otherwise(F.col("json")))
    titles = derived.DerivedTable(spark, fresh_folder(spark, "derived"), catalog.catalog_titles)
    titles.note(before)
    titles.refresh(before)
    titles.note(now.filter("id % 9 = 0 OR id % 100 = 7"))
    titles.refresh(now)
    return titles.read()


@query
def best_title_per_id(spark, d):
    return catalog.best_title_per_id(_titles(spark, d), TITLE)


@query
def title_search(spark, d):
    return catalog.title_search(_titles(spark, d), views.catalog(spark, d), TITLE)


@query
def title_search_indexed(spark, d):
    t = _titles(spark, d)
    return catalog.title_search_indexed(catalog.trigram_index(t), t, views.catalog(spark, d), TITLE)


@query
def title_search_written(spark, d):
    """The search by a written index, some of whose entries had other titles before an update."""
    t = _titles(spark, d)
    index = title_index.TitleIndex(spark, fresh_folder(spark, "titles"))
    index.update(t.select("id"), t.withColumn("title", F.when(F.col("id") % 5 == 0, F.reverse("title")).otherwise(F.col("title"))))
    some = t.filter("id % 5 = 0")
    index.update(some.select("id"), some)
    return index.search(views.catalog(spark, d), TITLE).withColumn("id", F.col("id").cast(t.schema["id"].dataType))


@query
def catalog_upsert(spark, d):
    c = views.catalog(spark, d)
    new = c.filter("id % 4 = 0").select((F.col("id") + F.when(F.col("id") % 8 == 0, 1_000_000).otherwise(0)).alias("id"), views.as_of().alias("updated"), F.lit("{}").alias("json"))
    return accounts.upsert(c, new, "id")


@query
def catalog_fill_missing(spark, d):
    ids = views.catalog(spark, d).agg(F.max("id").alias("last")).select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("last").cast("long"))).alias("id"))
    return catalog.fill_missing(ids, views.catalog(spark, d).filter("id % 3 = 0"))


@query
def id_chunks(spark, d):
    return catalog.id_chunks(F.lit(1), views.catalog(spark, d).select("id")).groupBy("chunk").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("ids"))


@query
def refresh_blocks(spark, d):
    return catalog.refresh_blocks(views.catalog(spark, d).select("id"))


@query
def crawl_end(spark, d):
    return catalog.crawl_end(views.catalog(spark, d).select("id").filter("id % 1000 < 700"), 5)


@query
def add_titles(spark, d):
    extra = views.read(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.col("s_name").alias("title_chinese"))
    return catalog.add_titles(views.catalog(spark, d).select("id"), extra)


# --- ingestion ----------------------------------------------------------------------------------


@query
def scan_files(spark, d):
    return views.files(spark, d).select("id", "path")


@query
def scan_media_paths(spark, d):
    return pipeline.media_paths(views.media_paths(spark, d))


@query
def path_parts(spark, d):
    p = F.col("path")
    return views.media_paths(spark, d).select("path", text.base_name(p).alias("name"), text.folder(p).alias("folder"), text.extension(p).alias("extension"))


@query
def episode_number(spark, d):
    return views.files(spark, d).select("id", text.episode_number(text.base_name(F.col("path"))).alias("episode"))


def _half_files(spark, d):
    """Files at some of the listed paths."""
    return views.media_paths(spark, d).filter(F.length("path") % 2 == 0)


@query
def new_paths(spark, d):
    return pipeline.new_paths(views.media_paths(spark, d), _half_files(spark, d))


@query
def new_files(spark, d):
    return pipeline.new_files(views.media_paths(spark, d), _half_files(spark, d))


@query
def file_media_columns(spark, d):
    return pipeline.media_columns(views.files(spark, d))


@query
def missing_catalog_ids(spark, d):
    return pipeline.missing_catalog_ids(views.files(spark, d), views.catalog(spark, d))


@query
def pending_media_info(spark, d):
    return pipeline.pending(views.files(spark, d).withColumn("media_info", F.when(F.col("id") % 3 != 0, F.col("media_info"))), F.col("media_info").isNull())


@query
def pending_scene(spark, d):
    return pipeline.pending(views.files(spark, d), F.col("scene_changes").isNull())


@query
def pending_color(spark, d):
    return pipeline.pending(views.files(spark, d), F.col("frame_count").isNull())


@query
def pending_load(spark, d):
    return pipeline.pending_load(views.files(spark, d), views.catalog(spark, d))


@query
def ingestion_stages(spark, d):
    """States of all stages after one run over the files; some fail by their id, and a third of the catalogue isn't there."""
    known = views.catalog(spark, d).filter("id % 3 <> 0").select(F.col("id").cast("long").alias("catalog_id"))
    failing = lambda n: lambda todo: todo.select(F.col("id").alias("key"), (F.col("id") % n != 0).alias("ok"), F.lit("{}").alias("result"))
    found = lambda todo: todo.join(known.hint("merge"), "catalog_id", "left_semi").select(F.col("catalog_id").alias("key"), F.lit(True).alias("ok"), F.lit("{}").alias("result"))
    stages = [
        Stage("catalogue", "catalog_id", found, retry=True), Stage("media", "id", failing(11)), Stage("scenes", "id", failing(13)), Stage("colours", "id", failing(7)),
        Stage("load", "id", failing(17), ("catalogue", "media", "scenes", "colours")),
    ]
    graph = StageGraph(spark, fresh_folder(spark, "stages"), stages, "id long, path string, catalog_id long")
    graph.add_files(views.files(spark, d).select("id", "path", "catalog_id"), 0)
    graph.run()
    return graph.states().select("id", "catalogue", "media", "scenes", "colours", F.col("load").alias("loaded"))


@query
def files_view(spark, d):
    return pipeline.files_view(views.files(spark, d), views.catalog(spark, d))


@query
def files_by_prefix(spark, d):
    return pipeline.files_by_prefix(views.files(spark, d), "2%")


def _gone(spark, d):
    f = views.files(spark, d)
    return pipeline.missing_files(f, f.filter("id % 5 <> 0").select("path"))


@query
def cleanup_files(spark, d):
    return pipeline.without(views.files(spark, d), _gone(spark, d), "id").select("id", "path")


@query
def cleanup_frames(spark, d):
    return pipeline.without(views.frames(spark, d), _gone(spark, d), "file_id").select("frame_id", "file_id")


@query
def cleanup_frames_by_file(spark, d):
    """The clean-up of a table of frames that is bucketed by file."""
    table = derived.write_frames_by_file(views.frames(spark, d), f"frames_{uuid.uuid4().hex}", 8)
    return pipeline.without(table, _gone(spark, d), "file_id").select("frame_id", "file_id")


@query
def apply_stage_results(spark, d):
    f = views.files(spark, d).select("id", "loaded")
    return accounts.apply_changes(f, f.filter("loaded IS NULL").select("id", (F.col("id") % 2 == 0).alias("loaded")), "id", "loaded")


@query
def log_rows(spark, d):
    s = views.logs(spark, d).withColumn("search_time", F.coalesce("search_time", F.lit(-1))).withColumn("accuracy", F.coalesce("accuracy", F.lit(-1.0)))
    return pipeline.log_rows(s)


@query
def safe_url_filter(spark, d):
    host = F.element_at(F.array(*[F.lit(x) for x in ("10.1.2.3", "172.20.0.1", "[::1]", "localhost:80", "198.51.100.7")]), (F.col("page_id") % 5 + 1).cast("int"))
    made = F.concat(F.lit("http://"), host, F.lit("/x"))
    u = F.when(F.col("page_id") % 3 == 0, made).when(F.col("page_id") % 7 == 0, F.lit("ftp://a.example.org/")).otherwise(F.col("url"))
    return views.read(spark, d, "pages").select("page_id", u.alias("url")).filter(text.is_safe_url(F.col("url")))


@query
def negotiate_format(spark, d):
    accept = F.element_at(F.array(*[F.lit(x) for x in ("image/webp,image/jxl", "image/png", "text/html, image/jxl;q=0.9", "*/*")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return views.read(spark, d, "part").select("p_partkey", text.negotiate_format(accept).alias("format"))


@query
def token_expiry(spark, d):
    return views.logs(spark, d).select("id", tokens.token_expiry(F.unix_seconds(F.col("created").cast("timestamp"))).alias("expiry"))


@query
def preview_tokens(spark, d):
    return views.files(spark, d).select("id", tokens.preview_token(b"some salt of the engine")(F.floor(F.col("duration") * 100).cast("long"), F.lit(1_700_000_000), F.col("id")).alias("token"))


# --- scenes -------------------------------------------------------------------------------------


@query
def scene_threshold(spark, d):
    return scenes.scene_threshold(views.read(spark, d, "events").select("event_id", (F.col("value") / 500).alias("score")))


@query
def scene_intervals(spark, d):
    return scenes.scene_intervals(views.scene_changes(spark, d), "user_id", ["t", "event_id"])


@query
def scene_window(spark, d):
    s = views.scene_changes(spark, d).withColumn("t", F.col("t") / 10000)
    lists = s.groupBy("user_id").agg(F.max("t").alias("duration"), F.array_sort(F.collect_list(F.struct("t", "score"))).alias("changes"))
    return scenes.scene_windows(lists.withColumn("t", F.col("duration") / 2)).select("user_id", "scene.start_time", "scene.end_time", "scene.duration")


@query
def preview_durations(spark, d):
    v = F.col("value") / 100 - 1
    return views.read(spark, d, "events").select("event_id", scenes.clamp_duration(v, 0.5, 0.5, 2.0).alias("shortest"), scenes.clamp_duration(v, 5.0, 0.5, 5.0).alias("longest"))


@query
def crop_decision(spark, d):
    w, h = F.lit(640.0), F.col("p_size") * 10.0 + 100
    return views.read(spark, d, "part").select("p_partkey", descriptor.crop_decision(w, h, w - F.col("p_partkey") % 50, h).alias("decision"))


# --- raw frames and images ----------------------------------------------------------------------


@query
def raw_frame_times(spark, d):
    """Clips of 8 x 4 pixels that the bytes of 50 pages each make, with logs of their times; each third clip's log lacks two."""
    part = F.floor(F.col("page_id") / 50)
    pages = views.read(spark, d, "pages").filter("page_id IS NOT NULL").groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("page_id", "html"))).alias("pages"))
    bytes_ = F.encode(F.array_join(F.transform("pages", lambda p: p["html"]), ""), "UTF-8")
    clips = pages.select("part", F.concat(F.lit("clips/c "), "part").alias("name"), bytes_.alias("data"))
    times = (F.octet_length("data") / 96).cast("int") + F.when(F.col("part") % 3 == 0, -2).otherwise(1)
    line = lambda i: F.concat(F.lit("n:"), i.cast("string"), F.lit(" pts_time:"), (i * 0.25).cast("string"), F.lit(" type:I"))
    log = F.when(times > 0, F.array_join(F.transform(F.sequence(F.lit(0), times - 1), line), "\n")).otherwise("")
    root = fresh_folder(spark, "clips")
    for extension, data in (("rgb", F.col("data")), ("log", F.encode(log, "UTF-8"))):
        raw_frames.write_files(clips.select(F.concat("name", F.lit("." + extension)).alias("name"), data.alias("data")), root)
    return raw_frames.timed_frames(spark, root, width=8, height=4).select("name", "frame", "time", F.md5(F.hex("data").cast("binary")).alias("digest"))


@query
def prepared_images(spark, d):
    """Grey images with black bars whose shade and bars follow from the page; what is left of them without borders."""
    k = F.col("page_id")
    pages = views.read(spark, d, "pages").select("page_id", (180 + k % 2 * 60).alias("h"), (k % 9 * 6).alias("t"), (k % 5 * 8).alias("l"), F.lpad(F.hex(F.length(F.coalesce("html", F.lit(""))) % 100 + 100), 2, "0").alias("shade"))
    many = lambda what, n: F.repeat(what, n.cast("int"))
    side = many(F.lit("000000"), F.col("l"))
    rows = F.concat(side, many(F.col("shade"), 3 * (320 - 2 * F.col("l"))), side)
    bar = many(F.lit("000000"), 320 * F.col("t"))
    images = pages.select("page_id", "h", F.unhex(F.concat(bar, many(rows, F.col("h") - 2 * F.col("t")), bar)).alias("data"))
    made = images.select("page_id", prepare_image.prepare_image_udf("data", F.lit(320), F.col("h").cast("int"), F.lit(True)).alias("p"))
    dark = F.replace(F.hex("p.data"), F.lit("00"), F.lit(""))
    return made.select("page_id", "p.width", "p.height", (F.length(dark) / 6).cast("int").alias("lit"))


@query
def request_sources(spark, d):
    """Requests made of pages: vectors, addresses (some not to be fetched), files and bodies, by the page's number."""
    k = F.col("page_id")
    html = F.encode("html", "UTF-8")
    url = F.when(k % 2 == 0, F.when(k % 3 == 0, F.lit("http://127.0.0.1/x")).when(k % 3 == 1, F.lit("http://198.51.100.7/a")).otherwise(""))
    files = F.when(k % 5 == 0, F.array(F.when(k % 25 != 0, html), html)).when(k % 5 == 1, F.array().cast("array<binary>"))
    asked = views.read(spark, d, "pages").select("page_id", F.when(k % 7 == 0, F.lit("AAAA")).when(k % 7 == 1, F.lit("")).alias("vector"), url.alias("url"), files.alias("files"), F.when(k % 3 == 0, html).alias("body"))
    return uploads.request_sources(asked).select("page_id", "source", "status", F.octet_length("content").cast("long").alias("bytes"))

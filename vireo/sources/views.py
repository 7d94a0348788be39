"""Domain tables over the generated parquet tables; every view is a plain projection that Catalyst prunes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
#: Id, priority, concurrency, quota of the account tiers.
TIERS = ((0, 0, 1, 100), (1, 2, 1, 1000), (2, 2, 1, 5000), (3, 5, 1, 10000), (4, 5, 2, 20000), (5, 5, 3, 50000), (6, 6, 4, 100000), (9, 9, 255, 2147483647))
SEGMENT_TIER = {"BUILDING": 0, "FURNITURE": 1, "HOUSEHOLD": 2, "MACHINERY": 3, "AUTOMOBILE": 6}
EVENT_CODE = {"view": 200, "purchase": 200, "click": 402, "signup": 400, "error": 503}
DIM = 33


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(value: str = AS_OF):
    return F.lit(value).cast("timestamp_ntz")


def lookup(column, mapping: dict):
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[column]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, file_id, time, vector of 33 small integers."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("frame_id"),
        F.col("label").alias("file_id"),
        (F.col("vec_id") * F.lit(0.5)).alias("time"),
        F.transform(F.slice("embedding", 1, DIM), lambda x: F.floor((x.cast("double") + 1) * 32).cast("int")).alias("vector"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lookup(F.col("event_type"), EVENT_CODE)
    ok = code == 200
    u = F.col("user_id")
    v4 = F.concat(F.lit("10.0."), (u % 5).cast("string"), F.lit("."), u.cast("string"))
    v6 = F.concat(F.lit("2001:db8:0:"), u.cast("string"), F.lit(":0:0:0:"), (F.col("event_id") % 16).cast("string"))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created"),
        F.when(u % 2 == 0, v4).otherwise(v6).alias("ip"),
        F.when(u % 10 != 0, u).alias("user_id"),
        code.alias("code"),
        F.when(ok, F.floor("value").cast("int")).alias("search_time"),
        F.when(ok, F.floor(F.col("value") / 500 * 10000 + 0.5) / 10000).alias("accuracy"),
    )


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIERS, "id int, priority int, concurrency int, quota int")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit("@example.com")).alias("email"),
        F.md5("c_name").alias("api_key"),
        lookup(F.col("c_mktsegment"), SEGMENT_TIER).alias("tier"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog_id = F.col("o_custkey") * 2
    number = F.lpad((F.col("o_orderkey") % 24 + 1).cast("string"), 2, "0")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        catalog_id.alias("catalog_id"),
        (F.col("o_orderkey") % 24 + 1).cast("int").alias("episode"),
        F.concat(catalog_id.cast("string"), F.lit("/clip "), F.col("o_orderkey").cast("string"), F.lit(" - "), number, F.lit(".mp4")).alias("path"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False).alias("loaded"),
        F.col("o_orderdate").alias("created"),
        F.col("o_orderdate").alias("updated"),
        (F.floor("o_totalprice").cast("double") / 100).alias("duration"),
        F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice").cast("int")).alias("frame_count"),
        F.concat(F.lit('{"format":{"size":"'), F.col("o_orderkey").cast("string"), F.lit('","nb_streams":'), (F.col("o_orderkey") % 3 + 1).cast("string"), F.lit(',"bit_rate":"'), (F.col("o_custkey") * 1000).cast("string"), F.lit('","duration":"'), F.floor("o_totalprice").cast("string"), F.lit('.5"}}')).alias("media_info"),
        F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("[[1.5,0.4]"), F.repeat(F.lit(",[2.5,0.3]"), (F.col("o_orderkey") % 4).cast("int")), F.lit("]"))).alias("scene_changes"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, updated, json: one nested document for each title."""
    s = lambda c: F.col(c).cast("string")
    year = F.when(F.col("p_size") % 5 == 0, F.lit("null")).otherwise((F.col("p_size") + 1970).cast("string"))
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        (as_of() - F.expr("make_dt_interval(cast(p_size as int))")).alias("updated"),
        F.concat(
            F.lit('{"id":'), s("p_partkey"), F.lit(',"seasonYear":'), year, F.lit(',"isAdult":'), F.when(F.col("p_size") % 7 == 0, "true").otherwise("false"),
            F.lit(',"format":"'), F.when(F.col("p_size") % 2 == 0, "TV").otherwise("MOVIE"), F.lit('","episodes":'), s("p_size"),
            F.lit(',"title":{"native":"'), F.col("p_name"), F.lit('","romaji":"'), F.col("p_type"), F.lit('","english":null},"synonyms":["'), F.col("p_brand"), F.lit('","'), F.col("p_name"), F.lit('"]}'),
        ).alias("json"),
    )


def media_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as a directory listing gives them: some in folders or with endings that don't count."""
    key = F.col("p_partkey")
    folder = F.when(key % 7 == 0, F.concat(F.lit("extra"), key.cast("string"))).otherwise((key * 2).cast("string"))
    ending = F.element_at(F.array(*[F.lit(x) for x in (".mp4", ".mkv", ".webm", ".MP4", ".txt")]), (key % 5 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(F.concat(folder, F.lit("/clip "), key.cast("string"), F.lit(" - "), F.lpad((key % 24 + 1).cast("string"), 2, "0"), ending).alias("path"))


def scene_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, t (seconds since the user's first event), score."""
    from pyspark.sql import Window

    first = F.min("ts").over(Window.partitionBy("user_id"))
    return read(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000 - F.unix_micros(first.cast("timestamp")) / 1000000).alias("t"), (F.col("value") / 500).alias("score"))

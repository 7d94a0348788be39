"""Quotas, account views, upserts, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_email
from ..session import checkpointed

#: Fixed value: the least length of a password.
PASSWORD_LENGTH = 8
#: What callers are told about a new account, in the order of the checks.
NO_ADDRESS = "Error: email cannot be empty"
BAD_ADDRESS = "Error: invalid email address"
NO_TIER = "Error: tier cannot be empty"
BAD_TIER = "Error: invalid tier number"
IN_USE = "Error: user already exists"


def used_last_day(logs: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Successes in the day before ``as_of`` by key, aggregated before any join."""
    return logs.filter((F.col("code") == 200) & (F.col("created") > as_of - F.expr("INTERVAL '1' DAY"))).groupBy(key).agg(F.count("*").alias("quota_used"))


def users_view(users: DataFrame, tiers: DataFrame, logs: DataFrame, as_of: Column) -> DataFrame:
    used = used_last_day(logs.filter("user_id IS NOT NULL"), "user_id", as_of)
    t = tiers.withColumnRenamed("id", "tier")
    return users.join(F.broadcast(t), "tier", "left").join(used, F.col("id") == F.col("user_id"), "left").select("id", "email", "api_key", "tier", "priority", "concurrency", "quota", F.coalesce("quota_used", F.lit(0)).cast("long").alias("quota_used"))


def logs_view(tiers: DataFrame, logs: DataFrame, as_of: Column) -> DataFrame:
    """The guest tier's limits beside each network's use; logs have a ``network``."""
    used = used_last_day(logs.filter("user_id IS NULL"), "network", as_of)
    guest = tiers.filter("id = 0").select("priority", "concurrency", "quota")
    return used.crossJoin(F.broadcast(guest)).select("network", "priority", "concurrency", "quota", "quota_used")


def quota_guest(tiers: DataFrame, logs: DataFrame, network: str, as_of: Column) -> DataFrame:
    """One row for a guest, also if the network has no use yet."""
    guest = tiers.filter("id = 0").select("priority", "concurrency", "quota").withColumn("network", F.lit(network))
    return guest.join(used_last_day(logs.filter((F.col("network") == network) & F.col("user_id").isNull()), "network", as_of), "network", "left").select("network", "priority", "concurrency", "quota", F.coalesce("quota_used", F.lit(0)).cast("long").alias("quota_used"))


def quota_message(quota: Column, used: Column) -> Column:
    """Fixed value: the text that callers compare with."""
    return F.when(used >= quota, F.concat(F.lit("Search quota depleted (quota per 24 hours: "), quota.cast("string"), F.lit(", used: "), used.cast("string"), F.lit(")")))


def insert_missing(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key isn't there yet, added."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of the same key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def apply_changes(existing: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Point updates of one column as a join: rows without a change keep their value."""
    new = changes.select(F.col(key), F.struct(F.col(column).alias("v")).alias("_new"))
    return existing.join(new, key, "left").withColumn(column, F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col(column))).drop("_new").select(*existing.columns)


def with_new_ids(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows numbered on from the greatest key; numbers are dealt without gathering the rows.

    The rows are written with their place first, so that what is counted is what is numbered.
    """
    greatest = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("_max"))
    placed = checkpointed(new.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id() - F.spark_partition_id().cast("long") * (1 << 33)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(counts), "_part").crossJoin(F.broadcast(greatest)).withColumn(key, F.col("_max") + F.col("_before") + F.col("_in") + 1).drop("_part", "_in", "_before", "_max")


def login(users: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(request_id, email, password digest) -> request_id, code, api_key: 200 with the key, else 403."""
    known = users.select("email", "password", F.col("api_key").alias("key")).dropDuplicates(["email", "password"])
    found = requests.join(known, ["email", "password"], "left")
    return found.select("request_id", F.when(F.col("key").isNull(), 403).otherwise(200).alias("code"), F.col("key").alias("api_key"))


def new_accounts(users: DataFrame, tiers: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(request_id, email, tier) -> request_id, email, tier, code, error.

    Checked in this order: address there, well-formed, tier there, known, address unused. Of several valid requests for one
    address the first is created, the others find it in use.
    """
    email, tier = F.col("email"), F.col("tier")
    known = requests.join(F.broadcast(tiers.select(F.col("id").alias("known_tier"))), tier == F.col("known_tier"), "left")
    used = known.join(users.select(F.col("email").alias("used_email")).distinct(), email == F.col("used_email"), "left")
    error = (
        F.when(email.isNull() | (email == ""), NO_ADDRESS).when(~is_email(email), BAD_ADDRESS)
        .when(tier.isNull() | (tier == 0), NO_TIER).when(F.col("known_tier").isNull(), BAD_TIER).when(F.col("used_email").isNotNull(), IN_USE)
    )
    checked = used.withColumn("error", error)
    first = checked.filter("error IS NULL").groupBy("email").agg(F.min("request_id").alias("first_id")).withColumnRenamed("email", "first_email")
    settled = checked.join(first, email == F.col("first_email"), "left").withColumn("error", F.when(F.col("error").isNull() & (F.col("request_id") > F.col("first_id")), IN_USE).otherwise(F.col("error")))
    code = F.when(F.col("error").isNull(), 200).when(F.col("error") == IN_USE, 409).otherwise(400)
    return settled.select("request_id", "email", "tier", code.alias("code"), "error")


def password_resets(users: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(request_id, api_key, password) -> request_id, user_id, code: 403 without a known key, 400 if too short."""
    known = users.select(F.col("id").alias("user_id"), F.col("api_key").alias("known_key")).dropDuplicates(["known_key"])
    found = requests.join(known, F.col("api_key") == F.col("known_key"), "left")
    code = F.when(F.col("user_id").isNull(), 403).when(F.coalesce(F.length("password"), F.lit(0)) < PASSWORD_LENGTH, 400).otherwise(200)
    return found.select("request_id", "user_id", code.alias("code"))


def queue_depth(queue: DataFrame) -> DataFrame:
    """(priority, queued) -> waiting: requests of this priority or a higher one."""
    return queue.withColumn("waiting", F.sum("queued").over(Window.orderBy("priority").rowsBetween(0, Window.unboundedFollowing)).cast("long"))


def admission(quota_used: Column, quota: Column, running: Column, concurrency: Column, waiting: Column, most: Column) -> Column:
    """The request counts itself in ``running`` and ``waiting`` before the test; quota is that used before."""
    return F.when(quota_used >= quota, 402).when(running > concurrency, 402).when(waiting > most, 503).otherwise(200)


def peak_concurrency(events: DataFrame, key: str) -> DataFrame:
    """(key, at, step +1/-1, id) -> the greatest running sum of each key."""
    w = Window.partitionBy(key).orderBy("at_time", "step", "id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("running", F.sum("step").over(w)).groupBy(key).agg(F.max("running").alias("peak"))


def running_concurrency(events: DataFrame, key: str, reset_us: int) -> DataFrame:
    """(key, at_time in microseconds, step +1/-1, id) -> these and ``running``: an end counts down, not below 0, and counters start anew at multiples of ``reset_us``.

    The sum that doesn't fall below 0 is the plain running sum less its least value so far, where that is negative. Counters of
    different periods are independent, so a busy client is split by them.
    """
    period = F.floor(F.col("at_time") / F.lit(reset_us))
    upto = Window.partitionBy(key, "period").orderBy("at_time", "step", "id").rowsBetween(Window.unboundedPreceding, 0)
    summed = events.select(key, "at_time", "step", "id").withColumn("period", period).withColumn("sum", F.sum("step").over(upto))
    return summed.withColumn("running", (F.col("sum") - F.least(F.lit(0), F.min("sum").over(upto))).cast("int")).select(key, "id", "step", "at_time", "running")


def webhook_top_tier(json: Column) -> Column:
    """Id of the included tier with the greatest amount, the first of equals."""
    kind = "array<struct<type:string,id:string,attributes:struct<amount_cents:long>>>"
    tiers = F.filter(F.from_json(F.get_json_object(json, "$.included"), kind), lambda x: x["type"] == "tier")
    best = F.array_max(F.transform(tiers, lambda x, i: F.struct(x["attributes"]["amount_cents"].alias("amount"), (-i).alias("place"), x["id"].alias("id"))))
    return best["id"]

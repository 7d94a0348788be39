"""Log analytics: traffic by time and code, exact discrete percentiles, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far back each period looks, and the codes that are always columns.
PERIODS = {"minute": "60 minutes", "hour": "72 hours", "day": "60 days"}
CODES = (200, 400, 402, 405, 500, 503)
LEVELS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def _recent(logs: DataFrame, period: str, as_of: Column) -> DataFrame:
    if period not in PERIODS:
        raise ValueError(f"period must be one of {', '.join(PERIODS)}")
    return logs.filter(F.col("created") > as_of - F.expr(f"INTERVAL '{PERIODS[period].split()[0]}' {PERIODS[period].split()[1][:-1]}")).withColumn("date_time", F.date_trunc(period, "created").cast("timestamp_ntz"))


def traffic(logs: DataFrame, period: str, as_of: Column) -> DataFrame:
    """date_time, code, count: every code, no empty buckets."""
    return _recent(logs, period, as_of).groupBy("date_time", "code").agg(F.count("*").alias("count"))


def traffic_pivot(logs: DataFrame, period: str, as_of: Column) -> DataFrame:
    """One row for each bucket: the fixed codes as columns, and the total over all codes."""
    return _recent(logs, period, as_of).groupBy("date_time").agg(*[F.count_if(F.col("code") == c).alias(f"c{c}") for c in CODES], F.count("*").alias("total"))


def traffic_codes(logs: DataFrame, period: str, as_of: Column) -> DataFrame:
    """One row for each bucket: the counts of whatever codes there are, as a map, and their total."""
    each = traffic(logs, period, as_of).filter("code IS NOT NULL")
    return each.groupBy("date_time").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "count")))).alias("counts"), F.sum("count").alias("total"))


def percentiles(logs: DataFrame, period: str, value: str, as_of: Column) -> DataFrame:
    """Discrete percentiles of ``value`` in each bucket; nulls are ignored, a bucket of nulls has nulls."""
    kind = logs.schema[value].dataType.simpleString()
    out = _recent(logs, period, as_of).groupBy("date_time").agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast(kind).alias(f"p{int(p * 100)}") for p in LEVELS])
    return out


def status_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.sum("frame_count").alias("frames"), F.sum(F.col("duration").cast("decimal(18,2)")).cast("double").alias("seconds"))


def rolling_success(logs: DataFrame, key: str) -> DataFrame:
    """For each log row: successes of the same key in the 24 hours up to it."""
    from pyspark.sql import Window

    day = Window.partitionBy(key).orderBy(F.unix_micros(F.col("created").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    return logs.withColumn("used", F.count_if(F.col("code") == 200).over(day))


def rate_windows(logs: DataFrame, network: Column, width: str, most: int) -> DataFrame:
    """Requests by network in tumbling windows, and whether they exceed ``most``."""
    return logs.groupBy(network.alias("network"), F.window("created", width).alias("w")).agg(F.count("*").alias("requests")).select("network", F.col("w.start").alias("window_start"), "requests", (F.col("requests") > most).alias("limited"))

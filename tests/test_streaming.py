import pandas as pd
import pytest
from pyspark.sql import functions as F

from vireo.operators import analytics
from vireo.sources import views
from vireo.streaming import flows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("logs") / "in")
    views.logs(spark, SF).withColumn("created", F.col("created").cast("timestamp")).repartition(3).write.parquet(d)
    return d


def run(stream, name, mode="complete"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_traffic_equals_batch(spark, logs_dir):
    schema = spark.read.parquet(logs_dir).schema
    run(flows.traffic(spark.readStream.schema(schema).parquet(logs_dir)), "traffic")
    got = sorted((str(r.date_time), r.code, r["count"]) for r in spark.table("traffic").collect())
    batch = views.logs(spark, SF).groupBy(F.date_trunc("hour", "created").alias("h"), "code").count().collect()
    assert got == sorted((str(r.h), r.code, r["count"]) for r in batch)


@pytest.mark.parametrize("flow", [flows.rate_limits, flows.quota_use])
def test_windows_run(spark, logs_dir, flow):
    schema = spark.read.parquet(logs_dir).schema
    run(flow(spark.readStream.schema(schema).parquet(logs_dir)), flow.__name__)
    assert spark.table(flow.__name__).count() >= 0


def test_directory_watch(spark, tmp_path):
    for p in ("12/a - 01.mp4", "12/b - 02.mkv", "x/c.mp4", "12/d.txt"):
        f = tmp_path / "media" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    root, table, state = f"file://{tmp_path}/media", f"{tmp_path}/files", f"{tmp_path}/state"
    for _ in range(2):
        flows.append_new(flows.watch_directory(spark, root), table, state).awaitTermination()
    rows = sorted(tuple(r) for r in spark.read.parquet(table).collect())
    assert rows == [("12/a - 01.mp4", 12, 1), ("12/b - 02.mkv", 12, 2)]

"""What a search request searches by: many requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_safe_url
from ..sources.readers import MAX_UPLOAD


def _given(c: Column) -> Column:
    """Whether there is anything: not null, not empty."""
    return F.coalesce(F.octet_length(c) > 0, F.lit(False))


def request_sources(requests: DataFrame) -> DataFrame:
    """Adds ``source`` (vector, url, file, body; null for none), ``content`` and ``status`` to requests(vector, url, files, body, ..).

    vector and url are strings, files an array of binaries, body a binary. A vector comes before an address, an address before the
    first file, files before a body; what comes first counts even if it is no good: others don't stand in for it. status is 200, or
    405 where there is nothing, 400 for an empty first file or an address that must not be fetched, 413 beyond 25 MiB. content is what was sent
    (null for vectors and addresses, and where status isn't 200).
    """
    first = F.get("files", F.lit(0))
    source = F.when(_given(F.col("vector")), "vector").when(_given(F.col("url")), "url").when(F.size("files") > 0, "file").when(_given(F.col("body")), "body")
    sent = F.when(F.col("source") == "file", F.coalesce(first, F.lit(b""))).when(F.col("source") == "body", F.col("body"))
    bad = ((F.col("source") == "url") & ~F.coalesce(is_safe_url(F.col("url")), F.lit(False))) | ((F.col("source") == "file") & (F.octet_length("content") == 0))
    status = F.when(F.col("source").isNull(), 405).when(F.octet_length("content") > MAX_UPLOAD, 413).when(bad, 400).otherwise(200)
    out = requests.withColumn("source", source).withColumn("content", sent).withColumn("status", status)
    return out.withColumn("content", F.when(F.col("status") == 200, F.col("content")))

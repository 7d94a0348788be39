"""Incremental ingestion: what is new, what is pending at each stage, what to remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, episode_number, folder, is_media_path

#: Media fields taken from the container's description.
MEDIA_FIELDS = (("size", "$.format.size", "bigint"), ("duration", "$.format.duration", "float"), ("nb_streams", "$.format.nb_streams", "smallint"), ("bit_rate", "$.format.bit_rate", "bigint"))


def media_paths(listing: DataFrame) -> DataFrame:
    return listing.filter(is_media_path(F.col("path")))


def new_paths(listing: DataFrame, files: DataFrame) -> DataFrame:
    return media_paths(listing).join(files.select("path"), "path", "left_anti")


def new_files(listing: DataFrame, files: DataFrame) -> DataFrame:
    """New paths with the catalogue id of their folder and the episode of their name."""
    return new_paths(listing, files).select("path", folder(F.col("path")).cast("int").alias("catalog_id"), episode_number(base_name(F.col("path"))).cast("smallint").alias("episode"))


def media_columns(files: DataFrame) -> DataFrame:
    """Derived columns of media_info and scene_changes (texts of JSON)."""
    return files.select("id", *[F.get_json_object("media_info", p).cast(t).alias(n) for n, p, t in MEDIA_FIELDS], (1 + F.json_array_length("scene_changes")).alias("scene_count"))


def missing_catalog_ids(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalogue ids of files that the catalogue lacks, by the rules of NOT IN.

    Null ids never qualify, and none does if the catalogue has a null id; all do if it is empty. An anti join, which
    picks its way by size, and one row of counts.
    """
    counts = catalog.agg(F.count("*").alias("_all"), F.count("id").alias("_known"))
    lacking = files.select("catalog_id").distinct().join(catalog.select(F.col("id").alias("catalog_id")), "catalog_id", "left_anti")
    applies = (F.col("_all") == 0) | (F.col("catalog_id").isNotNull() & (F.col("_all") == F.col("_known")))
    return lacking.crossJoin(F.broadcast(counts)).filter(applies).select("catalog_id")


def pending(files: DataFrame, condition: Column, limit: int = 20) -> DataFrame:
    """The newest files that wait for a stage."""
    return files.filter(condition).select("id", "path").orderBy(F.desc("id")).limit(limit)


def pending_load(files: DataFrame, catalog: DataFrame, limit: int = 20) -> DataFrame:
    ready = files.filter("loaded IS NULL AND frame_count IS NOT NULL")
    known = ready.join(catalog.select(F.col("id").alias("catalog_id")), "catalog_id", "left_semi")
    return known.select("id", "path").orderBy(F.desc("id")).limit(limit)


def files_view(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files with some fields of their catalogue entry."""
    entry = catalog.select(F.col("id").alias("catalog_id"), F.get_json_object("json", "$.title.native").alias("title_native"), F.get_json_object("json", "$.title.romaji").alias("title_romaji"), F.get_json_object("json", "$.isAdult").cast("boolean").alias("is_adult"))
    return files.select("id", "catalog_id", "episode", "path", "duration", "loaded").join(entry, "catalog_id", "left")


def files_by_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """LIKE prefix/%: wildcards in the prefix stay wildcards."""
    return files.filter(F.col("path").like(f"{prefix}/%")).select("id", "path", "loaded").orderBy("path")


def missing_files(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Files whose path is no longer listed."""
    return files.join(listing.select("path").distinct(), "path", "left_anti").select("id", "path")


def without(table: DataFrame, gone: DataFrame, key: str, gone_key: str = "id") -> DataFrame:
    """Delete by key, as an anti join."""
    return table.join(gone.select(F.col(gone_key).alias(key)), key, "left_anti").select(*table.columns)


def log_rows(searches: DataFrame) -> DataFrame:
    """Log rows of searches, one for each vector; negative times and accuracies mean none."""
    positive = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    return searches.select("created", "ip", "user_id", "code", positive("search_time"), positive("accuracy"))

"""Catalogue documents: typed projection, titles, fuzzy title search, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TITLE_THRESHOLD, trigram_similarity, trigrams
from ..session import checkpointed

RESULTS = 50
#: Name, path and type of the projected fields.
FIELDS = (
    ("title_native", "$.title.native", "string"), ("title_romaji", "$.title.romaji", "string"), ("title_english", "$.title.english", "string"), ("title_chinese", "$.title.chinese", "string"),
    ("is_adult", "$.isAdult", "boolean"), ("season", "$.season", "string"), ("season_year", "$.seasonYear", "int"), ("format", "$.format", "string"), ("status", "$.status", "string"),
    ("episodes", "$.episodes", "int"), ("duration", "$.duration", "int"), ("country", "$.countryOfOrigin", "string"), ("source", "$.source", "string"),
)


def catalog_view(catalog: DataFrame) -> DataFrame:
    """Typed columns of the documents; JSON null and the text 'null' are both null."""
    return catalog.select("id", *[F.nullif(F.get_json_object("json", path), F.lit("null")).cast(kind).alias(name) for name, path, kind in FIELDS], "updated")


def catalog_titles(catalog: DataFrame) -> DataFrame:
    """(id, title): one row for each distinct title or synonym, in one pass over the documents."""
    names = [F.get_json_object("json", f"$.title.{k}") for k in ("native", "romaji", "english", "chinese")]
    lists = [F.coalesce(F.from_json(F.get_json_object("json", f"$.{k}"), "array<string>"), F.array().cast("array<string>")) for k in ("synonyms", "synonyms_chinese")]
    every = F.array_distinct(F.concat(F.array(*names), *lists))
    return catalog.select("id", F.explode(every).alias("title")).filter("title IS NOT NULL AND title <> ''").distinct()


def best_title_per_id(titles: DataFrame, query: str) -> DataFrame:
    """id, title, similarity: the most similar title of each entry that matches at all."""
    wanted = trigrams(F.lit(query))
    scored = titles.withColumn("similarity", trigram_similarity(trigrams(F.col("title")), wanted))
    matching = scored.filter((F.col("similarity") >= TITLE_THRESHOLD) | F.col("title").ilike(f"%{query}%"))
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "title")
    return matching.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def title_search(titles: DataFrame, catalog: DataFrame, query: str, results: int = RESULTS) -> DataFrame:
    query = query.strip()
    if not query:
        raise ValueError("the query is empty")
    best = best_title_per_id(titles, query).orderBy(F.desc("similarity"), "id").limit(results)
    return best.join(catalog.select("id", "json"), "id")


def trigram_index(titles: DataFrame) -> DataFrame:
    """Posting list (gram, id, title, n): the grams of every title."""
    return titles.withColumn("grams", trigrams(F.col("title"))).select("id", "title", F.size("grams").alias("n"), F.explode("grams").alias("gram"))


def title_search_indexed(index: DataFrame, titles: DataFrame, catalog: DataFrame, query: str, results: int = RESULTS) -> DataFrame:
    """The same result from the posting list; only lists of the query's grams are read, plus the substring matches."""
    spark = titles.sparkSession
    grams = spark.range(1).select(F.explode(trigrams(F.lit(query))).alias("gram"))
    n_query = F.size(trigrams(F.lit(query)))
    shared = index.join(F.broadcast(grams), "gram").groupBy("id", "title", "n").agg(F.count("*").alias("c"))
    near = shared.withColumn("similarity", F.col("c") / (F.col("n") + n_query - F.col("c"))).filter(F.col("similarity") >= TITLE_THRESHOLD).select("id", "title", "similarity")
    inside = titles.filter(F.col("title").ilike(f"%{query}%")).withColumn("similarity", trigram_similarity(trigrams(F.col("title")), trigrams(F.lit(query)))).select("id", "title", "similarity")
    every = near.unionByName(inside).distinct()
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "title")
    best = every.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k").orderBy(F.desc("similarity"), "id").limit(results)
    return best.join(catalog.select("id", "json"), "id")


def fill_missing(ids: DataFrame, responses: DataFrame) -> DataFrame:
    """Every requested id with its document, or a skeleton."""
    skeleton = F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"title":{"native":null,"romaji":null,"english":null},"synonyms":[]}'))
    return ids.join(responses.select("id", "json"), "id", "left").select("id", F.coalesce("json", skeleton).alias("json"))


def id_chunks(first: Column, ids: DataFrame, size: int = 50) -> DataFrame:
    """Crawl blocks of ids."""
    return ids.withColumn("chunk", F.floor((F.col("id") - first) / size).cast("long"))


def add_titles(catalog: DataFrame, extra: DataFrame) -> DataFrame:
    """Alternative titles (id, title_chinese) of a small side table, where there are any."""
    return catalog.join(extra, "id", "left")


def refresh_blocks(ids: DataFrame, size: int = 50) -> DataFrame:
    """(id, block) of all known ids but the greatest, from high to low in blocks of ``size``.

    Ids are sorted over all tasks and numbered by their place in a task and the number of ids in the tasks before.
    """
    known = ids.filter("id IS NOT NULL").select("id").distinct()
    below = known.crossJoin(F.broadcast(known.agg(F.max("id").alias("_max")))).filter("id < _max").select("id")
    part = F.spark_partition_id()
    placed = checkpointed(below.orderBy(F.desc("id")).withColumn("_part", part).withColumn("_in", F.monotonically_increasing_id() - part.cast("long") * (1 << 33)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(counts, "_part").select("id", F.floor((F.col("_before") + F.col("_in")) / size).cast("long").alias("block"))


def crawl_end(found: DataFrame, known: int | None, size: int = 50, most_empty: int = 200) -> DataFrame:
    """last_id: where a crawl in blocks of ``size`` from ``known`` on ends, given the ids (id) that there are.

    Without a known id (an empty catalogue) it begins at 1, with nothing found yet.

    It ends with the first block whose end lies ``most_empty`` or more behind the last id found. An id's next one is looked
    for in its own range of ids and the one behind, so ids are never sorted in one task.
    """
    reach = most_empty + size
    first_id, known = (1, 0) if known is None else (known, known)
    start = found.sparkSession.createDataFrame([(known,)], "id long")
    ids = found.select(F.col("id").cast("long").alias("id")).filter(F.col("id") > known).distinct().unionByName(start)
    ids = ids.withColumn("part", F.floor((F.col("id") - known) / reach).cast("long"))
    first = ids.groupBy("part").agg(F.min("id").alias("next_first")).select((F.col("part") - 1).alias("part"), "next_first")
    behind = F.coalesce(F.lead("id").over(Window.partitionBy("part").orderBy("id")), F.col("next_first"))
    ends = F.lit(first_id + size - 1) + size * F.greatest(F.lit(0), F.ceil((F.col("id") + most_empty - (first_id + size - 1)) / size))
    followed = ids.join(first, "part", "left").withColumn("behind", behind).withColumn("ends", ends.cast("long"))
    return followed.filter(F.col("behind").isNull() | (F.col("behind") > F.col("ends"))).agg(F.min("ends").alias("last_id"))

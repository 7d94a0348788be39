"""A written trigram index of titles: posting lists by gram in buckets, kept up to date for changed entries only.

A text that many entries have as a title is indexed once: each distinct text of a segment has a number there, and ``titles`` tells the
entries that have it. Postings are rows (gram, number, n), sorted by gram and number within the partition of the gram's bucket and written by Parquet's second format, which stores ascending
numbers as packed differences. There are two kinds of gram: those of padded words, by which titles are similar, and those of the
whole lower-cased title, which every title that holds a text of three letters and more must have. A search reads the
buckets of its own grams only, counts shared grams, reads the few texts that qualify, and joins the entries that have them.

An update writes a segment with the titles, texts and postings of the changed entries, and their ids. A title counts if no
later segment has its entry, so an entry that lost its titles is in a segment's ids alone. ``compact`` makes one segment of all.
Segments become visible by the row that names them, which is written last; a stopped update leaves files that no one reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TITLE_THRESHOLD, trigram_similarity, trigrams
from .catalog import RESULTS

BUCKETS = 64
TITLES, TEXTS = "id long, title string, bucket int", "number long, title string"
WORD, INNER = 0, 1


def inner_grams(text: Column) -> Column:
    """Distinct 3-grams of the lower-cased text as it stands; none if it is shorter."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substr(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _literal_runs(pattern: str) -> list[str]:
    """The texts that whatever fits a LIKE pattern must hold: its parts between wildcards; an escape ends a part."""
    runs, now, k = [], "", 0
    while k < len(pattern):
        if pattern[k] in "%_\\":
            runs.append(now)
            now = ""
            k += pattern[k] == "\\"
        else:
            now += pattern[k]
        k += 1
    return [r for r in [*runs, now] if len(r.lower()) >= 3]


class TitleIndex:
    """The index in a folder. Titles, their distinct texts and postings lie by segment; ``_segments`` names those that count."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- writing

    def update(self, changed: DataFrame, titles: DataFrame) -> str:
        """changed(id): entries that are new, other than before, or gone; titles(id, title): what they have now."""
        ids = changed.select(F.col("id").cast("long").alias("id")).distinct()
        return self._add(ids, titles.select(F.col("id").cast("long").alias("id"), "title").join(ids, "id", "left_semi"), replaces=False)

    def compact(self) -> str:
        """One segment of all that counts."""
        now = self.titles().select("id", "title")
        return self._add(now.select("id").distinct(), now, replaces=True)

    def _add(self, ids: DataFrame, titles: DataFrame, replaces: bool) -> str:
        segment = uuid.uuid4().hex
        folder = f"{self.root}/{segment}"
        rows = titles.filter("title IS NOT NULL AND title <> ''").distinct()
        rows.withColumn("bucket", self._bucket_of(F.col("id"))).repartition("bucket").sortWithinPartitions("title", "id").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/titles")
        texts = self.spark.read.schema(TITLES).parquet(f"{folder}/titles").select("title").distinct()
        texts.select(F.monotonically_increasing_id().alias("number"), "title").write.option("compression", "zstd").parquet(f"{folder}/texts")
        named = self.spark.read.schema(TEXTS).parquet(f"{folder}/texts")
        postings = named.select("number", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), grams.alias("grams")) for kind, grams in ((WORD, trigrams(F.col("title"))), (INNER, inner_grams(F.col("title"))))])).alias("g"))
        postings = postings.select("number", "g.kind", F.size("g.grams").alias("n"), F.explode("g.grams").alias("gram")).withColumn("bucket", self._bucket_of(F.col("gram")))
        # a frequent gram's postings are dealt to several tasks
        postings.repartition("bucket", "kind", F.pmod(F.xxhash64("number"), F.lit(8))).sortWithinPartitions("kind", "gram", "number").write.partitionBy("bucket", "kind").option("parquet.writer.version", "v2").option("compression", "zstd").parquet(f"{folder}/postings")
        ids.write.option("compression", "zstd").parquet(f"{folder}/ids")
        order = 1 + max([s["order"] for s in self._segments()], default=-1)
        self.spark.createDataFrame([(segment, order, replaces)], "segment string, order long, replaces boolean").coalesce(1).write.mode("append").json(f"{self.root}/_segments")
        return segment

    def _bucket_of(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    # --- reading

    def _segments(self) -> list:
        try:
            rows = self.spark.read.schema("segment string, order long, replaces boolean").json(f"{self.root}/_segments").orderBy("order").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        start = max([k for k, r in enumerate(rows) if r["replaces"]], default=0)
        return rows[start:]

    def _read(self, table: str, schema: str, narrow=lambda df: df) -> DataFrame:
        """A table of all segments that count, with each row's segment number."""
        out = narrow(self.spark.createDataFrame([], schema)).withColumn("order", F.lit(None).cast("long"))
        for s in self._segments():
            out = out.unionByName(narrow(self.spark.read.schema(schema).parquet(f"{self.root}/{s['segment']}/{table}")).withColumn("order", F.lit(s["order"]).cast("long")))
        return out

    def _current(self, rows: DataFrame) -> DataFrame:
        """rows(id, order, ...) whose entry no later segment has."""
        later = self._read("ids", "id long").groupBy("id").agg(F.max("order").alias("latest"))
        return rows.join(later, "id").filter("order = latest").drop("latest")

    def titles(self) -> DataFrame:
        """id, title: all titles that count."""
        return self._current(self._read("titles", TITLES)).select("id", "title")

    def _postings(self, kind: int, grams: list[str]) -> DataFrame:
        """(number, n, gram, order) of some grams; only their buckets are read."""
        if not grams:
            return self.spark.createDataFrame([], "number long, n int, gram string, order long")
        buckets = sorted({r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select(self._bucket_of(F.col("gram"))).collect()})
        narrow = lambda df: df.filter(F.col("bucket").isin(buckets) & (F.col("kind") == kind) & F.col("gram").isin(grams)).select("number", "n", "gram")
        return self._read("postings", "number long, n int, gram string, bucket int, kind int", narrow)

    def _texts(self, numbers: DataFrame) -> DataFrame:
        """Numbered texts (number, order, ...) with their titles."""
        return self._read("texts", TEXTS).join(numbers, ["number", "order"])

    def _entries(self, texts: DataFrame) -> DataFrame:
        """(id, title, similarity) of the entries that have such titles now; texts(title, order, similarity)."""
        having = self._read("titles", TITLES).select("id", "title", "order").join(texts, ["title", "order"])
        return self._current(having).select("id", "title", "similarity")

    def similar(self, query: str) -> DataFrame:
        """id, title, similarity: titles that share enough grams with the query."""
        grams = self._grams(trigrams, query)
        shared = self._postings(WORD, grams).groupBy("number", "order", "n").agg(F.count("*").alias("c"))
        near = shared.withColumn("similarity", F.col("c") / (F.col("n") + F.lit(len(grams)) - F.col("c"))).filter(F.col("similarity") >= TITLE_THRESHOLD)
        return self._entries(self._texts(near).select("title", "order", "similarity"))

    def holding(self, query: str) -> DataFrame:
        """id, title, similarity: titles that hold the query (LIKE wildcards count). A query without a text of three letters reads all texts."""
        grams = sorted({g for r in _literal_runs(query) for g in self._grams(inner_grams, r)})
        if grams:
            having = self._postings(INNER, grams).groupBy("number", "order").agg(F.count("*").alias("c")).filter(F.col("c") == len(grams))
            rows = self._texts(having)
        else:
            rows = self._read("texts", TEXTS)
        fits = rows.filter(F.col("title").ilike(f"%{query}%"))
        return self._entries(fits.select("title", "order", trigram_similarity(trigrams(F.col("title")), trigrams(F.lit(query))).alias("similarity")))

    def _grams(self, of, text: str) -> list[str]:
        return self.spark.range(1).select(of(F.lit(text))).first()[0]

    def search(self, catalog: DataFrame, query: str, results: int = RESULTS) -> DataFrame:
        """The best title of each entry that matches, best entries first, with their documents."""
        query = query.strip()
        if not query:
            raise ValueError("the query is empty")
        every = self.similar(query).unionByName(self.holding(query)).distinct()
        first = Window.partitionBy("id").orderBy(F.desc("similarity"), "title")
        best = every.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k").orderBy(F.desc("similarity"), "id").limit(results)
        return best.join(catalog.select("id", "json"), "id")

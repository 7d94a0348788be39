"""A training-data pipeline over the table of documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on; all but the last return the columns
they were given. Between stages documents are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm import decontaminate, langid, mixing, ngram_join, suffix_dedup
from vireo.llm.common import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language go: those without a letter, and those of some length that are like no language learnt.

    Languages are learnt from all labelled documents. A null ``lang`` becomes the predicted one, others stay. Null,
    empty and letterless texts go; short texts stay, as their score tells nothing; repeated rows and null ids are rows like
    others; with no labelled text, every text with a letter stays; an empty table stays empty; other columns pass.
    """
    langs, prototypes = langid.learn_prototypes(docs)
    if not langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    found = langid.identify_languages(whole, langs, prototypes, keep=["doc"], with_size=True)
    known = found.filter((F.col("lang_pred") != "und") & ~langid.unlike_any())
    filled = {"lang": F.coalesce("doc.lang", "lang_pred")}
    return known.select(*[filled.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


#: At most so many keys of dropped documents (some 50 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _small(keys: DataFrame) -> DataFrame:
    keys = materialize(keys, "pipeline-keys")
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id stays of each group of near-duplicates; of repeated rows of it, one.

    A null id comes after all others. Null, empty and wordless texts are near-duplicates of nothing and stay, as do all
    rows of a table in which nothing is shared; very long texts are compared whole; other columns pass.
    """
    text = F.xxhash64("text")
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", text.alias("text_hash")).alias("key"), "text")
    groups = materialize(ngram_join.similar_groups(keyed, id_col="key").filter("n_shingles > 0").withColumnRenamed("doc_id", "key"), "pipeline-groups")

    def same(keys: DataFrame):
        return F.col("doc_id").eqNullSafe(keys["drop_id"]) & (text == keys["drop_hash"])

    as_key = [F.col("key.doc_id").alias("drop_id"), F.col("key.text_hash").alias("drop_hash")]
    drop = _small(groups.filter("key <> component_id").select(*as_key).distinct())
    kept = docs.join(drop, same(drop), "left_anti")
    repeated = materialize(groups.filter("key = component_id").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(*as_key), "pipeline-keys")
    if repeated.isEmpty():
        return kept
    repeated = _small(repeated)
    # of rows of one id and text the first by a hash of what can be hashed; each task sends on one of them
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    hashed = [n for n, f in zip(names, docs.schema) if f.dataType.typeName() not in ("map", "variant")]
    rows = kept.join(repeated, same(repeated), "left_semi").select(F.struct(*names).alias("doc"), F.col("doc_id").alias("row_id"), text.alias("row_hash"), F.xxhash64(*hashed).alias("order"))
    first = rows.groupBy("row_id", "row_hash").agg(F.min_by("doc", "order").alias("doc")).select(*[F.col(f"doc.{n}") for n in names])
    return kept.join(repeated, same(repeated), "left_anti").unionByName(first)


#: Passages of so many words that stand in another document too are repeats, even those of under 400 bytes.
PASSAGE_WORDS = 50


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes and more that stand elsewhere too are cut out, and passages of 50 words and more that stand in
    another document, however short; a document that is cut to blanks goes.

    A cut may fall inside a character; its other bytes are left out too. Null and short texts stay as they are; of
    repeated rows of some length nothing is left; an empty table stays empty; n_chars follows a cut, other columns pass.
    """
    cut = suffix_dedup.remove_repeats(docs, with_text=True, words=PASSAGE_WORDS)
    text = F.when(F.col("n_removed") > 0, F.try_validate_utf8(F.col("kept").cast("string")))
    kept = cut.withColumn("cut_text", F.when(F.col("n_removed") > 0, F.coalesce(text, F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", ""))).otherwise(F.col("doc.text")))
    kept = kept.filter((F.col("n_removed") == 0) | F.col("cut_text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("cut_text"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("cut_text").cast("long")).otherwise(F.col("doc.n_chars"))}
    return kept.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of ten words of a benchmark item, or all of a shorter one, go.

    Null and wordless texts stay, and all if the benchmark is empty; repeated rows share their fate; very long texts are
    scanned whole; other columns pass.
    """
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("runs") == 0).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies``, how often each is taken.

    Null and empty texts have no words and aren't taken; a null source is a source of its own; of repeated rows a cut may
    take some; an empty table stays empty; other columns pass.
    """
    return mixing.take_mix(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", one_of_each_group),
    ("repeats", remove_repeats),
    ("contamination", drop_contaminated),
    ("mix", mix),
]

#: SQL can't express the language model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

The mix holds ``share`` times all words. Every source has a weight; a source's target is ``level * weight``
clamped at ``max_epochs`` times its own size, with one common level such that the targets add up to the
budget. Clamping sources and resharing the excess by weight until no source is above its clamp ends at just
this level, which has a closed form: in the order of clamp / weight, a source is clamped if the targets at
its own clamping level still fit the budget. Only one row for each source takes part in it.

A document is then repeated ``floor(target / source size)`` times, and documents in a seeded hash order of id, size
and text are taken once more as long as their middle lies within the rest of the target. The place in that order at
which a source stops is found from sums over 4096 ranges of the hash and a sort of the one range in which it lies, so
no source, however large, meets in one task. Rows that share the place (repeated rows) are numbered by parts of the
table, and the first of them are taken. Scans: one that counts words (kept as a light table), one light.

Defined cases: null and empty text has size 0 and takes nothing; very long texts are documents like others, so a
source's words differ from its target by half a document at most; a null source is a source of its own, ordered
last; null ids are ids like others, their texts tell them apart; repeated rows are rows of their own, of which a cut may
take some (which of them makes no difference to :func:`mix_sources`; :func:`take_mix` orders them by all their
columns); an empty table gives an empty result; extra columns of ``docs`` never clash, as only the three named columns
are read, and :func:`take_mix` returns them untouched beside ``copies`` (a column of that name is replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "vireo-mix-1"
#: A plan of at most so many sources is broadcast (some 100 bytes each); a larger one is joined by shuffle, salted.
BROADCAST_SOURCES = 100_000
SALTS = 32
RANGE = 1 << 40  # of the 52 bits of hash: 4096 ranges


@dataclass(frozen=True)
class Columns:
    id: str = "doc_id"
    text: str = "text"
    source: str = "source"


def _with_place(rows: DataFrame, text, seed: str) -> DataFrame:
    """rows(id, ...) with size and place in the seeded hash order: 52 bits of md5 over seed, id, size and text."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    null = F.lit("null")
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), null), F.col("size").cast("string"), F.coalesce(F.md5(text), null))
    return rows.withColumn("size", size).withColumn("place", F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long"))


def _light(docs: DataFrame, c: Columns, seed: str) -> DataFrame:
    rows = docs.select(F.col(f"`{c.id}`").alias("id"), F.col(f"`{c.source}`").alias("source"), F.col(f"`{c.text}`").alias("text"))
    return _with_place(rows, F.col("text"), seed).drop("text").withColumn("part", F.spark_partition_id())


def plan_sources(sizes: DataFrame, cycle=CYCLE, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """(source, source_size) -> source, source_size, target, whole, wanted; one row for each source throughout."""
    everything = Window.orderBy("clamp_level", "rank")
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), ((F.col("rank") - 1) % len(cycle) + 1).cast("int"))
    before = everything.rowsBetween(Window.unboundedPreceding, 0)
    all_rows = Window.orderBy("clamp_level", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    planned = (
        sizes.withColumn("rank", rank)
        .withColumn("weight", weight)
        .withColumn("clamp", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("clamp_level", F.col("clamp") / F.col("weight"))
        .withColumn("clamps", F.sum("clamp").over(before))
        .withColumn("weights_after", F.sum("weight").over(all_rows) - F.sum("weight").over(before))
        .withColumn("budget", F.sum("source_size").over(all_rows).cast("double") * F.lit(float(share)))
        .withColumn("clamped", F.col("clamps") + F.col("clamp_level") * F.col("weights_after") <= F.col("budget"))
    )
    clamped = F.sum(F.when(F.col("clamped"), F.col("clamp")).otherwise(0.0)).over(all_rows)
    free = F.sum(F.when(F.col("clamped"), 0.0).otherwise(F.col("weight"))).over(all_rows)
    level = (F.col("budget") - clamped) / F.when(free > 0, free)
    return (
        planned.withColumn("level", level)
        .withColumn("target", F.when(F.col("clamped"), F.col("clamp")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("clamp"))))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", "whole", "wanted")
    )


def _with_plan(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """rows(source, ...) joined to plan(source, ...), whatever their sizes."""
    plan = plan.withColumnRenamed("source", "plan_source")
    same = F.col("source").eqNullSafe(F.col("plan_source"))
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), same).drop("plan_source")
    salted = plan.withColumn("plan_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.col("place"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, same & (F.col("salt") == F.col("plan_salt"))).drop("plan_source", "salt", "plan_salt")


def mix_plan(docs: DataFrame, cycle=CYCLE, max_epochs: int = MAX_EPOCHS, share: float = 1.0, seed: str = SEED, columns: Columns = Columns()) -> tuple[DataFrame, DataFrame, int]:
    """(light table, plan with the place at which each source stops, number of sources)."""
    light = materialize(_light(docs, columns, seed), "mix-light")
    ranges = materialize(light.groupBy("source", F.floor(F.col("place") / F.lit(RANGE)).alias("range")).agg(F.sum("size").alias("range_size")), "mix-ranges")
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    plan = materialize(plan_sources(sizes, cycle, max_epochs, share), "mix-plan")
    n_sources = plan.count()
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        _with_plan(ranges.withColumn("place", F.col("range")), plan, n_sources)
        .withColumn("upto", F.sum("range_size").over(upto))
        .filter(F.col("upto") > F.col("wanted"))
        .groupBy("source")
        .agg(F.min(F.struct("range", (F.col("upto") - F.col("range_size")).alias("before"), "wanted")).alias("cut"))
        .select("source", "cut.*")
    )
    cut = materialize(cut, "mix-cut")
    by_place = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.floor((2 * F.col("wanted") - 2 * (F.col("upto") - F.col("all")) + F.col("each")) / (2 * F.nullif("each", F.lit(0))))
    inside = (
        _with_plan(light, cut, n_sources)
        .filter(F.floor(F.col("place") / F.lit(RANGE)) == F.col("range"))
        .groupBy("source", "place", "before", "wanted")
        .agg(F.sum("size").alias("all"), F.max("size").alias("each"), F.count("*").alias("n"))
        .withColumn("upto", F.col("before") + F.sum("all").over(by_place))
        .withColumn("take", F.coalesce(F.greatest(F.least(fits, F.col("n")), F.lit(0)), F.col("n")))
        .filter("take < n")
        .groupBy("source")
        .agg(F.min(F.struct("place", "take")).alias("first"))
    )
    stops = (
        cut.withColumnRenamed("source", "s").join(inside, F.col("s").eqNullSafe(F.col("source")), "left")
        .select(F.col("s").alias("stop_source"), F.coalesce("first.place", (F.col("range") + 1) * F.lit(RANGE)).alias("stop"), F.coalesce("first.take", F.lit(0)).alias("take"))
    )
    plan = plan.join(stops, F.col("source").eqNullSafe(F.col("stop_source")), "left").drop("stop_source")
    return light, materialize(plan, "mix-stops"), n_sources


def _numbered(tied: DataFrame) -> DataFrame:
    """tied(source, place, order, part, ...) with ``number`` from 1 within each place, in the order of ``order``.

    Rows are counted by part of the table, so that a place with many rows never meets in one task.
    """
    key = ["source", "place", "order", "part"]
    before = Window.partitionBy("source", "place").orderBy("order", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tied.groupBy(*key).agg(F.count("*").alias("n")).select(*[F.col(c).alias(f"_{c}") for c in key], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    here = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    return tied.withColumn("here", here).join(offsets, same).withColumn("number", F.col("offset") + F.col("here")).drop("here", "offset", *[f"_{c}" for c in key])


def _copies(more):
    """Whole repetitions, and one more of the rows that the rest of the target takes."""
    return F.when(F.col("size") > 0, F.col("whole") + F.when((F.col("wanted") > 0) & more, 1).otherwise(0)).otherwise(0).cast("long")


def _before_stop():
    """Whether a row stands before the place where its source stops (null: it takes all)."""
    return F.col("stop").isNull() | (F.col("place") < F.col("stop"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for every row of ``docs``."""
    light, plan, n = mix_plan(docs, **options)
    rows = _with_plan(light, plan, n)
    if plan.filter("take > 0").isEmpty():
        out = rows.withColumn("copies", _copies(_before_stop()))
    else:
        at_stop = F.coalesce(F.col("place") == F.col("stop"), F.lit(False))
        tied = _numbered(rows.filter(at_stop).withColumn("order", F.lit(0)))
        out = rows.filter(~at_stop).withColumn("copies", _copies(_before_stop())).unionByName(tied.drop("order").withColumn("copies", _copies(F.col("number") <= F.col("take"))).drop("number"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def take_mix(docs: DataFrame, columns: Columns = Columns(), seed: str = SEED, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns, and ``copies``, how often each is taken."""
    _, plan, n = mix_plan(docs, columns=columns, seed=seed, **options)
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("doc"))
    placed = _with_place(rows.select("doc", F.col(f"doc.`{columns.id}`").alias("id"), F.col(f"doc.`{columns.source}`").alias("source")), F.col(f"doc.`{columns.text}`"), seed)
    rows = _with_plan(placed, plan, n)
    at_stop = F.coalesce(F.col("place") == F.col("stop"), F.lit(False))
    kept = [*[F.col(f"doc.`{x}`").alias(x) for x in docs.columns if x != "copies"], "copies"]
    taken = rows.withColumn("copies", _copies(_before_stop())).filter(F.col("copies") > 0).select(*kept)
    if plan.filter("take > 0").isEmpty():
        return taken
    hashed = [F.col(f"doc.`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    tied = materialize(rows.filter(at_stop).withColumn("order", F.xxhash64(*hashed)).withColumn("part", F.spark_partition_id()), "mix-tied")
    tied = _numbered(tied).withColumn("copies", _copies(F.col("number") <= F.col("take"))).filter(F.col("copies") > 0).select(*kept)
    return rows.filter(~at_stop).withColumn("copies", _copies(_before_stop())).filter(F.col("copies") > 0).select(*kept).unionByName(tied)


SQL = r"""
WITH light AS (
  SELECT doc_id, source, coalesce(md5(text), 'null') AS hash, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, row_number() OVER () AS n FROM documents
), placed AS (
  SELECT *, ('0x' || substr(md5('vireo-mix-1|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size::VARCHAR || '|' || hash), 1, 13))::BIGINT AS place FROM light
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM light GROUP BY source
), clamps AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((rank - 1) % 3 + 1)::INT] AS weight, (3 * source_size)::DOUBLE AS clamp FROM sizes
), fits AS (
  SELECT *, sum(clamp) OVER (ORDER BY clamp / weight, rank ROWS UNBOUNDED PRECEDING)
      + clamp / weight * (sum(weight) OVER () - sum(weight) OVER (ORDER BY clamp / weight, rank ROWS UNBOUNDED PRECEDING))
      <= (sum(source_size) OVER ())::DOUBLE AS clamped FROM clamps
), levels AS (
  SELECT (sum(source_size)::DOUBLE - coalesce(sum(clamp) FILTER (clamped), 0.0)) / nullif(sum(weight) FILTER (NOT clamped), 0.0) AS level FROM fits
), targets AS (
  SELECT source, source_size, CASE WHEN clamped THEN clamp ELSE least(level * weight, clamp) END AS target FROM fits, levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets
), ordered AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS wanted,
    sum(p.size) OVER (PARTITION BY p.source ORDER BY p.place, p.n ROWS UNBOUNDED PRECEDING) AS upto
  FROM placed p JOIN plan t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN wanted > 0 AND 2 * upto - size <= 2 * wanted THEN 1 ELSE 0 END))::BIGINT AS taken,
  (CASE WHEN size > 0 THEN whole + CASE WHEN wanted > 0 AND 2 * upto - size <= 2 * wanted THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS copies
FROM ordered
"""

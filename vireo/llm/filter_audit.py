"""Audit of filters that act on the same documents, by a Walsh-Hadamard transform (DataFrame functions only).

A document's mask tells which of five filters it fails. For each part 32 signed parity sums are aggregated over all
documents, and over the good and the toxic ones: W[s] = sum of (-1)^popcount(mask & s). The transform is its own inverse
up to a factor of 32, so the number of documents with each mask (a cell) comes back exactly in whole numbers. Every order of
the filters, every step and the Shapley values follow from the 32 cells of a part, without another look at documents: in
the 120 orders, a document that fails k filters is removed 120 / k times by each of them.

Cost: one scan of texts, which leaves a light row for each document (the SHA-256 of its text, id, part, mask); texts themselves
never move. Rows with the same hash, id, part and mask are counted first. Copies are found by the least id of each hash,
aggregated in every task before it moves; joined by hash and id, so that a group of copies isn't one key; the parity sums
are aggregated in every task, and a part has one row then.

Defined cases: null and empty texts are one text (no word; filter A only, and E for all but the least id); very long texts are
counted whole; ids that are null are no copies of others and make none; rows that repeat text and id don't fail E through
each other; a document of several labels is good (toxic) if any label says so, labels without id or of unknown ids
count nowhere; null languages and empty ones are one part, ''; an empty table has no parts and gives no rows; extra columns
aren't read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

LETTERS = "ABCDE"
#: Failure conditions of the registered filters.
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
MARKS = r"[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("docs", "good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails the filters of words, distinct words, capitals and marks (A to D)."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MAX_CAPITAL_PERCENT * F.char_length(text).cast("long"),
        text.rlike(MARKS),
    ]


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", failures=text_failures) -> DataFrame:
    """(id, part, mask, n): how many documents of this id, part and mask there are; the last bit is that of copies (E)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    fails = failures(F.col("text"))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))
    light = materialize(source.select("id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), bits.cast("int").alias("bits")), "audit-light")
    first = light.groupBy("hash").agg(F.min("id").alias("first_id")).withColumnRenamed("hash", "first_hash")
    counted = light.groupBy("hash", "id", "part", "bits").agg(F.count("*").alias("n"))
    found = counted.join(first, (F.col("hash") == F.col("first_hash")) & (F.col("id") == F.col("first_id")), "left")
    copy = F.when(F.col("id").isNotNull() & F.col("first_hash").isNull(), 1 << len(fails)).otherwise(0)
    return found.select("id", "part", (F.col("bits") + copy).alias("mask"), "n")


def with_labels(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """masks with ``good`` and ``toxic``, false where no label says so."""
    says = lambda c: F.coalesce(F.max(F.col(f"`{c}`") == 1), F.lit(False))
    known = labels.filter(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("label_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    no = F.lit(False)
    return masks.join(known, F.col("id") == F.col("label_id"), "left").select("part", "mask", "n", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def parity_sums(masks: DataFrame, filters: int = len(LETTERS)) -> DataFrame:
    """part and, for each measure, an array of the 2^filters signed parity sums."""
    weight = {"docs": F.col("n"), "good": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("n")).otherwise(0)}

    def signed(s: int, w: Column) -> Column:
        return F.sum(F.when(F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2 == 1, -w).otherwise(w))

    sums = masks.groupBy("part").agg(*[signed(s, weight[m]).alias(f"{m}{s}") for m in MEASURES for s in range(1 << filters)])
    return sums.select("part", *[F.array(*[F.col(f"{m}{s}") for s in range(1 << filters)]).alias(m) for m in MEASURES])


def mask_cells(sums: DataFrame, filters: int = len(LETTERS)) -> DataFrame:
    """The number of documents with each mask, by the inverse transform; place 1 is mask 0."""

    def inverse(w: Column) -> Column:
        signed = lambda m: F.transform(w, lambda x, s: F.when(F.bit_count(m.bitwiseAND(s)) % 2 == 1, -x).otherwise(x))
        return F.transform(F.sequence(F.lit(0), F.lit((1 << filters) - 1)), lambda m: F.call_function("div", F.aggregate(signed(m), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1 << filters)))

    return sums.select("part", *[inverse(F.col(m)).alias(m) for m in MEASURES])


def audit_orders(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and the counts of this step, for all orders of the filters."""
    n = len(letters)
    steps = [F.struct(F.lit("".join(o)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(1 << letters.index(o[k])).alias("bit"), F.lit(sum(1 << letters.index(x) for x in o[:k])).alias("before")) for o in permutations(letters) for k in range(n)]
    # a fixed list of n! * n rows for each part
    rows = cells.select("*", F.inline(F.array(*steps)))
    orders = 1
    for i in range(2, n + 1):
        orders *= i
    bit, before, zero = F.col("bit"), F.col("before"), F.lit(0).cast("long")

    def total(cells: Column, value) -> Column:
        return F.aggregate(F.transform(cells, lambda c, m: value(c, m)), zero, lambda a, x: a + x)

    def those(measure: str, when) -> Column:
        return total(F.col(measure), lambda c, m: F.when(when(m), c).otherwise(zero))

    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~gone(m)
    share = total(F.col("docs"), lambda c, m: F.when(fails(m), F.call_function("div", c * orders, F.greatest(F.bit_count(m), F.lit(1)))).otherwise(zero))
    return rows.select(
        "part", "filter_order", "step",
        those("docs", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        those("docs", removed).alias("removed"),
        those("docs", lambda m: fails(m) & gone(m)).alias("redundant"),
        those("docs", lambda m: m == bit).alias("unique_fails"),
        those("good", removed).alias("good_lost"),
        those("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    masks = with_labels(failure_masks(docs), labels)
    return audit_orders(mask_cells(parity_sums(masks)))


SQL = r"""
WITH worded AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), labelled AS (
  SELECT doc_id AS label_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), failing AS (
  SELECT n, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, MAP {
    'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS f
  FROM worded LEFT JOIN labelled ON doc_id = label_id
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), walked AS (
  SELECT *, list_position(list_transform(string_split(filter_order, ''), lambda x: f[x]), true) AS falls FROM failing, orders
), steps AS (
  SELECT *, filter_order[step] AS letter FROM walked, (SELECT unnest(range(1, 6))::INT AS step)
), counted AS (
  SELECT part, filter_order, step, any_value(letter) AS letter,
    count(*) FILTER (falls IS NULL OR falls > step) AS kept, count(*) FILTER (falls = step) AS removed, count(*) FILTER (falls < step AND f[letter]) AS redundant,
    count(*) FILTER (f[letter] AND len(list_filter(map_values(f), lambda y: y)) = 1) AS unique_fails,
    count(*) FILTER (falls = step AND good) AS good_lost, count(*) FILTER (falls = step AND toxic) AS toxic_lost
  FROM steps GROUP BY part, filter_order, step
), shares AS (
  SELECT part, letter, sum(removed)::BIGINT AS shapley FROM counted GROUP BY part, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM counted JOIN shares USING (part, letter)
"""

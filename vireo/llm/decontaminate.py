"""Benchmark decontamination by one Aho-Corasick automaton.

Benchmark texts are lower-cased and cut into words; every run of ``window`` consecutive words (a shorter item:
all its words) is a pattern of the automaton, a sequence of word numbers. Each document is normalised in the
same way and scanned once, words that no item has being number 0; matches give the hit words, and from the words'
offsets the spans of the original text.

The automaton is built once in a worker. It takes some hundred bytes for each word of a pattern, so a benchmark of more
than ``SHARD_WINDOWS`` windows is cut into shards of so many (long items between words), fetched, broadcast and scanned
with one at a time; a usual benchmark is one shard. Documents are only mapped, never shuffled, unless there are several
shards.

Defined cases: null or wordless texts have no words and no windows; very long texts are scanned whole in one task; a
null item_id marks words but is not counted as an item; items with equal id count once, windows that several items
have count for each; repeated documents give a row each; an empty benchmark leaves every document clean, and an empty
table of documents gives no rows; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, ensure_importable, materialize

WINDOW = 10
SHARD_WINDOWS = 250_000
#: A-Z to a-z; ASCII other than letters and digits to blank; all else stays.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """Windows of items (item, words) as sequences of word numbers."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[int]] = {}
        for k, w in items:
            own = [self.number.setdefault(x, len(self.number) + 1) for x in w]
            n = min(window, len(own))
            for i in range(len(own) - n + 1 if own else 0):
                patterns.setdefault(tuple(own[i : i + n]), set()).add(k)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for p, ks in patterns.items():
            self.machine.add_word(p, (len(p), tuple(ks)))
        self.empty = not patterns
        if patterns:
            self.machine.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """(number of words, hit runs of words [from, to), items)."""
        w = words(text)
        if self.empty or not w:
            return len(w), [], set()
        runs: list[tuple[int, int]] = []
        items: set[int] = set()
        for end, (n, ks) in self.machine.iter(tuple(map(self.number.get, w, repeat(0)))):
            first, to = end + 1 - n, end + 1
            items.update(ks)
            if runs and first <= runs[-1][1]:
                while len(runs) > 1 and runs[-2][1] >= first:
                    runs.pop()
                a, b = runs[-1]
                runs[-1] = (min(a, first), max(b, to))
            else:
                runs.append((first, to))
        return len(w), runs, items


_BUILT: dict[tuple[str, int], Automaton] = {}


def _automaton(name: str, items: list[tuple[int, list[bytes]]], window: int) -> Automaton:
    """The shard's automaton, built once in a worker, which holds the last one only."""
    if (name, window) not in _BUILT:
        _BUILT.clear()
        _BUILT[name, window] = Automaton(items, window)
    return _BUILT[name, window]


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets in the original text of runs of words."""
    a = np.frombuffer(text.translate(NORMAL), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], a.view(np.int8), [0]])))
    starts, ends = edges[0::2], edges[1::2]
    return [(int(starts[a]), int(ends[b - 1])) for a, b in runs]


def _shards(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items as (id, words) in shards of at most SHARD_WINDOWS windows, fetched one after another."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).filter("t IS NOT NULL")
    shard: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for r in rows.toLocalIterator():
        w = words(r["t"].encode())
        for a in range(0, max(len(w) - window + 1, 1), SHARD_WINDOWS):
            part = w[a : a + SHARD_WINDOWS + window - 1]
            n = max(len(part) - window + 1, 1)
            if shard and size + n > SHARD_WINDOWS:
                yield shard
                shard, size = [], 0
            shard.append((r["i"], part))
            size += n
    yield shard


SCAN = "doc {doc}, n_words long, runs array<struct<a:int,b:int>>, spans array<struct<a:int,b:int>>, items array<string>"


def _scan_with(rows: DataFrame, shard: list[tuple[str | None, list[bytes]]], window: int) -> DataFrame:
    spark = rows.sparkSession
    ids = sorted({i for i, _ in shard if i is not None})
    number = {x: k for k, x in enumerate(ids)}
    name = uuid.uuid4().hex
    held = spark.sparkContext.broadcast((ids, [(number[i] if i is not None else -1, w) for i, w in shard]))
    spans = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, items = held.value
        machine = _automaton(name, items, window)
        for b in batches:
            n, runs, where, found = [], [], [], []
            for t in b.column("text").cast(pa.binary()):
                text = t.as_py() or b""
                k, r, i = machine.scan(text)
                n.append(k)
                runs.append([{"a": x, "b": y} for x, y in r])
                where.append([{"a": x, "b": y} for x, y in original_spans(text, r)] if r else [])
                found.append([names[x] for x in sorted(i) if x >= 0])
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(n, pa.int64()), pa.array(runs, spans), pa.array(where, spans), pa.array(found, pa.list_(pa.string()))], names=["doc", "n_words", "runs", "spans", "items"])

    return rows.mapInArrow(apply, SCAN.format(doc=ddl(rows.schema["doc"].dataType)))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", keep: list[str] | None = None, item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc (struct of the columns ``keep``), n_words, runs and spans of hit words (word numbers, byte offsets), items."""
    spark = docs.sparkSession
    ensure_importable(spark)
    keep = list(docs.columns) if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    shards = _shards(benchmark, item_id_col, item_text_col, window)
    first = next(shards)
    more = next(shards, None)
    if more is None:
        return _scan_with(rows, first, window)
    # Several shards: number the rows in a written copy, scan it once for each shard, add up.
    rows = materialize(rows.withColumn("row", F.expr("uuid()")), "decontaminate-rows").select(F.struct("doc", "row").alias("doc"), "text")
    every = materialize(_scan_with(rows, first, window), "decontaminate-shard")
    while more is not None:
        found = _scan_with(rows, more, window).filter("size(runs) > 0")
        every = every.unionByName(materialize(found, "decontaminate-shard"))
        more = next(shards, None)
    pooled = every.groupBy("doc.row").agg(F.first("doc.doc").alias("doc"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return pooled.select("doc", "n_words", _merged("runs"), _merged("spans"), "items")


def _merged(name: str):
    """Sorted runs with overlaps joined."""
    return F.aggregate(
        F.array_sort(name),
        F.expr("cast(array() as array<struct<a:int,b:int>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["a"] <= F.element_at(acc, -1)["b"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x))),
    ).alias(name)


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    found = find_contamination(docs, benchmark, keep=[id_col], **options)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["b"] - r["a"])
    ids = F.array_sort("items")
    return found.select(
        F.col(f"doc.`{id_col}`").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated")
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
found AS (
  SELECT p.r, p.i, p.n, windows.item_id
  FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)) p
  JOIN windows ON windows.n = p.n AND windows.win = p.win
), hits AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.r = hits.r LEFT JOIN items ON d.r = items.r
"""

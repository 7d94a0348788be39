"""Removal of lines that many documents share, by two Bloom filters and an exact check of suspected lines.

A line's key is the line without white space at both ends, A-Z lower-cased. A first scan notes the keys of each document in two
filters of equal size: what was seen once, and what was seen again. Filters of two tasks combine by bits: seen again is what is
in either's second filter, or in both first ones. A key of two documents is thus always in the second filter, and most others
aren't. The second scan stores texts in blocks in the shared folder and sends on only suspected keys, as 128-bit names with
their number of documents in the block; their sums decide. Names that reach ``min_docs`` return to the blocks that have them
(a name has a row for each block at most, so a line that stands everywhere is split by blocks), and blocks write their texts
without these lines. With ``keep_first`` the first occurrence (least order, then block and row) of each key stays.

The filters have at least 8 bits for each line, up to ``FILTER_BITS``. Fuller filters suspect more and lose nothing, so
that results don't depend on their size; a filter that suspects everything makes each line's name move once for each block.

Defined cases: null and empty texts are one empty line; an empty key (and one shorter than ``min_chars`` code points) is never
dropped; very long texts are split in parts; repeated rows are documents of their own; an empty table gives no rows; ids may
be null or repeated; extra columns pass through untouched beside the result, as fields of ``doc``.
"""

from __future__ import annotations

import hashlib
import io
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch, textcodes
from .common import by_block, ddl, ensure_importable, fresh_path, get_file, materialize, put_file

MIN_DOCS = 10
MIN_CHARS = 1
BLOCK_BYTES = 8 << 20
FILTER_BITS = (20, 28)
PART = 1 << 20  # bytes of a text that are split into lines at once
WHITE = b" \t\n\v\f\r"


def parts(text: bytes) -> Iterator[bytes]:
    """A text cut at some of its line ends."""
    at = 0
    while (cut := text.find(b"\n", at + PART)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def keys(lower: bytes, min_chars: int) -> Iterator[bytes]:
    """The key of each line of a part in lower case; b"" where there is none that counts."""
    for line in lower.split(b"\n"):
        key = line.strip(WHITE)
        yield key if min_chars <= 1 or len(key) >= min_chars and len(key.decode("utf8", "replace")) >= min_chars else b""


def document_keys(text: bytes, min_chars: int = MIN_CHARS) -> set[bytes]:
    found: set[bytes] = set()
    for part in parts(text):
        found.update(keys(part.translate(textcodes.LOWER), min_chars))
    found.discard(b"")
    return found


def without_lines(text: bytes, stays: dict[bytes, int], row: int, min_chars: int = MIN_CHARS) -> tuple[bytes, int, int]:
    """(rest of the text, number of its lines, of dropped ones): names in ``stays`` go, but for the first line in that row."""
    if not stays:
        return text, text.count(b"\n") + 1, 0
    good, n, done = [], 0, set()
    for part in parts(text):
        for line, key in zip(part.split(b"\n"), keys(part.translate(textcodes.LOWER), min_chars)):
            n += 1
            if key and (name := xxhash.xxh3_128_digest(key)) in stays:
                if stays[name] != row or name in done:
                    continue
                done.add(name)
            good.append(line)
    return b"\n".join(good), n, n - len(good)


class SeenTwice:
    """Packed bits of keys seen once and of those seen again."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = (np.zeros(1 << (bits - 3), dtype=np.uint8) for _ in range(2))

    def add(self, codes: np.ndarray) -> None:
        """Codes of which some may be equal: equal ones are seen again at once."""
        own, n = np.unique(codes, return_counts=True)
        old = sketch.in_bloom(self.once, own.view(np.int64))
        for filled, some in ((self.twice, own[old | (n > 1)]), (self.once, own)):
            for at in sketch.bloom_places(some, self.bits):
                np.bitwise_or.at(filled, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def rows(self, salt: int) -> list[tuple[int, int, bytes]]:
        return sketch.chunk_rows(np.stack([self.once.reshape(sketch.CHUNKS, -1), self.twice.reshape(sketch.CHUNKS, -1)], axis=1).reshape(-1), salt)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two tasks' chunks, each of once-bits and twice-bits."""
    (once, twice), (other, again) = a.reshape(2, -1), b.reshape(2, -1)
    return np.concatenate([once | other, twice | again | (once & other)])


def seen_twice(texts: DataFrame, min_chars: int) -> np.ndarray:
    """Packed bits of the second filter over a one-column table of texts."""
    n = texts.agg(F.sum(1 + F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))))).first()[0] or 0
    low, high = FILTER_BITS
    bits = min(high, max(low, (8 * n).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, salt = SeenTwice(bits), [], secrets.randbits(31)
        for b in batches:
            for text in textcodes.binary(b.column("text")):
                held += [xxhash.xxh3_64_intdigest(k) for k in document_keys(text, min_chars)]
                if len(held) >= 1 << 18:
                    seen.add(np.array(held, dtype=np.uint64))
                    held = []
        if held:
            seen.add(np.array(held, dtype=np.uint64))
        if seen.once.any():
            rows = seen.rows(salt)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "salt", "blob"])

    both = sketch.combine(texts.mapInArrow(build, "chunk int, salt int, blob binary"), "uint8", merge)
    return both.reshape(sketch.CHUNKS, 2, -1)[:, 1].reshape(-1) if len(both) else both


def _store(rows: DataFrame, base: str, twice, min_chars: int) -> DataFrame:
    """Write blocks; (block, hi, lo, docs, first, row) for each suspected key of a block, and one row without key for each block."""
    order = ddl(rows.schema["order"].dataType)
    names = ["block", "hi", "lo", "docs", "first", "row"]

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ident = secrets.randbits(62)
        f = io.BytesIO()
        with pa.ipc.new_stream(f, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for b in held:
                w.write_batch(b)
        put_file(base, f"{ident:x}", f.getvalue())
        table = pa.Table.from_batches(held)
        rank = table.column("order").combine_chunks()
        # rows by their order, so that the first one seen is the first of the block
        place = pc.sort_indices(pa.table({"o": rank}), sort_keys=[("o", "ascending")]).to_pylist()
        texts = [t for b in held for t in textcodes.binary(b.column("text"))]
        own = [(i, k) for i in place for k in document_keys(texts[i], min_chars)]
        maybe = sketch.in_bloom(twice.value, np.fromiter((xxhash.xxh3_64_intdigest(k) for _, k in own), dtype=np.uint64, count=len(own)).view(np.int64))
        count: dict[bytes, int] = {}
        first: dict[bytes, int] = {}
        for x in np.flatnonzero(maybe).tolist():
            i, key = own[x]
            name = xxhash.xxh3_128_digest(key)
            count[name] = count.get(name, 0) + 1
            first.setdefault(name, i)
        code = np.frombuffer(b"".join(count), dtype=">i8").astype(np.int64).reshape(-1, 2)
        at = np.fromiter(first.values(), dtype=np.int32, count=len(first))
        own_block = pa.array(np.full(len(code) + 1, ident))
        one = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([
            own_block, pa.concat_arrays([one, pa.array(code[:, 0])]), pa.concat_arrays([one, pa.array(code[:, 1])]),
            pa.concat_arrays([one, pa.array(list(count.values()), pa.int64())]), pa.concat_arrays([pa.nulls(1, rank.type), rank.take(pa.array(at))]), pa.concat_arrays([pa.nulls(1, pa.int32()), pa.array(at)]),
        ], names=names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            length = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy())])
            start = 0
            while start < b.num_rows:
                end = max(start + 1, int(np.searchsorted(length, length[start] + BLOCK_BYTES - size, side="right")) - 1)
                held.append(b.slice(start, end - start))
                size += int(length[end] - length[start])
                if size >= BLOCK_BYTES or end < b.num_rows:
                    yield flush(held)
                    held, size = [], 0
                start = end
        if held:
            yield flush(held)

    return rows.mapInArrow(apply, f"block long, hi long, lo long, docs long, first {order}, row int")


def _rewrite(answers: DataFrame, base: str, doc_type: str, min_chars: int, with_text: bool) -> DataFrame:
    """answers(block, drop: hi, lo, row that keeps the line or null) -> the blocks' documents without these lines."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, drop in zip(b.column("block").to_pylist(), b.column("drop").to_pylist()):
                # the row (-1: none) in which the first line of this name stays
                stays = {(d["hi"].to_bytes(8, "big", signed=True) + d["lo"].to_bytes(8, "big", signed=True)): -1 if d["row"] is None else d["row"] for d in drop or ()}
                row = 0
                for stored in pa.ipc.open_stream(get_file(base, f"{block:x}")):
                    total, dropped, shas, kept = [], [], [], []
                    for text in textcodes.binary(stored.column("text")):
                        rest, n, gone = without_lines(text, stays, row, min_chars)
                        total.append(n)
                        dropped.append(gone)
                        shas.append(hashlib.sha256(rest).hexdigest())
                        if with_text:
                            kept.append(rest)
                        row += 1
                    cols = [stored.column("doc"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas, pa.string())]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.binary())] if with_text else cols, names=["doc", "n_lines", "n_dropped", "kept_sha256", "kept"][: 5 if with_text else 4])

    return answers.mapInArrow(apply, f"doc {doc_type}, n_lines long, n_dropped long, kept_sha256 string" + (", kept binary" if with_text else ""))


def drop_shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, text_col: str = "text", order_col: str = "doc_id", keep: list[str] | None = None, keep_first: bool = False, with_text: bool = False) -> DataFrame:
    """doc (struct of the columns ``keep``), n_lines, n_dropped, kept_sha256 [, kept bytes] for every row."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 at least")
    spark = docs.sparkSession
    ensure_importable(spark)
    keep = list(docs.columns) if keep is None else keep
    text = F.col(f"`{text_col}`").alias("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), text, F.col(f"`{order_col}`").alias("order"))
    base = fresh_path(spark, "lines")
    twice = spark.sparkContext.broadcast(seen_twice(docs.select(text), min_chars))
    found = materialize(_store(rows, base, twice, min_chars), "suspected")
    named = found.filter("hi IS NOT NULL")
    first = [F.min(F.struct(F.col("first").isNull().alias("no"), "first", "block", "row")).alias("first")] if keep_first else []
    shared = named.groupBy("hi", "lo").agg(F.sum("docs").alias("n"), *first).filter(F.col("n") >= min_docs)
    stays = F.when(F.col("first.block") == F.col("block"), F.col("first.row")) if keep_first else F.lit(None).cast("int")
    back = named.select("block", "hi", "lo").join(shared.drop("n"), ["hi", "lo"])
    # at most a block's distinct lines
    drop = back.groupBy("block").agg(F.collect_list(F.struct("hi", "lo", stays.alias("row"))).alias("drop"))
    blocks = found.filter("hi IS NULL").select("block")
    return _rewrite(by_block(blocks.join(drop, "block", "left"), blocks), base, ddl(rows.schema["doc"].dataType), min_chars, with_text)


def line_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    out = drop_shared_lines(docs, order_col=id_col, keep=[id_col], **options)
    return out.select(F.col(f"doc.`{id_col}`").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), split AS (
  SELECT n, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM docs
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split
), shared AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT n) >= 10
), marked AS (
  SELECT keyed.*, shared.key IS NOT NULL AS goes FROM keyed LEFT JOIN shared ON keyed.key = shared.key
), kept AS (
  SELECT n, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT goes), '') AS text FROM marked GROUP BY n
)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM docs JOIN kept USING (n)
"""

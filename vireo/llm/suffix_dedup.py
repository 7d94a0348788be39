"""Removal of long repeated byte strings by prefix-free parsing.

A rolling hash over half-length strings triggers phrase starts: a start is the least hash of some window of
``length`` bytes, so every window holds a trigger, and equal windows hold it at the same place. Parsing cuts
each text into phrases at the triggers, a phrase reaching as far as the windows that start in it, so that it
overlaps the next one and no phrase is a prefix of another's windows. The dictionary holds each distinct phrase
once; the parse lists where they occur. Both are sorted, and their orders combine to that of the corpus, in which
equal strings are neighbours:

* parse: its occurrences are sorted by phrase. As a window never leaves its phrase, suffixes of the parse are told
  apart by their first symbol, so this is their whole order here. A phrase that occurs twice repeats every window in
  it; no byte of it is looked at again;
* dictionary: distinct phrases of one trigger may share windows at their ends. Those that also share one of
  five shorter strings inside (a necessary condition) are fetched, and the suffix array of their bytes is built by
  prefix doubling, to the depth of ``length`` bytes. Windows of equal rank are equal byte by byte: repeats.

Phrases are told apart by 128 bits (a rolling hash of the trigger and one of another kind over all bytes).

Texts are stored in blocks in the shared folder; phrases are dealt to buckets by trigger as arrays, each distinct one
once for each block, and answers return to the blocks. Copies in a block are one text of that weight. Where there are
many blocks, groups of them are combined first, so that a phrase of all blocks comes once for each group.
A trigger with very many phrases isn't gathered: its windows are dealt out instead, named by 128 bits.

On request, passages of some words that stand in another document go too (see :mod:`.passages`): their anchors and windows
are dealt to buckets as phrases are, and return to the same blocks.

Defined cases: null and empty texts have 0 bytes and keep nothing (the hash of no bytes); texts shorter than
``length`` lose nothing; very long texts are parsed in overlapping tiles and held whole by the task that stores them;
repeated rows are occurrences like others, so long ones are removed wholly; among equal strings none is preferred, all
go; an empty table gives no rows; ids may be null or repeated; extra columns are not read or passed through untouched.
"""

from __future__ import annotations

import hashlib
import io
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages, textcodes
from .common import by_block, ddl, ensure_importable, fresh_path, get_file, materialize, n_partitions, put_file

LENGTH = 400
BLOCK_BYTES = 8 << 20
BUCKET = 250_000  # phrases aimed at for a bucket
FAN = 1024  # blocks whose phrases are combined before they meet those of others
STEP = 50  # distance of the inner strings
#: A trigger with more distinct phrases has its windows dealt out one by one.
HOT = 20_000
U = np.uint64


def phrases(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first window, last window, codes) of a tile of texts that end at ``ends``."""
    half = length // 2
    codes = textcodes.prefix_codes(data)
    n = len(data)
    if n < length:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, codes
    at = np.arange(n - half + 1)
    with np.errstate(over="ignore"):
        key = textcodes.span_hashes(codes, at, at + half)
    key = (key & ~U((1 << 22) - 1)) | at.astype(U)
    span, width = length - half + 1, 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if span > width:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    trigger = (key & U((1 << 22) - 1)).astype(np.int64)
    trigger = trigger[: n - length + 1]
    valid = np.ones(len(trigger), dtype=bool)
    starts = np.concatenate([[0], ends[:-1]])
    for a, b in zip(np.maximum(ends - length + 1, starts).tolist(), ends.tolist()):
        valid[a:b] = False
    window = np.flatnonzero(valid)
    if not len(window):
        none = np.empty(0, dtype=np.int64)
        return none, none, none, codes
    trigger = trigger[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    return trigger[first], window[first], window[last], codes


def _describe(data: bytes, codes: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger hash, phrase hash, hashes of inner strings, 0 where the phrase has none) of phrases."""
    half = length // 2
    a = textcodes.span_hashes(codes, p, p + half)
    c = np.fromiter((xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(lo.tolist(), (hi + length).tolist())), dtype=U, count=len(p))
    with np.errstate(over="ignore"):
        c = textcodes.mix(c + textcodes.mix((p - lo).astype(U)))
    inner = np.zeros((half // STEP + 1, len(p)), dtype=np.uint32)
    for j in range(len(inner)):
        # windows that start in (p - STEP * (j + 1), p - STEP * j]
        has = (lo <= p - STEP * j) & (hi > p - STEP * (j + 1))
        s = p[has] - STEP * j
        e = s + length - STEP
        inner[j, has] = ((textcodes.span_hashes(codes, s, e) >> U(32)).astype(np.uint32) | np.uint32(1))
    return a, c, inner


class _Block:
    """Distinct texts with weights, and their phrases."""

    def __init__(self, length: int):
        self.length, self.texts, self.number, self.weight, self.size, self.rows = length, [], {}, [], 0, []

    def add(self, text: bytes) -> None:
        k = self.number.get(text)
        if k is None:
            k = self.number[text] = len(self.texts)
            self.texts.append(text)
            self.weight.append(0)
            self.size += len(text)
        self.weight[k] += 1
        self.rows.append(k)

    def _tiles(self) -> Iterator[tuple[bytes, np.ndarray, int]]:
        """(bytes, ends of texts in them, offset in the block); long texts overlap by a window less a byte."""
        held, size, at = [], 0, 0
        for t in self.texts:
            if held and size + len(t) > textcodes.TILE:
                yield b"".join(held), np.cumsum([len(x) for x in held]), at
                at, held, size = at + size, [], 0
            if len(t) > textcodes.TILE:
                for s in range(0, len(t) - self.length + 1, textcodes.TILE - self.length + 1):
                    piece = t[s : s + textcodes.TILE]
                    yield piece, np.array([len(piece)]), at + s
                at += len(t)
            else:
                held.append(t)
                size += len(t)
        if held:
            yield b"".join(held), np.cumsum([len(x) for x in held]), at

    def parse(self) -> dict[str, np.ndarray]:
        """The phrases; ``first`` is the number of the first equal one, which has the weight of all of them."""
        ends = np.cumsum([len(t) for t in self.texts])
        out: dict[str, list[np.ndarray]] = {k: [] for k in ("p", "lo", "hi", "a", "c", "inner")}
        for data, tile_ends, at in self._tiles():
            p, lo, hi, codes = phrases(np.frombuffer(data, dtype=np.uint8), tile_ends, self.length)
            a, c, inner = _describe(data, codes, p, lo, hi, self.length)
            for k, v in zip(out, (p + at, lo + at, hi + at, a, c, inner)):
                out[k].append(v)
        got = {k: np.concatenate(v, axis=-1) if v else np.empty(0, dtype=np.int64) for k, v in out.items()}
        got["first"], got["weight"] = np.arange(len(got["p"])), np.zeros(len(got["p"]), dtype=np.uint8)
        if len(got["p"]):
            weight = np.array(self.weight)[np.searchsorted(ends, got["p"], side="right")]
            order = np.lexsort((got["c"], got["a"]))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (got["a"][order[1:]] != got["a"][order[:-1]]) | (got["c"][order[1:]] != got["c"][order[:-1]])
            first = order[np.flatnonzero(new)]
            got["first"][order] = first[np.cumsum(new) - 1]
            got["weight"][first] = np.minimum(np.bincount(np.cumsum(new) - 1, weights=weight[order]), 2)
        return got

    def anchors(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors of windows of so many words, and in how many documents they stand."""
        data, ends = np.frombuffer(b"".join(self.texts), dtype=np.uint8), np.cumsum([len(t) for t in self.texts])
        found = []
        for anchor, _, _, text, _, _ in passages.windows(data, ends, words):
            new = np.ones(len(anchor), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            found.append((anchor[new], text[new]))
        anchor, text = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, dtype=U), np.empty(0, dtype=np.int64))
        return passages.weighed(text, np.array(self.weight), anchor)

    def save(self, base: str, name: str, got: dict[str, np.ndarray]) -> None:
        f = io.BytesIO()
        np.savez(f, data=np.frombuffer(b"".join(self.texts), dtype=np.uint8), ends=np.cumsum([len(t) for t in self.texts]), weights=np.minimum(self.weight, 2), **{k: got[k].astype(np.int32) for k in ("p", "lo", "hi", "first")})
        put_file(base, name, zstandard.compress(f.getvalue(), 3))


def _load(base: str, block: int) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(zstandard.decompress(get_file(base, f"{block:x}")))) as f:
        return {k: f[k] if k == "data" else f[k].astype(np.int64) for k in f.files}


PHRASES = "bucket int, a binary, c binary, inner binary, weight binary, at binary"


def _parse(rows: DataFrame, base: str, buckets: int, length: int, words: int | None = None) -> DataFrame:
    """Store blocks; kind 0: (block, number of text, doc) for each row, kind 1: a block's phrases in a bucket, kind 2: its anchors there."""
    doc_type = ddl(rows.schema["doc"].dataType)
    names = ["kind", "block", "number", "doc", "bucket", "a", "c", "inner", "weight", "at"]

    def flush(block: _Block, docs: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        ident = secrets.randbits(62)
        got = block.parse()
        block.save(base, f"{ident:x}", got)
        doc = pa.concat_arrays(docs)
        k = len(doc)
        none = pa.nulls(k, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), pa.array([ident] * k, pa.int64()), pa.array(block.rows, pa.int32()), doc, pa.nulls(k, pa.int32()), none, none, none, none, none], names=names)
        if words:
            anchor, weight = block.anchors(words)
            dealt = list(_groups((anchor % U(buckets)).astype(np.int64)))
            k, none = len(dealt), pa.nulls(len(dealt), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([2] * k, pa.int32()), pa.array([ident] * k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, doc.type), pa.array([b for b, _ in dealt], pa.int32()), pa.array([anchor[x].tobytes() for _, x in dealt], pa.binary()), none, none, pa.array([weight[x].tobytes() for _, x in dealt], pa.binary()), none], names=names)
        if not len(got["p"]):
            return
        dealt = np.flatnonzero(got["weight"])
        bucket = (got["a"][dealt] % U(buckets)).astype(np.int64)
        cols: dict[str, list] = {c: [] for c in ("bucket", "a", "c", "inner", "weight", "at")}
        for b, pick in _groups(bucket):
            pick = dealt[pick]
            cols["bucket"].append(b)
            for c in ("a", "c", "weight"):
                cols[c].append(got[c][pick].tobytes())
            cols["inner"].append(np.ascontiguousarray(got["inner"][:, pick]).tobytes())
            cols["at"].append(pick.astype(np.uint32).tobytes())
        k = len(cols["bucket"])
        yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.array([ident] * k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, doc.type), pa.array(cols["bucket"], pa.int32()), *(pa.array(cols[c], pa.binary()) for c in ("a", "c", "inner", "weight", "at"))], names=names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, docs = _Block(length), []
        for b in batches:
            start = 0
            for i, text in enumerate(textcodes.binary(b.column("text"))):
                block.add(text)
                if block.size >= BLOCK_BYTES:
                    docs.append(b.column("doc").slice(start, i + 1 - start))
                    yield from flush(block, docs)
                    block, docs, start = _Block(length), [], i + 1
            if start < b.num_rows:
                docs.append(b.column("doc").slice(start))
        if docs:
            yield from flush(block, docs)

    return rows.mapInArrow(apply, f"kind int, block long, number int, doc {doc_type}, bucket int, a binary, c binary, inner binary, weight binary, at binary")


def _join(column) -> bytes:
    return b"".join(x for x in column.to_pylist() if x)


def _by_block(block: np.ndarray, **arrays: np.ndarray) -> pa.Table:
    """One row for each block, arrays as bytes."""
    order = np.argsort(block, kind="stable")
    own, first = np.unique(block[order], return_index=True)
    edges = np.append(first, len(order))
    cols = {"block": pa.array(own, pa.int64())}
    for k, v in arrays.items():
        v = v[order]
        cols[k] = pa.array([v[edges[i] : edges[i + 1]].tobytes() for i in range(len(own))], pa.binary())
    return pa.table(cols)


def _groups(number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places of it) for the values that occur."""
    order = np.argsort(number, kind="stable")
    own, first = np.unique(number[order], return_index=True)
    for x, pick in zip(own.tolist(), np.split(order, first[1:])):
        yield x, pick


class _Parse:
    """Some blocks' phrases of a bucket, sorted: their order, each distinct phrase's first place in it, and its weight."""

    def __init__(self, table: pa.Table, inner_rows: int):
        join = lambda c, t: np.frombuffer(_join(table.column(c)), dtype=t)
        self.a, self.c, weight, self.at = join("a", U), join("c", U), join("weight", np.uint8), join("at", np.uint32)
        self.block = np.repeat(table.column("block").to_numpy(), [len(x) // 8 for x in table.column("a").to_pylist()])
        self.inner = np.concatenate([np.frombuffer(x, dtype=np.uint32).reshape(inner_rows, -1) for x in table.column("inner").to_pylist()], axis=1)
        self.order = np.lexsort((self.at, self.block, self.c, self.a))
        a, c = self.a[self.order], self.c[self.order]
        self.new_a = np.concatenate([[True], a[1:] != a[:-1]])
        new = self.new_a | np.concatenate([[True], c[1:] != c[:-1]])
        self.phrase, self.first = np.cumsum(new) - 1, np.flatnonzero(new)
        self.weight = np.minimum(np.bincount(self.phrase, weights=weight[self.order]), 2).astype(np.uint8)

    def spread(self, status: np.ndarray) -> pa.Table:
        """All occurrences learn that they repeat; one of each distinct phrase gets its whole status."""
        each = status[self.phrase] & 1
        each[self.first] = status
        keep = np.flatnonzero(each)
        at = self.order[keep]
        return _by_block(self.block[at], at=self.at[at], status=each[keep])


def _combine(table: pa.Table, inner_rows: int) -> pa.Table:
    """The distinct phrases of a group of blocks, as those of one block that has the group's number."""
    p = _Parse(table, inner_rows)
    pick = p.order[p.first]
    one = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "block": pa.array([table.column("salt")[0].as_py()], pa.int64()), "a": one(p.a[pick]), "c": one(p.c[pick]), "inner": one(p.inner[:, pick]), "weight": one(p.weight), "at": one(np.arange(len(pick), dtype=np.uint32))})


def _return(table: pa.Table, hits: pa.Table, inner_rows: int) -> pa.Table:
    """The statuses of a group's distinct phrases, for its blocks."""
    p = _Parse(table, inner_rows)
    status = np.zeros(len(p.first), dtype=np.uint8)
    status[np.frombuffer(_join(hits.column("at")), dtype=np.uint32)] = np.frombuffer(_join(hits.column("status")), dtype=np.uint8)
    return p.spread(status)


def _with_bucket(table: pa.Table, answers: pa.Table) -> pa.Table:
    return answers.add_column(0, "bucket", pa.repeat(table.column("bucket")[0], len(answers)))


def _match_parse(table: pa.Table, inner_rows: int) -> pa.Table:
    """For a bucket's phrases: those that occur twice (1), those whose bytes are needed (2), in a hot trigger (4)."""
    p = _Parse(table, inner_rows)
    first = p.first
    status = (p.weight >= 2).astype(np.uint8)
    trigger = (np.cumsum(p.new_a) - 1)[first]
    distinct = np.bincount(trigger)[trigger]
    some = np.flatnonzero(distinct >= 2)
    needed = np.zeros(len(first), dtype=bool)
    for row in p.inner:
        x = row[p.order[first[some]]]
        with np.errstate(over="ignore"):
            key = textcodes.mix(trigger[some].astype(U) * U(0x9E3779B97F4A7C15) + x.astype(U))
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        needed[some[(n[back] >= 2) & (x != 0)]] = True
    status[needed] |= 2
    status[needed & (distinct > HOT)] |= 4
    return p.spread(status)


def _window_keys(codes: np.ndarray, data: np.ndarray, a: np.ndarray, start: np.ndarray, p: np.ndarray, length: int) -> np.ndarray:
    """128-bit names of windows: trigger, place of the trigger in the window, bytes."""
    raw, low = data.tobytes(), int(start[0])
    with np.errstate(over="ignore"):
        rolling = textcodes.mix(textcodes.span_hashes(codes, start, start + length) + textcodes.mix(a + (p - start).astype(U)))
    other = np.fromiter((xxhash.xxh3_64_intdigest(raw[s : s + length]) for s in range(low, low + len(start))), dtype=U, count=len(start))
    return np.stack([rolling, other], axis=1)


def window_ranks(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Ranks of data[i : i + length] for the places ``at``: the suffix array of ``data`` to that depth, by prefix doubling."""
    padded = np.concatenate([data, np.zeros(length + 8, dtype=np.uint8)])
    step = min(8, length)
    rank = np.zeros(len(data), dtype=U)
    for i in range(step):
        rank = (rank << U(8)) | padded[i : i + len(data)]
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint32)
    while 2 * step <= length:  # ranks to the depth of step bytes -> of twice as many
        key = rank.astype(U) << U(32)
        key[:-step] |= rank[step:]
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint32)
        step *= 2
    key = rank[at].astype(U) << U(32) | rank[at + length - step]  # two that overlap
    return np.unique(key, return_inverse=True)[1]


def _again(*keys: np.ndarray) -> np.ndarray:
    """Which entries are equal to another one in all keys."""
    order = np.lexsort(keys)
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    again = np.zeros(len(order), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) for all values of inclusive ranges."""
    n = hi - lo + 1
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]


SENT = "bucket int, block long, hot boolean, at binary, lo binary, hi binary, bytes binary, size binary, keys binary"


def _send(rows: pa.Table, base: str, buckets: int, length: int) -> pa.Table:
    """A block's phrases whose bytes are needed: bytes by the trigger's bucket, or window names by their own."""
    block = rows.column("block")[0].as_py()
    at = np.frombuffer(_join(rows.column("at")), dtype=np.uint32).astype(np.int64)
    status = np.frombuffer(_join(rows.column("status")), dtype=np.uint8)
    out: dict[str, list] = {k.split()[0]: [] for k in SENT.split(", ")}
    need = at[(status & 2) > 0]
    hot = ((status & 4) > 0)[(status & 2) > 0]
    if len(need):
        b = _load(base, block)
        data, half = b["data"], length // 2
        p, lo, hi = (b[k][need] for k in ("p", "lo", "hi"))
        # the bytes of the needed phrases, one behind the other
        which, src = _expand(lo, hi + length - 1)
        size = hi + length - lo
        shift = np.cumsum(size) - size - lo
        flat = data[src]
        own = p + shift
        a = np.zeros(len(need), dtype=U)
        for s in range(0, len(need), 2000):  # in parts that fit a tile
            e = min(s + 2000, len(need))
            base_at = int(lo[s] + shift[s])
            part = flat[base_at : int(hi[e - 1] + length + shift[e - 1])]
            codes = textcodes.prefix_codes(part)
            q = own[s:e] - base_at
            a[s:e] = textcodes.span_hashes(codes, q, q + half)
            for i in np.flatnonzero(hot[s:e]):
                l, h = int(lo[s + i] + shift[s + i] - base_at), int(hi[s + i] + shift[s + i] - base_at)
                start = np.arange(l, h + 1)
                keys = _window_keys(codes, part, np.full(len(start), a[s + i]), start, np.full(len(start), q[i]), length)
                for x, pick in _groups((keys[:, 0] % U(buckets)).astype(np.int64)):
                    for c, v in (("bucket", x), ("block", block), ("hot", True), ("at", np.full(len(pick), need[s + i], dtype=np.uint32).tobytes()), ("lo", (p[s + i] - lo[s + i] - pick).astype(np.int32).tobytes()), ("hi", b""), ("bytes", b""), ("size", b""), ("keys", keys[pick].tobytes())):
                        out[c].append(v)
        bucket = (a % U(buckets)).astype(np.int64)
        ends = np.cumsum(size)
        for x in np.unique(bucket[~hot]):
            pick = np.flatnonzero((bucket == x) & ~hot)
            text = b"".join(flat[ends[i] - size[i] : ends[i]].tobytes() for i in pick)
            for c, v in (("bucket", int(x)), ("block", block), ("hot", False), ("at", need[pick].astype(np.uint32).tobytes()), ("lo", (p - lo)[pick].astype(np.int32).tobytes()), ("hi", (p - hi)[pick].astype(np.int32).tobytes()), ("bytes", zstandard.compress(text, 1)), ("size", size[pick].astype(np.int32).tobytes()), ("keys", b"")):
                out[c].append(v)
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.table({k: pa.array(out[k], types[t]) for k, t in (x.split() for x in SENT.split(", "))})


def _match_dictionary(table: pa.Table, length: int) -> pa.Table:
    """Windows of a bucket's phrases that occur twice, as (phrase, distances of the trigger from, to)."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = table.to_pylist()
    hot = [r for r in rows if r["hot"]]
    if hot:
        key = np.concatenate([np.frombuffer(r["keys"], dtype=U) for r in hot]).reshape(-1, 2)
        again = _again(key[:, 1], key[:, 0])
        n = [len(r["at"]) // 4 for r in hot]
        found.append((np.repeat([r["block"] for r in hot], n)[again], np.frombuffer(b"".join(r["at"] for r in hot), dtype=np.uint32)[again], np.frombuffer(b"".join(r["lo"] for r in hot), dtype=np.int32)[again]))
    rows = [r for r in rows if not r["hot"]]
    if rows:
        data = np.frombuffer(b"".join(zstandard.decompress(r["bytes"]) for r in rows), dtype=np.uint8)
        n = [len(r["at"]) // 4 for r in rows]
        block, at = np.repeat([r["block"] for r in rows], n), np.frombuffer(b"".join(r["at"] for r in rows), dtype=np.uint32)
        far, near, size = (np.frombuffer(b"".join(r[k] for r in rows), dtype=np.int32).astype(np.int64) for k in ("lo", "hi", "size"))
        begin = np.cumsum(size) - size
        which, start = _expand(begin, begin + far - near)
        again = _again(window_ranks(data, start, length))
        which, start = which[again], start[again]
        found.append((block[which], at[which], (begin[which] + far[which] - start).astype(np.int32)))
    block, at, d = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((d, at, block))
    block, at, d = block[order], at[order], d[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (block[1:] != block[:-1]) | (at[1:] != at[:-1]) | (d[1:] != d[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1 if len(d) else first
    return _by_block(block[first], at=at[first], lo=d[last], hi=d[first])


def _match_anchors(table: pa.Table) -> pa.Table:
    """A bucket's anchors that stand in two documents, for each block."""
    each = table.column("a").to_pylist()
    a, weight = np.frombuffer(b"".join(each), dtype=U), np.frombuffer(_join(table.column("weight")), dtype=np.uint8)
    block = np.repeat(table.column("block").to_numpy(), [len(x) // 8 for x in each])
    some = passages.shared(block, weight, a)
    return _by_block(block[some], a=a[some])


def _send_windows(table: pa.Table, base: str, buckets: int, words: int) -> pa.Table:
    """A block's distinct windows with such an anchor, and in how many documents they stand, by their own bucket."""
    block = table.column("block")[0].as_py()
    wanted = np.sort(np.frombuffer(_join(table.column("a")), dtype=U))
    b = _load(base, block)
    found = []
    for anchor, one, other, text, _, _ in passages.windows(b["data"], b["ends"], words):
        some = wanted[np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)] == anchor
        found.append((text[some], one[some], other[some]))
    text, one, other = (np.concatenate(x) for x in zip(*found))
    one, other, weight = passages.weighed(text, b["weights"], one, other)
    dealt = list(_groups((one % U(buckets)).astype(np.int64)))
    keys = np.stack([one, other], axis=1)
    return pa.table({"bucket": pa.array([x for x, _ in dealt], pa.int32()), "block": pa.array([block] * len(dealt), pa.int64()), "keys": pa.array([keys[x].tobytes() for _, x in dealt], pa.binary()), "weight": pa.array([weight[x].tobytes() for _, x in dealt], pa.binary())})


def _match_windows(table: pa.Table) -> pa.Table:
    """A bucket's windows that stand in two documents, for each block."""
    each = table.column("keys").to_pylist()
    keys, weight = np.frombuffer(b"".join(each), dtype=U).reshape(-1, 2), np.frombuffer(_join(table.column("weight")), dtype=np.uint8)
    block = np.repeat(table.column("block").to_numpy(), [len(x) // 16 for x in each])
    some = passages.shared(block, weight, keys[:, 1], keys[:, 0])
    return _by_block(block[some], keys=keys[some])


def _cut(table: pa.Table, base: str, length: int, with_text: bool, words: int | None = None) -> pa.Table:
    """What is left of a block's texts, for each row."""
    block = table.column("block")[0].as_py()
    b = _load(base, block)
    data, ends = b["data"], b["ends"]
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    kinds = table.column("kind").to_numpy()
    answers = table.filter(pa.array(kinds == 1))
    at = np.frombuffer(_join(answers.column("at")), dtype=np.uint32).astype(np.int64)
    status = np.frombuffer(_join(answers.column("status")), dtype=np.uint8)
    repeats = np.zeros(len(b["p"]), dtype=bool)
    repeats[at[(status & 1) > 0]] = True
    at = np.flatnonzero(repeats[b["first"]])
    np.add.at(edge, b["lo"][at], 1)
    np.add.at(edge, b["hi"][at] + length, -1)
    answers = table.filter(pa.array(kinds == 2))
    at = np.frombuffer(_join(answers.column("at")), dtype=np.uint32).astype(np.int64)
    far, near = (np.frombuffer(_join(answers.column(k)), dtype=np.int32) for k in ("lo", "hi"))
    np.add.at(edge, b["p"][at] - far, 1)
    np.add.at(edge, b["p"][at] - near + length, -1)
    keys = np.frombuffer(_join(table.filter(pa.array(kinds == 3)).column("at")), dtype=U).reshape(-1, 2)
    if len(keys):
        keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
        for _, one, other, _, start, end in passages.windows(data, ends, words):
            at = np.minimum(np.searchsorted(keys[:, 0], one), len(keys) - 1)
            same = (keys[at, 0] == one) & (keys[at, 1] == other)
            np.add.at(edge, start[same], 1)
            np.add.at(edge, end[same], -1)
    np.cumsum(edge, out=edge)
    gone = edge[:-1] > 0
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)

    def per_text(flags: np.ndarray) -> np.ndarray:
        edge[0] = 0
        np.cumsum(flags, out=edge[1:])
        return (edge[ends] - edge[starts]).astype(np.int64)

    removed = per_text(gone)
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    begin[starts[(starts < len(gone))]] |= gone[starts[(starts < len(gone))]]
    spans = per_text(begin)
    texts, shas = [], []
    for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        kept = (data[s:e][~gone[s:e]] if removed[k] else data[s:e]).tobytes()
        shas.append(hashlib.sha256(kept).hexdigest())
        if with_text:
            texts.append(kept)
    rows = table.filter(pa.array(kinds == 0))
    n = rows.column("number").to_numpy()
    cols = {"doc": rows.column("doc"), "n_bytes": pa.array((ends - starts)[n]), "n_removed": pa.array(removed[n]), "n_spans": pa.array(spans[n]), "kept_sha256": pa.array(shas, pa.string()).take(pa.array(n))}
    if with_text:
        cols["kept"] = pa.array(texts, pa.binary()).take(pa.array(n))
    return pa.table(cols)


def remove_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", keep: list[str] | None = None, with_text: bool = False, words: int | None = None) -> DataFrame:
    """doc (struct of the columns ``keep``), n_bytes, n_removed, n_spans, kept_sha256 [, kept bytes] for every row.

    With ``words``, passages of so many words that stand in another document too go as well, however short their bytes are.
    """
    if length < 2 * STEP:
        raise ValueError(f"length must be {2 * STEP} at least")
    spark = docs.sparkSession
    ensure_importable(spark)
    keep = list(docs.columns) if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    doc_type = ddl(rows.schema["doc"].dataType)
    base = fresh_path(spark, "blocks")
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    per_phrase = (length - length // 2) // 2
    buckets = max(n_partitions(spark), size // per_phrase // BUCKET)
    parsed = materialize(_parse(rows, base, buckets, length, words), "parsed", partition_by="kind")
    inner_rows = length // 2 // STEP + 1
    dealt = parsed.filter("kind = 1").select("bucket", "block", "a", "c", "inner", "weight", "at")
    groups = -(-parsed.filter("kind = 0").select("block").distinct().count() // FAN)
    match, answer = (lambda t: _match_parse(t, inner_rows)), "block long, at binary, status binary"
    if groups <= 1:
        hits = dealt.groupBy("bucket").applyInArrow(match, answer)
    else:
        dealt = dealt.withColumn("salt", F.pmod("block", F.lit(groups)))
        combined = materialize(dealt.groupBy("bucket", "salt").applyInArrow(lambda t: _combine(t, inner_rows), "bucket int, block long, a binary, c binary, inner binary, weight binary, at binary"), "group-phrases")
        of_groups = combined.groupBy("bucket").applyInArrow(lambda t: _with_bucket(t, match(t)), f"bucket int, {answer}")
        hits = dealt.groupBy("bucket", "salt").cogroup(of_groups.withColumnRenamed("block", "salt").groupBy("bucket", "salt")).applyInArrow(lambda t, h: _return(t, h, inner_rows), answer)
    hits = materialize(hits, "phrase-hits")
    sent = by_block(hits, hits).groupBy("block").applyInArrow(lambda t: _send(t, base, buckets, length), SENT)
    shared = sent.groupBy("bucket").applyInArrow(lambda t: _match_dictionary(t, length), "block long, at binary, lo binary, hi binary")
    none = F.lit(None).cast("binary")
    every = (
        parsed.filter("kind = 0").select("block", "kind", "number", "doc", none.alias("at"), none.alias("status"), none.alias("lo"), none.alias("hi"))
        .unionByName(hits.select("block", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("number"), F.lit(None).cast(doc_type).alias("doc"), "at", "status", none.alias("lo"), none.alias("hi")))
        .unionByName(shared.select("block", F.lit(2).alias("kind"), F.lit(None).cast("int").alias("number"), F.lit(None).cast(doc_type).alias("doc"), "at", none.alias("status"), "lo", "hi"))
    )
    if words:
        anchors = parsed.filter("kind = 2").select("bucket", "block", "a", "weight").groupBy("bucket").applyInArrow(_match_anchors, "block long, a binary")
        windows = by_block(anchors, parsed.filter("kind = 0")).groupBy("block").applyInArrow(lambda t: _send_windows(t, base, buckets, words), "bucket int, block long, keys binary, weight binary")
        same = windows.groupBy("bucket").applyInArrow(_match_windows, "block long, keys binary")
        every = every.unionByName(same.select("block", F.lit(3).alias("kind"), F.lit(None).cast("int").alias("number"), F.lit(None).cast(doc_type).alias("doc"), F.col("keys").alias("at"), none.alias("status"), none.alias("lo"), none.alias("hi")))
    schema = f"doc {doc_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return by_block(every, parsed.filter("kind = 0")).groupBy("block").applyInArrow(lambda t: _cut(t, base, length, with_text, words), schema)


def repeat_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    out = remove_repeats(docs, keep=[id_col], **options)
    return out.select(F.col(f"doc.`{id_col}`").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The same by the hash of every 400-byte string (in chunks of 64 starts, as SQL finds a place in a long text by walking to it).
SQL = """
WITH hexed AS (
  SELECT row_number() OVER () AS n, doc_id, CASE WHEN text IS NULL THEN '' ELSE hex(encode(text)) END AS h FROM documents
), chunks AS (
  SELECT n, j, substr(h, 2 * j + 1, 926) AS h FROM (SELECT n, h, unnest(range(0, len(h) // 2 - 399, 64)) AS j FROM hexed)
), starts AS (
  SELECT n, j + i AS i, md5_number(substr(h, 2 * i + 1, 800)) AS code FROM (SELECT n, j, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM chunks)
), repeated AS (
  SELECT n, i FROM starts WHERE code IN (SELECT code FROM starts GROUP BY code HAVING count(*) > 1)
), edges AS (
  SELECT n, i, coalesce(i > max(i) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 400, true) AS opens FROM repeated
), runs AS (
  SELECT n, min(i) AS a, max(i) + 400 AS b FROM (SELECT n, i, sum(opens::INT) OVER (PARTITION BY n ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM edges) GROUP BY n, run
), gaps AS (
  SELECT n, a, b, coalesce(lag(b) OVER (PARTITION BY n ORDER BY a), 0) AS since FROM runs
), cut AS (
  SELECT n, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(h[2 * since + 1 : 2 * a], '' ORDER BY a) AS before FROM gaps JOIN hexed USING (n) GROUP BY n
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(before || h[2 * last + 1 :], h))) AS kept_sha256
FROM hexed LEFT JOIN cut USING (n)
"""

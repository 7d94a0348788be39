"""Jaccard self-join on word shingles by T-occurrence search, and its groups.

Two sets with Jaccard >= 0.75 share at least T = ceil(0.75 n) shingles, n being the larger size. As DivideSkip
does, each document's inverted lists are divided into short ones and T - 1 long ones: shingles are ordered by
frequency (a fixed-size count sketch over all documents) and the n - T + 1 rarest are the document's short
lists. With a partner that is no smaller it shares ceil(6/7 n), so it is indexed in fewer lists than it looks up:
of two documents that link, the smaller is indexed in a list that the larger looks up. That routes a document to
those that it may link with; entries that meet no partner of fitting size are dropped within the buckets.

Whatever is left is searched by T-occurrence in indexes of some hundred sets: a query's short lists are merged by
counting their members (vectorised, in place of a heap), sets whose count can still reach the required overlap
are looked up in the long lists by binary search, and those that reach it link.

Equal sets are one node. The pairs of a short list pass a filter before that: bitmaps of the two sets, of
about a bit for each member, differ in no more bits than the sets do in members. Only what changes the groups is
verified: first each document in an index that holds one other that it meets; then, with the components of those
links, the pairs that are still in different components. Lists of more than ``FEW`` documents make no pairs: those
that share documents and are in different components are gathered to a cluster, and all its documents outside of its
largest component are searched in the cluster's indexes of fitting sizes. A pair that this skips would join what
already is joined; no link between components is lost.

Postings move as arrays in one row for each task and bucket, merged lists in rows of bounded size; the sets of
documents that meet any other are made anew from the text and moved only for them. Indexes and the queries
sent to one are split into parts of bounded size, and a task returns at most as many links as it joins components.

Defined cases: a null, empty or blank text has no shingles and is linked with nothing, itself its component;
a null id is ignored in minima (a group of null ids only: null); repeated rows and equal sets are one node; a very
long text is hashed in tiles and its set is held whole in a task; an empty table, or one in which no two documents
share a shingle, gives every row its own component; ties in frequency fall to the smaller hash; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcodes
from .common import ddl, discard, ensure_importable, materialize, n_partitions
from .graph import components
from .sketch import bloom_filter, chunk_rows, combine, in_bloom

SHINGLE = 5
#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 75
SKETCH_BITS = 20
POSTINGS = 1_000_000  # held in a task before they are dealt to buckets
BUCKET = 1_500_000  # postings aimed at for a bucket
SALT = 1024  # queries that a part of an index gets
FEW = 64  # pairs are made of the documents of lists up to this length; longer lists are searched
INDEX = 512  # documents of an index that a task holds
BITMAPS = 2 << 20  # bytes of bitmaps of a cluster that a task holds
QUERIES = 4096  # bitmaps that it compares with them
BROADCAST_ROWS = 200_000
ROW = 1024  # documents of a list in one row
SKIP = 0.02  # weight of a list's length in the choice of how many lists are long


def linked(overlap, n, m, percent: int = PERCENT):
    return 100 * overlap >= percent * (n + m - overlap)


def short_lists(n: int, percent: int = PERCENT) -> int:
    """How many of n shingles are short lists: n - T + 1."""
    return n - (percent * n + 99) // 100 + 1


def indexed_lists(n: int, percent: int = PERCENT) -> int:
    """In how many of them a partner that is no smaller must meet it."""
    return n - linked_overlap(n, n, percent) + 1


def _class_of(counts: np.ndarray) -> np.ndarray:
    """Frequency class of each cell of the sketch, in half powers of two."""
    return (2 * np.log2(counts.astype(np.float64) + 1)).astype(np.uint8)


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return textcodes.binary(batch.column(name))


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the members that fall on each of a power of two of bits, at least as many as members and 64."""
    n = max(64, 1 << (len(s) - 1).bit_length())
    at = (s >> np.uint64(20)).astype(np.int64) & (n - 1)
    return np.packbits((np.bincount(at, minlength=n) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: bytes, n: int) -> int:
    """A bitmap as a number of n bits."""
    x, width = int.from_bytes(bits, "little"), 8 * len(bits)
    while width > n:
        width //= 2
        x = (x >> width) ^ (x & ((1 << width) - 1))
    return x


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of how many members are in one of two sets only: the bits in which their bitmaps differ."""
    n = 8 * min(len(a), len(b))
    return (_folded(a, n) ^ _folded(b, n)).bit_count()


def may_link(n: int, m: int, difference: int, percent: int = PERCENT) -> bool:
    """Whether sets of n and m members that differ in at least so many may link."""
    return percent * max(n, m) <= 100 * min(n, m) and 2 * linked_overlap(n, m, percent) + difference <= n + m


def linked_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """The least overlap with which sets of n and m members link."""
    return -(-percent * (n + m) // (100 + percent))


def _sign(rows: DataFrame, n_words: int) -> DataFrame:
    """kind 0: doc, n, code, bitmap for each row; kind 1: the task's part of the frequency sketch."""
    doc_type = ddl(rows.schema["doc"].dataType)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        names = ["kind", "doc", "n", "code", "chunk", "salt", "blob"]
        salt, doc = 0, None
        for b in batches:
            n, code, cells, bits = [], [], [], []
            for words in textcodes.word_hashes(_texts(b)):
                s = textcodes.shingle_set(words, n_words)
                n.append(len(s))
                code.append(textcodes.set_code(s) if len(s) else None)
                cells.append(s >> np.uint64(64 - SKETCH_BITS))
                bits.append(bitmap(s) if len(s) else None)
            if cells:
                counts += np.bincount(np.concatenate(cells).astype(np.int64), minlength=len(counts))
            salt += sum(n)
            k, doc = b.num_rows, b.column("doc")
            none = pa.nulls(k, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), doc, pa.array(n, pa.int64()), pa.array(code, pa.int64()), none, none, pa.array(bits, pa.binary())], names=names)
        if doc is not None:
            rows = chunk_rows(np.minimum(counts, 0xFFFFFFFF).astype(np.uint32), salt)
            k = len(rows)
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.nulls(k, doc.type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), *cols], names=names)

    return rows.mapInArrow(apply, f"kind int, doc {doc_type}, n long, code long, chunk int, salt int, blob binary")


def _postings(rows: DataFrame, classes: np.ndarray, buckets: int, n_words: int, percent: int) -> DataFrame:
    """(bucket, keys, docs, codes, sizes): postings of the short lists as arrays; a doc's last bit: whether it is indexed."""
    held = rows.sparkSession.sparkContext.broadcast(classes)

    def deal(keys: list[np.ndarray], codes: list[int], sizes: list[int]) -> pa.RecordBatch:
        key = np.concatenate(keys)
        n = np.array([len(k) for k in keys])
        doc = np.repeat(np.arange(len(keys), dtype=np.uint32), n)
        place = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
        indexed = place < np.repeat([indexed_lists(x, percent) for x in sizes], n)
        code, size = np.array(codes, dtype=np.int64), np.array(sizes, dtype=np.uint32)
        at = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        key, doc, at, indexed = key[order], doc[order], at[order], indexed[order]
        edges = np.searchsorted(at, np.arange(buckets + 1))
        out: dict[str, list] = {"bucket": [], "keys": [], "docs": [], "codes": [], "sizes": []}
        for k in range(buckets):
            a, b = edges[k], edges[k + 1]
            if a == b:
                continue
            own, back = np.unique(doc[a:b], return_inverse=True)
            out["bucket"].append(k)
            out["keys"].append((key[a:b] // np.uint64(buckets)).astype(np.uint32).tobytes())
            out["docs"].append((2 * back + indexed[a:b]).astype(_doc_type(len(own))).tobytes())
            out["codes"].append(code[own].tobytes())
            out["sizes"].append(size[own].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[c], pa.binary()) for c in ("keys", "docs", "codes", "sizes"))], names=list(out))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = held.value
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        codes: list[int] = []
        sizes: list[int] = []
        total = 0
        for b in batches:
            for words in textcodes.word_hashes(_texts(b)):
                s = textcodes.shingle_set(words, n_words)
                if not len(s) or (code := textcodes.set_code(s)) in seen:
                    continue
                seen.add(code)
                order = np.argsort(cls[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                keys.append(s[order[: short_lists(len(s), percent)]])
                codes.append(code)
                sizes.append(len(s))
                total += len(keys[-1])
                if total >= POSTINGS:
                    yield deal(keys, codes, sizes)
                    keys, codes, sizes, total = [], [], [], 0
        if keys:
            yield deal(keys, codes, sizes)

    return rows.select("text").mapInArrow(apply, "bucket int, keys binary, docs binary, codes binary, sizes binary")


def _doc_type(n: int) -> type:
    return np.uint16 if n <= 1 << 15 else np.uint32


def _with_partner(lists: np.ndarray, size: np.ndarray, indexed: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which entries of lists meet another of fitting size, the smaller of the two being indexed."""
    span = int(size.max()) * 100 // percent + 2
    place = lists.astype(np.int64) * span
    among = np.sort((place + size)[indexed])
    looked_up = np.sort((place + size)[~indexed])
    low, high = place + -(-size * percent // 100), place + size * 100 // percent
    between = lambda a, lo, hi: np.searchsorted(a, hi, side="right") - np.searchsorted(a, lo)
    own = between(among, low, np.where(indexed, high, place + size)) - indexed
    return own + np.where(indexed, between(looked_up, place + size, high), 0) > 0


LISTS = "list long, row int, n int, least long, codes array<long>, sizes array<long>"


def _merge_bucket(table: pa.Table, percent: int = PERCENT) -> pa.Table:
    """Merge a bucket's lists; each distinct list of two or more documents once, in the order of their codes."""
    key = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in table.column("keys").to_pylist()])
    codes, docs, sizes, at = [], [], [], 0
    for d, c, s in zip(*(table.column(x).to_pylist() for x in ("docs", "codes", "sizes"))):
        c = np.frombuffer(c, dtype=np.int64)
        docs.append(np.frombuffer(d, dtype=_doc_type(len(c))).astype(np.int64) + 2 * at)
        codes.append(c)
        sizes.append(np.frombuffer(s, dtype=np.uint32))
        at += len(c)
    code, first, back = np.unique(np.concatenate(codes), return_index=True, return_inverse=True)
    size = np.concatenate(sizes)[first].astype(np.int64)
    entry = np.concatenate(docs)
    doc, indexed = back[entry >> 1], (entry & 1).astype(bool)
    order = np.lexsort((~indexed, doc, key))
    key, doc, indexed = key[order], doc[order], indexed[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc, indexed = key[new], doc[new], indexed[new]
    lists = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
    meets = _with_partner(lists, size[doc], indexed, percent)
    lists, doc = lists[meets], doc[meets]
    out: dict[str, list] = {c.split()[0]: [] for c in LISTS.split(", ")}
    if len(doc):
        starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
        length = np.diff(np.append(starts, len(doc)))
        with np.errstate(over="ignore"):
            ident = np.add.reduceat(textcodes.mix(code[doc].view(np.uint64)), starts) + length.astype(np.uint64)
        ident, pick = np.unique(ident, return_index=True)
        for name, i in zip(ident.view(np.int64).tolist(), pick.tolist()):
            for row, a in enumerate(range(0, length[i], ROW)):
                part = doc[starts[i] + a : starts[i] + min(a + ROW, length[i])]
                for c, v in zip(out, (name, row, int(length[i]), int(code[doc[starts[i]]]), code[part], size[part])):
                    out[c].append(v)
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), types)})


def pack_set(s: np.ndarray) -> bytes:
    """The upper 40 bits of sorted hashes."""
    return (s >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack_set(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(np.uint64)


def _sets(rows: DataFrame, wanted: DataFrame, n_words: int) -> DataFrame:
    """(code, members) of the sets whose codes are in ``wanted`` (and a few others)."""
    held = rows.sparkSession.sparkContext.broadcast(bloom_filter(wanted))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        seen: set[int] = set()
        for b in batches:
            codes, blobs = [], []
            for words in textcodes.word_hashes(_texts(b)):
                s = textcodes.shingle_set(words, n_words)
                if not len(s) or (code := textcodes.set_code(s)) in seen or not in_bloom(bits, np.array([code], dtype=np.int64))[0]:
                    continue
                seen.add(code)
                codes.append(code)
                blobs.append(pack_set(s))
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(blobs, pa.binary())], names=["code", "members"])

    return rows.select("text").mapInArrow(apply, "code long, members binary")


class Index:
    """Inverted lists of some sets, searched as DivideSkip does."""

    def __init__(self, codes: list[int], sets: list[np.ndarray], percent: int):
        self.codes, self.sets, self.percent = codes, sets, percent
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        key = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(key, kind="stable")
        self.doc = doc[order]
        self.keys, self.starts, self.lengths = np.unique(key[order], return_index=True, return_counts=True)
        self.places = np.repeat(np.arange(len(self.keys)), self.lengths) * len(sets) + self.doc

    def search(self, s: np.ndarray) -> np.ndarray:
        """Numbers of the sets that link with ``s``."""
        need = (self.percent * len(s) + 99) // 100
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        lists = at[self.keys[at] == s]
        if len(lists) < need:
            return np.empty(0, dtype=np.int64)
        lists = lists[np.argsort(self.lengths[lists], kind="stable")]
        n_long = min(need - 1, int(need / (SKIP * np.log2(self.lengths[lists[-1]] + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        n = self.lengths[short]
        member = self.doc[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[short], n)]
        count = np.bincount(member, minlength=len(self.sets))
        found = np.flatnonzero(count >= need - n_long)
        found = found[self.percent * np.maximum(self.sizes[found], len(s)) <= 100 * np.minimum(self.sizes[found], len(s))]
        if n_long and len(found):
            wanted = (long[:, None] * len(self.sets) + found[None, :]).ravel()
            place = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
            count[found] += (self.places[place] == wanted).reshape(n_long, -1).sum(axis=0)
        return found[linked(count[found], len(s), self.sizes[found], self.percent)]


ROLES = ["kind", "group", "part", "role", "code", "comp"]


def _pair_roles(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as searches of each b in an index that holds a and some others, in parts of about SALT queries."""
    parts = max(1, -(-pairs.agg(F.count_distinct("a")).first()[0] // INDEX))
    placed = pairs.withColumn("group", F.pmod(F.xxhash64("a"), F.lit(parts)))
    salts = _small(placed.groupBy("group").agg(F.ceil(F.count("*") / SALT).cast("long").alias("salts")))
    zero, one = F.lit(0), F.lit(1)
    queries = placed.join(salts, "group").select(zero.alias("kind"), "group", F.pmod(F.xxhash64("b"), "salts").alias("part"), one.alias("role"), F.col("b").alias("code"), F.col("b").alias("comp")).distinct()
    index = placed.select("group", "a").distinct().join(salts, "group").select(zero.alias("kind"), "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("part"), zero.alias("role"), F.col("a").alias("code"), F.col("a").alias("comp"))
    return queries.unionByName(index)


def _small(table: DataFrame) -> DataFrame:
    """Written, and broadcast if it has at most BROADCAST_ROWS rows (of some 50 bytes)."""
    table = materialize(table, "join-small")
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


class Bitmaps:
    """Sets known by size and bitmap, ordered by size for each width of a bitmap."""

    def __init__(self, sizes: list[int], comps: list[int], bits: list[bytes], percent: int):
        self.percent = percent
        self.by_width: list[tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]] = []
        size, comp, width = np.array(sizes, dtype=np.int64), np.array(comps, dtype=np.int64), np.array([len(x) // 8 for x in bits])
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            at = at[np.argsort(size[at], kind="stable")]
            whole = np.frombuffer(b"".join(bits[i] for i in at), dtype="<u8").reshape(len(at), w)
            self.by_width.append((at, size[at], comp[at], {w: whole}))

    @staticmethod
    def fold(words: np.ndarray, w: int) -> np.ndarray:
        while words.shape[1] > w:
            half = words.shape[1] // 2
            words = words[:, :half] ^ words[:, half:]
        return words

    def may_link(self, size: int, comp: int, bits: bytes) -> np.ndarray:
        """Numbers of the sets of other components that sizes and bitmaps let link."""
        query, out = np.frombuffer(bits, dtype="<u8")[None, :], []
        for at, sizes, comps, folds in self.by_width:
            low, high = np.searchsorted(sizes, [-(-self.percent * size // 100), 100 * size // self.percent + 1])
            if low == high:
                continue
            w = min(max(folds), query.shape[1])
            if w not in folds:
                folds[w] = self.fold(folds[max(folds)], w)
            differ = np.bitwise_count(folds[w][low:high] ^ self.fold(query, w)).sum(axis=1, dtype=np.int64)
            both = sizes[low:high] + size
            fits = (2 * linked_overlap(both, 0, self.percent) + differ <= both) & (comps[low:high] != comp)
            out.append(at[low:high][fits])
        return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def _cluster_roles(entries: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Long lists' entries (list, least, code, size, comp) as searches: of all documents but the largest component's.

    Lists that share documents are one cluster, so that a document is indexed once. An index is split by bands of
    sizes and into parts of about INDEX documents. Bitmaps (code, bits) of the queries meet those of the bands that they may link
    with in blocks of bounded size; a search goes only to the parts with a document that may link, and only such documents are indexed.
    """
    cluster = materialize(components(entries.select(F.col("least").alias("a"), F.col("code").alias("b"))), "join-clusters")
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(float(np.log(100 / percent)) * (1 + 1e-9))).cast("long")
    docs = entries.select("code", "size", "comp").distinct().join(cluster, F.col("code") == F.col("node")).select(F.col("component").alias("group"), "code", "comp", "size", band.alias("band"))
    docs = materialize(docs.join(bitmaps, "code"), "join-cluster-documents")
    largest = docs.groupBy("group", "comp").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"))
    parts = docs.groupBy("group", "band").agg(F.ceil(F.count("*") / INDEX).cast("long").alias("parts"), F.ceil(F.sum(F.octet_length("bits")) / BITMAPS).cast("long").alias("blocks"))
    largest, parts = _small(largest), _small(parts)  # so that a large cluster isn't dealt to one task by its name
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    around = docs.join(largest, "group").filter("comp <> largest").withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))).join(parts, ["group", "band"])
    salts = _small(around.groupBy("group", "band").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("salts")))
    block, part = F.pmod(F.xxhash64("code", F.lit(1)), "blocks"), F.col("band") * (1 << 32) + F.pmod(F.xxhash64("code"), "parts")
    key, rest = ["group", "band", "block", "salt"], ["role", "code", "comp", "size", "part", "bits"]
    index = docs.join(parts, ["group", "band"]).join(salts, ["group", "band"]).withColumns({"block": block, "part": part, "role": F.lit(0)}).withColumn("salt", upto("salts")).select(*key, *rest)
    queries = around.join(salts, ["group", "band"]).withColumns({"block": upto("blocks"), "salt": F.pmod(F.xxhash64("code", F.lit(2)), "salts"), "part": F.lit(None).cast("long"), "role": F.lit(1)}).select(*key, *rest)
    placed = index.unionByName(queries).repartition(n_partitions(entries.sparkSession), *key).sortWithinPartitions(*key, "role")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, index, hit = None, None, [], set()
        names, types = ["group", "part", "role", "code", "comp"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            out: list[tuple] = []
            for *k, role, code, comp, size, part, bits in zip(*(batch.column(c).to_pylist() for c in [*key, *rest])):
                if k != now:
                    now, known, index, hit = k, None, [], set()
                if role == 0:
                    index.append((code, comp, size, part, bits))
                elif index:
                    known = known or Bitmaps([x[2] for x in index], [x[1] for x in index], [x[4] for x in index], percent)
                    found = known.may_link(size, comp, bits).tolist()
                    out += [(k[0], p, 1, code, comp) for p in {index[i][3] for i in found}]
                    out += [(k[0], index[i][3], 0, index[i][0], index[i][1]) for i in found if i not in hit]
                    hit.update(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(types)], names=names)

    found = placed.mapInArrow(apply, "group long, part long, role int, code long, comp long").distinct()
    return found.select(F.lit(1).alias("kind"), "group", "part", "role", "code", "comp")


def _search(rows: DataFrame, roles: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Links (a, b) that join components which no earlier one of the same task joined."""
    spark = rows.sparkSession
    roles = materialize(roles, "join-roles")
    sets = _sets(rows, roles.select("code"), n_words).dropDuplicates(["code"])
    key = ["kind", "group", "part"]
    placed = roles.join(sets, "code").repartition(n_partitions(spark), *key).sortWithinPartitions(*key, "role")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, codes, sets, comps, root = None, None, [], [], [], {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            a, b = [], []
            for *k, role, code, comp, blob in zip(*(batch.column(c).to_pylist() for c in [*ROLES, "members"])):
                if k != now:
                    now, index, codes, sets, comps, root = k, None, [], [], [], {}
                own = unpack_set(blob)
                if role == 0:
                    codes.append(code)
                    sets.append(own)
                    comps.append(comp)
                elif codes:
                    index = index or Index(codes, sets, percent)
                    for i in index.search(own).tolist():
                        x, y = find(comp), find(comps[i])
                        if x != y:
                            root[x] = y
                            a.append(codes[i])
                            b.append(code)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return placed.select(*ROLES, "members").mapInArrow(apply, "a long, b long")


def _fitting(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of short lists that may link by sizes and bitmaps."""
    for batch in batches:
        a, b = [], []
        for entries in batch.column("entries").to_pylist():
            docs = sorted((e["code"], e["size"], e["bits"]) for e in entries)
            for j, (code, n, bits) in enumerate(docs):
                for other, m, more in docs[:j]:
                    if may_link(n, m, 0, percent) and may_link(n, m, least_difference(bits, more), percent):
                        a.append(other)
                        b.append(code)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    spark = docs.sparkSession
    ensure_importable(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    signed = materialize(_sign(rows, n_words), "join-signed", partition_by="kind")
    own = signed.filter("kind = 0").select("doc", "n", "code")
    nodes = materialize(signed.filter("kind = 0 AND n > 0").groupBy("code").agg(F.min("doc").alias("least"), F.first("blob").alias("bits")), "join-nodes")
    counts = combine(signed.filter("kind = 1").select("chunk", "salt", "blob"), "uint32", np.add)
    classes = _class_of(counts) if len(counts) else np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    shingles = own.agg(F.sum("n")).first()[0] or 0
    buckets = max(n_partitions(spark), -(-shingles * (100 - percent) // (100 * BUCKET)))
    lists = _postings(rows, classes, buckets, n_words, percent).groupBy("bucket").applyInArrow(lambda t: _merge_bucket(t, percent), LISTS)
    lists = materialize(lists.dropDuplicates(["list", "row"]), "join-lists")
    entries = lists.select("list", "n", "least", F.explode(F.arrays_zip("codes", "sizes")).alias("e")).select("list", "n", "least", F.col("e.codes").alias("code"), F.col("e.sizes").alias("size"))
    short = entries.filter(F.col("n") <= FEW).join(nodes.select("code", "bits"), "code").groupBy("list").agg(F.collect_list(F.struct("code", "size", "bits")).alias("entries")).select("entries")
    pairs = materialize(short.mapInArrow(lambda it: _fitting(it, percent), "a long, b long").distinct(), "join-pairs")
    long = materialize(entries.filter(F.col("n") > FEW).select("list", "least", "code", "size"), "join-long-lists")
    # one search for each document first, then all that are still open
    near = pairs.unionByName(long.filter("code <> least").select(F.col("least").alias("a"), F.col("code").alias("b"))).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = materialize(_search(rows, _pair_roles(near), n_words, percent), "join-links")
    comps = materialize(components(links), "join-components")

    def component_of(table: DataFrame, code: str, name: str) -> DataFrame:
        found = table.join(comps.select(F.col("node").alias(code), F.col("component").alias("_c")), code, "left")
        return found.withColumn(name, F.coalesce("_c", code)).drop("_c")

    open_pairs = component_of(component_of(pairs, "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
    placed = component_of(long, "code", "comp")
    mixed = placed.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select(F.col("list").alias("mixed"))
    mixed = materialize(placed.join(mixed, F.col("list") == F.col("mixed")).drop("mixed"), "join-mixed")
    more = materialize(_search(rows, _pair_roles(open_pairs).unionByName(_cluster_roles(mixed, nodes.select("code", "bits"), percent)), n_words, percent), "join-links")
    if not more.isEmpty():
        comps = materialize(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "join-components")
    discard(spark, links, pairs, long, mixed)
    least = nodes.select("code", "least").join(comps, F.col("code") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "code"))
    per_comp = least.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_code = least.join(per_comp, "comp").select("code", "component_id")
    out = own.join(by_code, "code", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))
    return out


SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(x.doc_id) FROM reach JOIN w x ON x.r = reach.b WHERE reach.a = w.r) AS component_id
FROM w LEFT JOIN n ON n.r = w.r
"""

"""Phrases whose words stand together more often than chance has it, mined by bucket counts (PCY, DHP) and Apriori pruning.

One pass over the texts for each length of phrase. Pass k counts exactly the phrases of k words that may be frequent, and in
the same scan counts the phrases of k + 1 words in hashed buckets: a table of fixed size in each task, whose counts stop at the
threshold; all tasks' tables are added up, and one bit a bucket, whether it reached the threshold, is broadcast. A
phrase is counted exactly in the next pass only if its bucket's bit is set (PCY) and both phrases of one word less that it holds
are frequent (Apriori; known by a Bloom filter of bounded size). Only phrases that hold two maybe frequent ones are hashed to
buckets at all (DHP). All three tests let frequent phrases through, so that results don't depend on the size of tables.

Exact counts are sums over tasks of (language, phrase, count), so a phrase that stands everywhere moves as one row a task. All
counts that scores need are those of frequent phrases, as a part of a phrase is as frequent as the phrase. Each candidate's cuts
are joined to the counts of their two parts; products are decimals of 38 digits, divided in whole numbers.

Within a task phrases are told apart by 64-bit codes (a million different ones share a code with probability 3e-8), between
tasks by their bytes.

Defined cases: null and empty texts have no words; null languages are ``und``; very long texts are read in tiles that overlap
by ``max_words - 1`` words; repeated rows count like others; an empty table gives no rows; a language without a
candidate gives none; ids and extra columns aren't read.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sketch, textcodes
from .common import discard, ensure_importable, materialize

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
COVERED_PERCENT = 100
BLANKS = b" \t"
BREAKS = b".,;:!?\n\v\f\r"
BUCKET_BITS = (16, 27)  # at least 7: a chunk of buckets fills whole bytes
FLUSH = 400_000  # phrases that a task holds at most
SALTS = 64
U = np.uint64


def _table(some: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(some)] = True
    return out


IS_BREAK, IS_GAP = _table(BREAKS), _table(BREAKS + BLANKS)


@dataclass
class Tile:
    """Words of some texts: places in the bytes, hashes, piece, and number of the text; those before ``skip`` were read before."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    piece: np.ndarray
    text: np.ndarray
    skip: int = 0


def hash_spans(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ascending spans of bytes, in stretches; long ones by another hash."""
    out = np.empty(len(starts), dtype=U)
    long = ends - starts > textcodes.LONG_WORD
    for i in np.flatnonzero(long).tolist():
        out[i] = textcodes.xxhash.xxh3_64_intdigest(a[starts[i] : ends[i]].tobytes())
    step = textcodes.TILE - textcodes.LONG_WORD
    for at in range(0, len(a), step):
        some = np.arange(*np.searchsorted(starts, [at, at + step]))
        some = some[~long[some]]
        if len(some):
            out[some] = textcodes.span_hashes(textcodes.prefix_codes(a[at : at + textcodes.TILE]), starts[some] - at, ends[some] - at)
    return out


def make_tile(data: bytes, text_ends: np.ndarray, skip: int = 0) -> Tile:
    """The words of lower-cased bytes; texts end where ``text_ends`` says, each at a break."""
    a = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(a) + 2, dtype=bool)
    np.logical_not(IS_GAP[a], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    breaks = np.flatnonzero(IS_BREAK[a])
    return Tile(data, starts, ends, hash_spans(a, starts, ends), np.searchsorted(breaks, starts), np.searchsorted(text_ends, starts, side="right"), skip)


def tiles(texts: list[bytes], overlap: int) -> Iterator[tuple[Tile, np.ndarray]]:
    """(tile, number of the text of each word): short texts together, long ones in tiles that repeat ``overlap`` words."""
    held: list[int] = []
    size = 0

    def joined() -> tuple[Tile, np.ndarray]:
        data = b"\n".join(texts[i] for i in held).translate(textcodes.LOWER)
        tile = make_tile(data, np.cumsum([len(texts[i]) + 1 for i in held]))
        return tile, np.array(held)[tile.text]

    for i, t in enumerate(texts):
        if len(t) > textcodes.TILE:
            for tile in long_tiles(t, overlap):
                yield tile, np.full(len(tile.words), i)
            continue
        if held and size + len(t) > textcodes.TILE:
            yield joined()
            held, size = [], 0
        held.append(i)
        size += len(t) + 1
    if held:
        yield joined()


GAP = textcodes.re.compile(rb"[ \t.,;:!?\n\v\f\r]")


def long_tiles(text: bytes, overlap: int) -> Iterator[Tile]:
    """Tiles cut at gaps between words; each begins with the last words of the one before."""
    at, carry, n = 0, b"", 0
    while at < len(text):
        end = len(text)
        if end - at > textcodes.TILE and (found := GAP.search(text, at + textcodes.TILE)):
            end = found.start()
        data = carry + text[at:end].translate(textcodes.LOWER)
        tile = make_tile(data, np.array([len(data)]), n)
        yield tile
        n = min(overlap, len(tile.words))
        carry = data[tile.starts[-n] :] if n else b""
        at = end


class Counts:
    """Exact counts of a task, by code."""

    def __init__(self) -> None:
        self.known: dict[int, int] = {}
        self.part, self.phrase, self.n = [], [], []

    def add(self, tile: Tile, part: np.ndarray, at: np.ndarray, codes: np.ndarray, k: int) -> None:
        own, first, n = np.unique(codes, return_index=True, return_counts=True)
        for c, i, m in zip(own.tolist(), at[first].tolist(), n.tolist()):
            x = self.known.get(c)
            if x is None:
                self.known[c] = len(self.n)
                self.part.append(int(part[i]))
                self.phrase.append(b" ".join(tile.data[s:e] for s, e in zip(tile.starts[i : i + k].tolist(), tile.ends[i : i + k].tolist())))
                self.n.append(m)
            else:
                self.n[x] += m


class Buckets:
    """Counts by bucket that stop at ``most``."""

    def __init__(self, bits: int, most: int):
        self.bits, self.most = bits, most
        self.n = np.zeros(1 << bits, dtype=counter(most))

    def add(self, codes: np.ndarray) -> None:
        at, n = np.unique(bucket(codes, self.bits), return_counts=True)
        self.n[at] = np.minimum(self.n[at].astype(np.int64) + n, self.most)


def counter(most: int) -> str:
    return "uint8" if most < 1 << 8 else "uint32"


def bucket(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes >> U(64 - bits)).astype(np.int64)


def _longer(code: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return textcodes.mix(code * U(0xA0761D6478BD642F) + word)


def phrase_codes(tile: Tile, part_code: np.ndarray, k: int) -> np.ndarray:
    """Codes of the k words from each word on; those that leave their piece have no meaning."""
    with np.errstate(over="ignore"):
        code = textcodes.mix(tile.words + part_code)
    for j in range(1, k):
        code = _longer(code[: len(tile.words) - j], tile.words[j:])
    return code


def maybe_frequent(tile: Tile, part_code: np.ndarray, k: int, bits: np.ndarray | None, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, codes) of the phrases of k words that no test excludes; they may begin in words read before."""
    if len(tile.words) < k:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=U)
    if k == 1:
        return np.arange(len(tile.words)), phrase_codes(tile, part_code, 1)
    shorter = phrase_codes(tile, part_code, k - 1)
    frequent = sketch.in_bloom(known, shorter.view(np.int64))
    at = np.flatnonzero(frequent[:-1] & frequent[1:] & (tile.piece[: 1 - k] == tile.piece[k - 1 :]))
    codes = _longer(shorter[at], tile.words[at + k - 1])
    b = bucket(codes, (8 * len(bits)).bit_length() - 1)
    good = (bits[b >> 3] >> (b & 7)) & 1 > 0
    return at[good], codes[good]


OUT = "kind int, part string, phrase string, code long, n long, chunk int, salt int, blob binary"


def _pass(rows: DataFrame, k: int, max_words: int, bucket_bits: int, min_count: int, bits, known) -> DataFrame:
    """kind 0: exact counts of phrases of k words; kind 1: buckets of the phrases of k + 1 words."""
    names = [x.split()[0] for x in OUT.split(", ")]

    def counted(counts: Counts, parts: list[str]) -> pa.RecordBatch:
        m = len(counts.n)
        code = np.fromiter(counts.known, dtype=U, count=m).view(np.int64)
        some = pa.nulls(m, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(m, dtype=np.int32)), pa.array(parts, pa.string()).take(pa.array(counts.part, pa.int32())), pa.array(counts.phrase, pa.binary()).cast(pa.string()), pa.array(code), pa.array(counts.n, pa.int64()), some, some, pa.nulls(m, pa.binary())], names=names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, number, parts, part_codes = Counts(), {}, [], np.empty(0, dtype=U)
        buckets = Buckets(bucket_bits, min_count) if k < max_words else None
        filled = False
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                names_here = some.column("part").to_pylist()
                for x in names_here:
                    if x not in number:
                        number[x] = len(parts)
                        parts.append(x)
                        part_codes = np.append(part_codes, U(textcodes.xxhash.xxh3_64_intdigest(x.encode())))
                of_text = np.array([number[x] for x in names_here])
                for tile, text in tiles(list(textcodes.binary(some.column("text"))), max_words - 1):
                    if not len(tile.words):
                        continue
                    part = of_text[text]
                    place, codes = maybe_frequent(tile, part_codes[part], k, bits.value if bits else None, known.value if known else None)
                    new = place + k - 1 >= tile.skip
                    counts.add(tile, part, place[new], codes[new], k)
                    if buckets is not None and len(place) > 1:
                        # phrases of one word more whose two shorter ones are both possible
                        both = np.flatnonzero(place[1:] == place[:-1] + 1)
                        p = place[both]
                        inside = p + k < len(tile.words)
                        both, p = both[inside], p[inside]
                        good = (tile.piece[p] == tile.piece[p + k]) & (p + k >= tile.skip)
                        if good.any():
                            buckets.add(_longer(codes[both[good]], tile.words[p[good] + k]))
                            filled = True
                    if len(counts.n) >= FLUSH:
                        yield counted(counts, parts)
                        counts = Counts()
        if counts.n:
            yield counted(counts, parts)
        if filled:
            chunks = sketch.chunk_rows(buckets.n, secrets.randbits(31))
            m = len(chunks)
            text, long = pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), text, text, long, long, *(pa.array([c[j] for c in chunks], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.binary())))], names=names)

    return rows.mapInArrow(apply, OUT)


def frequent_phrases(docs: DataFrame, text_col: str = "text", part_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """((part, phrase, words, n) of the phrases with n >= min_count, (part, total) words of each part)."""
    spark = docs.sparkSession
    ensure_importable(spark)
    rows = docs.select(F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("und")).alias("part"), F.col(f"`{text_col}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    low, high = BUCKET_BITS
    bucket_bits = min(high, max(low, (size // min_count).bit_length()))
    found, totals, bits, known = [], None, None, None
    for k in range(1, max_words + 1):
        out = materialize(_pass(rows, k, max_words, bucket_bits, min_count, bits, known), f"phrases-{k}", partition_by="kind")
        counted = out.filter("kind = 0")
        if k == 1:
            totals = materialize(counted.groupBy("part").agg(F.sum("n").alias("total")), "phrase-totals")
        exact = counted.groupBy("part", "phrase").agg(F.sum("n").alias("n"), F.min("code").alias("code")).filter(F.col("n") >= min_count)
        found.append(materialize(exact.select("part", "phrase", F.lit(k).alias("words"), "n", "code"), f"frequent-{k}"))
        for x in (bits, known):
            if x is not None:
                x.unpersist()
        if k == max_words or found[-1].isEmpty():
            discard(spark, out)
            break
        cap = min_count
        packed = sketch.combine(out.filter("kind = 1").select("chunk", "salt", "blob"), counter(cap), lambda a, b: np.minimum(a.astype(np.int64) + b, cap).astype(a.dtype), lambda n: np.packbits(n >= cap, bitorder="little"))
        discard(spark, out)
        if not len(packed):
            break
        bits = spark.sparkContext.broadcast(packed)
        known = spark.sparkContext.broadcast(sketch.bloom_filter(found[-1].select("code")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.drop("code"), totals


def _words(phrase: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def _whole(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def scored_candidates(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """part, phrase, words, a, l, r, n, score of each phrase of two words and more, by its lowest-scoring cut."""
    candidates = frequent.filter("words >= 2").withColumnRenamed("n", "a")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("head", _words(F.col("phrase"), F.lit(1), F.col("cut"))).withColumn("tail", _words(F.col("phrase"), F.col("cut") + 1, F.col("words") - F.col("cut")))
    part_of = lambda name, n: frequent.select("part", F.col("phrase").alias(name), F.col("n").alias(n))
    joined = cuts.join(part_of("head", "l"), ["part", "head"]).join(part_of("tail", "r"), ["part", "tail"]).join(totals.withColumnRenamed("total", "n"), "part")
    above = F.lit(1000).cast("decimal(4,0)") * (_whole(F.col("a")) * _whole(F.col("n")))
    score = F.call_function("div", above, _whole(F.col("l")) * _whole(F.col("r")))
    best = joined.withColumn("score", score).groupBy("part", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    return best.select("part", "phrase", "words", "a", "low.l", "low.r", "n", "low.score")


def uncovered(candidates: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """Candidates that don't lie inside a longer one that is nearly as frequent.

    A longer one covers by way of those of one word more, which are as frequent as it is at least.
    """
    shorter = candidates.filter("words >= 3").select("part", F.explode(F.array(_words(F.col("phrase"), F.lit(1), F.col("words") - 1), _words(F.col("phrase"), F.lit(2), F.col("words") - 1))).alias("phrase"), "a")
    most = shorter.groupBy("part", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(most, ["part", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def mine_phrases(docs: DataFrame, top: int = TOP, covered_percent: int = COVERED_PERCENT, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each part's best phrases."""
    scored = materialize(scored_candidates(*frequent_phrases(docs, **options)), "phrases-scored")
    kept = uncovered(scored, covered_percent)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    in_salt = F.row_number().over(Window.partitionBy("part", "salt").orderBy(*order))
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", in_salt).filter(F.col("rank") <= top).drop("salt", "rank")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select(F.col("part").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), starts AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
), f AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, any_value(k) AS k, count(*) AS a FROM starts GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM f WHERE k >= 2
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, cuts.a, c, x.a AS l, y.a AS r, n, ((1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1 : c], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[c + 1 :], ' ') JOIN totals ON totals.lang = cuts.lang
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS x FROM scored) WHERE x = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.k > b.k AND 100 * f.a >= 100 * b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""

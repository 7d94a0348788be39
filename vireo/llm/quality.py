"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

The model is trained on all trusted documents, which are the labelled ones of good quality, less a fifth that is held out for
the thresholds (by a hash of the id; a caller may ask for fewer). Discounts come from counts of counts, the lower order from
continuation counts. Its tables (words with the counts that give backoff weight and lower-order probability; bigrams
with counts) are dealt to shards by hash. All documents are then scored: each block of texts asks the shards for those of its
distinct words and bigrams that may be in the model (a Bloom filter tells), a shard joins requests and counts, and the block adds
up log-probabilities. There are so many shards that none has more than about ``SHARD_CODES`` of the model's codes, and blocks are
dealt to slices, as many as keep a shard's requests bounded, that each have their copy of the model. Where the model grows with
the input, shards do and slices don't; where it stays small, its copies are small: they grow no faster than the input.

Bigrams are counted in ``COUNT_ROUNDS`` rounds, each for its share of them by hash, and documents are scored in up to
``ROUNDS`` rounds, each for its share of them. What a round stores and shuffles is deleted at its end, so
that the disk never holds all n-grams of all blocks beside the model; every round has the whole model. A document is kept unless its perplexity is above the threshold of its language: the
``QUANTILE`` of the perplexities of the language's trusted documents that the model was not trained on (of all
languages, where a language has none). The quantile is read from a histogram of log-perplexity over all of them.

Defined cases: null and empty texts are the end token alone; very long texts are held whole by the task that stores
them; an empty table gives no rows; perplexities at the threshold are kept; with no trusted text, every document is kept and the
threshold is null; a null language is a language of its own; null and repeated ids are rows like others (a label
counts for all rows of its id; a document is trusted if any of its labels says so); extra columns are not read.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcodes
from .common import by_block, ddl, discard, ensure_importable, fresh_path, get_file, materialize, n_partitions, put_file, shuffles_freed
from .sketch import bloom_filter, in_bloom
from .textcodes import pack_counts, unpack_counts

HELD_OUT = 5  # a trusted document in so many is never trained on, so that there are some for the thresholds
BROADCAST_ROWS = 200_000  # a larger number of trusted ids is joined by a shuffle
QUANTILE = 0.995
BIN = 0.001  # width of the histogram, in log10 of perplexity
BLOCK_BYTES = 8 << 20
SLICE_BLOCKS = 8  # what a shard is asked at a time is about as much as so many blocks ask of all shards
SHARD_CODES = 1_000_000  # words and bigrams of the model aimed at for a shard
COPIES = 64  # copies of the model that one task makes
COUNT_ROUNDS = 2  # rounds that bigrams are counted in
ROUNDS = 4  # rounds that documents are scored in
ROUND_BYTES = 16 << 20  # text that is worth a round of its own
COUNTS = (("total", "m1", "m2", "m3", "n"), ("c",))  # of a word, of a bigram
U = np.uint64
BEGIN, END, UNKNOWN = U(0xC0FFEE1B0001), U(0xC0FFEE1B0002), U(0)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit codes of begin, words as written, end of each text; each text's begin)."""
    parts, starts, at = [], [], 0
    for words in textcodes.word_hashes(texts, lower=False):
        starts.append(at)
        parts += [np.array([BEGIN]), words >> U(16), np.array([END])]
        at += len(words) + 2
    return np.concatenate(parts) if parts else np.empty(0, dtype=U), np.array(starts, dtype=np.int64)


def _wide(tokens: np.ndarray) -> np.ndarray:
    """64-bit codes, as the model's tables have them."""
    with np.errstate(over="ignore"):
        return textcodes.mix(tokens)


def _pair_codes(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return textcodes.mix(h * U(0xA0761D6478BD642F) + w)


def _pairs(tokens: np.ndarray) -> np.ndarray:
    return _pair_codes(tokens[:-1], tokens[1:])


def _count_pairs(rows: DataFrame, k: int, rounds: int) -> DataFrame:
    """(h, w, c): those bigrams of texts whose code has the remainder ``k``, with counts."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, starts = _tokens(textcodes.binary(b.column("text")))
            tokens = _wide(tokens)
            inside = np.ones(len(tokens), dtype=bool)
            inside[starts] = False
            at = np.flatnonzero(inside)
            codes = _pairs(tokens)[at - 1]
            own = codes % U(rounds) == k
            _, first, count = np.unique(codes[own], return_index=True, return_counts=True)
            at = at[own][first]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[at - 1].view(np.int64)), pa.array(tokens[at].view(np.int64)), pa.array(count.astype(np.int64))], names=["h", "w", "c"])

    return rows.select("text").mapInArrow(apply, "h long, w long, c long").groupBy("h", "w").agg(F.sum("c").alias("c"))


def _with_codes(pairs: DataFrame) -> DataFrame:
    """(code, c) of counted bigrams."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = _pair_codes(*(b.column(c).to_numpy().view(U) for c in ("h", "w")))
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), b.column("c")], names=["code", "c"])

    return pairs.select("h", "w", "c").mapInArrow(apply, "code long, c long")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from counts of counts."""
    if not n1:
        return 0.0, 0.0, 0.0
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.0)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def _discounts_of(table: DataFrame, count: str) -> tuple[float, float, float]:
    return discounts(*table.agg(*[F.count_if(F.col(count) == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first())


def _off(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.select([c == 0, c == 1, c == 2], [0.0, d[0], d[1]], d[2])


def _discount(c, d: tuple[float, float, float]):
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


class Weights(NamedTuple):
    """Discounts of bigrams and of continuations, number of continuations, probability of an unknown word."""

    d: tuple[float, float, float]
    d1: tuple[float, float, float]
    kinds: int
    unknown: float

    def gamma(self, total: np.ndarray, m1: np.ndarray, m2: np.ndarray, m3: np.ndarray) -> np.ndarray:
        left = m1 * self.d[0] + m2 * self.d[1] + m3 * self.d[2]
        return np.divide(left, total, out=np.ones(len(total)), where=total > 0)

    def low(self, n: np.ndarray) -> np.ndarray:
        return (n - np.minimum(n, _off(n, self.d1))) / (self.kinds or 1) + self.unknown


class Model:
    """words(code, total, m1, m2, m3, n), pairs(code, c); what turns their counts into probabilities.

    A word is followed by ``total`` words, ``m1``, ``m2`` and ``m3`` of them once, twice and more often, and follows ``n``.
    """

    def __init__(self, words: DataFrame, pairs: DataFrame, weights: Weights):
        self.words, self.pairs, self.weights = words, pairs, weights
        self.d, self.unknown = weights.d, weights.unknown


def train(rows: DataFrame) -> Model:
    rounds = [materialize(_count_pairs(rows, k, COUNT_ROUNDS), "kn-pairs") for k in range(COUNT_ROUNDS)]
    pairs = reduce(DataFrame.unionByName, rounds)
    d = _discounts_of(pairs, "c")
    after = pairs.groupBy(F.col("h").alias("code")).agg(F.sum("c").alias("total"), *[F.count_if(t).alias(f"m{k}") for k, t in ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") > 2))])
    follows = materialize(pairs.groupBy(F.col("w").alias("code")).agg(F.count("*").alias("n")), "kn-continuations")
    d1 = _discounts_of(follows, "n")
    kinds, types = follows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    lost = follows.agg(F.coalesce(F.sum(F.least(F.col("n"), _discount(F.col("n"), d1))), F.lit(0.0))).first()[0]
    unknown = (lost / kinds if kinds else 1.0) / (types + 1)
    words = after.join(follows, "code", "full").select("code", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS[0]])
    words, short = materialize(words, "kn-words"), materialize(_with_codes(pairs), "kn-counts")
    discard(rows.sparkSession, *rounds, follows)
    return Model(words, short, Weights(d, d1, kinds, unknown))


def _possible(tokens: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(``UNKNOWN`` and the distinct tokens that may be in the model, each token's number among them).

    A bigram of the model has both its words in the model, so no other word need be told from ``UNKNOWN``.
    """
    own, number = np.unique(tokens, return_inverse=True)
    may = in_bloom(bits, _wide(own).view(np.int64))
    return np.append(UNKNOWN, own[may]), np.where(may, np.cumsum(may), 0)[number]


def _requests(tokens: np.ndarray, bits: list[np.ndarray], shards: int) -> dict[tuple[int, int], np.ndarray]:
    """(0 word or 1 bigram, shard) -> the sorted distinct codes that may be in the model."""
    out = {}
    for what, codes in ((0, tokens), (1, _pairs(tokens))):
        own = np.unique(codes)
        own = own[in_bloom(bits[what], own.view(np.int64))]
        shard = (own % U(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        out |= {(what, k): own[order[edges[k] : edges[k + 1]]] for k in range(shards) if edges[k] < edges[k + 1]}
    return out


def _short(codes: np.ndarray) -> np.ndarray:
    """The upper 40 bits of codes, in the same order; a shard's codes have their remainder in common."""
    return codes >> U(24)


def _ask(rows: DataFrame, base: str, shards: int, known) -> DataFrame:
    """Store the tokens of blocks; kind 0: (block, number, doc) for each row; kind 1: a block's requests to a shard."""
    doc_type = ddl(rows.schema["doc"].dataType)
    names = ["kind", "block", "number", "doc", "shard", "what", "codes"]

    def flush(texts: list[bytes], docs: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        ident = secrets.randbits(62)
        bits = known.value
        tokens, starts = _tokens(texts)
        own, number = _possible(tokens, bits[0])
        put_file(base, f"{ident:x}", textcodes.pack_tokens(own, number, starts))
        doc = pa.concat_arrays(docs)
        n = len(doc)
        yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([ident] * n, pa.int64()), pa.array(range(n), pa.int32()), doc, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        out = [(k, what, pack_counts(np.diff(_short(codes), prepend=U(0)))) for (what, k), codes in _requests(_wide(own[number]), bits, shards).items()]
        n = len(out)
        yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.array([ident] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, doc.type), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary())))], names=names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, docs, size = [], [], 0
        for b in batches:
            start = 0
            for i, text in enumerate(textcodes.binary(b.column("text"))):
                texts.append(text)
                size += len(text) + 8
                if size >= BLOCK_BYTES:
                    docs.append(b.column("doc").slice(start, i + 1 - start))
                    yield from flush(texts, docs)
                    texts, docs, size, start = [], [], 0, i + 1
            if start < b.num_rows:
                docs.append(b.column("doc").slice(start))
        if docs:
            yield from flush(texts, docs)

    return rows.mapInArrow(apply, f"kind int, block long, number int, doc {doc_type}, shard int, what int, codes binary")


def _deal(table: DataFrame, what: int, shards: int) -> DataFrame:
    """A table of the model as (shard, what, codes, counts): some sorted codes of a shard in one row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column("code").to_numpy().view(U)
            shard = (code % U(shards)).astype(np.int64)
            order = np.lexsort((code, shard))
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            counts = [b.column(c).to_numpy() for c in COUNTS[what]]
            parts = [(k, order[edges[k] : edges[k + 1]]) for k in range(shards) if edges[k] < edges[k + 1]]
            codes = [pack_counts(np.diff(_short(code[at]), prepend=U(0))) for _, at in parts]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([what] * len(parts), pa.int32()), pa.array(codes, pa.binary()), pa.array([pack_counts(*(c[at] for c in counts)) for _, at in parts], pa.binary())], names=["shard", "what", "codes", "counts"])

    return table.select("code", *COUNTS[what]).mapInArrow(apply, "shard int, what int, codes binary, counts binary")


def _slices(tables: DataFrame, slices: int) -> DataFrame:
    """A copy of the model's rows for each slice, made by as many tasks as the number of copies asks for."""
    tasks = -(-slices // COPIES)
    dealt = tables.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    if tasks > 1:
        dealt = dealt.repartition(tasks, "task")
    last = F.least(F.lit(slices), (F.col("task") + 1) * COPIES) - 1
    return dealt.withColumn("slice", F.explode(F.sequence(F.col("task") * COPIES, last))).drop("task")


def _codes(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_counts(blob)[0].view(U))


def _join_counts(requests: pa.Table, model: pa.Table) -> pa.Table:
    """A shard's answers: which requested codes it has, and their counts."""
    parts = model.to_pylist()
    tables = []
    for k in (0, 1):
        own = [r for r in parts if r["what"] == k]
        code = np.concatenate([_codes(r["codes"]) for r in own] or [np.empty(0, dtype=U)])
        counts = np.concatenate([unpack_counts(r["counts"]) for r in own] or [np.empty((len(COUNTS[k]), 0), dtype=np.int64)], axis=1)
        order = np.argsort(code)
        tables.append((code[order], counts[:, order]))
    out: dict[str, list] = {c: [] for c in ("block", "what", "shard", "hits", "counts")}
    for block, k, shard, blob in zip(*(requests.column(c).to_pylist() for c in ("block", "what", "shard", "codes"))):
        want = _codes(blob)
        code, counts = tables[k]
        at = np.minimum(np.searchsorted(code, want), max(len(code) - 1, 0))
        hit = code[at] == want if len(code) else np.zeros(len(want), dtype=bool)
        found = counts[:, at[hit]] if len(code) else counts
        for c, v in (("block", block), ("what", k), ("shard", shard), ("hits", np.packbits(hit).tobytes()), ("counts", pack_counts(*found))):
            out[c].append(v)
    return pa.table({"block": pa.array(out["block"], pa.int64()), "what": pa.array(out["what"], pa.int32()), "shard": pa.array(out["shard"], pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in ("hits", "counts")}})


def _score(table: pa.Table, base: str, bits: list[np.ndarray], shards: int, weights: Weights) -> pa.Table:
    block = table.column("block")[0].as_py()
    tokens, starts = textcodes.unpack_tokens(get_file(base, f"{block:x}"))
    tokens = _wide(tokens)
    asked = _requests(tokens, bits, shards)
    kinds = table.column("kind").to_numpy()
    found: tuple[list, list] = ([], [])
    for r in table.filter(pa.array(kinds == 1)).to_pylist():
        codes = asked[r["what"], r["shard"]]
        hit = np.unpackbits(np.frombuffer(r["hits"], dtype=np.uint8), count=len(codes)).astype(bool)
        found[r["what"]].append((codes[hit], unpack_counts(r["counts"])))

    def look(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of counts of the known codes, then of one unknown (all 0), and the place of each code in them."""
        own = np.concatenate([f[0] for f in found[k]] or [np.empty(0, dtype=U)])
        order = np.argsort(own)
        counts = np.concatenate([*(f[1] for f in found[k]), np.zeros((len(COUNTS[k]), 1), dtype=np.int64)], axis=1)[:, np.append(order, len(own))]
        own = own[order]
        at = np.searchsorted(own, codes)
        hit = at < len(own)
        hit[hit] = own[at[hit]] == codes[hit]
        return counts, np.where(hit, at, len(own))

    counts, at = look(tokens, 0)
    total, gamma, p = counts[0][at], weights.gamma(*counts[:4])[at], weights.low(counts[4])[at]
    counts, at = look(_pairs(tokens), 1)
    c = counts[0][at]
    seen = np.divide(c - _off(c, weights.d), total[:-1], out=np.zeros(len(c)), where=total[:-1] > 0)
    logs = np.zeros(len(tokens))
    logs[1:] = np.log10(seen + gamma[:-1] * p[1:])
    logs[starts] = 0.0
    score = np.add.reduceat(logs, starts)
    size = np.diff(np.append(starts, len(tokens))) - 1
    rows = table.filter(pa.array(kinds == 0))
    number = rows.column("number").to_numpy()
    return pa.table({"doc": rows.column("doc"), "n_tokens": pa.array(size[number]), "log10_prob": pa.array(score[number])})


def _by_rounds(rows: DataFrame, keep: list[str]) -> list[DataFrame]:
    """Rows by a hash of text and kept values, in as many rounds as their size is worth."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, min(ROUNDS, size // ROUND_BYTES))
    plain = [f"doc.`{f.name}`" for f in rows.schema["doc"].dataType if f.name in keep and isinstance(f.dataType, (T.NumericType, T.StringType))]
    place = F.pmod(F.xxhash64("text", *plain), F.lit(rounds))
    return [rows.filter(place == k) for k in range(rounds)] if rounds > 1 else [rows]


def perplexities(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", last: bool = False) -> DataFrame:
    """doc (struct of the columns ``keep``), n_tokens, log10_prob for every row; with ``last``, the model's tables are deleted once dealt."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    shards = max(n_partitions(spark), -(-(model.words.count() + model.pairs.count()) // SHARD_CODES))
    known = spark.sparkContext.broadcast([bloom_filter(t.select("code")) for t in (model.words, model.pairs)])
    tables = materialize(_deal(model.words, 0, shards).unionByName(_deal(model.pairs, 1, shards)), "kn-shards")
    if last:
        discard(spark, model.words, model.pairs)
    scored = [_score_round(some, tables, model.weights, known, shards) for some in _by_rounds(rows, keep)]
    discard(spark, tables)
    return reduce(DataFrame.unionByName, scored)


def _score_round(rows: DataFrame, tables: DataFrame, weights: Weights, known, shards: int) -> DataFrame:
    spark = rows.sparkSession
    doc_type = ddl(rows.schema["doc"].dataType)
    base = fresh_path(spark, "quality-blocks")
    asked = materialize(_ask(rows, base, shards, known), "quality-requests", partition_by="kind")
    slices = max(1, -(-asked.filter("kind = 0").select("block").distinct().count() // (SLICE_BLOCKS * shards)))
    requests = asked.filter("kind = 1").select("shard", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice"), "block", "what", "codes")
    key = ["shard", "slice"]
    answers = requests.groupBy(*key).cogroup(_slices(tables, slices).groupBy(*key)).applyInArrow(_join_counts, "block long, what int, shard int, hits binary, counts binary")
    null = F.lit(None)
    values = ["hits", "counts"]
    every = asked.filter("kind = 0").select("block", "kind", "number", "doc", null.cast("int").alias("what"), null.cast("int").alias("shard"), *[null.cast("binary").alias(c) for c in values]).unionByName(
        answers.select("block", F.lit(1).alias("kind"), null.cast("int").alias("number"), null.cast(doc_type).alias("doc"), "what", "shard", *values)
    )
    score = lambda t: _score(t, base, known.value, shards, weights)
    out = materialize(by_block(every, asked.filter("kind = 0")).groupBy("block").applyInArrow(score, f"doc {doc_type}, n_tokens long, log10_prob double"), "quality-scored")
    discard(spark, asked, base)
    return out


def quantile_by_language(scored: DataFrame, quantile: float) -> tuple[DataFrame, float | None]:
    """(lang, threshold in log10 of perplexity) and that of all: upper ends of histogram bins."""
    bins = scored.groupBy("lang", F.floor(F.col("log_ppl") / BIN).alias("bin")).agg(F.count("*").alias("n"))

    def cut(w, every) -> DataFrame:
        reached = bins.groupBy(*every, "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
        return reached.filter(F.col("upto") >= F.ceil(F.col("all") * quantile)).groupBy(*every).agg(((F.min("bin") + 1) * BIN).alias("threshold"))

    own = cut(Window.partitionBy("lang"), ["lang"])
    row = cut(Window.partitionBy(F.lit(1)), []).first()
    return own, row["threshold"] if row else None


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", trusted: int | None = None, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_tokens, log10_prob, perplexity, threshold, keep for every row of ``docs``.

    With ``trusted``, the model is learnt from about so many trusted documents in place of all.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    place = F.xxhash64(F.lit("trusted"), "id")
    good = materialize(labels.filter(F.col(f"`{label_col}`") == 1).select(F.col(f"`{id_col}`").alias("id")).filter("id IS NOT NULL").distinct().withColumn("place", place), "quality-trusted")
    n_good = good.count()
    share = 1.0 if trusted is None else min(1.0, trusted / max(1, n_good))
    held = F.pmod(F.col("place"), F.lit(HELD_OUT)) == 0
    taken = ~held & (F.pmod(F.shiftright("place", 8), F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = good.filter(taken).select("id")
    learnt = docs.join(F.broadcast(chosen) if share * n_good <= BROADCAST_ROWS else chosen, "id", "left_semi").filter("text IS NOT NULL")
    with shuffles_freed(spark):
        scored = perplexities(docs, train(learnt), keep=["id", "lang"], last=True).select("doc.id", "doc.lang", "n_tokens", "log10_prob", (-F.col("log10_prob") / F.col("n_tokens")).alias("log_ppl"))
        own, of_all = quantile_by_language(scored.join(good.filter(~taken).select("id"), "id", "left_semi"), quantile)
        own = materialize(own, "quality-thresholds").withColumnsRenamed({"lang": "own_lang", "threshold": "own"})
    out = scored.join(own, F.col("lang").eqNullSafe(F.col("own_lang")), "left").withColumn("limit", F.coalesce("own", F.lit(of_all).cast("double")))
    return out.select(F.col("id").alias("doc_id"), "lang", "n_tokens", "log10_prob", F.pow(F.lit(10.0), "log_ppl").alias("perplexity"), F.pow(F.lit(10.0), "limit").alias("threshold"), F.coalesce(F.col("log_ppl") <= F.col("limit"), F.lit(True)).alias("keep"))

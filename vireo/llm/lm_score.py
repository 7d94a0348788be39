"""Scoring texts with a weighted backoff automaton made of smoothed n-grams.

States are the histories of up to ``order - 1`` tokens that training text has. A seen n-gram is an arc with the weight
(c(hw) + b * P'(w)) / (c(h) + b), where P' is the distribution of the shorter history's state, and leads to the longest
history that it ends in; any other word takes the failure arc of weight b / (c(h) + b) to that shorter history
(Dirichlet smoothing, so each state's weights add up to one). The lowest state has an arc for every word, the add-0.1
unigram distribution. A text is read once from left to right: the state is carried from token to token, failure
arcs are followed until there is an arc for the token, and the logarithms of all weights on the way are added up. The
texts of a block are read in step with each other; long ones are cut, each part entering in the state that its
predecessor ends in (which the ``order - 1`` tokens before it determine).

The counts come from the whole training part: every block of texts sends each of its distinct n-grams once,
with its count, to the n-gram's hash bucket, and gets the corpus count back. Nothing is pruned and no
model has to fit into a task: a bucket holds a share of the n-grams, and a block builds the part of the automaton
that its own n-grams reach. ``b`` is chosen from a grid by the leave-one-out likelihood of all training tokens;
arcs carry a weight for each value of the grid, so that texts are read once.

Defined cases: null and empty texts are the end token alone; very long texts are held whole by the task that stores
them; with no training text, counts are 0 and every probability is that of the lowest state; an empty table gives no
rows; a null id counts as text 'null' in the choice of folds; repeated rows are texts like others; equal
likelihoods choose the smallest strength; extra columns are not read.
"""

from __future__ import annotations

import io
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcodes
from .common import by_block, ddl, ensure_importable, fresh_path, get_file, materialize, n_partitions, put_file
from .textcodes import pack40, unpack40

ORDER = 2
ADD = 0.1
GRID = (2.0, 8.0, 32.0, 128.0, 512.0, 2048.0, 16384.0, 262144.0)
BLOCK_BYTES = 8 << 20
BUCKET = 1_500_000  # n-grams aimed at for a bucket
PART = 512  # tokens of a text that are read in one go
GROUP = 1 << 18  # tokens whose automaton is held at once
BEGIN, END = np.uint64(0x9C0FFEE1BEEF0001), np.uint64(0x9C0FFEE1BEEF0002)
U = np.uint64


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token codes, each text's begin among them): begin, words, end, for each text."""
    parts, starts, at = [], [], 0
    for words in textcodes.word_hashes(texts):
        starts.append(at)
        parts += [np.array([BEGIN]), words, np.array([END])]
        at += len(words) + 2
    return np.concatenate(parts) if parts else np.empty(0, dtype=U), np.array(starts, dtype=np.int64)


def _ngrams(tokens: np.ndarray, starts: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, codes of the k-grams that end at each token, whether they lie in one text)."""
    place = np.arange(len(tokens)) - np.repeat(starts, np.diff(np.append(starts, len(tokens))))
    with np.errstate(over="ignore"):
        code = textcodes.mix(tokens + U(1))
        yield 1, code, np.ones(len(tokens), dtype=bool)
        for k in range(2, order + 1):
            longer = np.zeros_like(code)
            longer[1:] = textcodes.mix(code[:-1] * U(0xA0761D6478BD642F) + tokens[1:] + U(k))
            code = longer
            yield k, code, place >= k - 1


def _distinct(code: np.ndarray, inside: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes ordered by (bucket, code), the bucket edges, and each token's number among them (where inside)."""
    own, back = np.unique(code[inside], return_inverse=True)
    bucket = (own % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return own[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), rank[back], order


def _gather(rows: DataFrame, base: str, buckets: int, order: int) -> DataFrame:
    """Store blocks; kind 0: (block, number, doc, train) for each row; kind 1: n-grams and counts for a bucket."""
    doc_type = ddl(rows.schema["doc"].dataType)
    names = ["kind", "block", "number", "doc", "train", "bucket", "k", "keys", "counts"]
    mask = U((1 << 40) - 1)

    def flush(texts: list[bytes], train: list[bool], docs: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        ident = secrets.randbits(62)
        f = io.BytesIO()
        np.savez(f, data=np.frombuffer(b"".join(texts), dtype=np.uint8), ends=np.cumsum([len(t) for t in texts]), train=np.array(train))
        put_file(base, f"{ident:x}", zstandard.compress(f.getvalue(), 3))
        doc = pa.concat_arrays(docs)
        n = len(doc)
        none = pa.nulls(n, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([ident] * n, pa.int64()), pa.array(range(n), pa.int32()), doc, pa.array(train, pa.bool_()), none, none, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
        tokens, starts = _tokens(texts)
        learnt = np.repeat(np.array(train), np.diff(np.append(starts, len(tokens))))
        cols: dict[str, list] = {c: [] for c in ("bucket", "k", "keys", "counts")}
        for k, code, inside in _ngrams(tokens, starts, order):
            own, edges, number, _ = _distinct(code, inside, buckets)
            counts = np.bincount(number[learnt[inside]], minlength=len(own)).astype(np.uint32)
            for b in np.flatnonzero(np.diff(edges)).tolist():
                s, e = edges[b], edges[b + 1]
                cols["bucket"].append(b)
                cols["k"].append(k)
                cols["keys"].append(pack40(own[s:e] // U(buckets) & mask))
                cols["counts"].append(zstandard.compress(counts[s:e].tobytes(), 1))
        n = len(cols["bucket"])
        yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.array([ident] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, doc.type), pa.nulls(n, pa.bool_()), pa.array(cols["bucket"], pa.int32()), pa.array(cols["k"], pa.int32()), pa.array(cols["keys"], pa.binary()), pa.array(cols["counts"], pa.binary())], names=names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, train, docs, size = [], [], [], 0
        for b in batches:
            start = 0
            flags = b.column("train").to_pylist()
            for i, text in enumerate(textcodes.binary(b.column("text"))):
                texts.append(text)
                train.append(bool(flags[i]))
                size += len(text) + 8
                if size >= BLOCK_BYTES:
                    docs.append(b.column("doc").slice(start, i + 1 - start))
                    yield from flush(texts, train, docs)
                    texts, train, docs, size, start = [], [], [], 0, i + 1
            if start < b.num_rows:
                docs.append(b.column("doc").slice(start))
        if docs:
            yield from flush(texts, train, docs)

    return rows.mapInArrow(apply, f"kind int, block long, number int, doc {doc_type}, train boolean, bucket int, k int, keys binary, counts binary")


def _total(table: pa.Table, begin_key: int, begin_bucket: int) -> pa.Table:
    """The corpus counts of a bucket's n-grams, for each row in the order sent; and its numbers of words."""
    keys = [unpack40(x) for x in table.column("keys").to_pylist()]
    ks = table.column("k").to_pylist()
    out: list[bytes | None] = [None] * len(keys)
    types = words = 0
    for k in set(ks):
        mine = [i for i, x in enumerate(ks) if x == k]
        key = np.concatenate([keys[i] for i in mine])
        count = np.concatenate([np.frombuffer(zstandard.decompress(table.column("counts")[i].as_py()), dtype=np.uint32) for i in mine]).astype(np.int64)
        own, back = np.unique(key, return_inverse=True)
        total = np.bincount(back, weights=count, minlength=len(own)).astype(np.int64)
        if k == 1:
            real = total > 0
            if table.column("bucket")[0].as_py() == begin_bucket:
                real &= own != U(begin_key)
            types, words = int(real.sum()), int(total[real].sum())
        each, at = total[back], 0
        for i in mine:
            out[i] = zstandard.compress(each[at : at + len(keys[i])].tobytes(), 1)
            at += len(keys[i])
    n = len(out)
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "k": table.column("k"), "totals": pa.array(out, pa.binary()), "types": pa.array([types] + [0] * (n - 1), pa.int64()), "words": pa.array([words] + [0] * (n - 1), pa.int64())})


class Automaton:
    """States, arcs and failure arcs of some texts' n-grams, with a weight for each strength of ``grid``.

    ``counts[k - 1]``: corpus count of each distinct k-gram; ``number[k - 1]``: the k-gram that ends at each token, -1
    where it would begin before its text. State 0 is the empty history.
    """

    def __init__(self, counts: list[np.ndarray], number: list[np.ndarray], n: int, v: int, grid: tuple[float, ...] = GRID):
        strength = np.array(grid)
        order, self.n_words = len(counts), len(counts[0])
        last = []  # a token at which each distinct k-gram ends
        for c, x in zip(counts, number):
            at = np.zeros(len(c), dtype=np.int64)
            inside = np.flatnonzero(x >= 0)
            at[x[inside]] = inside
            last.append(at)
        state, size = [], 1
        for c in counts[: order - 1]:
            own = np.zeros(len(c), dtype=np.int64)  # 0: no state of its own
            seen = np.flatnonzero(c > 0)
            own[seen] = np.arange(size, size + len(seen))
            state.append(own)
            size += len(seen)
        self.fail = np.zeros(size, dtype=np.int64)
        self.fail_weight = np.zeros((size, len(grid)))
        low = (counts[0] + ADD) / (n + ADD * (v + 1))
        self.word_weight = np.log10(low)
        self.word_target = state[0] if order > 1 else np.zeros(self.n_words, dtype=np.int64)
        p = np.repeat(low[:, None], len(grid), axis=1)
        keys, weights, targets = [], [], []
        for k in range(1, order):  # (k + 1)-grams: arcs of the states of k-grams
            seen = np.flatnonzero(counts[k - 1] > 0)
            own, at = state[k - 1][seen], last[k - 1][seen]
            if k > 1:
                self.fail[own] = state[k - 2][number[k - 2][at]]
            self.fail_weight[own] = np.log10(strength / (counts[k - 1][seen][:, None] + strength))
            seen = np.flatnonzero(counts[k] > 0)
            at = last[k][seen]
            history = number[k - 1][at - 1]
            shorter = p[number[k - 1][at]]
            p = np.zeros((len(counts[k]), len(grid)))
            p[seen] = (counts[k][seen][:, None] + strength * shorter) / (counts[k - 1][history][:, None] + strength)
            keys.append(state[k - 1][history] * self.n_words + number[0][at])
            weights.append(np.log10(p[seen]))
            targets.append(state[k][seen] if k < order - 1 else state[k - 1][number[k - 1][at]])
        key = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
        by_key = np.argsort(key)
        self.keys = key[by_key]
        self.weights = np.concatenate(weights)[by_key] if keys else np.zeros((0, len(grid)))
        self.targets = np.concatenate(targets)[by_key] if keys else key

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, weights) of reading a word in each state."""
        weight = np.zeros((len(word), self.fail_weight.shape[1]))
        state, out, open_ = state.copy(), np.zeros(len(word), dtype=np.int64), np.arange(len(word))
        while len(open_):
            now = state[open_]
            lowest = now == 0
            done = open_[lowest]
            weight[done] += self.word_weight[word[done]][:, None]
            out[done] = self.word_target[word[done]]
            open_, now = open_[~lowest], now[~lowest]
            if not len(open_):
                break
            key = now * self.n_words + word[open_]
            arc = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[arc] == key if len(self.keys) else np.zeros(len(key), dtype=bool)
            weight[open_[hit]] += self.weights[arc[hit]]
            out[open_[hit]] = self.targets[arc[hit]]
            open_, now = open_[~hit], now[~hit]
            weight[open_] += self.fail_weight[now]
            state[open_] = self.fail[now]
        return out, weight

    def read(self, words: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
        """log10 probabilities of texts, for each strength; a text's first token, its begin, is only a history."""
        ends = np.append(starts[1:], len(words))
        parts = np.maximum(-(-(ends - starts - 1) // PART), 1)
        text = np.repeat(np.arange(len(starts)), parts)
        within = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        scored = starts[text] + 1 + within * PART
        until = np.minimum(scored + PART, ends[text])
        first = np.maximum(scored - max(order - 1, 1), starts[text])
        longest = np.argsort(first - until, kind="stable")
        first, scored, until, text = first[longest], scored[longest], until[longest], text[longest]
        size = until - first
        state = np.zeros(len(first), dtype=np.int64)
        total = np.zeros((len(first), self.fail_weight.shape[1]))
        for t in range(int(size.max(initial=0))):
            m = int(np.searchsorted(-size, -t, side="left"))
            state[:m], weight = self.step(state[:m], words[first[:m] + t])
            weight[first[:m] + t < scored[:m]] = 0
            total[:m] += weight
        out = np.zeros((len(starts), total.shape[1]))
        np.add.at(out, text, total)
        return out


def _left_out(counts: list[np.ndarray], number: list[np.ndarray], at: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 likelihood, for each strength, of the training tokens ``at`` under a model that hasn't learnt the one in question."""

    def less(k: int, places: np.ndarray) -> np.ndarray:
        x = number[k][places]
        return np.where(x >= 0, np.maximum(counts[k][x] - 1, 0), 0) if len(counts[k]) else np.zeros(len(places), dtype=np.int64)

    low = (less(0, at) + ADD) / (max(n - 1, 0) + ADD * (v + 1))
    steps = [(number[k][at] >= 0, less(k, at), less(k - 1, at - 1)) for k in range(1, len(counts))]
    out = []
    for b in GRID:
        p = low
        for inside, c, h in steps:
            p = np.where(inside, (c + b * p) / (h + b), p)
        out.append(np.log10(p).sum())
    return np.array(out)


def _of_part(counts: list[np.ndarray], number: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Counts and numbers of the n-grams that a stretch of tokens has."""
    few, renamed = [], []
    for c, x in zip(counts, number):
        inside = x >= 0
        own, back = np.unique(x[inside], return_inverse=True)
        few.append(c[own])
        renamed.append(np.full(len(x), -1, dtype=np.int64))
        renamed[-1][inside] = back
    return few, renamed


def _score(table: pa.Table, base: str, buckets: int, order: int, n: int, v: int) -> pa.Table:
    block = table.column("block")[0].as_py()
    with np.load(io.BytesIO(zstandard.decompress(get_file(base, f"{block:x}")))) as f:
        data, ends, train = f["data"].tobytes(), f["ends"], f["train"]
    texts = [data[s:e] for s, e in zip(np.concatenate([[0], ends[:-1]]).astype(int).tolist(), ends.tolist())]
    tokens, starts = _tokens(texts)
    del data, texts
    kinds = table.column("kind").to_numpy()
    answers = table.filter(pa.array(kinds == 1))
    got = {(k, b): t for k, b, t in zip(*(answers.column(c).to_pylist() for c in ("k", "bucket", "totals")))}
    counts, numbers = [], []
    for k, code, inside in _ngrams(tokens, starts, order):
        own, edges, number, _ = _distinct(code, inside, buckets)
        counts.append(np.concatenate([np.frombuffer(zstandard.decompress(got[k, b]), dtype=np.int64) for b in np.flatnonzero(np.diff(edges)).tolist()] or [np.empty(0, dtype=np.int64)]))
        numbers.append(np.full(len(tokens), -1, dtype=np.int32))
        numbers[-1][inside] = number
        del code, own, number
    del got, answers
    size = len(tokens)
    del tokens
    scores, base_score = np.zeros((len(starts), len(GRID))), np.zeros(len(starts))
    n_known, likelihood = np.zeros(len(starts), dtype=np.int64), np.zeros(len(GRID))
    group = starts // GROUP
    for first in np.unique(group, return_index=True)[1].tolist():  # texts that begin in the same stretch
        last = int(np.searchsorted(group, group[first], side="right"))
        a, b = int(starts[first]), int(starts[last]) if last < len(starts) else size
        part = slice(first, last)
        c, x = _of_part(counts, [k[a:b] for k in numbers])
        begins = starts[part] - a
        real = np.ones(b - a, dtype=bool)
        real[begins] = False
        machine = Automaton(c, x, n, v)
        scores[part] = machine.read(x[0], begins, order)
        base_score[part] = np.add.reduceat(np.where(real, machine.word_weight[x[0]], 0), begins)
        n_known[part] = np.add.reduceat(real & (c[0][x[0]] > 0), begins)
        del machine
        likelihood += _left_out(c, x, np.flatnonzero(real & np.repeat(train[part], np.diff(np.append(begins, b - a)))), n, v)
    rows = table.filter(pa.array(kinds == 0))
    number = rows.column("number").to_numpy()
    n_tokens = np.diff(np.append(starts, size)) - 1
    listed = lambda x: pa.array(list(x), pa.list_(pa.float64()))
    return pa.table({"doc": rows.column("doc"), "train": rows.column("train"), "n_tokens": pa.array(n_tokens[number]), "n_known": pa.array(n_known[number]), "base_score": pa.array(base_score[number]), "scores": listed(scores[number]), "left_out": listed([likelihood.tolist()] + [None] * (len(number) - 1))})


def score_texts(docs: DataFrame, train: Column, order: int = ORDER, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc (struct of the columns ``keep``), train, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    ensure_importable(spark)
    keep = list(docs.columns) if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{text_col}`").alias("text"), train.alias("train"))
    doc_type = ddl(rows.schema["doc"].dataType)
    base = fresh_path(spark, "lm-blocks")
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    buckets = max(n_partitions(spark), size * order // 8 // BUCKET)
    gathered = materialize(_gather(rows, base, buckets, order), "lm-counts", partition_by="kind")
    with np.errstate(over="ignore"):
        begin = int(textcodes.mix(np.array([BEGIN + U(1)]))[0])
    begin_key, begin_bucket = begin // buckets & ((1 << 40) - 1), begin % buckets
    totals = gathered.filter("kind = 1").select("bucket", "block", "k", "keys", "counts").groupBy("bucket").applyInArrow(lambda t: _total(t, begin_key, begin_bucket), "block long, bucket int, k int, totals binary, types long, words long")
    totals = materialize(totals, "lm-totals")
    v, n = (int(x or 0) for x in totals.agg(F.sum("types"), F.sum("words")).first())
    null = F.lit(None)
    every = gathered.filter("kind = 0").select("block", "kind", "number", "doc", "train", null.cast("int").alias("bucket"), null.cast("int").alias("k"), null.cast("binary").alias("totals")).unionByName(
        totals.select("block", F.lit(1).alias("kind"), null.cast("int").alias("number"), null.cast(doc_type).alias("doc"), null.cast("boolean").alias("train"), "bucket", "k", "totals")
    )
    schema = f"doc {doc_type}, train boolean, n_tokens long, n_known long, base_score double, scores array<double>, left_out array<double>"
    scored = materialize(by_block(every, gathered.filter("kind = 0")).groupBy("block").applyInArrow(lambda t: _score(t, base, buckets, order, n, v), schema), "lm-scored")
    likelihood = scored.agg(*[F.sum(F.col("left_out")[i]).alias(f"x{i}") for i in range(len(GRID))]).first()
    best = max(range(len(GRID)), key=lambda i: likelihood[i] if likelihood[i] is not None else 0.0)
    return scored.select("doc", "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", F.col("scores")[best].alias("score"))

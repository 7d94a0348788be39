"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +-1. A trigram binds its letters by multiplication after rotating the
first by two places and the second by one; a text bundles (adds) its trigrams; a language's prototype bundles
its training texts. A text's language is the prototype with the largest cosine, and that cosine, at least 0,
is the score. Letters are lower-cased; any run of other characters is one blank, which has a vector too.

Training adds up, in each task, one vector for each language seen, so only tasks x languages vectors are
shuffled, and the driver receives one vector for each language: languages are few by nature, and more than
``MAX_LANGUAGES`` distinct labels are an error rather than a silent cut. Whole texts are read, in pieces that
carry the last two letters over.

:func:`unlike_any` tells texts that are like no language: vectors of unrelated texts have cosines of about normal
distribution with deviation 1 / sqrt(DIM), whatever their length.

Defined cases: a text that is null, empty or without letters is ``und`` with score 0; very long texts are read in
pieces; rows with null text or lang are not learnt from; repeated rows count as often as they stand; with nothing to
learn from, every text is ``und``; an empty table gives no rows; ties go to the first language by code point; a null id
counts as text 'null' in the choice of folds; extra columns are not read (columns named as the results are replaced).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ddl, ensure_importable

DIM = 1024
PIECE = 1 << 19  # characters handled at once
MAX_LANGUAGES = 4096
ENOUGH = 100  # trigrams
NOISE = 4  # deviations of the cosine with an unrelated text
BLANK = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


@lru_cache(maxsize=50_000)
def letter_vector(code: int) -> np.ndarray:
    return (np.random.Generator(np.random.PCG64(7_919 + code)).integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.int8)


@lru_cache(maxsize=50_000)
def _letter_bits(code: int) -> np.ndarray:
    return letter_vector(code) < 0


class _Trigrams:
    """Bound vectors of trigrams, a bit for each component, as a worker holds them on (some 8 MB) beside later stages' needs."""

    def __init__(self, most: int = 65_536):
        self.most, self.row, self.table = most, {}, np.empty((most, DIM // 8), dtype=np.uint8)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """For each trigram, which components are -1."""
        if len(self.row) + len(codes) > self.most:
            self.row.clear()
        if len(codes) > self.most:
            return np.stack([self._bind(int(c)) for c in codes])
        at = np.empty(len(codes), dtype=np.int64)
        for i, c in enumerate(codes.tolist()):
            r = self.row.get(c)
            if r is None:
                r = self.row[c] = len(self.row)
                self.table[r] = np.packbits(self._bind(c))
            at[i] = r
        return np.unpackbits(self.table[at], axis=1)

    @staticmethod
    def _bind(code: int) -> np.ndarray:
        """The product of signs is the exclusive or of what is negative."""
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(_letter_bits(a), 2) ^ np.roll(_letter_bits(b), 1) ^ _letter_bits(c)


def normalized(text: str, carry: np.ndarray) -> np.ndarray:
    """Code points with one blank for each run of non-letters, behind ``carry``, the two before them."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    a = np.where(_letters()[a], a, BLANK)
    a = np.concatenate([carry, a])
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = (a[1:] != BLANK) | (a[:-1] != BLANK)
    return a[keep]


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """(trigram codes, counts, whether there is a letter) of a whole text."""
    carry, found, letters = np.array([BLANK], dtype=np.int64), [], False
    for at in range(0, max(len(text), 1), PIECE):
        a = normalized(text[at : at + PIECE] + (" " if at + PIECE >= len(text) else ""), carry)
        letters = letters or bool((a != BLANK).any())
        if len(a) >= 3:
            found.append(np.unique((a[:-2] << 42) | (a[1:-1] << 21) | a[2:], return_counts=True))
        carry = a[-2:]
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), letters
    if len(found) == 1:
        return *found[0], letters
    codes, back = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
    counts = np.zeros(len(codes), dtype=np.int64)
    np.add.at(counts, back, np.concatenate([x[1] for x in found]))
    return codes, counts, letters


def text_vectors(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vectors, whether there is a letter, numbers of trigrams) for groups of texts in order."""
    bound = _cached_trigrams()
    group: list[tuple[np.ndarray, np.ndarray, bool]] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, back = np.unique(np.concatenate([g[0] for g in group]), return_inverse=True)
        counts = np.zeros((len(group), len(codes)), dtype=np.float32)
        counts[np.repeat(np.arange(len(group)), [len(g[0]) for g in group]), back] = np.concatenate([g[1] for g in group])
        out = np.repeat(counts.sum(axis=1, keepdims=True), DIM, axis=1)
        for at in range(0, len(codes), 2048):
            out -= 2 * (counts[:, at : at + 2048] @ bound(codes[at : at + 2048]).astype(np.float32))
        return out, np.array([g[2] for g in group]), np.array([int(g[1].sum()) for g in group])

    for t in texts:
        group.append(trigram_counts(t or ""))
        size += len(group[-1][0])
        if len(group) >= 256 or size > 100_000:
            yield flush()
            group, size = [], 0
    if group:
        yield flush()


@lru_cache(maxsize=1)
def _cached_trigrams() -> _Trigrams:
    return _Trigrams()


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for start in range(0, b.num_rows, 1024):
            part = b.slice(start, 1024)
            langs, at = part.column("lang").to_pylist(), 0
            for vectors, _, _ in text_vectors(part.column("text").to_pylist()):
                for v, lang in zip(vectors, langs[at : at + len(vectors)]):
                    if lang in sums:
                        sums[lang] += v
                    else:
                        sums[lang] = v.astype(np.float64)
                at += len(vectors)
    if sums:
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})


def learn_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in code point order and their prototypes, of length 1."""
    ensure_importable(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    parts = rows.mapInArrow(_learn, "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    got = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector")).limit(MAX_LANGUAGES + 1).collect()
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} language labels")
    got.sort(key=lambda r: r["lang"].encode())
    p = np.array([r["vector"] for r in got], dtype=np.float64).reshape(len(got), DIM)
    norm = np.linalg.norm(p, axis=1, keepdims=True)
    return [r["lang"] for r in got], (p / np.where(norm > 0, norm, 1)).astype(np.float32)


def score_texts(texts: list[str | None], langs: list[str], prototypes: np.ndarray) -> tuple[list[str], list[float], list[int]]:
    """(language, score, number of trigrams) of each text."""
    pred: list[str] = []
    score: list[float] = []
    size: list[int] = []
    for vectors, letters, sizes in text_vectors(texts):
        size += sizes.tolist()
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        cosines = (vectors / np.where(norm > 0, norm, 1)) @ prototypes.T if len(langs) else np.zeros((len(vectors), 0))
        for c, letter in zip(cosines, letters):
            known = bool(letter) and len(langs) > 0
            k = int(np.argmax(c)) if known else 0
            pred.append(langs[k] if known else "und")
            score.append(float(min(1.0, max(0.0, c[k]))) if known else 0.0)
    return pred, score, size


def identify_languages(docs: DataFrame, langs: list[str], prototypes: np.ndarray, text_col: str = "text", keep: list[str] | None = None, with_size: bool = False) -> DataFrame:
    """Columns ``keep`` of ``docs``, lang_pred, score and, if asked for, n_trigrams, in one scan without a shuffle."""
    ensure_importable(docs.sparkSession)
    keep = list(docs.columns) if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    schema = ddl(rows.schema["doc"].dataType)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                pred, score, size = score_texts(part.column("text").to_pylist(), langs, prototypes)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(size, pa.int64())], names=["doc", "lang_pred", "score", "n_trigrams"])

    out = rows.mapInArrow(apply, f"doc {schema}, lang_pred string, score double, n_trigrams long")
    made = ["lang_pred", "score"] + ["n_trigrams"] * with_size
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in keep if c not in made], *made)


def unlike_any(score: str = "score", n_trigrams: str = "n_trigrams") -> Column:
    """Whether a text of some length is no more like any language than unrelated letters are.

    Shorter texts share so few trigrams with a prototype that their cosine tells nothing; they are never unlike.
    """
    return (F.col(n_trigrams) >= ENOUGH) & (F.col(score) < NOISE / DIM**0.5)


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % folds

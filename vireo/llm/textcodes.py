"""Vectorised text codes: word hashes, shingle sets and rolling window hashes over UTF-8 bytes (NumPy, no loops over bytes)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import xxhash
import zstandard

U = np.uint64
TILE = 1 << 19  # bytes hashed at once: bounds memory, whatever the length of a text
LONG_WORD = 128  # longer words are hashed by xxh3: sums of powers modulo 2^64 collide on crafted words of some thousand bytes
MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so powers have inverses mod 2^64
BLANK = re.compile(rb"[ \t-\r]")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=U) * U(MULTIPLIER))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER^i and its inverse, i < n."""
    inverse = pow(MULTIPLIER, -1, 1 << 64)
    with np.errstate(over="ignore"):
        out = []
        for base in (MULTIPLIER, inverse):
            p = np.full(n, base, dtype=U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def prefix_codes(data: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] == M^i * hash(data[i:j]); len(data) + 1 long, len(data) <= 4 * TILE."""
    size = TILE if len(data) <= TILE else 4 * TILE
    powers, _ = _powers(size + 1)
    out = np.zeros(len(data) + 1, dtype=U)
    with np.errstate(over="ignore"):
        np.cumsum(_byte_values()[data] * powers[: len(data)], out=out[1:])
    return out


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each span, equal for equal bytes wherever they stand."""
    size = TILE if len(codes) - 1 <= TILE else 4 * TILE
    _, inverse = _powers(size + 1)
    with np.errstate(over="ignore"):
        return mix((codes[ends] - codes[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


@lru_cache(maxsize=1)
def _is_space() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def _tile_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of a tile."""
    word = np.empty(len(data) + 2, dtype=bool)
    word[0] = word[-1] = False
    np.logical_not(_is_space()[data], out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[0::2], edges[1::2]


def _hash_tile(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, word starts) of lower-cased bytes that hold whole words: a tile, or one enormous word."""
    a = np.frombuffer(data, dtype=np.uint8)
    starts, ends = _tile_words(a)
    if len(a) > 4 * TILE:
        if len(starts) > 1:
            raise ValueError("a piece of several words is over the bound")
        hashes = np.empty(len(starts), dtype=U)
    else:
        hashes = span_hashes(prefix_codes(a), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return hashes, starts


def _pieces(data: bytes) -> Iterator[bytes]:
    """Parts of a long text of TILE bytes at most, cut only at white space; a longer word is a part of its own."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > TILE:
            blanks = np.flatnonzero(_is_space()[np.frombuffer(data, dtype=np.uint8, count=TILE - 1, offset=at + 1)])
            if len(blanks):
                end = at + 1 + int(blanks[-1])
            elif found := BLANK.search(data, at + TILE):
                end = found.start()
        yield data[at:end]
        at = end


def word_hashes(texts: Iterable[bytes], lower: bool = True) -> Iterator[np.ndarray]:
    """The 64-bit hashes of each text's words (A-Z lower-cased), in order; short texts are hashed together."""
    held: list[bytes] = []
    size = 0
    case = LOWER if lower else bytes(range(256))

    def flush() -> Iterator[np.ndarray]:
        hashes, starts = _hash_tile(b" ".join(held).translate(case))
        ends = np.cumsum([len(x) + 1 for x in held])
        yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))

    for t in texts:
        if held and size + len(t) > TILE:
            yield from flush()
            held, size = [], 0
        if len(t) > TILE:
            yield np.concatenate([_hash_tile(p.translate(case))[0] for p in _pieces(t)])
        else:
            held.append(t)
            size += len(t) + 1
    if held:
        yield from flush()


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, no word none."""
    if len(words) == 0:
        return words
    k = min(n, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - k + 1, U(k), dtype=U)
        for i in range(k):
            out = mix(out * U(0xA0761D6478BD642F) + words[i : len(words) - k + 1 + i])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) > 1 else out


def set_code(s: np.ndarray) -> int:
    """64-bit signed code of a sorted set of hashes."""
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "little", signed=True)


def pack40(x: np.ndarray) -> bytes:
    """The lower 40 bits of each number."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack40(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(U)


def pack_counts(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of one length, compressed by planes of bytes (most upper bytes are 0)."""
    x = np.array(columns).view(np.uint8).reshape(-1, 8)
    return len(columns).to_bytes(1, "little") + zstandard.compress(np.ascontiguousarray(x.T).tobytes(), 3)


def unpack_counts(b: bytes) -> np.ndarray:
    """The columns as rows of signed numbers."""
    planes = np.frombuffer(zstandard.decompress(b[1:]), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.int64).reshape(b[0], -1)


def pack_tokens(own: np.ndarray, number: np.ndarray, starts: np.ndarray) -> bytes:
    """Tokens ``own[number]`` (``own`` ascends) of texts that begin at ``starts``; frequent ones get small numbers."""
    count = np.bincount(number, minlength=len(own))
    rank = np.empty(len(own), dtype=np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(own))
    parts = pack_counts(np.diff(own, prepend=U(0)).view(np.int64), count), pack_counts(rank[number]), pack_counts(np.diff(starts, prepend=0))
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def unpack_tokens(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, starts) of ``pack_tokens``."""
    parts, at = [], 0
    while at < len(b):
        size = int.from_bytes(b[at : at + 8], "little")
        parts.append(unpack_counts(b[at + 8 : at + 8 + size]))
        at += 8 + size
    (gaps, count), (number,), (between,) = parts
    return np.cumsum(gaps.view(U))[np.argsort(-count, kind="stable")][number], np.cumsum(between)


def binary(column, step: int = 256) -> Iterator[bytes]:
    """The values of an Arrow string column as bytes, some at a time; null: empty."""
    import pyarrow as pa

    for at in range(0, len(column), step):
        yield from (x if x is not None else b"" for x in column.slice(at, step).cast(pa.binary()).to_pylist())

"""Passages of many words that stand in more than one document, by anchors.

The anchor of a window of words is its least hash of ``GRAM`` words, so equal windows have equal anchors at equal places. Only
windows whose anchor stands in another document are compared, by 128 bits of all their words. Counted are documents: what one
document repeats by itself is no such passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import textcodes

GRAM = 8
U = np.uint64


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Codes of the ``n`` values from each place on, by doubling."""
    total = max(0, len(h) - n + 1)
    out, size, step = None, 0, 1
    with np.errstate(over="ignore"):
        while total:
            if n & step:
                out = h[:total] if out is None else textcodes.mix(out[:total] * U(0xA0761D6478BD642F) + h[size : size + total])
                size += step
            if size == n:
                return out
            h = textcodes.mix(h[:-step] * U(0xE7037ED1A0B428DB) + h[step:])
            step *= 2
    return np.empty(0, dtype=U)


def _tiles(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Numbers of texts, from and up to, that have about a tile of bytes; a longer text is one of its own."""
    first = 0
    while first < len(ends):
        start = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + 4 * textcodes.TILE, side="right")))
        yield first, last
        first = last


def windows(data: np.ndarray, ends: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, two codes, text, start, end) of the windows of ``n`` words of texts that end at ``ends``, a tile at a time."""
    space = textcodes._is_space()
    gram = min(GRAM, n)
    width = n - gram + 1
    for first, last in _tiles(data, ends):
        low, own = int(ends[first - 1]) if first else 0, ends[first:last]
        part = data[low : int(own[-1])]
        begins = np.append(low, own[:-1])
        word = ~space[part]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        inner = own[:-1][(own[:-1] > low) & (own[:-1] < own[-1])] - low
        opens[inner] = word[inner]
        closes[inner - 1] = word[inner - 1]
        start, end = np.flatnonzero(opens) + low, np.flatnonzero(closes) + low + 1
        if len(start) < n:
            continue
        h = np.concatenate(list(textcodes.word_hashes((data[a:b].tobytes() for a, b in zip(begins.tolist(), own.tolist())), lower=False)))
        text = np.searchsorted(ends, start, side="right")
        whole = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
        if not len(whole):
            continue
        grams = runs(h, gram)
        anchor = np.empty(len(h) - n + 1, dtype=U)
        tile = 1 << 20
        for s in range(0, len(anchor), tile):
            some = grams[s : s + tile + width - 1]
            key = (some & ~U((1 << 21) - 1)) | np.arange(len(some), dtype=U)
            size = 1
            while 2 * size <= width:
                key = np.minimum(key[:-size], key[size:])
                size *= 2
            if width > size:
                key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
            anchor[s : s + tile] = some[(key & U((1 << 21) - 1)).astype(np.int64)]
        with np.errstate(over="ignore"):
            other = runs(textcodes.mix(h + U(0x8EBC6AF09C88C6E3)), n)
        yield anchor[whole], runs(h, n)[whole], other[whole], text[whole], start[whole], end[n - 1 :][whole]


def weighed(text: np.ndarray, weight: np.ndarray, *codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct codes and in how many documents they stand, 2 for more; ``weight``: documents of each text."""
    order = np.lexsort((text, *codes[::-1]))
    text, codes = text[order], [c[order] for c in codes]
    new = np.ones(len(text), dtype=bool)
    if len(text):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
    once = new.copy()
    once[1:] |= text[1:] != text[:-1]
    group = np.cumsum(new) - 1
    total = np.bincount(group[once], weights=weight[text[once]], minlength=int(new.sum()))
    return *[c[new] for c in codes], np.minimum(total, 2).astype(np.uint8)


def shared(block: np.ndarray, weight: np.ndarray, *codes: np.ndarray) -> np.ndarray:
    """Which entries stand in two documents, those of equal codes in other blocks included."""
    order = np.lexsort(codes)
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in codes])
    group = np.cumsum(new) - 1
    out = np.zeros(len(order), dtype=bool)
    out[order] = (np.bincount(group, weights=weight[order]) >= 2)[group] if len(order) else False
    return out

"""The arithmetic of prediction by partial matching over byte contexts, on arrays.

A gram is a context of ``order`` bytes followed by a symbol, as one integer, the symbol
in its lowest byte. Its lower orders are its lower bytes. In a context seen n times with
q different symbols, a symbol seen c times has probability (2c - 1) / 2n, and escaping to
the next shorter context q / 2n. There the symbols of the longer context are excluded
from both n and q, as they would have been coded before. Below order 0 all symbols not
yet seen are alike.

Symbols are bytes; 0xFF, which UTF-8 never holds, ends a text, and 0xFE fills the context
before its start.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

END, BEFORE = 0xFF, 0xFE
SYMBOLS = 256
#: Orders that every task holds; there can be at most 256 to the third power of their grams.
LOW = 2


def grams(raw: bytes, order: int) -> np.ndarray:
    """The gram of every byte of the text and of its end."""
    buffer = bytes([BEFORE]) * order + raw + bytes([END]) + bytes(8)
    view = np.ndarray(len(raw) + 1, dtype=">u8", buffer=buffer, strides=(1,))
    return (view >> np.uint64(8 * (7 - order))).astype(np.int64)


@dataclass
class Level:
    """The trie's nodes of one order: grams with counts, contexts with totals, all sorted."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray  # of the context's counts
    kinds: np.ndarray  # different symbols in the context
    shared: np.ndarray  # what the context's symbols count in the next shorter context

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray, shorter: Level | None) -> Level:
        """From sorted grams, all with counts."""
        contexts, first = np.unique(grams >> 8, return_index=True)
        sums = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64)
        order_mask = None if shorter is None else shorter.mask
        below = np.zeros(len(grams), np.int64) if shorter is None else shorter.count(grams & order_mask)
        return cls(grams, counts, contexts, sums(counts), sums(np.ones(len(grams), np.int64)), sums(below))

    mask: int = 0

    def count(self, grams: np.ndarray) -> np.ndarray:
        return _looked_up(self.grams, self.counts, grams)

    def place(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.contexts):
            return np.zeros(len(contexts), np.int64), np.zeros(len(contexts), bool)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return at, self.contexts[at] == contexts


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def shortened(grams: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of a lower order with their counts."""
    keys, inverse = np.unique(grams & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
    return keys, np.bincount(inverse, counts, len(keys)).astype(np.int64)


def levels(grams: np.ndarray, counts: np.ndarray, orders: range, below: list[Level]) -> list[Level]:
    """Levels of the ascending ``orders`` on top of those ``below``; ``grams`` are of the highest order, with counts."""
    out = list(below)
    for order in orders:
        level = Level.of(*shortened(grams, counts, order), out[-1] if out else None)
        level.mask = (1 << 8 * (order + 1)) - 1
        out.append(level)
    return out


def log10_probability(grams: np.ndarray, ladder: list[Level]) -> np.ndarray:
    """For each gram of the highest order: log10 of the symbol's probability in its context."""
    out = np.zeros(len(grams))
    alive = np.arange(len(grams))
    more, kinds = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)  # excluded: counts and symbols
    for level in reversed(ladder):
        if not len(alive):
            break
        own = grams[alive] & level.mask
        at, known = level.place(own >> 8)
        total = np.where(known, level.total[at] if len(level.total) else 0, 0) - more
        left = np.where(known, level.kinds[at] if len(level.kinds) else 0, 0) - kinds
        count = level.count(own)
        coded = count > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.log10(np.where(coded, 2 * count - 1, left)) - np.log10(2 * total)
        out[alive] += np.where(left > 0, step, 0.0)  # with no symbol left, the escape is certain
        if len(level.shared):
            more = np.where(known, level.shared[at], 0)
            kinds = np.where(known, level.kinds[at], 0)
        alive, more, kinds = alive[~coded], more[~coded], kinds[~coded]
    out[alive] -= np.log10(SYMBOLS - kinds)
    return out

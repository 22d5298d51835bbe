"""Sets of hashed word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

WORDS = 5
#: Bytes of a text whose words are held at once.
PIECE = 1_000_000
_FACTORS = np.random.default_rng(20).integers(1, 2**62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(raw: bytes) -> Iterator[bytes]:
    """The text in pieces that end at white space (a longer word is one piece)."""
    at = 0
    while len(raw) - at > PIECE:
        ends = [p for p in (raw.find(s, at + PIECE) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
        if not ends:
            break
        yield raw[at : min(ends)]
        at = min(ends)
    yield raw[at:]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word: A-Z lower-cased, words end at ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    parts = []
    for piece in pieces(raw):
        words = piece.lower().split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingle_set(text: str) -> np.ndarray:
    """The sorted hashes of the distinct shingles of five words; of fewer words, one hash of all; of none, nothing."""
    words = word_hashes(text)
    count = len(words)
    if not count:
        return words
    with np.errstate(over="ignore"):
        if count < WORDS:
            return _mixed((words * _FACTORS[:count]).sum(keepdims=True) + np.uint64(count))
        many = count - WORDS + 1
        sums = words[:many] * _FACTORS[0]
        for k in range(1, WORDS):
            sums += words[k : k + many] * _FACTORS[k]
        return np.unique(_mixed(sums))

"""Byte-level BPE: each merge is found in a segment tree over byte positions.

A leaf holds the rank of the pair that starts at its position, an inner node the least
of its two children, ties to the left. The root is the next merge. A merge changes
three leaves (the pair's, the swallowed one's and the left neighbour's), so it costs a
logarithmic number of node updates. Short pieces go through their trees in lockstep, one
numpy row per piece; longer ones use one tree each.

A long piece (a script without spaces, base64, an address) is first cut where no token
of the vocabulary can reach across: a token over the cut would hold the two bytes beside
it alone, or with the one before or after. No merge crosses such a place, so the parts'
ids are the piece's ids, and nearly all parts are short.

Defined results: null text is empty; empty text has no ids; repeated rows are encoded
each; nothing is ever special, so control strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import blocks, id_and_text

#: Pieces whose ids a worker remembers, and their characters; beyond it the memory starts anew.
REMEMBERED, REMEMBERED_CHARS = 300_000, 16_000_000
#: Longer pieces (in bytes) are cut before they are merged.
CUT = 24
#: Pieces of up to so many bytes are merged in lockstep.
LOCKSTEP = 512
#: Leaves of the trees that go in lockstep at once.
LEAVES = 1 << 19
#: Matches of a long text that are held at once.
MATCHES = 200_000
_NONE = np.int64(1) << 40


class Merges:
    """The ranks, the pairs that merge, and the ids of pieces seen so far."""

    def __init__(self, ranks: bytes, pattern: str):
        lines = (line.split() for line in ranks.splitlines() if line.strip())
        self.rank = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.pattern = regex.compile(pattern)
        pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_of = pairs
        self.two, self.three = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        for token in self.rank:
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = True
            for a, b, c in zip(token, token[1:], token[2:]):
                self.three[a << 16 | b << 8 | c] = True
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], _NONE)
        self.byte_ids = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("the ranks must hold every single byte")
        self.seen: dict[str, bytes] = {}
        self.seen_chars = 0

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, ``_NONE`` where there is none or an id is missing (-1)."""
        key = left << 32 | right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def parts(self, word: bytes) -> list[bytes]:
        """``word`` cut at every place that no token can reach across."""
        b = np.frombuffer(word, np.uint8).astype(np.int32)
        two = b[:-1] << 8 | b[1:]
        three = self.three[two[:-1] << 8 | b[2:]]
        reach = self.two[two]
        reach[1:] |= three
        reach[:-1] |= three
        cuts = [0, *(np.flatnonzero(~reach) + 1).tolist(), len(word)]
        return [word[x:y] for x, y in zip(cuts, cuts[1:])]

    def pieces(self, words: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        cut = {word: self.parts(word) for word in words if len(word) > CUT and word not in self.rank}
        if not cut:
            return self._merged(words)
        own = list(set().union(*cut.values(), (word for word in words if word not in cut)))
        ids = dict(zip(own, self._merged(own), strict=True))
        return [b"".join([ids[p] for p in cut[word]]) if word in cut else ids[word] for word in words]

    def _merged(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        classes: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            whole = self.rank.get(word)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(word) > LOCKSTEP:
                out[i] = self._one(word)
            else:
                classes.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append(i)
        for size, members in classes.items():
            if len(members) * 64 < size:  # too few to be worth a numpy step for each merge
                for i in members:
                    out[i] = self._one(words[i])
                continue
            step = max(1, LEAVES // size)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._lockstep([words[k] for k in part], size), strict=True):
                    out[i] = ids
        return out  # type: ignore[return-value]

    def _lockstep(self, words: list[bytes], size: int) -> list[bytes]:
        count = len(words)
        lengths = np.fromiter(map(len, words), np.int64, count)
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(count, size)
        inside = np.arange(size) < lengths[:, None]
        ids = np.full((count, size + 1), -1, np.int64)  # the last column stands for "no neighbour"
        ids[:, :size][inside] = self.byte_ids[raw[inside]]
        after = np.tile(np.minimum(np.arange(1, size + 2), size), (count, 1))
        before = np.tile(np.arange(-1, size), (count, 1))
        tree = np.full((count, 2 * size), _NONE * size, np.int64)
        place = np.arange(size)
        leaves = self.pair(ids[:, :size].ravel(), ids[:, 1:].ravel()).reshape(count, size)
        tree[:, size:] = np.minimum(leaves, _NONE) * size + np.where(leaves < _NONE, place, 0)
        level = size
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.flatnonzero(tree[:, 1] < _NONE * size)
        while live.size:
            root = tree[live, 1]
            at, rank = root % size, root // size
            gone = after[live, at]
            far = after[live, gone]
            ids[live, at], ids[live, gone] = rank, -1
            after[live, at] = far
            before[live, far] = at
            left = before[live, at]
            self._set(tree, live, gone, np.full(live.size, _NONE), size)
            self._set(tree, live, at, self.pair(ids[live, at], ids[live, far]), size)
            has = left >= 0
            rows = live[has]
            self._set(tree, rows, left[has], self.pair(ids[rows, left[has]], ids[rows, at[has]]), size)
            live = live[tree[live, 1] < _NONE * size]
        kept = ids[:, :size] >= 0
        flat = ids[:, :size][kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, rank: np.ndarray, size: int) -> None:
        node = size + leaf
        tree[rows, node] = np.where(rank < _NONE, rank * size + leaf, _NONE * size)
        while size > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            size >>= 1

    def _one(self, word: bytes) -> bytes:
        """The same merges for one long piece; a node is rank * size + place, a change goes up while it changes nodes."""
        count = len(word)
        size = 1 << (count - 1).bit_length()
        none = int(_NONE) * size
        start = self.byte_ids[np.frombuffer(word, np.uint8)]
        ids = [*start.tolist(), -1]
        ranks = self.pair(start[:-1], start[1:])
        level = np.full(size, none, np.int64)
        level[: count - 1] = np.where(ranks < _NONE, ranks * size + np.arange(count - 1), none)
        levels = [level]
        while len(level) > 1:
            level = np.minimum(level[::2], level[1::2])
            levels.append(level)
        tree = [none, *np.concatenate(levels[::-1]).tolist()]
        pairs = self.pair_of.get
        after, before = list(range(1, count + 2)), list(range(-1, count))

        def put(leaf: int, rank: int | None) -> None:
            node = size + leaf
            value = none if rank is None else rank * size + leaf
            while tree[node] != value:
                tree[node] = value
                if node == 1:
                    break
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            far = after[at] = after[gone]
            ids[at], ids[gone] = rank, -1
            before[far] = at
            put(gone, None)
            put(at, pairs(rank << 32 | ids[far]) if far < count else None)
            left = before[at]
            if left >= 0:
                put(left, pairs(ids[left] << 32 | rank))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _ids(self, found: list[str]) -> bytes:
        seen = self.seen
        return b"".join([seen[p] for p in found])

    def _learn(self, wanted: set[str]) -> None:
        if len(self.seen) + len(wanted) > REMEMBERED or self.seen_chars > REMEMBERED_CHARS:
            self.seen.clear()
            self.seen_chars = 0
        new = [p for p in wanted if p not in self.seen]
        self.seen_chars += sum(map(len, new))
        self.seen.update(zip(new, self.pieces([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. A long text is matched in parts, so that its matches are never held whole."""
        if len(texts) == 1 and len(texts[0]) > MATCHES:
            matches, parts = self.pattern.finditer(texts[0]), []
            while part := [m.group() for m in islice(matches, MATCHES)]:
                self._learn(set(part))
                parts.append(self._ids(part))
            return [b"".join(parts)]
        found = [self.pattern.findall(t) for t in texts]
        self._learn(set().union(*found))
        return [self._ids(f) for f in found]

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


_held: dict[tuple[int, str], Merges] = {}


def _merges(ranks, pattern: str) -> Merges:
    key = (hash(ranks.value), pattern)
    if key not in _held:
        _held.clear()
        _held[key] = Merges(ranks.value, pattern)
    return _held[key]


def _shipped(df: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary file, of fixed size


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit) of every row."""
    ranks = _shipped(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(ranks, pattern)
        for batch in batches:
            for part in blocks(batch, "text"):
                ids = merges.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that its ids stand for."""
    ranks = _shipped(encoded, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(ranks, "")
        for batch in batches:
            for part in blocks(batch, "ids"):
                out = [merges.decode(x or b"") for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_tokens"), part.column("ids"), pa.array(out, pa.binary())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    return decode(encoded, ranks_path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )

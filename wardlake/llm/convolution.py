"""A byte-level convolutional network in numpy.

Every byte gives a learned vector, and beside it flags for whether the same byte stood
2 to 13 places before, so that filters can learn repetition. Filters slide over chunks
of fixed length that overlap and together cover the document. Each filter's largest
response in a chunk is kept; the largest and the mean over the chunks are combined into
one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CHUNK, OVERLAP = 384, 32
WIDTH, STRIDE = 12, 4
EMBED, FILTERS = 8, 24
LAGS = tuple(range(2, 14))
CHANNELS = EMBED + len(LAGS)


def chunk_starts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document its number of chunks, and for all of them the start within the document."""
    step = CHUNK - OVERLAP
    counts = np.maximum(1, -(-(lengths - OVERLAP) // step))
    first = np.cumsum(counts) - counts
    return counts, (np.arange(counts.sum()) - np.repeat(first, counts)) * step


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of all texts, zero where a text has ended, and how many each text has (an empty one has one)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts) + bytes(CHUNK), np.uint8)
    counts, starts = chunk_starts(lengths)
    begin = np.repeat(np.cumsum(lengths) - lengths, counts)
    out = np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[begin + starts]
    left = np.repeat(lengths, counts) - starts
    short = np.flatnonzero(left < CHUNK)
    out[short] *= np.arange(CHUNK) < left[short, None]
    return out, counts


@dataclass
class Network:
    table: np.ndarray  # 257 x EMBED; byte 0, of padding, is kept at zero
    filters: np.ndarray  # WIDTH * CHANNELS x FILTERS
    bias: np.ndarray  # FILTERS
    top: np.ndarray  # 2 * FILTERS
    shift: np.ndarray  # 1

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        random = np.random.default_rng(seed)
        table = random.normal(0, 0.5, (256, EMBED))
        table[0] = 0
        filters = random.normal(0, (WIDTH * CHANNELS) ** -0.5, (WIDTH * CHANNELS, FILTERS))
        pieces = (table, filters, np.zeros(FILTERS), random.normal(0, 0.1, 2 * FILTERS), np.zeros(1))
        return cls(*(p.astype(np.float32) for p in pieces))

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """Chunks x positions x the inputs of one window."""
        inputs = np.zeros((*chunks.shape, CHANNELS), np.float32)
        inputs[..., :EMBED] = self.table[chunks]
        for k, lag in enumerate(LAGS):
            inputs[:, lag:, EMBED + k] = (chunks[:, lag:] == chunks[:, :-lag]) & (chunks[:, lag:] > 0)
        flat = inputs.reshape(len(chunks), CHUNK * CHANNELS)
        view = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * CHANNELS, axis=1)
        return view[:, :: STRIDE * CHANNELS]

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response in each chunk, and where it was."""
        windows = self.windows(chunks)
        flat = np.ascontiguousarray(windows).reshape(-1, WIDTH * CHANNELS)
        answers = (flat @ self.filters).reshape(*windows.shape[:2], FILTERS)
        at = answers.argmax(1)
        best = np.take_along_axis(answers, at[:, None], 1)[:, 0] + self.bias
        return np.maximum(best, 0), at

    def combined(self, best: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents' features: the largest and the mean of their chunks."""
        first = np.cumsum(counts) - counts
        return np.concatenate([np.maximum.reduceat(best, first), np.add.reduceat(best, first) / counts[:, None]], 1), first

    def scores(self, texts: list[bytes], step: int = 256) -> np.ndarray:
        """One probability per text; chunks go through the filters ``step`` at a time, also those of a long text."""
        if not texts:
            return np.zeros(0)
        chunks, counts = chunks_of(texts)
        best = np.concatenate([self.pooled(chunks[i : i + step])[0] for i in range(0, len(chunks), step)])
        features, _ = self.combined(best, counts)
        return 1 / (1 + np.exp(-np.clip(features @ self.top + self.shift, -30, 30).astype(float)))

    def slopes(self, chunks: np.ndarray, index: np.ndarray, counts: np.ndarray, y: np.ndarray, step: int = 256) -> dict[str, np.ndarray]:
        """The loss's slope by every parameter over some documents; ``index`` has their chunks, ``counts`` of each.

        Chunks go through ``step`` at a time, twice: for the documents' features, then for the slopes.
        """
        blocks = [slice(i, i + step) for i in range(0, len(index), step)]
        best, place = (np.concatenate(parts) for parts in zip(*(self.pooled(chunks[index[b]]) for b in blocks), strict=True))
        features, _ = self.combined(best, counts)
        chance = 1 / (1 + np.exp(-np.clip(features @ self.top + self.shift, -30, 30)))
        slope = ((chance - y) / len(y)).astype(np.float32)
        from_doc = slope[:, None] * self.top
        owner = np.repeat(np.arange(len(y)), counts)
        back = from_doc[owner, :FILTERS] * (best >= features[owner, :FILTERS])
        back += (from_doc[:, FILTERS:] / counts[:, None])[owner]
        back *= best > 0
        filters, table = np.zeros_like(self.filters), np.zeros_like(self.table)
        for b in blocks:
            part, answer, at = chunks[index[b]], back[b], place[b]
            which = self.windows(part)[np.arange(len(part))[:, None], at]  # chunks x filters x inputs
            filters += np.einsum("cf,cfi->if", answer, which)
            inputs = (answer[..., None] * self.filters.T).reshape(len(part), FILTERS, WIDTH, CHANNELS)[..., :EMBED]
            bytes_at = part[np.arange(len(part))[:, None, None], at[..., None] * STRIDE + np.arange(WIDTH)]
            np.add.at(table, bytes_at.ravel(), inputs.reshape(-1, EMBED))
        table[0] = 0
        return {"table": table, "filters": filters, "bias": back.sum(0), "top": features.T @ slope + 1e-4 * self.top, "shift": slope.sum(keepdims=True)}

    def fit(self, chunks: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 5, size: int = 48, rate: float = 0.01) -> Network:
        """Adam on the logistic loss. ``counts`` chunks belong to each row of ``y``."""
        random = np.random.default_rng(11)
        begin = np.cumsum(counts) - counts
        state = {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in ("table", "filters", "bias", "top", "shift")}
        moved, total = 0, epochs * -(-len(y) // size)
        for _ in range(epochs):
            order = random.permutation(len(y))
            for at in range(0, len(y), size):
                rows = order[at : at + size]
                own = counts[rows]
                index = np.concatenate([np.arange(begin[r], begin[r] + counts[r]) for r in rows])
                slopes = self.slopes(chunks, index, own, y[rows])
                moved += 1
                for key, slope_of in slopes.items():
                    mean, square = state[key]
                    mean += 0.1 * (slope_of - mean)
                    square += 0.001 * (slope_of**2 - square)
                    pace = rate * (1 - moved / (total + 1)) * mean / (1 - 0.9**moved)
                    setattr(self, key, getattr(self, key) - pace / (np.sqrt(square / (1 - 0.999**moved)) + 1e-8))
        return self

"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted at once, each with a cost. Pieces are placed in
order of falling length, each into the open bin that it leaves the least room in. If it
fits nowhere, a bin is opened: for every permitted length the remaining pieces are
projected into it, largest first, and the length with the least cost per packed
character is taken. At the end each bin shrinks to the smallest permitted length that
holds its contents.

Pieces are dealt at random over shards of about ``SHARD_PIECES``, which are packed
independently; only lengths are moved, never texts, and waste stays that of the last
bins of each shard.

Defined results: a document longer than the largest length is cut into pieces of that
length and a rest; an empty or null text is one piece of length 0, in no bin (``bin_id``,
``capacity`` and ``offset`` null); repeated rows are packed each; an empty table gives
an empty result. Ties go to the smaller length and the older bin.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.session import written

CAPACITIES = (1024, 2048, 4096, 8192, 16384)
#: Pieces that one task packs together, on average.
SHARD_PIECES = 20_000


def attention_cost(capacity: int) -> float:
    """The cost of a sequence: linear layers, and attention that grows with the square."""
    return capacity * (1 + capacity / 65_536)


class Remaining:
    """How many pieces of each length are yet to be placed; finds the largest not above a bound."""

    def __init__(self, lengths: Sequence[int], largest: int):
        self.count = np.bincount(lengths, minlength=largest + 1).tolist()
        self.below = list(range(largest + 1))  # towards the nearest length that is left

    def at_most(self, length: int) -> int:
        below, root = self.below, length
        while root and not self.count[root]:
            root = below[root] if below[root] != root else root - 1
        while length > root:  # shorten the way for the next search
            below[length], length = root, min(below[length], length - 1)
        return root

    def take(self, length: int) -> None:
        self.count[length] -= 1

    def projected(self, room: int) -> int:
        """How much of ``room`` the remaining pieces fill, largest first."""
        filled, bound = 0, room
        while bound > 0 and (length := self.at_most(bound)):
            filled += length * min(self.count[length], (room - filled) // length)
            bound = min(length - 1, room - filled)
        return filled


def pack(lengths: Sequence[int], capacities: Sequence[int], cost: Callable[[int], float]) -> tuple[list[int], list[int], list[int]]:
    """For lengths in falling order (none is 0): the bin and offset of each, and the final capacity of each bin."""
    sizes = sorted(capacities)
    price = {c: cost(c) for c in sizes}
    rest = Remaining(lengths, sizes[-1])
    bins, offsets, filled = [], [], []
    rooms: list[tuple[int, int]] = []  # (room, bin) of open bins, ascending
    for length in lengths:
        rest.take(length)
        at = bisect_left(rooms, (length, -1))
        if at < len(rooms):
            room, chosen = rooms.pop(at)
        else:
            best = None
            for size in sizes[bisect_left(sizes, length) :]:
                content = length + rest.projected(size - length)
                each = price[sizes[bisect_left(sizes, content)]] / content
                if best is None or each < best[0]:
                    best = (each, size)
            room, chosen = best[1], len(filled)
            filled.append(0)
        bins.append(chosen)
        offsets.append(filled[chosen])
        filled[chosen] += length
        if room > length:
            insort(rooms, (room - length, chosen))
    return bins, offsets, [sizes[bisect_left(sizes, f)] for f in filled]


def best_fit(
    docs: DataFrame,
    capacities: Sequence[int] = CAPACITIES,
    cost: Callable[[int], float] = attention_cost,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin_id, capacity and offset (in code points)."""
    largest = max(capacities)
    lengths = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).alias("n"),
        F.monotonically_increasing_id().alias("row"),
    )
    lengths = written(lengths, "packing-lengths")  # so that row numbers hold
    # one count comes back: how many shards the pieces are dealt over
    pieces_in_all = lengths.agg(F.sum(F.ceil(F.col("n") / largest)).alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(pieces_in_all / shard_pieces))
    pieces = lengths.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0)).cast("int"))))
    pieces = pieces.select(
        "doc_id", "piece", (F.col("piece") * largest).alias("start"),
        F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).alias("length"),
        F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"), "row",
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, final = pack(frame["length"].tolist(), capacities, cost)
        out = frame[["doc_id", "piece", "start", "length"]].copy()
        out["bin_id"] = np.array(bins, np.int64) + (frame["shard"].to_numpy(np.int64) << 32)
        out["capacity"] = np.array(final)[bins]
        out["offset"] = offsets
        return out

    kinds = "doc_id long, piece int, start int, length int, bin_id long, capacity int, offset int"
    packed = pieces.where("length > 0").groupBy("shard").applyInPandas(run, kinds)
    nulls = [F.lit(None).cast(k).alias(c) for c, k in (("bin_id", "long"), ("capacity", "int"), ("offset", "int"))]
    return packed.unionByName(pieces.where("length = 0").select("doc_id", "piece", "start", "length", *nulls))

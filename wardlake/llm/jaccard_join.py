"""Documents that share shingles: a Jaccard join by T-occurrence search.

The search is DivideSkip: of the inverted lists of a document's shingles the longest are
set aside, the short ones are merged by a heap, and what occurs often enough in them is
probed in the long lists by bisection. A document qualifies if it occurs in at least T
lists, T being the overlap that the threshold demands.

So that not every document meets every index shard, a document is only sent where it can
have a partner:

* Documents with equal sets are one entity, known by its set's hash; copies are never
  expanded into pairs, and the set of only one of them is moved.
* Two sets that reach the threshold share SHARED shingles (or as many as the threshold
  asks of small ones) among the first n - ceil(t n) + SHARED of each, in any order that
  all documents share. Frequent shingles come last in it. Any order gives the same links,
  it only decides how long the lists become, so a lower bound of the frequencies is
  enough: each task counts the shingles of its documents and reports those it met more
  than once. The most frequent are known one by one, the others by sums over buckets of
  shingles, so that those of long lists come last however many there are.
* In each shingle's list, all meet the first entity. Verified links give components. In
  long lists those outside the list's largest component then meet one member of it, twice
  with another one. Last, members that still are in different components meet: in short
  lists as pairs, in long ones by a search of those outside the largest component in the
  shards that hold members of the list of a like size; of both, only the sets of those are
  moved that may have a partner there by sizes, prefixes and histograms. A list is thus not expanded into pairs within a
  group of like documents, though nothing is left out.
* Before sets are moved, a histogram of each set's hashes bounds the overlap of a pair.

What a step stored is deleted as soon as no later step reads it.

Everything is exact but for hash collisions (64 bits for shingles, 64 bits and the size
for sets); nothing is sampled or capped.

Defined results: null and empty texts, and texts of white space, have no shingles and are
linked with nothing; repeated rows are copies; rows without an id are linked, but give no
component its name unless no row has an id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlake.llm.common import blocks, id_and_text, unused
from wardlake.llm.components import components
from wardlake.llm.shingles import shingle_set
from wardlake.session import dropped, released, shuffles_removed, written

#: Shingles that a task counts together; frequent shingles that are broadcast, at most.
COUNTED, FREQUENT = 4_000_000, 200_000
#: Bits of a shingle that choose its bucket, for the shingles that are too many to be known one by one.
BUCKET_BITS = 21
#: Ids of documents whose sets are fetched that are broadcast, at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Shingles of the index sets of a shard and of the queries of a block, on average.
SHARD_SHINGLES, BLOCK_SHINGLES = 500_000, 1_000_000
#: The same of queries to shards that long lists ask, where a query meets many members.
LONG_BLOCK_SHINGLES = 40_000
#: Blocks of a shard that long lists ask, at most: to each goes a copy of what the shard holds.
BLOCKS = 16
#: Queries of a block, on average, while shards are only asked for likely partners.
BLOCK_QUERIES = 2_000
#: Shingles of the prefixes that a pair must share.
SHARED = 3
#: Lists of so many rows are long; how often their members meet one of the largest component.
LONG, MEETINGS = 64, 2
BINS = 128
MU = 0.0085


def least_overlap(size: int, percent: int) -> int:
    """The least overlap that a set of this size has with any set that reaches the threshold."""
    return -(-percent * size // 100)


def prefix_size(size: int, percent: int) -> int:
    return min(size, size - least_overlap(size, percent) + SHARED)


class Index:
    """Inverted lists over the sets of one shard, as one array of members sorted by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        shingles = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(shingles, kind="stable")
        self.members = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        self.shingles, self.first = np.unique(shingles[order], return_index=True)
        self.last = np.append(self.first[1:], len(shingles))

    def search(self, query: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """The members that reach the threshold, and their overlaps."""
        size = len(query)
        least = least_overlap(size, percent)
        if not len(self.shingles):
            return []
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        at = at[self.shingles[at] == query]
        if len(at) < least:
            return []
        lengths = self.last[at] - self.first[at]
        at = at[np.argsort(lengths, kind="stable")]
        lists = [self.members[a:b] for a, b in zip(self.first[at].tolist(), self.last[at].tolist(), strict=True)]
        aside = min(least - 1, int(least / (MU * math.log2(max(2, len(lists[-1]))) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        long = [postings.tolist() for postings in long]
        out = []
        for member, group in groupby(heapq.merge(*(postings.tolist() for postings in short))):
            count = sum(1 for _ in group)
            if count < least - aside:
                continue
            other = self.sizes[member]
            needed = max(least, -(-percent * (size + other) // (100 + percent)))
            for k, postings in enumerate(long):
                if count + len(long) - k < needed:
                    break
                place = bisect_left(postings, member)
                count += place < len(postings) and postings[place] == member
            if 100 * count >= percent * (size + other - count):
                out.append((member, count))
        return out


def entity_of(shingles: np.ndarray) -> int:
    """A hash of the whole set, as a signed 64-bit integer."""
    value = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >> 63 else value


def _counted(docs: DataFrame) -> DataFrame:
    """One row per document (its entity, size and histogram), and rows of shingles that a task met more than once."""
    names = ["doc_id", "text_hash", "n", "entity", "bins", "shingle", "met"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        total = 0

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            values, counts = values[counts > 1].view(np.int64), counts[counts > 1]
            columns = [pa.nulls(len(values), k) for k in kinds[:5]] + [pa.array(values), pa.array(counts.astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for part in blocks(batch, "text"):
                sizes, entities, bins = [], [], []
                for text in part.column("text").to_pylist():
                    own = shingle_set(text)
                    entity = entity_of(own)
                    sizes.append(len(own))
                    entities.append(entity)
                    bins.append(np.minimum(np.bincount((own >> np.uint64(57)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
                    if entity not in seen:
                        seen.add(entity)
                        held.append(own)
                        total += len(own)
                        if total >= COUNTED:
                            yield frequent()
                            held.clear()
                            seen.clear()
                            total = 0
                columns = [part.column("doc_id"), part.column("text_hash")]
                columns += [pa.array(v, k) for v, k in zip((sizes, entities, bins), kinds[2:5], strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(part.num_rows, k) for k in kinds[5:])], names)
        yield frequent()

    return docs.mapInArrow(run, "doc_id long, text_hash long, n int, entity long, bins binary, shingle long, met int")


def _frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, with their counts: at most FREQUENT of them, the most frequent; and levels of buckets.

    A bucket's level grows with the sum of the counts of the shingles in it, 0 if none was met more
    than once; of more shingles than there are buckets, the most frequent give it.
    """
    met = counted.where("shingle is not null").groupBy("shingle").agg(F.sum("met").alias("met"))
    met = written(met, "frequent-shingles")
    by_count = met.groupBy(F.least("met", F.lit(100_000)).alias("met")).count().orderBy(F.desc("met")).collect()

    def least_met(most: int) -> int | None:
        total, least = 0, None
        for row in by_count:  # one row per count
            if total + row["count"] > most:
                break
            total, least = total + row["count"], row["met"]
        return least

    levels = np.zeros(1 << BUCKET_BITS, np.uint8)
    least = least_met(len(levels))
    if least is not None:
        bucket = F.shiftrightunsigned("shingle", 64 - BUCKET_BITS).cast("int").alias("bucket")
        level = F.least(F.round(8 * F.log2(F.sum("met"))), F.lit(255)).cast("short").alias("level")
        stored = written(met.where(F.col("met") >= least).groupBy(bucket).agg(level), "shingle-levels")
        filled = stored.toArrow()
        levels[filled["bucket"].to_numpy()] = filled["level"].to_numpy()
        dropped(stored)
    least = least_met(FREQUENT)
    shingles, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if least is not None:
        chosen = met.where(F.col("met") >= least).toArrow()
        shingles, counts = chosen["shingle"].to_numpy().view(np.uint64), chosen["met"].to_numpy()
    dropped(met)
    order = np.argsort(shingles)
    return shingles[order], counts[order], levels


def _ranks(own: np.ndarray, known: np.ndarray, counts: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The place of each shingle in the order that all documents share: by the bucket's level, known ones last by their count."""
    rank = levels[own >> np.uint64(65 - len(levels).bit_length())].astype(np.int64)  # as many buckets as levels
    met = np.flatnonzero(rank)  # known ones are among them
    if len(known) and len(met):
        at = np.minimum(np.searchsorted(known, own[met]), len(known) - 1)
        rank[met] = np.where(known[at] == own[met], 256 + counts[at], rank[met])
    return rank


def _prefixes(docs: DataFrame, frequent, percent: int) -> DataFrame:
    """``shingle``, ``entity``, ``n`` and ``often`` for the prefix of every set; tasks leave out copies that they notice."""
    names = ["shingle", "entity", "n", "often"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, levels = frequent.value
        seen: set[int] = set()
        for batch in batches:
            for part in blocks(batch, "text"):
                taken, entities, sizes, often = [], [], [], []
                for text in part.column("text").to_pylist():
                    own = shingle_set(text)
                    entity = entity_of(own)
                    if not len(own) or entity in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(entity)
                    first = prefix_size(len(own), percent)
                    rank = _ranks(own, known, counts, levels)
                    order = np.argsort(rank, kind="stable")[:first]
                    taken.append(own[order])
                    often.append(rank[order] >= 256)
                    entities.append(np.full(first, entity))
                    sizes.append(np.full(first, len(own), np.int32))
                if taken:
                    columns = [np.concatenate(taken).view(np.int64), *(np.concatenate(c) for c in (entities, sizes, often))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return docs.mapInArrow(run, "shingle long, entity long, n int, often boolean")


def _shared(prefixes: DataFrame) -> DataFrame:
    """The prefix rows whose shingle has several entities, with the list's first entity and its size.

    Rare shingles have short lists, which a window goes over; the lists of frequent ones may be
    of any length, and are aggregated and joined back.
    """
    window = Window.partitionBy("shingle")
    own = F.struct("entity", "n")
    rare = prefixes.where("not often").select("shingle", "entity", "n", F.min(own).over(window).alias("first"), F.max("entity").over(window).alias("last"))
    rare = rare.where("first.entity != last").select("shingle", "entity", "n", "first")
    often = prefixes.where("often").select("shingle", "entity", "n").distinct()
    ends = often.groupBy("shingle").agg(F.min(own).alias("first"), F.max("entity").alias("last")).where("first.entity != last")
    often = often.join(ends.select("shingle", "first"), "shingle")
    return rare.distinct().unionByName(often).select(
        "shingle", "entity", "n", F.col("first.entity").alias("first"), F.col("first.n").alias("first_n")
    )


def _fits(a: str, b: str, percent: int):
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``entity``, ``n`` and ``shingles`` (binary), once for each of the wanted rows (doc_id, text_hash), one of each entity.

    Repeated rows are left out in tasks, and between tasks by an aggregate of those alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in blocks(batch, "text"):
                own = []
                for text_hash, text in zip(part.column("text_hash").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if text_hash not in seen:
                        seen.add(text_hash)
                        own.append(shingle_set(text))
                if len(seen) > 1_000_000:
                    seen.clear()
                columns = [pa.array([entity_of(s) for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int32()), pa.array([s.tobytes() for s in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["entity", "n", "shingles"])

    many = wanted.count()
    wanted = wanted.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))
    texts = docs.join(F.broadcast(wanted) if many <= BROADCAST_IDS else wanted, same, "left_semi").select("text_hash", "text")
    sets = written(texts.mapInArrow(run, "entity long, n int, shingles binary"), "shingle-sets")
    if sets.count() == many:
        return sets
    again = written(sets.groupBy("entity").count().where("count > 1").select("entity"), "repeated-sets")
    once = sets.join(again, "entity", "left_semi").groupBy("entity").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    one_of_each_set = written(sets.join(again, "entity", "left_anti").unionByName(once), "shingle-sets")
    released(sets)
    dropped(again)
    return one_of_each_set


def _unpacked(bins: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bins), np.uint8).reshape(-1, BINS)


def _may_reach(a_n, b_n, a_bins: np.ndarray, b_bins: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs reach the threshold if all that their histograms and sizes allow is shared."""
    # a full bin stands for any number
    full = np.maximum(a_n, b_n)[:, None]
    a_bins, b_bins = (np.where(bins == 255, full, bins) for bins in (a_bins, b_bins))
    most = np.minimum(np.minimum(a_bins, b_bins).sum(1), np.minimum(a_n, b_n))
    return 100 * most >= percent * (a_n + b_n - most)


def _links(docs: DataFrame, entities: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b), and perhaps further pairs met on the way, that reach the threshold."""
    # a pair's first member is the query, its second the index
    sides = [entities.select(F.col("entity").alias(c), F.col("n").alias(f"{c}_n"), F.col("bins").alias(f"{c}_bins")) for c in "ab"]
    known = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "a_n", "b_n", "a_bins", "b_bins")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = [batch.column(k).to_numpy().astype(np.int64) for k in (2, 3)]
            kept = _may_reach(*sizes, *(_unpacked(batch.column(k).to_pylist()) for k in (4, 5)), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept))

    likely = written(known.mapInArrow(bounded, "a long, b long"), "likely-pairs")
    held = likely.select(F.col("b").alias("member")).distinct()
    shard = _shard(entities, held, "b")
    asked = likely.select(shard, F.col("a").alias("entity")).distinct()
    found = _searched(docs, entities, asked, likely.select(shard, F.col("b").alias("member")).distinct(), percent, BLOCK_SHINGLES)
    dropped(likely)
    return found


def _shard(entities: DataFrame, held: DataFrame, name: str):
    """The shard of an index entity, so that shards hold about SHARD_SHINGLES."""
    in_all = held.join(entities.select(F.col("entity").alias("member"), "n"), "member").agg(F.sum("n")).first()[0]
    return F.pmod(F.xxhash64(name), F.lit(max(1, math.ceil((in_all or 0) / SHARD_SHINGLES)))).cast("int").alias("shard")


def _like_size(n: str, percent: int):
    """A class of sizes: those of two sets that reach the threshold differ by one at most."""
    return F.floor(F.log(F.col(n)) / math.log(101 / percent)).cast("int")


def _searched(docs: DataFrame, entities: DataFrame, asked: DataFrame, held: DataFrame, percent: int, block_shingles: int, max_blocks: int = 1 << 30) -> DataFrame:
    """All pairs (a, b) of an asked entity and a held member of the same shard that reach the threshold."""
    asked, held = written(asked, "asked"), written(held, "held")
    ends = asked.select("entity").unionByName(held.select(F.col("member").alias("entity"))).distinct()
    wanted = written(entities.join(ends, "entity").select("doc_id", "text_hash").distinct(), "wanted-texts")
    sets = _sets(docs, wanted)
    held_sets = sets.select(F.col("entity").alias("member"), F.col("shingles").alias("member_shingles"))
    weights = asked.join(entities.select("entity", "n"), "entity").groupBy("shard")
    many = weights.agg(F.least(F.ceil(F.sum("n") / block_shingles), F.lit(max_blocks)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("entity", F.lit("block")), F.col("blocks")).cast("int").alias("block")
    queries = asked.join(many, "shard").select("shard", block, "entity").join(sets.select("entity", "shingles"), "entity")
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    index = held.join(held_sets, "member").join(many, "shard").withColumn("block", every_block)

    def search(key: tuple, queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        queries, held = queries.drop_duplicates("entity"), held.drop_duplicates("member")
        names = held["member"].tolist()
        lists = Index([np.frombuffer(s, np.uint64) for s in held["member_shingles"]])
        out = []
        for entity, shingles in zip(queries["entity"].tolist(), queries["shingles"], strict=True):
            out += [(entity, names[m]) for m, _ in lists.search(np.frombuffer(shingles, np.uint64), percent) if names[m] != entity]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    searched = queries.groupBy("shard", "block").cogroup(index.groupBy("shard", "block"))
    found = written(searched.applyInPandas(search, "a long, b long"), "links")
    dropped(asked, held, wanted)
    released(sets)
    return found


def _apart(lists: DataFrame, labels: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """The list rows with their labels, and of each list with several labels the largest.

    ``top`` is the label that most rows of the list have, ``one`` a member with it that a hash
    picks anew in every turn, ``rows`` the length of the list.
    """
    known = labels.withColumnRenamed("node", "entity")
    named = lists.join(known, "entity", "left").select("shingle", "entity", "n", F.coalesce("label", "entity").alias("label"))
    named = written(named, "labelled-lists")
    pick = F.struct(F.xxhash64("entity", "shingle", F.lit(turn)).alias("hash"), "entity", "n")
    sizes = named.groupBy("shingle", "label").agg(F.count("*").alias("many"), F.min(pick).alias("one"))
    largest = sizes.groupBy("shingle").agg(
        F.max(F.struct("many", "label", "one")).alias("top"), F.count("*").alias("labels"), F.sum("many").alias("rows")
    )
    largest = largest.where("labels > 1").select("shingle", F.col("top.label").alias("top"), F.col("top.one").alias("one"), "rows")
    return named, largest


def _long_places(long: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The shards that each entity outside the largest component of a list asks, and the shard of each member.

    Shards hold about SHARD_SHINGLES of one class of sizes.
    """
    sized = long.withColumn("like", _like_size("n", percent))
    members = sized.select("entity", "n", "like").distinct()
    shards = members.groupBy("like").agg(F.ceil(F.sum("n") / SHARD_SHINGLES).cast("int").alias("shards")).collect()
    many = F.create_map(*(F.lit(x) for row in shards for x in row))  # one entry per class of sizes
    shard = (F.col("like").cast("long") * (1 << 32) + F.pmod(F.xxhash64("entity"), many[F.col("like")])).alias("shard")
    places = sized.select("shingle", F.explode(F.array(*(F.col("like") + k for k in (-1, 0, 1)))).alias("like"), shard).distinct()
    asked = sized.where("label != top").select("shingle", "like", "entity").join(places, ["shingle", "like"])
    return asked.select("shard", "entity").distinct(), members.select(shard, F.col("entity").alias("member"))


def _likely_places(entities: DataFrame, apart: DataFrame, asked: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """``shard``, ``entity`` and ``asks``: the asked and the held entities that may have a partner in the shard.

    Partners share enough shingles of their prefixes, in lists with several labels, and reach the
    threshold by their histograms. Neither sets are moved for this, nor pairs put out.
    """
    asked, held = written(asked, "asked"), written(held, "held")
    signs = apart.join(held.select(F.col("member").alias("entity")), "entity", "left_semi").groupBy("entity").agg(F.collect_list("shingle").alias("signs"))
    signs = written(signs.join(entities.select("entity", "n", "bins"), "entity"), "prefix-signs")
    many = asked.groupBy("shard").agg(F.least(F.ceil(F.count("*") / BLOCK_QUERIES), F.lit(BLOCKS)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("entity", F.lit("block")), F.col("blocks")).cast("int").alias("block")
    queries = asked.join(many, "shard").select("shard", block, "entity").join(signs, "entity")
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    held_signs = signs.select(F.col("entity").alias("member"), *(F.col(c).alias(f"member_{c}") for c in ("n", "bins", "signs")))
    index = held.join(held_signs, "member").join(many, "shard").withColumn("block", every_block)

    def likely(key: tuple, queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names, sizes = held["member"].to_numpy(), held["member_n"].to_numpy(np.int64)
        asking, met = [], np.zeros(len(held), bool)
        if len(queries) and len(held):
            bins = _unpacked(held["member_bins"].tolist())
            shingles = np.concatenate(held["member_signs"].tolist())
            order = np.argsort(shingles, kind="stable")
            owners = np.repeat(np.arange(len(held)), held["member_signs"].map(len))[order]
            shingles = shingles[order]
            for entity, size, own_bins, own in zip(queries["entity"].tolist(), queries["n"].tolist(), queries["bins"], queries["signs"], strict=True):
                ends = (np.searchsorted(shingles, own, side).tolist() for side in ("left", "right"))
                members, often = np.unique(np.concatenate([owners[a:b] for a, b in zip(*ends, strict=True)]), return_counts=True)
                enough = np.minimum(SHARED, least_overlap(np.maximum(size, sizes[members]), percent))
                members = members[(often >= enough) & (names[members] != entity)]
                own_bins = np.broadcast_to(_unpacked([own_bins]), (len(members), BINS))
                members = members[_may_reach(np.full(len(members), size), sizes[members], own_bins, bins[members], percent)]
                if len(members):
                    asking.append(entity)
                    met[members] = True
        places = [*asking, *names[met].tolist()]
        asks = np.arange(len(places)) < len(asking)
        return pd.DataFrame({"shard": np.full(len(places), key[0], np.int64), "entity": np.array(places, np.int64), "asks": asks})

    likely_ones = queries.groupBy("shard", "block").cogroup(index.groupBy("shard", "block"))
    found = written(likely_ones.applyInPandas(likely, "shard long, entity long, asks boolean"), "likely-places")
    dropped(asked, held, signs)
    return found


def near_groups(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``component`` and ``text_hash`` of every row.

    ``component_id`` is the smallest doc_id that links reach; ``component`` names the component
    where ids are missing (null: no words), and ``text_hash`` (xxhash64) the text.
    """
    with shuffles_removed(docs.sparkSession):
        rows, labels = _labelled(id_and_text(docs, id_col, text_col), percent)
    own = rows.join(labels.withColumnRenamed("node", "entity"), "entity", "left")
    own = own.withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "entity")))
    names = own.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return own.join(names, "label", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("label").alias("component"), "text_hash"
    )


def _labelled(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``text_hash``, ``n`` and ``entity`` of every row, and the label of each entity that has links."""
    spark = docs.sparkSession
    texts = docs.withColumn("text_hash", F.xxhash64("text"))
    counted = written(_counted(texts), "shingle-counts")
    frequent = spark.sparkContext.broadcast(_frequent(counted))  # at most FREQUENT shingles
    rows = counted.where("n is not null").select("doc_id", "text_hash", "n", "entity", "bins")
    # one row stands for all copies; only its text is fetched
    own = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("own")
    entities = rows.where("n > 0").groupBy("entity", "n").agg(own, F.first("bins").alias("bins"))
    entities = written(entities.select("entity", "n", "own.doc_id", "own.text_hash", "bins"), "entities")
    prefixes = written(_prefixes(texts, frequent, percent), "prefixes")
    lists = written(_shared(prefixes), "shared-shingles")
    dropped(prefixes)
    # a first try: documents that have the same first entity in two lists
    starts = lists.where(F.col("entity") != F.col("first")).where(_fits("n", "first_n", percent))
    starts = starts.groupBy(F.col("entity").alias("a"), F.col("first").alias("b")).agg(F.count("*").alias("met"), F.max("n").alias("n"))
    links = _links(texts, entities, starts.where((F.col("met") > 1) | (F.col("n") < 4)).select("a", "b"), percent)
    labels = components(links)

    for turn in range(MEETINGS):
        named, largest = _apart(lists, labels, turn)
        met = named.join(largest.where(F.col("rows") >= LONG).select("shingle", "top", "one"), "shingle").where("label != top")
        met = met.where(_fits("n", "one.n", percent)).select(F.col("entity").alias("a"), F.col("one.entity").alias("b"))
        met = written(met.distinct(), "meetings")
        dropped(named)
        if met.isEmpty():
            break
        links = links.unionByName(_links(texts, entities, met, percent))
        dropped(met)
        labels = components(links)

    named, largest = _apart(lists, labels, MEETINGS)
    apart = written(named.join(largest.select("shingle", "top", "rows"), "shingle"), "apart")
    outside = apart.where("label != top")
    # short lists: pairs, which must share enough of the prefixes, counted over short lists
    left = outside.where(F.col("rows") < LONG)
    left = left.select("shingle", "top", F.col("entity").alias("x"), F.col("n").alias("x_n"), F.col("label").alias("x_label"))
    right = named.select("shingle", F.col("entity").alias("y"), F.col("n").alias("y_n"), F.col("label").alias("y_label"))
    rest = left.join(right, "shingle").where("x_label != y_label").where(_fits("x_n", "y_n", percent))
    rest = rest.where("y_label = top or x < y")  # each pair once in a list
    rest = rest.groupBy(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).agg(
        F.count("*").alias("met"), F.max(F.greatest("x_n", "y_n")).alias("n")
    )
    asked = F.ceil(F.col("n") * percent / 100)  # of the larger set
    rest = written(rest.where(F.col("met") >= F.least(F.lit(SHARED), asked)).select("a", "b"), "rest-pairs")
    more = [] if rest.isEmpty() else [_links(texts, entities, rest, percent)]
    # long lists: those outside the largest component go to the shards that hold members of the list of a like size
    long = apart.where(F.col("rows") >= LONG)
    if not long.isEmpty():
        found = _likely_places(entities, apart, *_long_places(long, percent), percent)
        if not found.isEmpty():
            asked = found.where("asks").select("shard", "entity")
            held = found.where("not asks").select("shard", F.col("entity").alias("member")).distinct()
            more.append(_searched(texts, entities, asked, held, percent, LONG_BLOCK_SHINGLES, BLOCKS))
        dropped(found)
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    final = components(reduce(DataFrame.unionByName, more, known)) if more else labels
    dropped(named, apart, rest, lists, entities)
    return rows, final


def one_of_each(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all columns, of one document of each component: that of the smallest id, then text hash.

    Documents without words all stay; of repeated rows (same id and text) one stays.
    """
    groups = near_groups(docs, percent, id_col, text_col).where("component is not null")
    with shuffles_removed(docs.sparkSession):
        groups = written(groups, "components")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = groups.groupBy("component").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    gone = groups.join(first.select("component", "first"), "component").where(place != F.col("first"))
    key, mark = unused("gone_id", docs.columns), unused("gone_hash", docs.columns)
    named = [F.col("doc_id").alias(key), F.col("text_hash").alias(mark)]
    gone = written(gone.select(*named).distinct(), "gone-rows")
    again = written(groups.groupBy(*named).count().where("count > 1").drop("count"), "repeated-rows")
    dropped(groups)
    gone, again = (F.broadcast(t) if t.count() <= BROADCAST_IDS else t for t in (gone, again))
    text_hash = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (text_hash == F.col(mark))
    kept = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return kept
    extra = kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(again, same, "left_anti").unionByName(extra)

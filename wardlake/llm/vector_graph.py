"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

A shard's graph starts at random. In two passes every vector is searched for from the
medoid; what the beam holds, with its neighbours so far, is pruned: of the candidates,
nearest first, one is kept unless a kept one is nearer to it by the factor ``alpha``.
Kept edges are also added backwards. Vectors of a batch are searched and pruned together
in numpy.

Inner products are made distances by one more component that gives all vectors the norm
of the longest. Equal vectors are one node, with the smallest of their ids; a search
therefore never drowns in copies, and ties between copies are exact. All rows are
indexed. Queries meet every shard in blocks: one task holds one shard's graph and one
block of queries, both of bounded size.

Defined results: vectors that are null, zero, or hold null or non-finite components, rows
without an id, and vectors that don't have the commonest dimension take no part (ties: the
smaller dimension); repeated ids are one row, with the smallest of their vectors; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wardlake.session import written

DEGREE, SLACK = 32, 48  # edges after pruning, and before it is due
BUILD_BEAM, SEARCH_BEAM = 48, 96
ALPHA = 1.2
BATCH = 256
#: Vectors of a shard and queries of a block, on average.
SHARD_ROWS, BLOCK_ROWS = 8_192, 2_048


class Graph:
    """Edges over unit-free float32 vectors of one norm; an edge to oneself stands for none."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray, entry: int):
        self.vectors, self.edges, self.entry = vectors, edges, entry

    @classmethod
    def built(cls, vectors: np.ndarray, seed: int = 0) -> Graph:
        count = len(vectors)
        random = np.random.default_rng(seed)
        entry = int(np.argmax(vectors @ vectors.mean(0))) if count else 0
        edges = np.repeat(np.arange(count)[:, None], SLACK, axis=1)
        if count <= DEGREE + 1:
            edges[:, : max(0, count - 1)] = [[j for j in range(count) if j != i] for i in range(count)]
            return cls(vectors, edges, entry)
        edges[:, : DEGREE // 2] = random.integers(0, count, (count, DEGREE // 2))
        graph = cls(vectors, edges, entry)
        for alpha in (1.0, ALPHA):
            order = random.permutation(count)
            for at in range(0, count, BATCH):
                graph.insert(order[at : at + BATCH], alpha)
        return graph

    def beam(self, queries: np.ndarray, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes found for each query and their inner products (-inf: none), best first."""
        rows = len(queries)
        width = min(width, len(self.vectors))
        ids = np.full((rows, width), self.entry)
        near = np.full((rows, width), -np.inf, np.float32)
        near[:, 0] = queries @ self.vectors[self.entry]
        done = np.ones((rows, width), bool)
        done[:, 0] = False
        met = np.zeros((rows, len(self.vectors)), bool)
        met[:, self.entry] = True
        line = np.arange(rows)[:, None]
        while not done.all():
            pick = np.argsort(done, axis=1, kind="stable")[:, :expand]
            fresh = ~done[line, pick]
            done[line, pick] = True
            some = np.flatnonzero(fresh.any(1))
            around = np.where(fresh[some][:, :, None], self.edges[ids[some[:, None], pick[some]]], self.entry).reshape(len(some), -1)
            around.sort(axis=1)
            new = ~met[some[:, None], around]
            new[:, 1:] &= around[:, 1:] != around[:, :-1]
            met[some[:, None], around] = True
            at, column = np.nonzero(new)
            found = np.full(around.shape, -np.inf, np.float32)
            found[at, column] = np.einsum("ij,ij->i", self.vectors[around[at, column]], queries[some[at]])
            both = np.concatenate([near[some], found], 1)
            top = np.argpartition(-both, width - 1, axis=1)[:, :width]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable"), 1)
            near[some] = np.take_along_axis(both, top, 1)
            ids[some] = np.take_along_axis(np.concatenate([ids[some], around], 1), top, 1)
            over = np.concatenate([done[some], np.zeros(around.shape, bool)], 1)
            done[some] = np.take_along_axis(over, top, 1) | np.isneginf(near[some])
        return ids, near

    def pruned(self, nodes: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """At most DEGREE diverse neighbours of each node (columns beyond: the node itself)."""
        candidates = np.sort(candidates, axis=1)
        away = np.einsum("bkd,bd->bk", self.vectors[candidates], self.vectors[nodes])
        norm = float(np.einsum("i,i->", self.vectors[0], self.vectors[0]))
        distance = np.sqrt(np.maximum(0, 2 * norm - 2 * away))
        distance[candidates == nodes[:, None]] = np.inf
        distance[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = np.inf
        keep = min(candidates.shape[1], 2 * SLACK)
        best = np.argsort(distance, axis=1)[:, :keep]
        candidates, distance = np.take_along_axis(candidates, best, 1), np.take_along_axis(distance, best, 1)
        picked = self.vectors[candidates]
        between = np.sqrt(np.maximum(0, 2 * norm - 2 * np.matmul(picked, picked.transpose(0, 2, 1))))
        out = np.repeat(nodes[:, None], SLACK, axis=1)
        open_ = np.isfinite(distance)
        line = np.arange(len(nodes))
        for slot in range(DEGREE):
            first = open_.argmax(1)  # candidates are in order of distance
            has = open_[line, first]
            if not has.any():
                break
            out[has, slot] = candidates[has, first[has]]
            open_ &= ~((alpha * between[line, first] <= distance) & has[:, None])
            open_[line, first] = False
        return out

    def insert(self, nodes: np.ndarray, alpha: float) -> None:
        found, _ = self.beam(self.vectors[nodes], BUILD_BEAM)
        self.edges[nodes] = self.pruned(nodes, np.concatenate([found, self.edges[nodes]], 1), alpha)
        new = self.edges[nodes][:, :DEGREE]
        source, target = np.repeat(nodes, DEGREE), new.ravel()
        real = source != target
        source, target = source[real], target[real]
        there = (self.edges[target] == source[:, None]).any(1)
        source, target = source[~there], target[~there]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        ends, first, counts = np.unique(target, return_index=True, return_counts=True)
        degree = (self.edges[ends] != ends[:, None]).sum(1)
        place = np.arange(len(target)) - np.repeat(first, counts)
        fits = degree + counts <= SLACK
        self.edges[ends[fits]] = np.take_along_axis(
            self.edges[ends[fits]], np.argsort(self.edges[ends[fits]] == ends[fits][:, None], axis=1, kind="stable"), 1
        )  # free columns last
        easy = np.repeat(fits, counts)
        self.edges[target[easy], (np.repeat(degree, counts) + place)[easy]] = source[easy]
        full = np.flatnonzero(~fits)
        for at in range(0, len(full), 4 * BATCH):
            part = full[at : at + 4 * BATCH]
            extra = np.repeat(ends[part][:, None], counts[part].max(), axis=1)
            for k, g in enumerate(part):
                extra[k, : counts[g]] = source[first[g] : first[g] + counts[g]]
            self.edges[ends[part]] = self.pruned(ends[part], np.concatenate([self.edges[ends[part]], extra], 1), alpha)


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with one more component, so that all have the norm ``longest``, scaled to 1."""
    rest = np.sqrt(np.maximum(0, longest**2 - np.einsum("ij,ij->i", vectors, vectors)))
    return (np.concatenate([vectors, rest[:, None]], 1) / longest).astype(np.float32)


def clean(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``vector`` (array of double) of the rows that take part."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine & F.exists("vector", lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("vector") == (common["d"] if common else 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest(
    embeddings: DataFrame,
    k: int = 20,
    query: str = "query_id % 20 = 0",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k rows of largest inner product found for each query row.

    ``query`` is a condition on query_id; a row is no neighbour of itself. Ties go to the smaller vec_id.
    """
    rows = written(clean(embeddings, id_col, vector_col), "vectors")
    # of equal vectors k + 1 ids are enough for k neighbours besides oneself; the limit acts before the shuffle
    same = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    nodes = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes.withColumn("node", F.element_at("ids", 1)), "vector-nodes")
    asked = rows.withColumnRenamed("vec_id", "query_id").where(query).join(nodes.select("vector", "node"), "vector")
    asked = written(asked.select("query_id", "node"), "vector-queries")
    queries = nodes.join(asked.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("query"), "vector")
    # three numbers come back: how many nodes and queries there are, and the largest norm
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    size = nodes.agg(F.count("*").alias("n"), F.max(norm).alias("longest")).first()
    longest = (size["longest"] or 1.0) * (1 + 1e-9)
    shards, blocks = max(1, math.ceil(size["n"] / shard_rows)), max(1, math.ceil(asked.select("node").distinct().count() / block_rows))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        vectors = np.stack(frame["vector"].to_numpy()).astype(float)
        graph = Graph.built(lengthened(vectors, longest), seed=int(frame["shard"].iloc[0]))
        return pd.DataFrame(
            {
                "shard": [frame["shard"].iloc[0]],
                "nodes": [frame["node"].to_numpy(np.int64).tobytes()],
                "vectors": [vectors.tobytes()],
                "edges": [graph.edges.astype(np.int32).tobytes()],
                "entry": [graph.entry],
            }
        )

    kinds = "shard int, nodes binary, vectors binary, edges binary, entry int"
    dealt = nodes.select("node", "vector", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"))
    index = written(dealt.groupBy("shard").applyInPandas(build, kinds), "vector-graphs")

    def search(key: tuple, wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted) or not len(held):
            return pd.DataFrame({"query": [], "node": [], "score": []})
        shard = held.iloc[0]
        ids = np.frombuffer(shard["nodes"], np.int64)
        vectors = np.frombuffer(shard["vectors"], float).reshape(len(ids), -1)
        edges = np.frombuffer(shard["edges"], np.int32).reshape(len(ids), -1)
        graph = Graph(lengthened(vectors, longest), edges, int(shard["entry"]))
        queries = np.stack(wanted["vector"].to_numpy()).astype(float)
        padded = np.concatenate([queries, np.zeros((len(queries), 1))], 1).astype(np.float32)
        names, parts = wanted["query"].to_numpy(np.int64), []
        for at in range(0, len(queries), BATCH):
            found, near = graph.beam(padded[at : at + BATCH], max(SEARCH_BEAM, 2 * k))
            line, column = np.nonzero(~np.isneginf(near))
            chosen = found[line, column]
            score = np.einsum("ij,ij->i", vectors[chosen], queries[at + line])
            order = np.lexsort((ids[chosen], -score, line))
            first = np.searchsorted(line[order], np.arange(found.shape[0]))
            best = order[np.arange(len(order)) - first[line[order]] <= k]
            parts.append(pd.DataFrame({"query": names[at + line[best]], "node": ids[chosen[best]], "score": score[best]}))
        return pd.concat(parts)

    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    wanted = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("shard", every_shard)
    pairs = wanted.groupBy("shard", "block").cogroup(index.withColumn("block", every_block).groupBy("shard", "block"))
    found = pairs.applyInPandas(search, "query long, node long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    per_node = found.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    per_node = per_node.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    final = asked.join(per_node, asked["node"] == per_node["query"]).where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return final.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score"
    )

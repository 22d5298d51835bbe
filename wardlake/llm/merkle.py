"""A Merkle tree over a dataset, with a proof for every row, by time-forward processing.

Rows are leaves, ordered within their source. Every run of ``FAN`` consecutive nodes has a
parent, up to the source's subroot; the subroots, ordered by source, have the root over them.

Nodes are labelled by level and place. Each node, when its label comes up, sends its digest
to its parent through a priority queue ordered by label, so that a parent finds the digests
of its children together when its own label comes up. A second sweep in reversed order sends
every child the proof of its parent and the siblings it adds, down to the leaves.

The queue is external: subtrees of ``FAN ** LEVELS`` leaves are swept by a queue in memory,
whose size is thereby bounded, and what they send to the tree above goes as rows through
Spark's sorted shuffle, which spills. A round takes ``LEVELS`` levels; 4 rounds are enough
for 10^13 rows. Only digests and ids are shuffled, never texts; a source with a third of all
rows is as many subtrees as its rows need, in as many tasks.

Defined results: null fields are ``-``; a null source is a source of its own, before all
others; a null doc_id comes first and is tampered with never; equal ids are ordered by leaf,
equal leaves are interchangeable; a source of one row has its leaf as subroot, a table with
one source has its subroot as root; proofs without siblings are empty; an empty table gives
an empty result. Further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlake.session import written

FAN = 3
#: Levels that one task sweeps, and with them the leaves of its subtree, FAN ** LEVELS at most.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Proof = tuple | None  # (left siblings, right siblings, proof of the parent)


def height(count: int, levels: int | None = None) -> int:
    """Levels above ``count`` nodes until one remains, ``levels`` at most."""
    up = 0
    while count > 1:
        count = -(-count // FAN)
        up += 1
    return up if levels is None else min(up, levels)


def forward(digests: list[str], up: int) -> dict[tuple[int, int], str]:
    """The digests of all nodes of a subtree of ``up`` levels, by label (level, place).

    The queue holds (label of the receiver, place of the sender, digest).
    """
    known = {(0, i): d for i, d in enumerate(digests)}
    queue = [((1, i // FAN), i, d) for i, d in enumerate(digests)] if up else []
    while queue:
        label = queue[0][0]
        inputs = []
        while queue and queue[0][0] == label:
            inputs.append(heapq.heappop(queue)[2])
        digest = known[label] = sha256("".join(inputs).encode()).hexdigest()
        level, place = label
        if level < up:
            heapq.heappush(queue, ((level + 1, place // FAN), place, digest))
    return known


def backward(known: dict[tuple[int, int], str], up: int, above: Proof) -> dict[int, Proof]:
    """The proof of every leaf of the subtree whose own root has the proof ``above``."""
    queue: list[tuple[tuple[int, int], Proof]] = [((-up, 0), above)]
    out: dict[int, Proof] = {}
    while queue:
        (level, place), proof = heapq.heappop(queue)
        level, place = -level, -place
        if not level:
            out[place] = proof
            continue
        run = [p for p in range(place * FAN, place * FAN + FAN) if (level - 1, p) in known]
        for child in run:
            left = "".join(known[level - 1, p] for p in run if p < child)
            right = "".join(known[level - 1, p] for p in run if p > child)
            heapq.heappush(queue, ((1 - level, -child), (left, right, proof)))
    return out


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields, each as its length in bytes, a colon and its value."""
    return F.sha2(F.concat(*(_field(c) for c in columns)).cast("binary"), 256)


def _ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0) and ``total`` within their ``tree``, by range partitions and their counts."""
    kept = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            nth = []
            for tree in batch.column("tree").to_pylist():
                at = at + 1 if tree == current else 0
                current = tree
                nth.append(at)
            columns = [*batch.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "nth"])

    dealt = rows.repartitionByRange(F.col("tree"), *order).sortWithinPartitions(F.col("tree"), *order)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    numbered = written(dealt.mapInArrow(number, f"{kinds}, part int, nth long"), name)
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("tree")).alias("total"),
    )
    joined = numbered.join(counts, ["tree", "part"])
    return joined.select(*kept, (F.col("nth") + F.col("before")).alias("rank"), "total")


MEMBERS = "members array<struct<rank: long, digest: binary, doc_id: long, claimed: binary, name: string>>"


def _round(nodes: DataFrame, levels: int) -> DataFrame:
    """One row per subtree: its nodes in order and its own digest, in the shared folder."""
    width = FAN**levels
    blocks = nodes.groupBy("tree", F.floor(F.col("rank") / width).alias("block")).agg(
        F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("rank", "digest", "doc_id", "claimed", "name"))).alias("members")
    )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                digests = [d.hex() for d in row.column("members").flatten().field("digest").to_pylist()]
                up = height(row.column("total")[0].as_py(), levels)
                root = forward(digests, up)[up, 0]
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([bytes.fromhex(root)], pa.binary())], [*row.schema.names, "root"])

    return written(blocks.mapInArrow(sweep, f"tree string, block long, total long, {MEMBERS}, root binary"), "merkle-round")


def _rounds(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """All rounds from the leaves up, and ``tree`` and ``root`` of every tree."""
    width = FAN**levels
    rounds = []
    while True:
        blocks = _round(nodes, levels)
        rounds.append(blocks)
        if (blocks.agg(F.max("total").alias("m")).first()["m"] or 0) <= width:  # one number
            break
        empty = [F.lit(None).cast(k).alias(c) for c, k in (("doc_id", "long"), ("claimed", "binary"), ("name", "string"))]
        above = blocks.where(F.col("total") > width)
        nodes = above.select("tree", F.ceil(F.col("total") / width).alias("total"), F.col("block").alias("rank"), F.col("root").alias("digest"), *empty)
    tops = [b.where(F.col("total") <= width).select("tree", "root") for b in rounds]
    roots = tops[0]
    for top in tops[1:]:
        roots = roots.unionByName(top)
    return rounds, roots


PROOF = "array<struct<left: string, right: string>>"
_PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _down(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The members of the lowest round, each with its proof; ``tops`` has the proof and digest of every tree's root."""
    width = FAN**levels

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                tree, total, subroot = (row.column(c)[0].as_py() for c in ("tree", "total", "subroot"))
                members = row.column("members").flatten()
                above: Proof = None
                for p in reversed(row.column("proof")[0].as_py()):
                    above = (p["left"], p["right"], above)
                up = height(total, levels)
                known = forward([d.hex() for d in members.field("digest").to_pylist()], up)
                proofs = backward(known, up, above)
                made = []
                for i in range(len(members)):
                    proof, flat = proofs[i], []
                    while proof is not None:
                        flat.append({"left": proof[0], "right": proof[1]})
                        proof = proof[2]
                    made.append(flat)
                same = lambda v: pa.array([v] * len(members), pa.string())
                fields = [members.field(c) for c in ("rank", "digest", "doc_id", "claimed", "name")]
                yield pa.RecordBatch.from_arrays(
                    [same(tree), *fields, pa.array(made, _PROOF), same(subroot)],
                    ["tree", "rank", "digest", "doc_id", "claimed", "name", "proof", "subroot"],
                )

    kinds = f"tree string, rank long, digest binary, doc_id long, claimed binary, name string, proof {PROOF}, subroot string"
    start = tops.select("tree", F.lit(0).cast("long").alias("block"), F.lit(True).alias("top"), "proof", "subroot")
    sent = None
    for blocks in reversed(rounds):
        messages = start if sent is None else start.unionByName(sent)
        told = blocks.withColumn("top", F.col("total") <= width).join(messages, ["tree", "block", "top"])
        nodes = told.select("tree", "total", "members", "proof", "subroot").mapInArrow(sweep, kinds)
        sent = nodes.select("tree", F.col("rank").alias("block"), F.lit(False).alias("top"), "proof", "subroot")
    return nodes


def manifest(docs: DataFrame, claimed: Column | None = None, fields: tuple[str, ...] = FIELDS, levels: int = LEVELS) -> DataFrame:
    """``doc_id``, ``leaf``, ``claimed``, ``subroot``, ``root`` and ``proof`` of every row.

    ``claimed`` is a text that stands in for the last field, whose leaf is returned beside
    the row's own (null: none). ``proof`` lists from the leaf up what stands left and right
    of the node among its siblings, as hex digests in order.
    """
    columns = [F.col(c) for c in fields]
    own = leaf_digest(columns)
    stated = leaf_digest([*columns[:-1], claimed]) if claimed is not None else F.lit(None).cast("string")
    leaves = docs.select(
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string"))).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(own).alias("digest"), F.unhex(stated).alias("claimed"),
        F.lit(None).cast("string").alias("name"),
    )
    leaves = written(leaves, "merkle-leaves")  # texts are read once
    ordered = _ranked(leaves, [F.asc_nulls_first("doc_id"), F.col("digest"), F.col("claimed")], "merkle-ranked")
    rounds, subroots = _rounds(ordered, levels)
    sources = subroots.select(
        F.lit("").alias("tree"), F.lit(None).cast("long").alias("doc_id"), F.col("root").alias("digest"),
        F.lit(None).cast("binary").alias("claimed"), F.col("tree").alias("name"),
    )
    upper, roots = _rounds(_ranked(sources, [F.col("name")], "merkle-sources"), levels)
    found = roots.first()  # one row
    root = F.lit(found["root"].hex() if found else None).cast("string")
    tops = roots.select("tree", F.lower(F.hex("root")).alias("subroot"), F.array().cast(PROOF).alias("proof"))
    named = _down(upper, tops, levels).select(F.col("name").alias("tree"), F.lower(F.hex("digest")).alias("subroot"), "proof")
    rows = _down(rounds, written(named, "merkle-tops"), levels)
    return rows.select(
        "doc_id", F.lower(F.hex("digest")).alias("leaf"), F.lower(F.hex("claimed")).alias("claimed"), "subroot", root.alias("root"), "proof"
    )


def proof_digest(proof: Column) -> Column:
    """SHA-256 (hex) of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), "").cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]).cast("binary"), 256))


def checked(manifest_rows: DataFrame) -> DataFrame:
    """Every row's proof folded from the claimed leaf (the row's own, if none is claimed) and compared with the root."""
    rebuilt = manifest_rows.withColumn("folded_root", folded(F.coalesce("claimed", "leaf"), F.col("proof")))
    return rebuilt.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )

import random
from collections import defaultdict

from wardlake.llm import packing
from wardlake.llm.queries import QUERIES

SIZES = (8, 16, 32)


def plain(lengths, sizes, cost):
    """The same rule without its data structures."""
    bins, chosen, left = [], [], sorted(lengths, reverse=True)
    while left:
        length = left.pop(0)
        fits = [(room - length, i) for i, (room, _) in enumerate(bins) if room >= length]
        if fits:
            room, i = min(fits)
        else:
            options = []
            for size in sizes:
                if size >= length:
                    content = length
                    for other in left:
                        content += other if content + other <= size else 0
                    options.append((cost(min(s for s in sizes if s >= content)) / content, size))
            i, room = len(bins), min(options)[1] - length
            bins.append(None)
        bins[i] = (room, (bins[i][1] if bins[i] else 0) + length)
        chosen.append(i)
    return chosen, [min(s for s in sizes if s >= content) for _, content in bins]


def test_against_the_plain_rule():
    random.seed(3)
    for _ in range(60):
        lengths = sorted((random.randint(1, 32) for _ in range(random.randint(1, 60))), reverse=True)
        bins, _, final = packing.pack(lengths, SIZES, packing.attention_cost)
        assert (bins, final) == plain(lengths, SIZES, packing.attention_cost)


def check(rows, texts, sizes):
    """Every character is packed once, nothing overlaps and no bin is larger than it must be."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        if r.length:
            bins[r.bin_id, r.capacity].append((r.offset, r.length))
        else:
            assert r.bin_id is None and r.capacity is None and r.offset is None
    for doc_id, text in texts.items():
        at = 0
        for start, length in sorted(pieces[doc_id]):
            assert start == at
            at += length
        assert at == len(text or "")
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), spans in bins.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert capacity == min(s for s in sizes if s >= at)
    return bins


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "é" * 100, 4: "x" * 8, 5: "y" * 32, None: "abc"}
    rows = [(i, t, "clash") for i, t in texts.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, length string")
    check(packing.best_fit(frame, SIZES).collect(), texts, SIZES)
    twice = packing.best_fit(frame.union(frame), SIZES).collect()
    assert len(twice) == 2 * len(packing.best_fit(frame, SIZES).collect())
    assert packing.best_fit(frame.limit(0), SIZES).count() == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    bins = check(QUERIES["op1_best_fit_packing"](spark, sf_dir).collect(), texts, packing.CAPACITIES)
    filled = sum(length for spans in bins.values() for _, length in spans)
    assert filled / sum(capacity for _, capacity in bins) > 0.95


def test_shards_hold_everything(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(packing.best_fit(docs, shard_pieces=20).collect(), texts, packing.CAPACITIES)

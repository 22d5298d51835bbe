import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from wardlake.llm import jaccard_join as J
from wardlake.llm.components import components
from wardlake.llm.queries import QUERIES
from wardlake.llm.shingles import shingle_set
from wardlake.session import setting


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lower)


def plain_set(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def plain(docs):
    """Components by counting the overlap of every pair that shares a shingle."""
    sets = [plain_set(t) for _, t in docs]
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            lists[g].append(i)
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        overlaps = defaultdict(int)
        for g in s:
            for j in lists[g]:
                if j < i:
                    overlaps[j] += 1
        for j, n in overlaps.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(docs):
        least[root(i)].append(doc_id)
    names = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return sorted(((d, len(sets[i]), names[root(i)]) for i, (d, _) in enumerate(docs)), key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


def edited(rng, words, share, vocabulary):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in words]


def corpus(seed):
    """Chains of edits around the threshold, copies, shared passages, and odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", " \n\t ", "one", "ONE", "one two three four", "One two  three\nfour", "é É", "é é"]
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(6, 150))]
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(words))
            words = edited(rng, words, rng.choice([0, 0.01, 0.02, 0.03, 0.05]), vocabulary)
    for _ in range(15):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        texts += [" ".join(passage + own)] * rng.randint(1, 3)
    texts.append("again " * 3000)
    rng.shuffle(texts)
    return [(i * 3 - 20, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(4))
def test_against_all_pairs(spark, monkeypatch, seed):
    if seed % 2:
        monkeypatch.setattr(J, "SHARD_SHINGLES", 400)
        monkeypatch.setattr(J, "BLOCK_SHINGLES", 200)
        monkeypatch.setattr(J, "BROADCAST_IDS", 0)
        monkeypatch.setattr(J, "FREQUENT", 20)
        monkeypatch.setattr(J, "LONG", 3)
        monkeypatch.setattr(J, "LONG_BLOCK_SHINGLES", 200)
    docs = corpus(seed)
    docs += [(None, docs[3][1]), (docs[5][0], docs[5][1]), (docs[6][0], docs[9][1])]
    frame = spark.createDataFrame([(*d, "clash", "clash") for d in docs], "doc_id long, text string, n string, shingle string")
    assert got(J.near_groups(frame)) == plain(docs)


@pytest.mark.parametrize("broadcast_ids", [0, J.BROADCAST_IDS])
def test_sets_of_copies_are_moved_once(spark, monkeypatch, broadcast_ids):
    """Copies, some with the same id and some without, and a near copy of them."""
    words = [f"w{i}" for i in range(100)]
    text, near = " ".join(words), " ".join(words[:-1])
    docs = [(i, text) for i in range(50)] + [(7, text)] * 20 + [(None, near)] * 20 + [(99, "other words")]
    sets = []

    def recorded(frame, name, written=J.written):
        out = written(frame, name)
        if name == "shingle-sets":
            sets.append(out)
        return out

    monkeypatch.setattr(J, "written", recorded)
    monkeypatch.setattr(J, "BROADCAST_IDS", broadcast_ids)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert got(J.near_groups(frame)) == plain(docs)
    assert sorted(r.n for r in sets[-1].collect()) in ([], [95, 96]) and any(s.count() == 2 for s in sets)
    assert max(s.count() for s in sets) <= 2 + 2 * 4  # a copy for each task at most


def test_empty_table_and_lone_rows(spark):
    frame = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    assert got(J.near_groups(frame.limit(0))) == []
    assert got(J.near_groups(frame)) == [(1, 0, 1), (2, 1, 2)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf_dir, sf):
    path = sf_dir.replace("sf0.001", sf)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert got(QUERIES["op6_jaccard_join"](spark, path)) == plain(docs)


def test_search_against_counting():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(20):
        base = rng.integers(0, 1 << 60, rng.integers(1, 200), dtype=np.uint64)
        for _ in range(10):
            sets.append(np.unique(np.where(rng.random(len(base)) < 0.06, rng.integers(0, 1 << 60, len(base), dtype=np.uint64), base)))
    index = J.Index(sets)
    for query in sets:
        wanted = []
        for i, other in enumerate(sets):
            n = len(np.intersect1d(query, other))
            if 100 * n >= 80 * (len(query) + len(other) - n):
                wanted.append((i, n))
        assert index.search(query, 80) == wanted


def test_shingles_agree_with_words():
    texts = ["a b c d e f", "A  b\tc d E\x0bf", "a b c d", "x" * 10, "", "é   ü a b c d", "word " * 400_000]
    for text in texts:
        assert len(shingle_set(text)) == len(plain_set(text))
    assert (shingle_set(texts[0]) == shingle_set(texts[1])).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in rows} == {i: root(i) for a, b in edges if a != b for i in (a, b)}
    assert len(rows) == len({r.node for r in rows})


def test_one_of_each_with_columns_of_any_names(spark):
    names = ["gone_id", "gone_hash", "gone_id_2", "a.b", "component"]
    text = "one two three four five six seven"
    frame = spark.createDataFrame([(i, text, *names) for i in (1, 1, 2, 3)], ["doc_id", "text", *names])
    kept = J.one_of_each(frame)
    assert kept.columns == ["doc_id", "text", *names] and [r.doc_id for r in kept.collect()] == [1]


@pytest.mark.parametrize("edges, tables", [([], 1), ([(3, 3)], 1), ([(5, 2), (7, 2), (9, 4)], 2), ([(1, 2), (2, 3), (3, 4)], None)])
def test_components_take_no_more_rounds_than_needed(spark, monkeypatch, edges, tables):
    import wardlake.llm.components as C

    names = []
    keep = C.written
    monkeypatch.setattr(C, "written", lambda rows, name: names.append(name) or keep(rows, name))
    rows = C.components(spark.createDataFrame(edges, "a long, b long"))
    assert tables is None or len(names) == tables
    plainly = {a: a for e in edges if e[0] != e[1] for a in e}
    for _ in edges:
        for a, b in edges:
            if a != b:
                plainly[a] = plainly[b] = min(plainly[a], plainly[b])
    assert {(r.node, r.label) for r in rows.collect()} == set(plainly.items())
    assert rows.count() == len(plainly)


def stored(monkeypatch):
    """Names and folders of the tables that the join stores from now on."""
    import wardlake.llm.components as C

    tables = []
    keep = J.written

    def recorded(frame, name):
        out = keep(frame, name)
        tables.append((name, out.stored_at, frame.sparkSession.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)))
        return out

    monkeypatch.setattr(J, "written", recorded)
    monkeypatch.setattr(C, "written", recorded)
    return tables


def test_what_is_read_no_more_is_deleted(spark, monkeypatch):
    monkeypatch.setattr(J, "LONG", 3)
    tables, key = stored(monkeypatch), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, docs = spark.conf.get(key, None), corpus(1)
    groups = J.near_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    left = [name for name, folder, _ in tables if os.path.exists(re.sub("^file:/*", "/", folder))]
    assert {"prefixes", "shared-shingles", "labelled-lists", "shingle-sets", "likely-pairs", "links"} <= {name for name, *_ in tables}
    assert set(left) <= {"shingle-counts", "links", "edges"}
    assert {cleanup for *_, cleanup in tables} == {"true"} and spark.conf.get(key, None) == before
    assert got(groups) == plain(docs)


def test_frequent_shingles_come_last_however_many_there_are(spark, monkeypatch):
    """A passage in unlike documents is in no prefix, though its shingles are not known one by one."""
    monkeypatch.setattr(J, "FREQUENT", 0)
    shared, keep = [], J._shared
    monkeypatch.setattr(J, "_shared", lambda prefixes: shared.append(keep(prefixes).count()) or keep(prefixes))
    passage = " ".join(f"p{i}" for i in range(50))
    docs = [(d, passage + "".join(f" d{d}w{i}" for i in range(100))) for d in range(20)]
    assert got(J.near_groups(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))) == plain(docs)
    assert shared == [0]


def test_long_lists_are_searched_where_sizes_are_alike(spark, monkeypatch):
    like = {r.n: r.like for r in spark.range(1, 2000).selectExpr("cast(id as int) n").select("n", J._like_size("n", 80).alias("like")).collect()}
    assert all(like[m] - like[n] in (0, 1) for n in like for m in range(n, min(1999, n * 100 // 80) + 1))
    monkeypatch.setattr(J, "SHARD_SHINGLES", 300)
    rng = random.Random(3)
    rows = [(s, e, n, e % 3, 0) for e, n in ((e, rng.randint(1, 400)) for e in range(60)) for s in {e % 2, e % 5, 7}]
    long = spark.createDataFrame(rows, "shingle long, entity long, n int, label long, top long")
    asked, held = ([tuple(r) for r in frame.collect()] for frame in J._long_places(long, 80))
    shard_of = {e: s for s, e in held}
    assert len(held) == len(shard_of) == 60 and len(set(shard_of.values())) > 15
    size = {e: n for _, e, n, *_ in rows}
    lists = [{e for s, e, *_ in rows if s == shingle} for shingle in {r[0] for r in rows}]
    wanted = {(shard_of[y], x) for members in lists for x in members for y in members if x % 3 and 100 * min(size[x], size[y]) >= 80 * max(size[x], size[y])}
    assert wanted <= set(asked) and len(asked) == len(set(asked))
    assert all(abs((shard >> 32) - like[size[x]]) <= 1 for shard, x in asked)


def test_sets_of_unlike_members_of_long_lists_are_not_moved(spark, monkeypatch):
    """Forty documents share a passage, in a long list of several labels; two of them are near copies."""
    monkeypatch.setattr(J, "LONG", 3)
    monkeypatch.setattr(J, "MEETINGS", 0)
    monkeypatch.setattr(J, "_frequent", lambda counted: (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(2, np.uint8)))
    moved, keep = [], J._searched

    def searched(docs, entities, asked, held, *others):
        moved.append((len({r.entity for r in asked.collect()}), len({r.member for r in held.collect()})))
        return keep(docs, entities, asked, held, *others)

    monkeypatch.setattr(J, "_searched", searched)
    passage = " ".join(f"p{i}" for i in range(50))
    docs = [(d, passage + "".join(f" d{d}w{i}" for i in range(60))) for d in range(40)]
    docs += [(40, docs[17][1] + " more"), (41, docs[39][1] + " more")]
    assert got(J.near_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == plain(docs)
    assert moved and all(max(m) <= 4 for m in moved)


def test_copies_are_left_out_without_moving_texts(spark):
    frame = spark.createDataFrame([(i, "one two three four five six seven") for i in range(4)], "doc_id long, text string")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        kept = J.one_of_each(frame)
        assert [r.doc_id for r in kept.collect()] == [0]
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()

import zlib
from hashlib import sha256
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wardlake.llm import merkle as M
from wardlake.llm.queries import ORACLE_SQL, QUERIES

KIND = "doc_id long, source string, lang string, n_chars int, text string, rank string, leaf string, root string, tree string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(leaves):
    """The root and, for each leaf, its siblings by level: (left, right)."""
    nodes, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for i, p in enumerate(at):
            start = p // 3 * 3
            proofs[i].append(("".join(nodes[start:p]), "".join(nodes[p + 1 : start + 3])))
        at = [p // 3 for p in at]
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return (nodes or [None])[0], proofs


def plain(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
        trees[s] = tree([leaf_of(r, r[4]) for r in sources[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for row, proof in zip(sources[s], trees[s][1]):
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            digest = leaf_of(row, text)
            for left, right in proof + top:
                digest = H(left, digest, right)
            sides = "".join(left + right for left, right in proof + top)
            out.append((row[0], leaf_of(row, row[4]), trees[s][0], root, H(sides), digest, digest == root))
    return sorted(out, key=repr)


def ours(spark, rows, levels):
    frame = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], KIND)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return sorted(map(tuple, M.checked(M.manifest(frame, tampered, levels=levels)).collect()), key=repr)


def test_odd_rows_over_several_rounds(spark):
    rows = [(i * 7 % 101, "hot", "en", i, f"text {i}\nline") for i in range(101)]
    rows += [(200 + i, f"s{i}", None, None, None) for i in range(11)] + [(300, None, "é", 1, "ü\n"), (301, None, None, -5, "")]
    rows += [(400, "hot", "en", 1, "same\n")] * 3 + [(None, "hot", "en", 1, "no\nid"), (500, "", "", 0, "\n\n"), (501, "Ä", "", 0, "\x00")]
    true = plain(rows)
    for levels in (1, 2, 7):
        assert ours(spark, rows, levels) == true


@pytest.mark.parametrize("count", [1, 2, 3, 4, 9, 10, 28])
def test_runs_that_are_not_full(spark, count):
    rows = [(i, "s", "en", 1, f"{i}\n") for i in range(count)]
    assert ours(spark, rows, 2) == plain(rows)


def test_an_empty_table(spark):
    assert ours(spark, [], 2) == []


def test_sweeps():
    digests = [H(str(i)) for i in range(14)]
    up = M.height(14)
    known = M.forward(digests, up)
    root, proofs = tree(digests)
    assert known[up, 0] == root
    for i, proof in M.backward(known, up, None).items():
        flat = []
        while proof is not None:
            flat.append(proof[:2])
            proof = proof[2]
        assert flat == proofs[i]


def test_the_query_and_its_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    got = QUERIES["op13_merkle_manifest"](spark, sf_dir)
    rows = sorted(map(tuple, got.collect()), key=repr)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    assert rows == plain([tuple(r) for r in given])
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{Path(sf_dir) / 'documents.parquet'}'")
    listed = ", ".join(got.columns)
    assert sorted(database.execute(f"SELECT {listed} FROM ({ORACLE_SQL['op13_merkle_manifest']})").fetchall(), key=repr) == rows

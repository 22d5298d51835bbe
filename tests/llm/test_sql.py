"""The registered queries against the SQL that is given for them."""

from pathlib import Path

import duckdb
import pytest

from wardlake.llm.oracle import ORACLE_SQL
from wardlake.llm.queries import QUERIES


def same(spark, folder, name):
    database = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        database.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    frame = QUERIES[name](spark, str(folder))
    columns = sorted(frame.columns)
    ours = sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
    theirs = database.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert ours == sorted(theirs, key=repr) and ours


@pytest.mark.parametrize("name", ["op6_jaccard_join", "op10_chat_formatting"])
def test_given_tables(spark, sf_dir, name):
    same(spark, sf_dir, name)


def test_odd_conversations(spark, tmp_path):
    rows = [
        (1, 0, "user", "a[b<c\\"), (1, 1, "assistant", None), (2, None, None, "no role"), (2, 0, "a|b>\\<c", "é🙂|"), (2, 0, "a|b>\\<c", "é🙂|"),
        (3, 0, "system", ""), (3, 1, "assistant", "early"), (4, 0, "assistant", "<s>"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").toPandas().to_parquet(tmp_path / "conversations.parquet")
    same(spark, tmp_path, "op10_chat_formatting")


def test_odd_documents(spark, tmp_path):
    words = [f"w{n}" for n in range(60)]
    texts = [None, "", " \n\t", "One two", "one\ttwo", "one two three", " ".join(words), "  ".join(words).upper(), " ".join([*words, "x", "y"])]
    texts += [" ".join(words[n:]) for n in range(0, 30, 3)] + ["a " * 500, "a " * 20, "É é É é É é", "é é é é é é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    same(spark, tmp_path, "op6_jaccard_join")

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardlake.llm import binary_packing as B
from wardlake.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "  a b ", "it's we'll I'D don't.", "É Éa ÉÉx é K ΣΑΣ Σ. ab cd x y \x85 z\x1cq", "日本語テキスト mixed テ9x 12345 1.5,6",
    "foo.bar, baz., a..b ,. ok?! we'.'s a.'ll", "<|endoftext|> a <|startoftext|>b", "áb ́ a", "ﬁ ǅ İstanbul ŉ ẞ STRASSE ß. é, ÿ.",
    "x" * 3000, "\x01 \x00 ab\x00", "👩‍👩‍👧 ok 'tis 's 'S", "ÀÖØß÷ ×a a÷b", "≮ ≠ ≯x", "a" + "̖̀" * 3 + " b", "१२३ ①② Ⅷ½",
]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    with open(PATH, encoding="utf-8") as file:
        return B.Words(file.read())


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_words_give_the_ids_of_whole_texts(words, whole):
    chance = random.Random(1)
    letters = "abcXYZéÉßñ .,'\n\t 19_-!?́Σσςж語 İ$#"
    texts = ODD + ["".join(chance.choice(letters) for _ in range(chance.randint(1, 60))) for _ in range(2000)]
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert ids_of(ids) == [*whole.encode(text, add_special_tokens=False).ids, 1]


def test_long_texts_go_in_windows(words, whole, monkeypatch):
    text = " ".join(ODD[:6] * 40)
    expected = [*whole.encode(text, add_special_tokens=False).ids, 1]
    for window in (1, 7, 100):
        monkeypatch.setattr(B, "WINDOW", window)
        assert ids_of(words.encode([text])[0]) == expected
    monkeypatch.setattr(B, "REMEMBERED", 3)
    assert ids_of(words.encode([text])[0]) == expected


@pytest.mark.parametrize("tokens", [0, 1, 2, 3, 2047, 2048, 2049, 10_000])
def test_lengths(tokens):
    made = B.lengths(tokens)
    assert sum(made) == tokens and sorted(made, reverse=True) == made
    assert all(n & (n - 1) == 0 and n <= 2048 for n in made)
    assert len({n for n in made if n < 2048}) == len([n for n in made if n < 2048])


def check(pieces, docs, whole):
    """Every id of every document lies in one piece; every sequence is one piece, in the bucket of its length."""
    by_row = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.doc_id is not None, p.doc_id or 0, p.start)):
        by_row[p.doc_id].append(p)
    assert set(by_row) == set(docs)
    for doc_id, texts in docs.items():
        ids = [*whole.encode(texts[0] or "", add_special_tokens=False).ids, 1]
        expected = [(at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())) for at, n in zip(np.cumsum([0, *B.lengths(len(ids))]).tolist(), B.lengths(len(ids)))]
        assert [(p.start, p.length, p.ids_crc32) for p in by_row[doc_id]] == [e for e in expected for _ in texts]
        assert {p.doc_tokens for p in by_row[doc_id]} == {len(ids)}
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    assert all(p.offset == 0 and p.length & (p.length - 1) == 0 and p.length <= 2048 for p in pieces)
    in_order = [p.length for p in sorted(pieces, key=lambda p: p.sequence_id)]
    assert in_order == sorted(in_order)


def test_odd_rows(spark, whole):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (51, "same"), (51, "same"), (None, "no id"), (52, "a b " * 5000)]
    frame = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "doc_id long, text string, ids string, length string, start string")
    docs = defaultdict(list)
    for i, t in rows:
        docs[i].append(t)
    pieces = B.decompose(frame.repartition(3), PATH)
    check(B.summary(pieces).collect(), docs, whole)
    assert B.decompose(frame.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        B.decompose(frame, PATH, largest=1000)


def test_buckets_and_batches(spark, tmp_path):
    frame = spark.createDataFrame([(i, "a b c " * i) for i in range(60)], "doc_id long, text string")
    pieces = B.decompose(frame, PATH)
    B.write_buckets(pieces, str(tmp_path / "buckets"))
    stored = spark.read.parquet(str(tmp_path / "buckets"))
    assert stored.selectExpr("length(ids) = 4 * length AS fine").distinct().collect() == [(True,)]
    assert stored.count() == pieces.count()
    sums = defaultdict(int)
    for p in B.batches(pieces, 64).collect():
        sums[p.bucket, p.sequence_id >> B.NUMBER_BITS, p.batch] += p.length
    assert all(total <= max(64, bucket) for (bucket, _, _), total in sums.items())


def test_the_query(spark, sf_dir, whole):
    docs = {r.doc_id: [r.text] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(QUERIES["op12_binary_packing"](spark, sf_dir).collect(), docs, whole)

import base64
import hashlib
import itertools
import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wardlake.llm import byte_bpe
from wardlake.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    random.seed(5)
    yield from ["", " ", "a", "\n\n  b", "x" * 700, "ab" * 900, "<|endoftext|>", "\0ÿ é 漢字 🙂🙂", "it's we'll", "a" * 64, "a" * 65]
    yield "".join(chr(random.randint(32, 0x2FFF)) for _ in range(3000))
    yield "word and word " * 20_000


def test_ids_equal_the_library(spark, reference):
    texts = [None, *odd_texts(), "a", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    encoded = byte_bpe.encode(rows, RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in byte_bpe.decode(encoded, RANKS).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        expected = reference.encode_ordinary(text or "")
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == expected
        assert got[i].n_tokens == len(expected)
        assert bytes(got[i].decoded) == (text or "").encode()


def test_both_trees_agree():
    with open(RANKS, "rb") as file:
        merges = byte_bpe.Merges(file.read(), public_tokenizers.PATTERN)
    random.seed(2)
    for _ in range(300):
        word = bytes(random.choice(b"etaoin hs") for _ in range(random.randint(2, 64)))
        if word not in merges.rank:
            assert merges._one(word) == merges.pieces([word])[0]


@pytest.fixture(scope="module")
def merges():
    with open(RANKS, "rb") as file:
        return byte_bpe.Merges(file.read(), public_tokenizers.PATTERN)


def hard_texts():
    chance = random.Random(4)
    pick = lambda letters, n: "".join(chance.choice(letters) for _ in range(n))
    yield "han", "".join(chr(chance.randint(0x4E00, 0x9FA5)) for _ in range(60_000))
    yield "common han", pick("的一是不了人我在有他这中大来上国", 60_000)
    yield "kana", "".join(chr(chance.randint(0x3041, 0x3096)) for _ in range(60_000))
    yield "base64", base64.b64encode(chance.randbytes(120_000)).decode()
    yield "addresses", " ".join("https://ex.com/" + pick("abcdefghijklmnop/-_%20", 600) for _ in range(300))
    yield "letters", pick("etaoinshrdlu", 150_000)
    yield "marks", pick("!@#$%^&*()_+-=[]{}|;:,.<>?/~", 150_000)


def test_long_pieces_keep_pace(merges, reference):
    """Texts that are one piece, or few, take at most three times as long per byte as words
    between spaces; common letters without any space, which hardly ever can be cut, six times."""
    chance = random.Random(3)
    english = " ".join("".join(chance.choice("etaoinshrdlu") for _ in range(chance.randint(2, 9))) for _ in range(40_000))

    def pace(text):
        merges.seen.clear()
        start = time.process_time()
        ids = merges.encode([text])[0]
        took = time.process_time() - start
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        return took / len(text.encode())

    usual = min(pace(english) for _ in range(2))
    for name, text in hard_texts():
        assert min(pace(text) for _ in range(2)) < (6 if name == "letters" else 3) * usual, name
    for run in ("=" * 20_000, " " * 20_000, "ab" * 10_000):
        pace(run)


def test_no_token_reaches_over_a_cut(merges):
    chance = random.Random(6)
    tokens = [t for t in merges.rank if len(t) > 1]
    for _ in range(300):
        word = b"".join(chance.choice(tokens) for _ in range(12))
        parts = merges.parts(word)
        assert b"".join(parts) == word
        cuts = set(itertools.accumulate(map(len, parts[:-1])))
        for start in range(len(word)):
            for end in range(start + 2, min(len(word), start + 20) + 1):
                if word[start:end] in merges.rank:
                    assert not cuts & set(range(start + 1, end))


def test_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(rows, RANKS, public_tokenizers.PATTERN).count() == 0


def test_query_against_the_library(spark, reference, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op8_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = reference.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()

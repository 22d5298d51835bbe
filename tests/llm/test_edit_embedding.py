import hashlib
import random

import numpy as np
import pytest

from wardlake.llm import edit_embedding as E
from wardlake.llm.queries import QUERIES

WALKS = E.Walks()


def plain_fingerprint(text):
    """The walk one time step after another, with every written character kept."""
    coins = (E._mix(np.arange(E.CLASSES * E.PERIOD)) & np.uint64(1)).astype(bool).reshape(E.CLASSES, E.PERIOD)
    coins[:, -1] = True
    written, at = [], 0
    while at < len(text):
        code = ord(text[at])
        written.append(code)
        at += bool(coins[(code ^ (code >> 8) * 37) % E.CLASSES, (len(written) - 1) % E.PERIOD])
    out = []
    for slot in range(E.SLOTS):
        times = range(slot, len(written), E.SLOTS)
        if not times:
            out.append(0)
            continue
        time = min(times, key=lambda t: int(E._mix(np.array([t + (1 << 40)]))[0]))
        out.append(int(E._mix(np.array([written[time] * E.SLOTS + slot], np.uint64))[0] % np.uint64(255)) + 1)
    return bytes(out).hex()


def prints(texts):
    return [f.tobytes().hex() for f in WALKS.fingerprints(texts)]


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_against_the_plain_walk():
    rng = random.Random(4)
    texts = ["", "a", "ab", "é🙂漢", "x" * 500, *(words(rng, rng.randint(1, 300)) for _ in range(12))]
    assert prints(texts) == [plain_fingerprint(t) for t in texts]


def test_few_edits_change_few_slots():
    """A walk needs a while to meet the other again, at times a long one, so this holds for most edits."""
    rng, near, far = random.Random(1), [], []
    for _ in range(40):
        text = words(rng, 400)
        at = rng.randrange(len(text))
        a, b, c = WALKS.fingerprints([text, text[:at] + "zq" + text[at + 1 :], words(rng, 400)])
        near.append(E.likeness(a, b))
        far.append(E.likeness(a, c))
    assert np.median(near) > 0.9 and np.mean(np.array(near) > 0.5) > 0.8 and max(far) < 0.3


def neighbours(docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    docs = [(i, t or "") for i, t in docs]
    for (doc_id, text), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        new = E.edited(text, following)
        yield doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), *prints([text, new, following])


def check(rows, docs):
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows), key=str)
    wanted = []
    for doc_id, n, digest, own, changed, following in neighbours(docs):
        a, b, c = (np.frombuffer(bytes.fromhex(x), np.uint8) for x in (own, changed, following))
        wanted.append((doc_id, n, digest, own, changed, float(E.likeness(a, b)), float(E.likeness(a, c))))
    assert got == sorted(wanted, key=str)


@pytest.mark.parametrize("run_rows", [1, 3, 2000])
def test_rows_and_their_next(spark, monkeypatch, run_rows):
    monkeypatch.setattr(E, "RUN_ROWS", run_rows)
    docs = [(5, "five five"), (1, None), (2, ""), (9, "nine, the last"), (9, "nine again"), (7, "seven" * 50), (3, "a"), (3, "a"), (-4, "é🙂"), (None, "none"), (None, "b")]
    for own in (docs, docs[:-2], docs[:1]):
        frame = spark.createDataFrame([(*d, "clash") for d in own], "doc_id long, text string, run string")
        check(E.with_next(frame).collect(), own)
    assert E.with_next(frame.limit(0)).count() == 0


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(QUERIES["op2_edit_embedding"](spark, sf_dir).collect(), docs)


def test_links(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(20):
        text = words(rng, 200)
        texts += [text, text, text[:300] + "!" + text[301:]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = {frozenset((r.fingerprint, r.near)) for r in E.linked(E.fingerprint(frame), 0.7).collect()}
    made = prints(texts)
    unlike = [(a, b) for a, b in zip(made[::3], made[2::3], strict=True) if a != b]
    alike = {frozenset((a, b)) for a, b in unlike if E.likeness(*(np.frombuffer(bytes.fromhex(x), np.uint8) for x in (a, b))) >= 0.7}
    assert alike and pairs == alike

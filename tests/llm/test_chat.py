import hashlib
from collections import defaultdict

import pytest

from wardlake.llm import chat
from wardlake.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, segments string"


def plain(rows):
    """Digests of each conversation, straight from its rows."""
    grouped = defaultdict(list)
    for conv_id, turn, role, text in rows:
        grouped[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv_id, turns in grouped.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        learned = "".join(text for *_, role, text in turns if role == "assistant")
        out[conv_id] = (
            len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()
        )
    return out


def seen(frame):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in frame.collect()}


def test_odd_conversations(spark):
    marks = [m for pair in chat.INSTRUCT.marks.values() for m in pair]
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"),
        (2, 0, "assistant", "first"), (2, 1, "assistant", None), (2, None, None, "no role"),
        (3, 0, "user", "".join(marks) + "\\" * 5), (3, 1, "assistant", "\\<s>\\\\</s><|x|>" * 50),
        (4, 0, "a|b>\\<c", "odd role"), (4, 0, "a|b>\\<c", "odd role"), (4, 1, "", ""),
        (None, 0, "user", "no id"), (5, 0, "system", ""), (5, 1, "user", ""), (5, 2, "assistant", "é🙂" * 5000),
    ]
    given = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    formatted = chat.format_turns(given)
    back = chat.read_back(formatted)
    assert seen(back) == plain(rows)
    assert {r.conv_id: r.valid for r in back.collect()} == {1: True, 2: False, 3: True, 4: False, None: True, 5: True}
    lengths = defaultdict(int)
    for r in formatted.collect():
        lengths[r.conv_id] += sum(len(s.text) for s in r.segments)
    assert {r.conv_id: r.formatted_chars for r in back.collect()} == dict(lengths)


def test_format_is_as_declared(spark):
    given = spark.createDataFrame([(1, 0, "user", "a[b"), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_turns(given).collect(), key=lambda r: r.position)
    assert "".join(s.text for r in rows for s in r.segments) == "[INST]a\\[b[/INST]<s>ok</s>"
    assert [s.text for r in rows for s in r.segments if s.loss] == ["ok"]


def test_marks_must_differ():
    with pytest.raises(ValueError):
        chat.Template({"user": ("<a>", "<a>")}, frozenset(), {})


def test_empty_table(spark):
    given = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(given)).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert seen(QUERIES["op10_chat_formatting"](spark, sf_dir)) == plain(rows)

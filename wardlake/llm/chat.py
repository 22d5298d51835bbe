"""Chat formatting by a finite-state machine over roles.

A template declares, for every role, the text before and after a turn and whether the
turn's text counts for the loss, and which role may follow which. Rows are ordered by
conversation and turn and pass through the machine one at a time; each gives the text
segments of its turn with a loss flag per segment. Nothing is held per conversation but
the machine's state, so that one may be of any length.

Control strings inside texts are escaped: the escape character and the first character
of every control string are preceded by the escape character. The formatted text can
therefore be read back to exactly the turns that went in.

Defined results: null text is empty; null role is the role ``""``; unknown roles and
turns out of order are formatted all the same, with ``valid`` false; equal turn numbers
are ordered by role and text (null turns first); repeated rows are turns of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import blocks

START = "start"


@dataclass(frozen=True)
class Template:
    """``marks``: role to (before, after); ``loss``: roles that are learned; ``follows``: state to roles allowed next.

    ``other`` marks roles that ``marks`` doesn't name; it has a place for the role's name.
    """

    marks: dict[str, tuple[str, str]]
    loss: frozenset[str]
    follows: dict[str, frozenset[str]]
    other: tuple[str, str] = ("<|{}|>", "<|/{}|>")
    escape: str = "\\"

    def __post_init__(self):
        texts = [m for pair in self.marks.values() for m in pair]
        if any(len(p[0]) == 0 or len(p[1]) == 0 for p in self.marks.values()) or len(set(texts)) != len(texts):
            raise ValueError("every role needs marks of its own before and after its turns")
        if any(self.escape in m for m in [*texts, *self.other]):
            raise ValueError("a mark must not hold the escape character")

    @property
    def controls(self) -> frozenset[str]:
        """The characters that begin a control string."""
        return frozenset([self.escape, *(m[0] for pair in [*self.marks.values(), self.other] for m in pair)])


INSTRUCT = Template(
    marks={"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")},
    loss=frozenset({"assistant"}),
    follows={
        START: frozenset({"system", "user"}),
        "system": frozenset({"user"}),
        "user": frozenset({"assistant"}),
        "assistant": frozenset({"user"}),
    },
)


class Machine:
    """Steps through the turns of conversations and writes their segments."""

    def __init__(self, template: Template):
        self.template = template
        self.special = re.compile("[" + re.escape("".join(sorted(template.controls))) + "]")
        self.state = START

    def escaped(self, text: str) -> str:
        return self.special.sub(lambda m: self.template.escape + m.group(), text)

    def step(self, role: str, text: str) -> tuple[bool, list[tuple[str, bool]]]:
        """Whether the turn is allowed here, and its segments."""
        template = self.template
        valid = role in template.follows.get(self.state, ())
        self.state = role
        if role in template.marks:
            before, after = template.marks[role]
        else:
            before, after = (m.format(self.escaped(role).replace("|", template.escape + "|")) for m in template.other)
        return valid, [(before, False), (self.escaped(text), role in template.loss), (after, False)]


class Reader:
    """Reads the turns back out of formatted text."""

    def __init__(self, template: Template):
        escape = re.escape(template.escape)
        self.template = template
        self.unescape = re.compile(escape + "(.)", re.DOTALL)
        name = rf"(?:[^|{escape}]|{escape}.)*"
        opens = [rf"(?P<k{i}>{re.escape(b)})" for i, (b, _) in enumerate(template.marks.values())]
        first, second = template.other[0].split("{}")
        opens.append(f"{re.escape(first)}(?P<name>{name}){re.escape(second)}")
        self.opening = re.compile("|".join(opens), re.DOTALL)
        self.body = re.compile("(?:[^" + re.escape("".join(sorted(template.controls))) + f"]|{escape}.)*+", re.DOTALL)
        self.roles = list(template.marks)

    def plain(self, text: str) -> str:
        return self.unescape.sub(r"\1", text)

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(formatted):
            found = self.opening.match(formatted, at)
            if not found:
                raise ValueError(f"no turn begins at {at}")
            if found.lastgroup == "name":
                role, after = self.plain(found["name"]), self.template.other[1].format(found["name"])
            else:
                role = self.roles[int(found.lastgroup[1:])]
                after = self.template.marks[role][1]
            body = self.body.match(formatted, found.end())
            if not formatted.startswith(after, body.end()):
                raise ValueError(f"the turn at {at} doesn't end")
            yield role, self.plain(body.group())
            at = body.end() + len(after)


SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_turns(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """``conv_id``, ``position`` (from 0), ``valid`` and ``segments`` (array of text and loss) of every turn.

    ``conversations`` has conv_id, turn, role and text. Rows of a conversation lie in one
    partition, in order of ``position``.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, conversation, position = Machine(template), object(), 0
        for batch in batches:
            for part in blocks(batch, "text"):
                positions, valids, segments = [], [], []
                turns = zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)
                for conv_id, role, text in turns:
                    if conv_id != conversation:
                        machine, conversation, position = Machine(template), conv_id, 0
                    valid, made = machine.step(role, text)
                    positions.append(position)
                    valids.append(valid)
                    segments.append([{"text": t, "loss": loss} for t, loss in made])
                    position += 1
                columns = [part.column("conv_id"), pa.array(positions, pa.int64()), pa.array(valids, pa.bool_())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(segments, SEGMENTS)], ["conv_id", "position", "valid", "segments"]
                )

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(
        run, "conv_id long, position long, valid boolean, segments array<struct<text: string, loss: boolean>>"
    )


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation, from the segments that :func:`format_turns` wrote, in its order.

    ``turns_sha256`` is over role, newline, text, newline of every turn; ``loss_chars`` and
    ``loss_sha256`` are over all text under the loss mask, unescaped. The digests are
    updated turn by turn.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, conversation = Reader(template), object()
        done: list[tuple] = []
        state: list = []

        def close() -> None:
            if state:
                done.append((conversation, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
            columns = list(zip(*done, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "valid", "segments")), strict=True)
            for conv_id, valid, segments in rows:
                if conv_id != conversation:
                    close()
                    conversation, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                formatted_text = "".join(s["text"] for s in segments)
                for role, text in reader.turns(formatted_text):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                learned = reader.plain("".join(s["text"] for s in segments if s["loss"]))
                state[2] += len(learned)
                state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted_text)
                state[5] &= valid
            yield out()
            done.clear()
        close()
        yield out()

    return formatted.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long, valid boolean",
    )

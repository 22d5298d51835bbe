import itertools
import random
import re
import zlib

import pytest

from wardlake.llm import repeated_units
from wardlake.llm.queries import QUERIES

LONG = "This sentence has quite a few words in it to be found again."
MANY = (1 << 64) - 1


def unspaced(c):
    return any(a <= ord(c) <= b for a, b in [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)])


def atoms(text):
    """Words, and single letters of scripts without spaces, with their places."""
    out, word = [], []
    for k, c in enumerate([*text, " "]):
        if c.isspace() or unspaced(c):
            if word:
                out.append((word[0], "".join(text[i] for i in word).lower()))
            word = []
            if unspaced(c):
                out.append((k, c))
        else:
            word.append(k)
    return out


def weight(words):
    return sum(0.5 if len(w) == 1 and unspaced(w) else 1 + len(w) // 32 for w in words)


def opened(pieces, least):
    """For pieces (start, end, words) in a row: units forwards from each, and one backwards if the last fall short."""
    out, short = [], False
    for i in range(len(pieces)):
        for j in range(i, len(pieces)):
            words = [w for p in pieces[i : j + 1] for w in p[2]]
            if weight(words) >= least:
                out.append((pieces[i][0], pieces[j][1], tuple(words)))
                break
        else:
            short = True
    for i in reversed(range(len(pieces) if short else 0)):
        words = [w for p in pieces[i:] for w in p[2]]
        if weight(words) >= least:
            out.append((pieces[i][0], pieces[-1][1], tuple(words)))
            break
    return out


def parts(text, start, end):
    """A long sentence cut at words whose mixed hash is least among four on either side."""
    own = atoms(text[start:end])
    crc = [zlib.crc32(w.encode()) for _, w in own]
    value = []
    for k, c in enumerate(crc):
        v = c * 0x9E3779B97F4A7C15 & MANY
        if k:
            v ^= crc[k - 1] * 0xC2B2AE3D27D4EB4F & MANY
        value.append(v ^ v >> 29)
    cuts = [k for k in range(4, len(own) - 4) if all(value[k] < value[k - i] and value[k] <= value[k + i] for i in range(1, 5))]
    edges = [0, *cuts, len(own)]
    places = [start, *(start + own[c][0] for c in cuts), end]
    return [(a, b, [w for _, w in own[x:y]]) for a, b, x, y in zip(places, places[1:], edges, edges[1:])]


def plain_units(text, least):
    out = set()
    lines, at = [], 0
    for line in text.split("\n"):
        pieces = [(at + m.start(), at + m.end(), [w for _, w in atoms(m.group())]) for m in re.finditer(r"[^.!?。！？]*(?:[.!?。！？]+\s*|$)", line) if m.group().strip()]
        lines.append((pieces, bool(re.search(r"[.!?。！？]\s*$", line))))
        out.update(opened(pieces, least))
        at += len(line) + 1
    for blank, group in itertools.groupby(lines, lambda x: not x[0]):
        group = [] if blank else list(group)
        sentences, going = [], False
        for pieces, stopped in group:
            short = len(group) > 1 and weight([w for p in pieces for w in p[2]]) < least
            for start, end, words in pieces:
                if going:
                    before = sentences.pop()
                    sentences.append((before[0], end, before[2] + words, True, before[4]))
                else:
                    sentences.append((start, end, words, False, short))
                going = False
            going = not stopped
        plainly = [s[:3] for s in sentences]
        rest = False
        for i, (start, end, words, broken, short) in enumerate(sentences):
            if weight(words) > 32 and len(words) > 8:
                out.update(opened(parts(text, start, end), least))
            if (broken or (short and weight(words) < least)) and not rest:
                found = opened(plainly[i:], least)
                if found and found[0][0] == start:
                    out.add(found[0])
                else:
                    out.update(opened([(0, 0, []), *plainly], least)[-1:] if weight([w for s in plainly for w in s[2]]) >= least else [])
                    rest = True
    return sorted(out)


def plain(docs, least=repeated_units.LEAST_WORDS):
    """What stays of each text, by walking all units in rank order."""
    seen, out = {}, {}
    for doc_id, text in sorted(docs.items()):
        text, spans = text or "", []
        for start, end, key in plain_units(text, least):
            first = seen.setdefault(key, (doc_id, start, end))
            if first[0] != doc_id or start >= first[2]:
                spans.append((start, end))
        gone = {k for a, b in spans for k in range(a, b)}
        kept, at = [], 0
        # a line that is left blank goes with its break, unless a span goes on over the break
        for line in text.split("\n"):
            left = "".join(c for k, c in enumerate(line, at) if k not in gone)
            touched = any(k in gone for k in range(at, at + len(line)))
            kept.append((left, touched and not left.strip(), at + len(line) in gone))
            at += len(line) + 1
        out[doc_id] = joined(kept)
    return out


def joined(lines):
    """Lines put together again: (what is left, whether it goes, whether its break was cut)."""
    done, at = "", 0
    while at < len(lines):
        run = [lines[at]]
        while run[-1][2] and at + 1 < len(lines):
            at += 1
            run.append(lines[at])
        left = "".join(x[0] for x in run)
        goes = any(x[1] for x in run) and not left.strip()
        last = at == len(lines) - 1
        done += "" if goes else left + ("" if last else "\n")
        at += 1
    return done


def run(spark, rows, **options):
    kind = "doc_id long, text string, start string, spans string"
    frame = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], kind)
    return repeated_units.without_repeats(frame, **options).collect()


def test_small_cases(spark):
    rows = [
        (1, f"Alpha beta. {LONG} Tail here."),
        (2, f"{LONG.upper()}\nown line"),
        (3, None),
        (4, ""),
        (5, f"a b c. {LONG}\n\n{LONG}   \nend"),
        (6, "short line\nshort line"),
        (7, "One two. Three four. Five six. Seven eight. Nine"),
        (8, "Prefix. One two. Three four. Five six. Seven eight. Nine"),
        (9, "no stop " * 5000),
        (10, "no stop " * 5000),
    ]
    got = {r.doc_id: r for r in run(spark, rows)}
    assert {k: r.text for k, r in got.items()} == plain(dict(rows))
    assert got[2].text == "own line" and [tuple(s) for s in got[2].removed] == [(0, len(LONG) + 1)]
    assert got[6].text == "short line\nshort line" and got[3].text == ""
    assert got[10].text == "" and got[9].text == rows[8][1]
    for doc_id, text in rows:
        cut = {k for s in got[doc_id].removed for k in range(s.start, s.end)}
        assert "".join(c for k, c in enumerate(text or "") if k not in cut) == got[doc_id].text


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, LONG), (1, LONG), (None, LONG), (2, LONG), (2, f"{LONG} And more of it.")]
    got = sorted((str(r.doc_id), r.text) for r in run(spark, rows))
    assert got == [("1", ""), ("1", ""), ("2", ""), ("2", "And more of it."), ("None", LONG)]
    assert run(spark, []) == []


def words(chance, n):
    return ["".join(chance.choice("abcdefghijklmnop") for _ in range(chance.randint(2, 8))) for _ in range(n)]


def lay(passage, width):
    return "\n".join(" ".join(passage[i : i + width]) for i in range(0, len(passage), width))


def share_cut(text, passage, row):
    at = text.index(passage)
    return sum(max(0, min(s.end, at + len(passage)) - max(s.start, at)) for s in row.removed) / len(passage)


@pytest.mark.parametrize("case", ["ten lines of six", "in a line", "two widths", "no spaces", "verse", "one long word"])
def test_passages_are_found_however_they_are_laid_out(spark, case):
    chance = random.Random(case)
    rows, passages = [], {}
    for k in range(30):
        passage = words(chance, 60)
        around = [" ".join(words(chance, chance.randint(5, 30))) for _ in range(4)]
        if case == "ten lines of six":
            first = second = lay(passage, 6)
        elif case == "in a line":
            first = second = " ".join(passage)
        elif case == "two widths":
            first, second = lay(passage, 12), lay(passage, 10)
        elif case == "verse":
            first = second = "\n".join(" ".join(passage[i : i + 5]) + "," for i in range(0, 60, 5)) + "."
        elif case == "one long word":
            first = second = "".join(passage)
            around = [a + "." for a in around[:1]] + ["so."] + [a + "." for a in around[2:3]] + ["end."]
        else:
            first = second = "".join(chr(chance.randint(0x4E00, 0x5200)) for _ in range(400))
        rows += [(2 * k, f"{around[0]} {first} {around[1]}"), (2 * k + 1, f"{around[2]} {second} {around[3]}")]
        if case == "one long word":
            rows[-2:] = [(2 * k, f"{around[0]}\n{first}\n{around[1]}"), (2 * k + 1, f"{around[2]}\n{second}\n{around[3]}")]
        passages[2 * k + 1] = second
    got = {r.doc_id: r for r in run(spark, rows)}
    shares = [share_cut(dict(rows)[i], p, got[i]) for i, p in passages.items()]
    assert min(shares) > 0 and sum(shares) / len(shares) > 0.6
    assert all(not r.removed for i, r in got.items() if i % 2 == 0)
    assert {i: r.text for i, r in got.items()} == plain(dict(rows))


def test_random_layouts_against_plain(spark):
    chance = random.Random(7)
    stock = [" ".join(words(chance, n)) for n in (3, 5, 9, 12, 40, 70)] + ["漢字かな交じり文です。", "短い", LONG]
    rows = []
    for k in range(150):
        text = "".join(chance.choice(stock) + chance.choice([" ", ". ", "\n", "\n\n", ".\n", " \n \n", "! "]) for _ in range(chance.randint(1, 14)))
        rows.append((k, text))
    got = {r.doc_id: r.text for r in run(spark, rows)}
    assert got == plain(dict(rows))


def test_a_kept_unit_is_not_cut_by_its_own_repeats(spark):
    rows = [(1, "No. " * 10), (2, "No. " * 17), (3, "Yes. " * 20)]
    assert {r.doc_id: r.text.strip() for r in run(spark, rows)} == {1: "No. No. No. No. No. No. No. No. No. No.", 2: "", 3: "Yes. Yes. Yes. Yes. Yes. Yes. Yes. Yes."}


def test_columns_may_have_any_names(spark):
    names = ["_gone_id", "gone_id", "gone_hash", "gone_spans", "removed", "removed_spans", "a.b"]
    frame = spark.createDataFrame([(1, LONG, *names), (2, LONG, *names)], ["doc_id", "text", *names])
    rows = repeated_units.without_repeats(frame).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", *names, "removed_spans_2"}
    assert sorted((r.doc_id, r.text, r["a.b"]) for r in rows) == [(1, LONG, "a.b"), (2, "", "a.b")]


def test_query_against_plain(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.text for r in QUERIES["op7_substring_dedup"](spark, sf_dir).collect()} == plain(docs)

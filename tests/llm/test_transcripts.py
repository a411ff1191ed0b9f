"""Transcripts against a plain parser and renderer: borders of chunks and ranges, long texts, rows without a key."""

import collections
import re

import numpy as np
import pytest
import xxhash

from contentloom.llm import transcripts as T

FIELDS = "conv_id long, turn long, role string, text string"


def seen(line):
    found = re.match(T.MARKER, line)
    name = next((g for g in found.groups() if g), "").lower() if found else ""
    role = next((i + 1 for i, r in enumerate(T.ROLES) if name in T.NAMES[r]), 0)
    return role, min(T.LENGTHS - 1, int(np.floor(np.log2(len(line) + 1) * 0.75))), int(bool(re.search(r"\?\s*$", line)))


def plain(rows, model):
    """Turns of all rows: conversation, place, line, role, lines, text."""
    groups = collections.defaultdict(list)
    for i, (conv, place, _, text) in enumerate(rows):
        text = text or ""
        h = xxhash.xxh64_intdigest(text.encode(), seed=42)
        groups[conv if conv is not None and place is not None else ("row", i)].append((place if place is not None else 0, h - (1 << 64) * (h >> 63), text, conv, place))
    out = []
    for own in groups.values():
        lines = [(conv, place, n, line) for _, _, text, conv, place in sorted(own, key=lambda r: r[:2]) for n, line in enumerate(text.split("\n"))]
        marks = [seen(x[3]) for x in lines]
        e = model.emission(*(np.array(c) for c in zip(*marks)))
        score, back = model.start + e[0], []
        for x in e[1:]:
            through = score[:, None] + model.step
            back.append(through.argmax(0))
            score = through.max(0) + x
        states = [int(score.argmax())]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        turns = []
        for (conv, place, n, line), state, mark in zip(lines, states[::-1], marks):
            role, begins = T.STATES[state]
            if begins or not turns:
                turns.append([conv, place, n, role, []])
                line = re.sub(T.MARKER, "", line) if mark[0] and begins else line
            turns[-1][4].append(line)
        out += [(c, p, n, r, len(x), "\n".join(x).strip(" ")) for c, p, n, r, x in turns]
    return sorted(out, key=repr)


def got(rows):
    return sorted(((r.conv_id, r.place, r.line, r.role, r.n_lines, r.text) for r in rows.collect()), key=repr)


def talk(c, n):
    roles = ["user", "assistant"]
    return [(c, t, roles[t % 2], ("User: " if t % 2 == 0 else "Assistant: ") * (t % 5 != 3) + "text" * (t % 7) + "\nmore?" * (t % 3)) for t in range(n)]


ROWS = [r for c, n in ((1, 40), (2, 5), (3, 1), (4, 90)) for r in talk(c, n)]
# One turn of 200 places, a long text, repeated rows, rows without a key, odd texts.
ODD = [(10, 0, None, "Assistant: begins")] + [(10, t, None, "goes on and on") for t in range(1, 200)] + [(11, 0, None, "User: w\n" + "w\n" * 5000 + "### Assistant\nbye")]
ODD += [(12, 1, None, "Assistant: yes")] * 3 + [(12, 0, None, "User: a?\nb"), (12, 1, None, "Assistant: no"), (13, 5, None, None), (14, 0, None, ""), (15, -1, None, "[USER] hi")]
ODD += [(None, 0, None, "User: same\nrow")] * 50 + [(None, None, None, None)] * 4 + [(16, None, None, "<|assistant|>x"), (16, None, None, "  Human:  ")]


@pytest.mark.parametrize("chunk,fan", [(3, 4), (1024, 64)])
def test_equals_plain_parser(spark, monkeypatch, chunk, fan):
    monkeypatch.setattr(T, "CHUNK", chunk)
    monkeypatch.setattr(T, "FAN", fan)
    model = T.fitted(spark.createDataFrame(ROWS, FIELDS))
    table = spark.createDataFrame(ROWS + ODD, FIELDS).repartition(7)
    found = T.parsed(table, model)
    assert got(found) == plain(ROWS + ODD, model)
    assert all(r.chat == f"<|im_start|>{r.role}\n{r.text}<|im_end|>" for r in found.collect())


def test_many_equal_rows_and_a_very_long_text(spark):
    model = T.fitted(spark.createDataFrame(ROWS, FIELDS))
    rows = [(None, 3, None, "User: q")] * 1000 + [(1, 0, None, "Assistant: a\n" + "word\n" * 100_000)]
    turns = got(T.parsed(spark.createDataFrame(rows, FIELDS), model))
    assert turns == plain(rows, model) and len([t for t in turns if t[0] is None]) == 1000
    assert sum(t[4] for t in turns) == 1000 + 100_002


def test_empty_table_and_clashing_names(spark):
    model = T.fitted(spark.createDataFrame([], FIELDS))
    assert T.parsed(spark.createDataFrame([], FIELDS), model).count() == 0
    rows = [(*r, 1, "k", 2, "l") for r in talk(1, 3)]
    table = spark.createDataFrame(rows, FIELDS + ", place int, key string, number int, line string")
    assert got(T.parsed(table, model)) == plain([r[:4] for r in rows], model)

"""The conversation trie against a plain one, on odd rows and with small chunks."""

import collections
import random
import zlib

import pytest
from brute import sha

from contentloom.llm import conversation_trie

FIELDS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + mine[h:]
    return out


def plain(rows):
    whole = rebuilt(rows)
    members = collections.defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k))))
        for k, m in members.items()
    )


def found(made):
    rows = made.nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1]))


def odd_rows():
    rnd, rows = random.Random(3), []
    for c in range(60):
        for t in range(rnd.randint(1, 14)):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bé", ""])))
    for c in range(100, 160):  # copies of one conversation
        rows += [(c, t, "user", "same") for t in range(9)]
    rows += [(7, 0, "user", "twice")] * 5 + [(200, None, None, None), (200, None, "user", "x"), (200, 3, "user", None)]
    rows += [(300, t, "user", "w" * 40_000 if t == 30 else "w") for t in range(50)] + [(None, 1, "user", "nobody's"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("chunk", [3, 4096])
def test_equals_plain_trie(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversation_trie, "CHUNK", chunk)
    monkeypatch.setattr(conversation_trie, "LIST", min(chunk, 512))
    monkeypatch.setattr(conversation_trie, "REPEATS", min(chunk, 65_536))
    rows = odd_rows()
    made = conversation_trie.trie(spark.createDataFrame(rows, FIELDS).repartition(5))
    assert found(made) == sorted(plain(rows), key=lambda r: (r[0], r[1]))
    assert sum(r.weight for r in made.sequences.collect()) == made.ends.count() == len(rebuilt(rows))


def test_texts_of_nodes(spark):
    rows = odd_rows()
    table = spark.createDataFrame(rows, FIELDS)
    whole = rebuilt(rows)
    got = conversation_trie.with_last_turn(conversation_trie.trie(table), table).collect()
    for r in got:
        assert (r.role, r.text) == (whole[r.conv_id][r.depth - 1] if r.depth else (None, None))


def test_empty_table_and_clashing_names(spark):
    assert found(conversation_trie.trie(spark.createDataFrame([], FIELDS))) == []
    assert found(conversation_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], FIELDS))) == []
    rows = [(1, 1, "user", "x", 4, 5, "z", 9), (1, 0, "user", "", 4, 5, "z", 9)]
    made = conversation_trie.trie(spark.createDataFrame(rows, FIELDS + ", conv int, place int, said string, depth int"))
    assert found(made) == sorted(plain([r[:4] for r in rows]), key=lambda r: (r[0], r[1]))

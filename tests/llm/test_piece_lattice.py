import hashlib
import random

import numpy as np
import pytest
from public_tokenizers import path

from contentloom.llm import piece_lattice as L
from contentloom.llm.entry import op8_sentencepiece

MODEL = path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return L.Vocabulary.read(MODEL)


def all_paths(v, text):
    """Scores and ids of every segmentation of a whole text, without segments."""
    arcs = v.arcs(text)
    paths = [[(0.0, ())]]
    for place in arcs[1:]:
        paths.append([(s + x, ids + more) for i, x, more in place for s, ids in paths[i]])
    return sorted(paths[-1], reverse=True)


def test_n_best_equals_all_paths(vocabulary):
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice("the ingé1²._\n漢|") for _ in range(rnd.randint(1, 12)))
        paths = all_paths(vocabulary, L.BLANK + text.replace(" ", L.BLANK))
        for n in (1, 2, 5):
            ids, scores = L.Encoder(vocabulary, n).encode(text)
            assert scores == [s for s, _ in paths[:n]]
            assert (scores[0], tuple(ids)) in paths
            top = vocabulary.best(L.BLANK + text.replace(" ", L.BLANK), n)
            assert [s for s, _ in top] == scores and all(p in paths for p in top) and len({p for _, p in top}) == len(top)


def test_round_trip_and_small_store(vocabulary, monkeypatch):
    monkeypatch.setattr(L, "REMEMBER_BYTES", 1200)
    rnd, e = random.Random(2), L.Encoder(vocabulary)
    for text in ["", " ", "a", "  a  b\t\n\n", "▁", "x▁ ▁y", "<s> </s> <0x41>", "\U0001f600é漢", "a" * 5000, "|" * 3000, "\x00\x7f"] + ["".join(chr(rnd.choice([32, 97, 105, 233, 0x2581, 0x4e00, 10, 48])) for _ in range(60)) for _ in range(50)]:
        assert e.decode(e.encode(text)[0]) == text


def test_query_and_odd_rows(spark, table):
    rows = op8_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.round_trip and r.n_best == L.N_BEST for r in rows)
    odd = [(1, None), (2, ""), (3, "word " * 20000), (3, "word " * 20000), (None, "x")]
    got = sorted((repr(r.doc_id), r.n_pieces, r.score is None, r.round_trip) for r in L.summary(table(odd), MODEL).collect())
    assert got == [("1", None, True, True), ("2", 0, False, True), ("3", 40001, False, True), ("3", 40001, False, True), ("None", 1, False, True)]
    assert L.encoded(table(odd).limit(0), MODEL).count() == 0 and L.encoded(table(odd), MODEL).columns[:5] == table(odd).columns


def test_pieces_of_all_n_best(spark, table, vocabulary):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("the ingé1²._\n漢|▁") for _ in range(rnd.randint(1, 12))) for _ in range(60)] + ["the other thing of the other thing"]
    rows = {r.doc_id: r for r in L.encoded(table(list(enumerate(texts))), MODEL).collect()}
    e, several = L.Encoder(vocabulary), 0
    for d, text in enumerate(texts):
        got = rows[d]["__n_best"]
        assert got[0] == rows[d]["__pieces"] and len(got) == len(rows[d]["__scores"]) == len(set(map(tuple, got)))
        assert all(e.decode(np.array(ids)) == text for ids in got)
        several += len(got) == L.N_BEST
        if L.BLANK not in text and len(text) < 13:
            paths = all_paths(vocabulary, L.BLANK + text.replace(" ", L.BLANK))
            assert all((s, tuple(ids)) in paths for s, ids in zip(rows[d]["__scores"], got))
    assert several > 30
    digests = {r.doc_id: r.n_best_sha256 for r in L.summary(table(list(enumerate(texts))), MODEL).collect()}
    assert digests == {d: hashlib.sha256(";".join(",".join(map(str, x)) for x in r["__n_best"]).encode()).hexdigest() for d, r in rows.items()}


def test_segments_share_the_passes_over_lattices(vocabulary, monkeypatch):
    rnd = random.Random(4)
    letters = "etaoinshrdé漢😀İ"
    texts = [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12))) for _ in range(400)) for _ in range(20)]
    texts += ["", None, "▁", " ▁ a▁▁b", "a" * 300 + " b", "".join(rnd.choice("ab 1|漢\n▁²😀") for _ in range(2000))]
    alone, forward = [], L.Vocabulary.forward
    monkeypatch.setattr(L.Vocabulary, "forward", lambda v, segment: alone.append(segment) or forward(v, segment))
    vocabulary.paths_known.clear()
    together = L.Encoder(vocabulary).n_best_of(texts)
    # One by one go only those of the least losses in a text, and the long ones.
    assert len(alone) <= (L.N_BEST - 1) * len(texts) + 1 < 100
    # The same when every segment has a lattice of its own.
    monkeypatch.setattr(L, "TOGETHER", 0)
    single = L.Encoder(vocabulary).n_best_of(texts)
    assert len(alone) > 5000 and together[1] == single[1]
    assert [p and [x.tolist() for x in p] for p in together[0]] == [p and [x.tolist() for x in p] for p in single[0]]
    assert L.Encoder(vocabulary).decoded([p and p[0] for p in together[0]]) == texts


def test_steps_whose_slots_are_taken(vocabulary, monkeypatch):
    monkeypatch.setattr(L, "HASH_BITS", 6)
    full, begins = L.PieceTree(vocabulary), list(vocabulary.begins)
    number = {b: k for k, b in enumerate(begins, 1)} | {"": 0}
    at = np.array([number[b[:-1]] for b in begins])
    assert full.step(at, full.character[[ord(b[-1]) for b in begins]]).tolist() == list(range(1, len(begins) + 1))
    last = full.character[0x10FFFF]
    assert last == 0 and (full.step(at, np.full(len(at), last)) == -1).all()

import random

import pyarrow as pa
from brute import repeated_words

from contentloom.llm import sidelists, substring_dedup
from contentloom.llm.entry import op9_substring_dedup
from contentloom.llm.words import hashed, split_words

FOLDER = "/root/testdata/sf0.01"


def test_equal_windows_elect_equal_anchors():
    rnd = random.Random(5)
    for _ in range(150):
        words = ["a", "b", "c", "d"][:rnd.randint(1, 4)] + [f"w{i}" for i in range(rnd.choice([0, 3, 50]))]
        docs = [[rnd.choice(words) for _ in range(rnd.choice([0, 5, 13, 40, 90]))] for _ in range(3)]
        docs += [docs[0][:20] + docs[1] + docs[2][-17:], ["a"] * 30, ["b"] + ["a"] * 17 + ["c"]]
        offsets, flat = split_words(pa.array([" ".join(d) for d in docs]), False)
        h, seen = hashed(flat), {}
        _, start, low, high = substring_dedup.anchors(offsets, h)
        for s, a, b in zip(start, low, high):
            assert s <= a < b <= s + 13
            assert seen.setdefault(tuple(h[s:s + 13]), (a - s, b - s)) == (a - s, b - s)
        assert len(start) == sum(max(0, len(d) - 12) for d in docs)


def test_equals_brute_force(spark):
    rows = op9_substring_dedup(spark, FOLDER).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in rows} == repeated_words(docs)


def test_odd_rows_and_shuffled_lists(spark, table, monkeypatch):
    p = [f"p{i}" for i in range(60)]
    rows = [
        (1, " ".join(p)), (2, "x " + "\t".join(p[5:18]) + " y"), (3, None), (4, ""), (5, " ".join(p[:12])), (6, "r " * 40), (7, "s " + "r " * 13),
        (8, "q " * 30000), (9, "q " * 20), (10, " ".join(p[:30] + p[29:])), (None, " ".join(p[20:40]) + " z"),
    ]
    want = repeated_words([(d if d is not None else 10**9, t) for d, t in rows])
    for limit in (0, 1 << 20):
        monkeypatch.setattr(sidelists, "SEND_BYTES", limit)
        got = {r.doc_id if r.doc_id is not None else 10**9: (r["__n_words"], r["__n_removed"]) for r in substring_dedup.deduplicated(table(rows)).collect()}
        assert got == {d: v[:2] for d, v in want.items()}
    again = [(1, " ".join(p)), (1, " ".join(p)), (2, " ".join(p)), (2, "other " + " ".join(p[:20])), (2, " ".join(p))]
    made = substring_dedup.deduplicated(table(again))
    assert sorted((r.doc_id, r.text, r["__n_removed"]) for r in made.collect()) == [(1, " ".join(p), 0)] * 2 + [(2, "", 60), (2, "", 60), (2, "other", 20)]
    assert substring_dedup.deduplicated(table(rows).limit(0)).count() == 0

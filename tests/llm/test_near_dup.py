import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from brute import near_classes

from contentloom.llm import near_dup

FOLDER = "/root/testdata/sf0.01"


def test_signature_is_unbiased_for_weights():
    rng, errors = np.random.default_rng(1), []
    for _ in range(30):
        a = rng.integers(0, 9, 60)
        b = np.where(rng.random(60) < 0.6, a, rng.integers(0, 9, 60))
        h = np.sort(rng.integers(0, 2**63, 60).astype(np.uint64))
        text = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = near_dup.bag_minhash(2, text, np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), slots=2048)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01


@pytest.mark.parametrize("group", [0, near_dup.GROUP_NODES])
def test_classes_equal_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(near_dup, "GROUP_NODES", group)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    assert got == near_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_similar_sets_equal_all_pairs():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 30, 200):
        base = rnd.integers(0, 2**40, 60)
        sets = [np.unique(np.concatenate([base[rnd.random(60) < 0.9], rnd.integers(0, 2**40, rnd.integers(0, 6))])) for _ in range(n)]
        sets[0] = np.array([7])
        label = near_dup.similar_sets(np.array([len(x) for x in sets]), np.concatenate(sets), 0.8)
        want = list(range(n))
        for i in range(n):
            for j in range(i):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = want[i], want[j]
                    want = [b if w == a else w for w in want]
        assert len({*zip(label.tolist(), want)}) == len(set(want)) == len(set(label.tolist()))


@pytest.mark.parametrize("small,group", [(2, 0), (near_dup.SMALL, 0), (near_dup.SMALL, near_dup.GROUP_NODES)])
def test_chain_of_copies_and_a_star(spark, table, monkeypatch, small, group):
    """Links through members that are no pivot are found, in a task, and in Spark over several rounds if buckets are never small."""
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "GROUP_NODES", group)
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = [(100 + i, " ".join(base[i * 6:] + [f"x{j}" for j in range(i * 6)])) for i in range(12)]
    for k in range(40):
        w = base[::-1]
        for p in rnd.sample(range(300), 6):
            w[p] = f"y{k}-{p}"
        rows.append((200 + k, " ".join(w)))
    got = {r.doc_id: r.class_id for r in near_dup.classes(table(rows)).collect()}
    assert got == near_classes(rows)


def test_rows_without_an_id_and_rows_of_one_id(spark, table):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1:]) for k in range(0, 100, 10)] + [" ".join(words[::-1])]
    rows = [(None, t) for t in texts] + [(5, t) for t in texts] + [(9, "other words than these")]
    got = {(r.doc_id, r.class_id) for r in near_dup.classes(table(rows)).collect()}
    assert got == {(None, 5), (5, 5), (9, 9)}
    assert {r.doc_id for r in near_dup.distinct_documents(table(rows)).collect()} == {5, 9}


def test_odd_rows(spark, table):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A, b!"), (6, "b a"), (7, "z " * 20000), (7, "z " * 20000), (None, "a b"), (9, "z " * 19000), (None, None)]
    got = {(r.doc_id, r.class_id) for r in near_dup.classes(table(rows)).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (None, 4), (9, 7), (None, None)}
    assert near_dup.classes(table(rows)).count() == len(rows)
    kept = near_dup.distinct_documents(table(rows))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 7] and kept.columns == table(rows).columns
    assert near_dup.classes(table(rows).limit(0)).count() == 0


def test_signing_takes_few_texts_at_a_time():
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(400)) for _ in range(1200)]
    number = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([*[number] * 4, pa.array(texts)], names=["doc_id", *near_dup.ROW, "text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in near_dup._signatures(batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 30e6


def test_filter_stays_packed(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id", "id * 7 AS t1", "id * 11 AS t2")
    hashes = rows.selectExpr("xxhash64(id, t1) AS p1", "xxhash64(id, t2) AS p2").toPandas()
    marks = near_dup._marks(rows)
    others = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000)
    assert marks.nbytes * 8 <= 32 * 3000
    assert all(near_dup._marked(marks, hashes[c].to_numpy()).all() for c in ("p1", "p2"))
    assert near_dup._marked(marks, others).mean() < 0.2
    monkeypatch.setattr(near_dup, "MARK_BITS", 1 << 10)
    marks = near_dup._marks(rows)
    assert marks.nbytes == 128 and near_dup._marked(marks, hashes["p1"].to_numpy()).all()


def test_large_group_takes_the_same_jobs_whatever_its_size(spark, table, monkeypatch):
    """Copies that share bands but are not similar: no pivot decides them, so they are dealt over tasks instead of rounds."""
    monkeypatch.setattr(near_dup, "SMALL", 2)
    monkeypatch.setattr(near_dup, "GROUP_NODES", 8)
    written = []
    monkeypatch.setattr(near_dup, "materialize", lambda df, label, *a, write=near_dup.materialize, **k: written.append(label) or write(df, label, *a, **k))
    rnd = random.Random(6)
    base, rows = [f"w{i}" for i in range(120)], []
    for k in range(90):
        w = list(base)
        for p in rnd.sample(range(3, 120, 7), 4):
            w[p] = "z"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: r.class_id for r in near_dup.classes(table(rows)).collect()}
    assert got == near_classes(rows) and 10 < len(set(got.values())) < 90
    assert len(written) <= 8


@pytest.mark.parametrize("whole", [True, False])
def test_meetings_bring_all_pairs_together(spark, monkeypatch, whole):
    """Any two nodes of a bucket meet in a task; blocks of a large group or bucket keep to the limit, whatever the number of runs."""
    monkeypatch.setattr(near_dup, "GROUP_NODES", 16)
    monkeypatch.setattr(near_dup, "SMALL", 1)
    big = [(i, [7] + [100 + b for b in range(9) if whole]) for i in range(60)]
    rows = big if whole else big + [(60 + i, [7] * (i == 0) + [200 + i, 201 + i]) for i in range(200)]
    nodes = spark.createDataFrame([(i.to_bytes(4, "big"), b"root", b, 10) for i, b in rows], "node binary, root binary, bands array<long>, size long")
    keys = {int.from_bytes(r.node, "big"): set(r["keys"]) for r in near_dup._meetings(nodes).collect()}
    met, held = {}, {}
    for i, bands in rows:
        for b in bands:
            met.setdefault(b, []).append(i)
        for k in keys[i]:
            held.setdefault(k, []).append(i)
    assert all(keys[i] & keys[j] for own in met.values() for i in own for j in own)
    assert max(map(len, held.values())) <= 32 and len(set(keys)) == len(rows)
    assert any("-" in k and k.split("-")[0] == b"root".hex().upper() for k in held) == whole


def test_bands_are_not_broadcast(spark, table, monkeypatch):
    """Their rows are many times those of the nodes, which Spark's estimate does not know."""
    plans = []

    def planned(links, found=near_dup.components):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return found(links)

    monkeypatch.setattr(near_dup, "components", planned)
    words = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(words[:k] + [f"x{k}"] + words[k + 1:])) for k in range(0, 100, 10)]
    assert {r.class_id for r in near_dup.classes(table(rows)).collect()} == {0}
    assert len(plans) == 1 and "BroadcastHashJoin" not in plans[0]

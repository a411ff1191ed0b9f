"""The kept back references against computing them anew, and keyed tables."""

import random

from pyspark.sql import functions as F

from contentloom.operators import reference_view as V, references as X
from contentloom.sources import keyed

EDGES, OBJECTS = "source_id string, target_id string, reference_type string", "id string, object_type string"


def test_equals_full_recomputation_after_random_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "FOLD_AFTER", 3)
    rnd = random.Random(6)
    ids = [f"o{i}" for i in range(40)]
    edge = lambda s: (s, rnd.choice([*ids, "hot", "hot", "nowhere"]), rnd.choice(["a", "b"]))
    edges = {s: {edge(s) for _ in range(rnd.randint(0, 4))} for s in ids}
    objects = {i: rnd.choice(["article", "page", None]) for i in [*ids[:35], "hot"]}
    table = lambda rows, fields: spark.createDataFrame(sorted(rows, key=repr), fields)
    all_edges = lambda: {e for es in edges.values() for e in es}
    view = V.create(table(all_edges() | {(None, "hot", "a"), ("o1", None, "a")}, EDGES), table([*objects.items(), (None, "x")], OBJECTS), str(tmp_path / "v"), 16)

    def check():
        want = X.back_references(table(all_edges(), EDGES), table(objects.items(), OBJECTS)).select("target_id", "id", "type")
        assert sorted(tuple(r) for r in view.read(spark).select("target_id", "id", "type").collect()) == sorted(tuple(r) for r in want.collect())

    check()
    for turn in range(5):
        changed = rnd.sample(ids, 5)
        for s in changed:
            edges[s] = {edge(s) for _ in range(rnd.randint(0, 4))}
        new = table([e for s in changed for e in edges[s]], EDGES)
        for _ in range(1 + turn % 2):  # every other batch runs twice
            V.replace_edges(view, table([(s,) for s in changed], "id string"), new)
        check()
        fresh = {rnd.choice([*ids, "nowhere"]): rnd.choice(["x", "y"]) for _ in range(3)}
        gone = set(rnd.sample(ids, 2)) | ({"hot"} if turn == 2 else set())
        V.change_objects(view, table(fresh.items(), OBJECTS), table([(g,) for g in gone], "id string"))
        objects.update(fresh)
        for g in gone:
            objects.pop(g, None)
        check()
    V.replace_edges(view, table([], "id string"), table([], EDGES))
    check()


def test_keyed_table_reads_and_writes_its_parts_only(spark, tmp_path):
    rows = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    t = keyed.create(rows.union(spark.createDataFrame([(None, 1), (None, 2), ("k5", 7)], "k string, v long")), str(tmp_path / "t"), "k", 64)
    keys = spark.createDataFrame([("k5",), ("k6",), ("none",), (None,)], "k string")
    assert sorted((r.k, r.v) for r in t.of(keys).collect()) == [("k5", 5), ("k5", 7), ("k6", 6)]
    assert t.near(keys).count() < 200
    assert "PartitionFilters: [" in t.of(keys)._jdf.queryExecution().toString()
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    parts = t.replace(keys, spark.createDataFrame([("k5", 50), ("new", 1)], "k string, v long"))
    assert len(parts) <= 4
    same = [p for p in (tmp_path / "t").rglob("*.parquet") if stamps.get(p) == p.stat().st_mtime_ns]
    assert len(same) >= 58
    got = {(r.k, r.v) for r in t.read(spark).collect()}
    assert ("k5", 50) in got and ("new", 1) in got and not {("k5", 5), ("k6", 6)} & got and len(got) == 2000 - 2 + 2 + 2
    one = keyed.create(rows.limit(3), str(tmp_path / "one"), "k", 8)
    one.replace(one.read(spark).select("k"), rows.limit(0))
    assert one.read(spark).count() == 0

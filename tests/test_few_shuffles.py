"""Key filters, heavy keys by groups and kept views that shuffle and write little, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from contentloom.operators import reference_view as V, references as X, skew
from contentloom.sources import keyed

EDGES, OBJECTS = "source_id string, target_id string, reference_type string", "id string, object_type string"


def test_back_references_shuffle_edges_once(spark):
    edges = [(f"s{i % 7}", f"t{i % 5}", "ab"[i % 2]) for i in range(60)] + [("s1", "t1", None), (None, "t1", "a"), ("s1", None, "a"), ("s9", "t2", "a"), ("s1", "gone", "a")]
    objects = [(f"t{i}", "page") for i in range(4)] + [("s1", "article"), ("s2", None), (None, "x")]
    back = X.back_references(spark.createDataFrame(edges, EDGES), spark.createDataFrame(objects, OBJECTS))
    kind = lambda s: dict(objects).get(s) if s and dict(objects).get(s) else "unknown"
    want = {(t, s, kind(s)) for s, t, _ in edges if t in dict(objects) and t}
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, want))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(target_id#\d+, source_id#\d+", plan)
    assert re.search(r"Exchange hashpartitioning\(source_id#\d+, __salt#\d+L?, \d+\), REPARTITION", plan)


@pytest.mark.parametrize("words", [1, 64])
def test_filtered_joins_equal_plain_ones(spark, monkeypatch, words):
    monkeypatch.setattr(skew, "FILTER_WORDS", words)
    rows = spark.createDataFrame([(f"k{i % 50}", i) for i in range(200)] + [(None, 1)], "k string, v long")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(0, 60, 3)] * 2 + [(None,)], "k string")
    asked = {f"k{i}" for i in range(0, 60, 3)}
    for spread in ([], ["v"]):
        assert sorted((r.k, r.v) for r in skew.matching(rows, keys, "k", spread).collect()) == sorted((r.k, r.v) for r in rows.collect() if r.k in asked)
        assert sorted((str(r.k), r.v) for r in skew.without(rows, keys, "k", spread).collect()) == sorted((str(r.k), r.v) for r in rows.collect() if r.k not in asked)


def test_heavy_keys_of_full_groups(spark, monkeypatch):
    monkeypatch.setattr(skew, "BUCKETS", 3)
    rows = spark.createDataFrame([(f"k{i}",) for i in range(9) for _ in range(i)] + [(None,)] * 30, "k string")
    assert {(r.k, r["__parts"]) for r in skew.heavy_keys(rows, ["k"], 3).collect()} == {(f"k{i}", -(-i // 3)) for i in range(4, 9)}


def test_many_keys_are_replaced_as_few_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "FEW_KEYS", 0)
    rows = spark.range(300).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    t = keyed.create(rows.union(spark.createDataFrame([(None, 1)], "k string, v long")), str(tmp_path / "t"), "k", 8)
    keys = rows.where("v % 3 = 0").select("k")
    assert sorted(r.v for r in t.of(keys).collect()) == list(range(0, 300, 3))
    t.replace(keys, spark.createDataFrame([("k3", -3), ("new", -1)], "k string, v long"))
    assert sorted(r.v for r in t.read(spark).collect()) == sorted([v for v in range(300) if v % 3] + [1, -3, -1])


def test_sources_without_edges_touch_no_part(spark, tmp_path):
    edges = spark.createDataFrame([(f"s{i}", "t", "a") for i in range(40)], EDGES)
    objects = spark.createDataFrame([("t", "page"), ("o", "page")], OBJECTS)
    view = V.create(edges, objects, str(tmp_path / "v"), 4)
    files = lambda: {(p, p.stat().st_mtime_ns) for p in (tmp_path / "v" / "edges").rglob("*.parquet")}
    before = files()
    V.replace_edges(view, spark.createDataFrame([(f"o{i}",) for i in range(40)], "id string"), edges.limit(0), "none")
    assert files() == before and view.read(spark).count() == 40


def test_repeated_edges_and_objects_are_kept_once(spark, tmp_path):
    edges = [("s", "t", "a"), ("s", "t", "a"), ("s", "t", "b"), ("s", "t", None), ("s", "t", None), ("u", "t", "a"), (None, "t", "a"), ("s", None, "a")]
    objects = [("t", "page"), ("s", "x"), ("s", "y"), ("s", None), ("t", "page")]
    view = V.create(spark.createDataFrame(edges, EDGES), spark.createDataFrame(objects, OBJECTS), str(tmp_path / "v"), 4)
    assert sorted(map(repr, map(tuple, view.edges.read(spark).collect()))) == sorted(map(repr, set(edges)))
    assert sorted(map(tuple, view.read(spark).collect())) == [("t", "s", "y"), ("t", "u", "unknown")]

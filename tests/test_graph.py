"""References, hierarchy, writes, templates and vectors on small tables with hot keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentloom.operators import hierarchy as H, references as X, skew, templates as M, vectors as E, writes as W

NOW = "2024-06-01 00:00:00"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def hot(spark):
    """Edges of which a third point at one target and a tenth at none."""
    n = spark.range(3000).withColumn("source_id", F.concat(F.lit("s"), F.col("id") % 2500))
    target = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("t"), F.col("id") % 500))
    return n.select("source_id", target.alias("target_id"), F.lit("link").alias("reference_type"))


def test_heavy_keys_are_few_and_right(hot):
    assert rows(skew.heavy_keys(hot, ["target_id"], 50), "target_id") == [("hot",)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, hot, how):
    right = spark.range(0, 400).select(F.concat(F.lit("t"), "id").alias("target_id"), F.lit(1).alias("known")).union(spark.createDataFrame([("hot", 1)], "target_id string, known int"))
    want = hot.join(right, "target_id", how)
    got = skew.salted_join(hot, right, ["target_id"], ["source_id"], how, task_rows=50)
    assert rows(got, *want.columns) == rows(want, *want.columns)


def test_pick(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "w"), ("b", 2, None)], "k string, at int, v string")
    assert rows(skew.pick(df, ["k"], ["at", "v"]), "k", "at", "v") == [("a", 3, "y"), ("b", 2, None)]
    assert rows(skew.pick(df, ["k"], ["at"], last=False), "k", "v") == [("a", "x"), ("b", None)]


def test_back_references_are_whole_and_bounded(spark, hot):
    ids = spark.range(2500).select(F.concat(F.lit("s"), "id").alias("id"), F.lit("article").alias("object_type"))
    objects = ids.union(spark.createDataFrame([("hot", "topic"), ("t2", None)], "id string, object_type string"))
    back = X.back_references(hot, objects)
    want = {(r["target_id"], r["source_id"]) for r in hot.collect() if r["target_id"] in ("hot", "t2")}
    assert {(r["target_id"], r["id"]) for r in back.collect()} == want
    parts = X.referenced_by_parts(back, part_size=100).collect()
    assert {(p["target_id"], r["id"]) for p in parts for r in p["referenced_by"]} == want
    assert max(len(p["referenced_by"]) for p in parts) < 200
    assert {p["part"] for p in parts if p["target_id"] == "t2"} == {0}


def test_delete_leaves_no_edge_to_a_deleted_id(spark, hot):
    gone = spark.createDataFrame([("hot",), ("s3",)], "id string")
    left = X.drop_references(hot.dropna(), gone)
    assert left.where("target_id IN ('hot','s3') OR source_id IN ('hot','s3')").count() == 0
    assert left.count() == hot.dropna().where("target_id != 'hot' AND source_id != 's3'").count()


def test_replacing_with_nothing_removes(spark, hot):
    out = X.replace_edges(hot, hot.where("false"), spark.createDataFrame([("s1",)], "id string"))
    assert out.where("source_id = 's1'").count() == 0


def test_odd_reference_shapes(spark):
    df = spark.createDataFrame([("a", '{"x":[{"id":1},{"id":null},[{"id":"deep"}]],"y":{"id":"y"}}', '{"references":"none","parent_id":5,"related_to":{"id":"q"}}'), ("b", "[1]", None)], "id string, content string, metadata string")
    assert rows(X.extract_embedded(df), "source_id", "id", "type") == [("a", "1", "unknown"), ("a", "y", "unknown")]
    assert rows(X.extract_edges(df), "source_id", "target_id", "reference_type") == [("a", "5", "parent")]


def test_levels_of_deep_and_broken_hierarchies(spark):
    chain = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(70)]
    broken = [("l1", "gone"), ("l2", "l1"), ("x", "y"), ("y", "z"), ("z", "x"), ("below", "x"), ("self", "self"), ("r", "")]
    out = {r["id"]: (r["level"], r["issue"]) for r in H.levels(spark.createDataFrame(chain + broken, "id string, parent_id string")).collect()}
    assert all(out[f"c{i}"] == (i, None) for i in range(70))
    assert out["l1"] == (None, "parent_not_found") and out["l2"] == (None, "ancestor_not_found") and out["r"] == (0, None)
    assert {out[k] for k in ("x", "y", "z", "below", "self")} == {(None, "cycle")}


def test_levels_with_a_hot_parent(spark):
    df = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("id") == 0, None).otherwise("n0").alias("parent_id"))
    assert rows(H.levels(df).groupBy("level").count(), "level", "count") == [(0, 1), (1, 4999)]


def test_taxonomy_sizes(spark):
    assert rows(H.taxonomy(spark).groupBy("level").count(), "level", "count") == [("alpha", 11), ("beta", 21), ("gamma", 20), ("organizer", 10), ("qualifier", 12)]


STORED = "id string, name string, object_type string, version string, description string, definition string, created_at timestamp_ntz, updated_at timestamp_ntz"


def test_upsert_is_idempotent(spark):
    current = spark.createDataFrame([("1", "A", "alpha", "1", "old", "{}")], STORED.rsplit(", ", 2)[0]).withColumn("created_at", W.at("2020-01-01 00:00:00")).withColumn("updated_at", W.at("2020-01-01 00:00:00"))
    batch = spark.createDataFrame([("A", "2", None, '{"x":1}'), ("B", "1", "b", "{}"), ("B", "0", "older", "{}")], "name string, version string, description string, definition string")
    once = W.upsert(current, batch, "name", NOW)
    assert rows(once, "name", "version", "description", "definition") == [("A", "2", "old", '{"x":1}'), ("B", "1", "b", "{}")]
    assert rows(W.upsert(once, batch, "name", NOW), *once.columns) == rows(once, *once.columns)


def test_sparse_update_without_attributes_changes_nothing(spark):
    current = spark.createDataFrame([("1", "d", "v")], "id string, description string, version string").withColumn("updated_at", W.at("2020-01-01 00:00:00"))
    updates = spark.createDataFrame([("1", None, None)], "id string, description string, version string")
    assert rows(W.sparse_update(current, updates, NOW, []), *current.columns) == rows(current, *current.columns)


def test_adaptation_by_site_or_project(spark):
    made = spark.createDataFrame([("a", "t", "s1", None, 1), ("b", "t", None, "p1", 2), ("c", "t", "s2", "p1", 0), ("d", "u", "s1", "p1", 9)], "id string, original_template_id string, site_id string, project_id string, created_at int")
    wanted = spark.createDataFrame([("t", "s1", "p1"), ("t", "s1", None), ("t", None, "p9"), ("t", "s2", None)], "original_template_id string, site_id string, project_id string")
    assert rows(M.find_adaptation(made, wanted), "site_id", "project_id", "adaptation_id") == [("s1", "p1", "b"), ("s1", None, "a"), ("s2", None, "c")]


def test_version_resolution(spark):
    have = spark.createDataFrame([("p", v) for v in ("1.0.0", "1.2.0", "1.10.0", "2.0.0", "junk")], "prompt_name string, version string")
    asked = spark.createDataFrame([(1, "p", ">=1.2.0"), (2, "p", ">=1.3"), (3, "p", ">=9.0"), (4, "p", "any")], "request_id int, prompt_name string, version_requirement string")
    low = {r["request_id"]: (r["resolved"], r["used_fallback"]) for r in M.resolve_versions(asked, have).collect()}
    assert low == {1: ("1.2.0", False), 2: ("1.10.0", False), 3: ("2.0.0", True), 4: ("2.0.0", True)}
    assert {r["request_id"]: r["resolved"] for r in M.resolve_versions(asked, have, "latest", "none").collect()} == {1: "2.0.0", 2: "2.0.0", 3: None, 4: None}


@pytest.mark.parametrize("blocks", [1, 3])
def test_top_k_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 6))
    v[100:200] = v[100]  # a third are copies of one vector
    ids = [f"v{i:03d}" for i in range(300)]
    vectors = spark.createDataFrame([(i, [float(x) for x in r], "a", None) for i, r in zip(ids, v)], "content_id string, embedding array<double>, content_type string, metadata string").repartition(7)
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in v[i * 11]]) for i in range(20)], "query_id string, embedding array<double>")
    got = E.top_k(queries, vectors, 5, blocks=blocks, shards=4).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = []
    for q in range(20):
        scores = np.round(unit @ unit[q * 11], 6)
        for rank, i in enumerate(sorted(range(300), key=lambda i: (-scores[i], ids[i]))[:5], 1):
            want.append((f"q{q}", ids[i], rank))
    assert sorted((r["query_id"], r["content_id"], r["rank"]) for r in got) == sorted(want)
    assert E.top_k(queries.where("false"), vectors, 5).count() == 0


def test_top_k_leaves_unusable_vectors_out(spark):
    kind = "content_id string, embedding array<double>, content_type string, metadata string"
    vectors = spark.createDataFrame([("a", [1.0, 0.0], "t", None), ("b", None, "t", None), ("c", [0.0, 0.0], "t", None), ("d", [1.0], "t", None), ("e", [None, 1.0], "t", None), ("f", [1.0, 0.0], "t", None)], kind)
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("r", None), ("s", [2.0])], "query_id string, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["content_id"], r["score"]) for r in E.top_k(queries, vectors, 2).collect())
    assert got == [("q", 1, "a", 1.0), ("q", 2, "f", 1.0), ("s", 1, "d", 1.0)]
    assert {r.content_id for r in E.unusable(vectors).collect()} == {"b", "e"}

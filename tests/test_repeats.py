"""Keys that come twice, streams that start anew, and payloads that once went wrong."""

import itertools

import pytest
from pyspark.sql import functions as F

from contentloom.functions import rules as R
from contentloom.functions.model import FieldDef, Model
from contentloom.functions.typespec import is_iso_datetime
from contentloom.operators import skew, store, templates as M, validation as V, writes as W
from contentloom.session import scratch_path
from contentloom.sources import snapshots
from contentloom.streaming.upsert import upsert_stream

NOW = "2024-01-03 00:00:00"


def _contents(spark):
    return spark.createDataFrame([("1", "c", "m")], "id string, content string, metadata string").withColumn("updated_at", W.at("2020-01-01 00:00:00"))


@pytest.mark.parametrize("turn", range(6))
def test_repeated_updates_do_not_depend_on_their_order_of_arrival(spark, turn):
    given = [("1", "new", None, 1), ("1", None, "m2", 2), ("1", "zz", "zz", 0)]
    rows = list(itertools.permutations(given))[turn]
    updates = spark.createDataFrame(rows, "id string, content string, metadata string, seq int").repartition(3)
    whole = W.update(_contents(spark), updates, NOW, ["seq"]).first()
    assert (whole.content, whole.metadata) == ("c", "m2")
    folded = W.sparse_update(_contents(spark), updates, NOW, ["seq"]).first()
    assert (folded.content, folded.metadata) == ("new", "m2")


def test_two_streams_and_a_new_checkpoint_lose_nothing(spark):
    root = scratch_path(spark, "two-streams")
    for n, key in enumerate("abc"):
        source = scratch_path(spark, "source")
        spark.createDataFrame([(key, n)], "k string, v int").write.parquet(source)
        stream = spark.readStream.schema("k string, v int").parquet(source)
        checkpoint = scratch_path(spark, "progress")
        for _ in range(2):  # the second start finds its batch published
            upsert_stream(stream, root, ["k"], ["v"], checkpoint, available_now=True).awaitTermination()
    assert sorted(r.k for r in snapshots.read(spark, root, ["k"], ["v"]).collect()) == ["a", "b", "c"]
    assert snapshots.manifest(spark, root).count() == 3


def test_components_keep_all_their_texts(spark):
    rows = [("p", "agent_role", 2, "a"), ("p", "agent_role", 1, "b"), ("p", "agent_task", 1, "t")]
    assert M.assemble(spark.createDataFrame(rows, "prompt string, component string, position int, text string"), "agent").first().text.split("\n") == ["b", "a", "t"]


def test_white_space_before_an_object_and_dotted_keys(spark):
    m = Model("M", (FieldDef("a.b", "int"),))
    rows = [('\n\t {"a.b":1}', True), ('{"a":{"b":1}}', False), ("\n[1]", False), ("\n", False)]
    got = V.validate(spark.createDataFrame(rows, "p string, want boolean"), "p", m).collect()
    assert all(r.is_valid == r.want for r in got)


@pytest.mark.parametrize("text, good", [
    ("2023-01-01", True), ("2023-01-01T12:00:00", True), ("2023-01-01 12:00", True), ("2023-01-01T12:00:00.5+02:00", True), ("2023-01-01T12:00:00Z", True),
    ("2023-01-01 12:00:00 Europe/Paris", False), ("2023-01-01T1:2:3", False), ("2023-01-01 ", False), ("2023-01-01T12:00:00 UTC", False), ("2023-13-01", False),
])
def test_datetime_forms(spark, text, good):
    assert spark.range(1).select(is_iso_datetime(F.lit(text)).alias("x")).first().x is good


def test_any_of_counts_texts_that_look_empty(spark):
    m = Model("M", (), (R.any_of("a", "b"),))
    rows = [('{"a":"0"}', True), ('{"a":"[]"}', True), ('{"a":""}', False), ('{"a":[]}', False), ('{"a":0}', False), ('{"b":"false"}', True)]
    got = V.validate(spark.createDataFrame(rows, "p string, want boolean"), "p", m).collect()
    assert all(r.is_valid == r.want for r in got)


def test_mixed_validation_holds_the_metadata_contract(spark):
    m = Model("M", (), metadata_required=("tags",), metadata_recommended=("level",))
    df = spark.createDataFrame([("M", '{"metadata":{}}'), ("M", '{"metadata":{"tags":1}}')], "m string, p string")
    mixed, single = V.validate_mixed(df, "p", "m", {"M": m}).collect(), V.validate(df, "p", m).collect()
    assert [(r.is_valid, r.errors, r.warnings) for r in mixed] == [(r.is_valid, r.errors, r.warnings) for r in single]


def test_versions_of_any_length(spark):
    have = spark.createDataFrame([("p", "1.2"), ("p", "20240101123456.1")], "prompt_name string, version string")
    asked = spark.createDataFrame([(1, "p", ">=1.2.0"), (2, "p", ">=20240101123456.1"), (3, "p", ">=1.2.1")], "request_id int, prompt_name string, version_requirement string")
    assert {r.request_id: r.resolved for r in M.resolve_versions(asked, have).collect()} == {1: "1.2", 2: "20240101123456.1", 3: "20240101123456.1"}


def test_inserted_texts_are_not_filled_again(spark):
    df = spark.createDataFrame([("p", "c", "x {context} {controlled_context} {context}!")], "prompt string, context_id string, text string")
    contexts = spark.createDataFrame([("c", "{controlled_context}", "{context}")], "context_id string, context string, controlled_context string")
    assert M.fill(df, contexts).first().text == "x {controlled_context} {context} {controlled_context}!"


def test_search_takes_backslashes(spark):
    df = spark.createDataFrame([("C:\\dir", "", ""), ("other", "", "")], "title string, content string, metadata string")
    assert [r.title for r in store.search(df, "C:\\dir").collect()] == ["C:\\dir"]


def test_heavy_keys_get_as_many_parts_as_they_need(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 400, "hot").when(F.col("id") < 404, "warm").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    right = left.select("k").distinct().withColumn("r", F.length("k"))
    assert {r.k: r["__parts"] for r in skew.heavy_keys(left, ["k"], 3).collect()} == {"hot": 134, "warm": 2}
    for how in ("left", "inner", "left_semi"):
        got = skew.salted_join(left, right, ["k"], ["v"], how, task_rows=3)
        assert sorted(got.collect()) == sorted(left.join(right, "k", how).collect())

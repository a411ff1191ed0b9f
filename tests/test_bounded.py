"""Work whose cost must not grow faster than its input."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contentloom.operators import catalog as C, vectors as E
from contentloom.operators.skew import pick
from contentloom.session import BATCH_ROWS, materialize
from contentloom.sources import keyed


def test_a_meeting_of_vectors_needs_bounded_memory():
    rng = np.random.default_rng(3)
    rows = rng.integers(-2, 3, size=(40_000, 4)).astype(np.float32)  # many equal scores
    ids = [f"v{i:05d}" for i in rng.permutation(len(rows))]
    v = pa.table({"content_id": ids, "embedding": pa.array(list(rows), pa.list_(pa.float32()))})
    q = pa.table({"query_id": ids[:600], "embedding": v["embedding"].slice(0, 600)})
    tracemalloc.start()
    got = E.scores_in_group(q, v, 7, 0.5).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    norm = np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    unit = np.divide(rows, norm, out=np.zeros(rows.shape), where=norm > 0)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((-r["score"], r["content_id"]))
    for i in range(0, 600, 50):
        scores = np.round(unit @ unit[i], 6)
        want = sorted((-s, c) for s, c in zip(scores.tolist(), ids) if s >= 0.5)[:7]
        assert sorted(found.get(ids[i], [])) == want


@pytest.mark.parametrize("blocks", [None, 1])
def test_given_blocks_do_not_let_a_meeting_grow(spark, monkeypatch, blocks):
    monkeypatch.setattr(E, "QUERY_ROWS", 10)
    monkeypatch.setattr(E, "VECTOR_ROWS", 20)
    rows = spark.range(60).selectExpr("concat('v', id) AS content_id", "array(cast(id as float), 1f, cast(id % 7 as float)) AS embedding", "'t' AS content_type", "cast(null as string) AS metadata")
    asked = rows.selectExpr("content_id AS query_id", "embedding")
    seen = []
    monkeypatch.setattr(E.F, "sequence", lambda a, b, real=E.F.sequence: seen.append(str(b)) or real(a, b))
    got = E.top_k(asked, rows, 3, blocks=blocks, shards=1)
    assert any("5" in x for x in seen)  # six blocks of ten queries
    assert got.count() == 180


def test_schemas_of_one_split_are_converted_by_all_cores(spark):
    deep = lambda n: '{"items":' * n + '{"format":"date-time","type":"string"}' + ',"type":"array"}' * n
    schemas = spark.createDataFrame([("s", f"n{i}", f'{{"properties":{{"a":{deep(i)},"b":{{"type":"array","items":3}},"c":7}},"required":["a"]}}') for i in range(40)], "source_schema string, name string, definition string").coalesce(1)
    want = {f"n{i}": {"a": "List[" * i + "datetime" + "]" * i, "b": "List[Any]", "c": "Any"} for i in range(40)}
    converted, migrated = C.from_json_schema(schemas), C.migrate_b(schemas)
    got = {}
    for r in converted.collect():
        got.setdefault(r["model"], {})[r["field"]] = r["type"]
    assert got == want
    assert {r["field"]: r["type"] for r in C.field_catalog(migrated).where("model = 's_n39'").collect()} == want["n39"]
    for df in (converted, migrated):
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_pick_carries_each_value_once(spark):
    rows = spark.createDataFrame([(k, i % 3, f"text {i}", {"i": i}) for i in range(12) for k in ("a", "b")], "k string, v int, t string, m map<string,int>")
    whole = pick(rows.select("k", "v", "t"), ["k"], ["v", "v"])
    assert sorted(map(tuple, whole.collect())) == [("a", 2, "text 8"), ("b", 2, "text 8")]
    assert "max_by" not in whole._jdf.queryExecution().toString()
    assert sorted(map(tuple, pick(rows, ["k"], ["v"], last=False).collect())) == [("a", 0, "text 0", {"i": 0}), ("b", 0, "text 0", {"i": 0})]


def test_a_table_of_few_parts_is_written_without_a_shuffle(spark, tmp_path):
    rows = spark.range(200).selectExpr("concat('k', id % 20) AS k", "id AS v")
    few, many = keyed.create(rows, str(tmp_path / "few"), "k", 4), keyed.create(rows, str(tmp_path / "many"), "k", 40)
    for table in (few, many):
        assert sorted(map(tuple, table.read(spark).collect())) == sorted((f"k{i % 20}", i) for i in range(200))
        assert table.of(spark.createDataFrame([("k3",)], "k string")).count() == 10
    files = lambda name: len(list((tmp_path / name).glob("__part=*/*.parquet")))
    assert files("few") > 4  # a file of each task, as no task waits for the others
    assert files("many") <= 40


@pytest.mark.parametrize("own", [None, "30", "20000"])
def test_texts_go_to_python_in_small_batches(spark, own):
    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    if own:
        spark.conf.set(BATCH_ROWS, own)
    try:
        before = spark.conf.get(BATCH_ROWS)
        found = materialize(spark.range(0, 900, 1, 1).mapInArrow(count, "n long"), "batches", batch_rows=100)
        assert [r.n for r in found.collect()] == ([30] * 30 if own == "30" else [100] * 9)
        assert spark.conf.get(BATCH_ROWS) == before and spark.conf.get(BATCH_ROWS, None) == own
    finally:
        spark.conf.unset(BATCH_ROWS)

"""Files, snapshots, catalogs and streams."""

import json

import pytest
from pyspark.sql import functions as F

from contentloom.functions.model import ddl_for, model
from contentloom.operators import catalog, validation as V, verify
from contentloom.sources import definitions, inspector, snapshots, tables
from contentloom.streaming.upsert import upsert_stream

NOW = "2024-06-01 00:00:00"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def contents(spark):
    raw = spark.createDataFrame(
        [("1", "article", "Héllo -- World! 5", None, '{"status":"active","tags":["x"],"hierarchy_level":"3"}'), ("2", "page", "B", '{"a":1}', None), ("3", "page", None, None, None)],
        "id string, content_type string, title string, content string, metadata string",
    )
    return tables.conform_contents(raw, NOW)


def test_content_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "contents")
    df = contents(spark)
    assert [r["null_columns"] for r in tables.null_violations(df).collect()] == [["title", "slug"]]
    tables.write_contents(df, path)
    back = tables.read_contents(spark, path)
    assert rows(back, "id", "slug", "content", "metadata") == [("1", "héllo-world-5", "{}", '{"status":"active","tags":["x"],"hierarchy_level":"3"}'), ("2", "b", '{"a":1}', "{}")]
    assert back.where("id = '1'").first()["hierarchy_level"] == 3
    plan = back.where("content_type = 'page' AND status = 'active'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(content_type" in plan and "EqualTo(status,active)" in plan


def test_definitions_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "A", "fields": {"x": {"type": "str"}}}, indent=2))
    (tmp_path / "b.json").write_text('{"fields": {}}')
    (tmp_path / "c.json").write_text("{oops")
    good, bad = definitions.load_definitions(spark, str(tmp_path), NOW)
    assert rows(good, "name", "description") == [("A", "A model definition")]
    assert sorted(r["error"] for r in bad.collect()) == ["invalid JSON", "name is required"]
    out = str(tmp_path / "out")
    definitions.write_documents(catalog.export_json(good, good.select("name")), out)
    assert json.loads(spark.read.text(out).first()["value"])["fields"]["x"]["required"] is False
    with pytest.raises(ValueError):
        catalog.export_json(good, spark.createDataFrame([("Z",)], "name string"))


def test_snapshots_and_deltas(spark, tmp_path):
    root = str(tmp_path / "t")
    table = lambda *r: spark.createDataFrame(r, "k string, at int, v string")
    assert snapshots.read(spark, root) is None
    snapshots.publish(table(("a", 1, "x"), ("b", 1, "y")), root, "first")
    snapshots.publish_delta(table(("a", 2, "new"), ("c", 1, "z")), root, "second")
    snapshots.publish_delta(table(("b", 0, "stale")), root, "third")
    want = [("a", "new"), ("b", "y"), ("c", "z")]
    assert rows(snapshots.read(spark, root, ["k"], ["at"]), "k", "v") == want
    assert snapshots.published(spark, root, "second") and not snapshots.published(spark, root, "fourth")
    snapshots.compact(spark, root, ["k"], ["at"])
    assert rows(snapshots.read(spark, root), "k", "v") == want


def test_stream_upsert_over_several_batches(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "t")
    for batch in ([("a", 1), ("b", 5)], [("a", 3), ("c", 1)], [("b", 2)]):
        spark.createDataFrame(batch, "k string, at int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, at int").parquet(source)
        upsert_stream(stream, root, ["k"], ["at"], str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert rows(snapshots.read(spark, root, ["k"], ["at"]), "k", "at") == [("a", 3), ("b", 5), ("c", 1)]


def test_stream_of_many_batches_stays_small(spark, tmp_path):
    source, root, checkpoint, n = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "cp"), 23
    for b in range(n):
        spark.createDataFrame([(f"k{(b + j) % 7}", b, b * j) for j in range(3)], "k string, at int, v int").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k string, at int, v int").option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda s: upsert_stream(s, root, ["k"], ["at"], checkpoint, available_now=True, fold_after=4)
    run(stream).awaitTermination()
    want = {}
    for r in spark.read.parquet(source).collect():
        want[r.k] = max(want.get(r.k, (-1,)), (r.at, r.v))
    state = lambda: snapshots.read(spark, root, ["k"], ["at"])
    assert {r.k: (r.at, r.v) for r in state().collect()} == want
    assert snapshots.manifest(spark, root).count() <= 10 and snapshots.waiting(spark, root) < 4
    assert state()._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 2
    # The stream's past batches are known although their rows in the log are gone, and another stream's are not.
    log = snapshots.manifest(spark, root)
    (name, last), = {k: v for r in log.collect() for k, v in (r.streams or {}).items()}.items()
    assert last >= n - 5 and all(snapshots.published(spark, root, name, b) for b in range(last + 1))
    assert not snapshots.published(spark, root, name, n + 1) and not snapshots.published(spark, root, "other", 0)
    run(stream).awaitTermination()
    assert {r.k: (r.at, r.v) for r in state().collect()} == want


def test_unfinished_writes_do_not_count(spark, tmp_path):
    root = str(tmp_path / "t")
    table = lambda *r: spark.createDataFrame(r, "k string, at int")
    snapshots.publish(table(("a", 1)), root, "one")
    table(("a", 9), ("b", 9)).write.parquet(f"{root}/deltas/version=2")  # its job ended before the log was written
    assert rows(snapshots.read(spark, root, ["k"], ["at"]), "k", "at") == [("a", 1)]
    snapshots.publish_delta(table(("b", 2)), root, "two")
    assert rows(snapshots.read(spark, root, ["k"], ["at"]), "k", "at") == [("a", 1), ("b", 2)]
    for _ in range(3):
        snapshots.compact(spark, root, ["k"], ["at"])
    assert rows(snapshots.read(spark, root), "k", "at") == [("a", 1), ("b", 2)]
    assert snapshots.published(spark, root, "one") and snapshots.published(spark, root, "two") and not snapshots.published(spark, root, "three")
    assert snapshots.manifest(spark, root).count() == 2


def test_write_split(spark, tmp_path):
    m = model("M", x="int")
    df = spark.createDataFrame([(1, '{"x":1}'), (2, '{"x":"1"}')], "n int, j string")
    tables.write_split(V.validate(df, "j", m), str(tmp_path / "s"))
    assert rows(spark.read.parquet(str(tmp_path / "s")).where("is_valid = true"), "n") == [(1,)]


def test_catalog_scan_and_keys(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shelf LOCATION '{tmp_path}/shelf'")
    try:
        m = model("Posts", id="str", title="str", size="int?")
        inspector.create_table(spark, "posts", ddl_for(m), ["id"], "shelf")
        columns = inspector.table_columns(spark, "shelf")
        assert rows(columns, "table", "column", "data_type", "pos") == [("posts", "id", "string", 1), ("posts", "size", "bigint", 3), ("posts", "title", "string", 2)]
        assert rows(verify.primary_keys(columns, inspector.primary_keys(spark, "shelf")), "table", "column") == [("posts", "id")]
    finally:
        spark.sql("DROP DATABASE IF EXISTS shelf CASCADE")


def test_repair(spark):
    m = model("T", a="int", b="List[str]?")
    assert verify.repair(spark.createDataFrame([(1,)], "a bigint"), m).dtypes == [("a", "bigint"), ("b", "array<string>")]
    assert verify.repair(None, m, spark).count() == 0


def test_all_or_nothing(spark):
    m = model("M", x="int")
    good = V.validate(spark.createDataFrame([('{"x":1}',), ('{"x":2}',)], "j string"), "j", m)
    bad = V.validate(spark.createDataFrame([('{"x":1}',), ("{}",)], "j string"), "j", m)
    assert V.all_or_nothing(good).count() == 2 and V.all_or_nothing(bad).count() == 0
    assert {r["batch_valid"] for r in V.with_gate(bad).collect()} == {False}


def test_audit_of_empty_input(spark):
    row = V.audit(spark.createDataFrame([], "j string"), "j", model("M", x="int")).first()
    assert tuple(row) == (0, 0, 0, 0)


def test_legacy_inputs(spark):
    df = spark.createDataFrame([("A", "{}")], "name string, definition string")
    out = catalog.read_legacy([("site", df), ("pg_catalog", df), ("other", df.drop("definition"))])
    assert rows(out, "name", "source_schema") == [("A", "site")]
    assert out.where(F.col("source_schema") == "site").count() == 1

"""Partitioned tables: merges that touch few partitions, pruned reads, pages at any depth."""

import random

import pytest
from pyspark.sql import functions as F

from contentloom.operators import pages, writes
from contentloom.sources import keyed, partitioned

FIELDS = "id string, project string, kind string, v int"


def stamps(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_merge_writes_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = {f"r{i}": (f"r{i}", f"p{i % 5}", ["a", "b", None, "x/y=z"][i % 4], i) for i in range(100)}
    table = spark.createDataFrame(list(rows.values()), FIELDS)
    partitioned.write(table, path, ["project", "kind"])
    assert len(list((tmp_path / "t").rglob("*.parquet"))) == 20
    for changes in ([("r1", "p1", "b", 500), ("new", "p1", "b", 1)], [("r2", "p9", None, 501), ("r2", "p9", "a", 499)], [], [(f"r{i}", "p0", "a", 600 + i) for i in range(100) if i % 5 == 4 and i % 4 == 3]):
        before = stamps(tmp_path / "t")
        frame = spark.createDataFrame(changes, FIELDS)
        for _ in range(2):  # again without an effect
            touched = partitioned.merge(frame, path, table.schema, ["project", "kind"], "id", ["v"])
        for c in changes:
            if c[0] not in rows or rows[c[0]][3] < c[3]:
                rows[c[0]] = c
        back = partitioned.read(spark, path, table.schema)
        assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, rows.values()))
        after = stamps(tmp_path / "t")
        assert sum(after.get(f) == s for f, s in before.items()) >= len(before) - len(touched) - 1
    plan = partitioned.read(spark, path, table.schema).where("project = 'p1' AND kind = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project" in plan
    partitioned.merge(spark.createDataFrame([(None, "p1", "b", 1)], FIELDS), path, table.schema, ["project", "kind"], "id", ["v"])
    assert partitioned.read(spark, path, table.schema).count() == len(rows) + 1


def test_periods_prune(spark, tmp_path):
    rows = spark.range(1500).select("id", (F.lit("2020-06-01").cast("timestamp_ntz") + F.make_dt_interval("id")).alias("created_at"))
    table = partitioned.by_period(rows)
    partitioned.write(table, str(tmp_path / "t"), ["created_at_year"])
    back = partitioned.read(spark, str(tmp_path / "t"), table.schema)
    got = partitioned.between(back, "2021-03-01", "2022-02-01")
    assert got.count() == rows.where("created_at >= '2021-03-01' AND created_at < '2022-02-01'").count() == 337
    read = back.where(F.col("created_at_year") >= F.lit("2021-01-01").cast("timestamp_ntz"))
    assert "PartitionFilters: [isnotnull(created_at_year" in got._jdf.queryExecution().executedPlan().toString() and read.count() < 1500


@pytest.mark.parametrize("shelf_rows", [7, 100, 10_000])
def test_all_pages_are_the_table_once(spark, tmp_path, shelf_rows):
    rnd = random.Random(2)
    rows = [(f"i{i}" if rnd.random() > 0.05 else None, rnd.choice(["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-03-01 00:00:00", None]), i) for i in range(230)] + [("same", "2024-01-01 00:00:00", 5)] * 20
    table = spark.createDataFrame(rows, "id string, at string, n int").select("id", F.col("at").cast("timestamp_ntz").alias("created_at"), "n").repartition(4)
    path = str(tmp_path / "t")
    pages.build(table, path, shelf_rows)
    want = [tuple(r) for r in table.orderBy(F.desc_nulls_last("created_at"), "id", "n").collect()]
    got = [tuple(r) for at in range(0, 270, 30) for r in pages.page(spark, path, 30, at).collect()]
    assert got == want
    assert pages.page(spark, path, 10, 5000).count() == 0
    if shelf_rows == 7:
        read = pages.shelves_of(spark, path, 10, 200)
        assert 0 < len(read) < spark.read.parquet(f"{path}/starts").count() / 3
    pages.build(table.limit(0), path + "-empty")
    assert pages.page(spark, path + "-empty", 10, 0).count() == 0


def test_upsert_of_touched_parts_equals_the_whole(spark, tmp_path):
    fields = "name string, version string, updated_at timestamp_ntz, created_at timestamp_ntz"
    now, old = "2024-06-01 00:00:00", F.lit("2024-01-01").cast("timestamp_ntz")
    table = spark.range(300).select(F.concat(F.lit("m"), "id").alias("name"), F.lit("1").alias("version"), old.alias("updated_at"), old.alias("created_at"))
    batch = spark.createDataFrame([("m7", "2"), ("m8", "3"), ("other", "1")], "name string, version string")
    kept = keyed.create(table, str(tmp_path / "t"), "name", 32)
    whole = sorted(tuple(r) for r in writes.upsert(table, batch, "name", now).select(*table.columns).collect())
    before = stamps(tmp_path / "t")
    for _ in range(2):
        assert len(writes.upsert_parts(kept, batch, now)) <= 3
        assert sorted(tuple(r) for r in kept.read(spark).collect()) == whole and fields
    assert sum(stamps(tmp_path / "t").get(f) == s for f, s in before.items()) >= 28

"""The vector index against the plain search, what it reads, and its odd rows."""

import numpy as np
import pytest

from contentloom.operators import vector_index as I
from contentloom.operators import vectors as E

FIELDS = "content_id string, embedding array<float>, content_type string, metadata string"


def clustered(n=600, dims=8, groups=12, seed=1):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(groups, dims)) * 4
    rows = []
    for i in range(n):
        v = centers[i % groups] + rnd.normal(size=dims) * 0.2
        rows.append((f"v{i:05d}", [float(x) for x in v], f"t{i % 3}", '{"k":"%d"}' % (i % 2)))
    return rows


def found(df):
    return sorted((r.query_id, r["rank"], r.content_id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame(clustered(), FIELDS).repartition(4)
    return rows, I.build(rows, str(tmp_path_factory.mktemp("i") / "cells"))


@pytest.mark.parametrize("how", [{}, {"content_type": "t1"}, {"content_type": "t2", "filters": {"k": "1"}}, {"threshold": 0.97}, {"content_type": "none"}])
def test_equals_plain_search(spark, index, monkeypatch, how):
    monkeypatch.setattr(I, "QUERY_ROWS", 7)
    monkeypatch.setattr(I, "CELL_ROWS", 11)
    rows, made = index
    asked = rows.where("content_id LIKE '%7'").selectExpr("content_id AS query_id", "embedding")
    got = found(I.search(made, asked, 9, **how))
    assert got == found(E.top_k(asked, rows, 9, **how)) and bool(got) == (how.get("content_type") != "none")


def test_far_cells_are_not_read(spark, index):
    rows, made = index
    assert made.rows.sum() == 600 and (made.rows > 0).sum() > 12
    asked = rows.where("content_id = 'v00003'").selectExpr("content_id AS query_id", "embedding")
    first = I.probes(made, asked, 5).select("cell").distinct().count()
    best = I.search(made, asked, 5)
    kth = min(r.score for r in best.collect())
    more = I.probes(made, asked.selectExpr("*", f"CAST({kth} AS DOUBLE) AS kth"), 5).select("cell").distinct().count()
    assert first + more < (made.rows > 0).sum() / 2
    assert "PartitionFilters" in best._jdf.queryExecution().toString() and "cell" in I.read(spark, made.path).columns


def test_odd_vectors(spark, tmp_path):
    rows = clustered(80, 4, 3, 2)
    rows += [(f"same{i:03d}", [1.0, 2.0, 3.0, 4.0], "t0", None) for i in range(150)]  # ties in one cell
    rows += [("zero", [0.0] * 4, "t0", None), ("null", None, "t0", None), ("none", [], "t0", None), ("hole", [1.0, None, 2.0, 3.0], "t0", None), ("nan", [float("nan")] * 4, "t0", None)]
    rows += [(f"short{i}", [float(i), 1.0], "t0", None) for i in range(5)] + [("v00001", rows[1][1], "t1", None)]
    table = spark.createDataFrame(rows, FIELDS).repartition(3)
    made = I.build(table, str(tmp_path / "cells"), cells=6)
    asked = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate([rows[0][1], [1.0, 2.0, 3.0, 4.0], [0.0] * 4, [2.0, 1.0], [1.0], None, [], [float("nan")] * 4, [-1.0, -2.0, -3.0, -4.0]])], "query_id string, embedding array<float>")
    got = found(I.search(made, asked, 12))
    assert got == found(E.top_k(asked, table, 12)) and {r[0] for r in got} == {"q0", "q1", "q2", "q3", "q8"}
    empty = I.build(table.limit(0), str(tmp_path / "empty"))
    assert found(I.search(empty, asked, 3)) == []


def test_groups_follow_the_counted_rows(spark, monkeypatch):
    monkeypatch.setattr(E, "QUERY_ROWS", 20)
    monkeypatch.setattr(E, "VECTOR_ROWS", 10)
    table = spark.createDataFrame(clustered(120), FIELDS)
    asked = table.selectExpr("content_id AS query_id", "embedding")
    assert found(E.top_k(asked, table, 3)) == found(E.top_k(asked, table, 3, blocks=1, shards=1))

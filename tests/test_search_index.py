"""The trigram index against the scan, and what it reads."""

import random

import pytest

from contentloom.operators import search_index as S
from contentloom.operators import store

FIELDS = "id string, title string, content string, metadata string"


def odd_rows():
    rnd = random.Random(4)
    words = ["alpha", "Beta", "gamma", "İstanbul", "ΣΊΣΥΦΟΣ", "straße", "日本語", "a_b", "100%", "c\\d", "x"]
    rows = [(f"r{i}", *(None if rnd.random() < 0.1 else " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for _ in range(3))) for i in range(900)]
    rows += [(None, "alpha twice", None, None)] * 3 + [("all", None, None, None), ("blank", "", "", ""), ("long", "t", "word " * 60_000 + "needle", "m"), ("split", "nee", "dle", "eed"), ("r1", "again", "gamma", "")]
    return rows


PATTERNS = ["needle", "alpha beta", "ALPHA", "istanbul", "i̇stanbul", "σίσυφος", "ΣΊΣΥΦΟΣ", "straße", "日本語", "日本", "a_b", "alp%mma", "100%", "c\\d", "", "%", "x", "not there", "_lph_", "gam%x%alp"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    table = spark.createDataFrame(odd_rows(), FIELDS).repartition(5)
    path = str(tmp_path_factory.mktemp("s") / "index")
    S.build(table, path)
    return table, path


@pytest.mark.parametrize("send", [0, 10_000])
@pytest.mark.parametrize("pattern", PATTERNS)
def test_equals_scan(spark, index, monkeypatch, pattern, send):
    monkeypatch.setattr(S, "SEND_RANGES", send)
    table, path = index
    got = S.search(spark, path, pattern)
    assert got.columns == table.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, store.search(table, pattern).collect()))


def test_reads_a_part_of_the_table(spark, index):
    table, path = index
    grams = S.literal_grams(spark, "needle")
    found = S.candidates(spark, path, grams)
    assert len(grams) == 4 and found.count() <= 2  # the row that has them in different columns is a candidate too
    read = S.rows_read(spark, path, found)
    assert 0 < read.count() < table.count()
    plan = read._jdf.queryExecution().toString()
    assert "__shelf" in plan[plan.index("PartitionFilters"):] and "__range" in plan[plan.index("PushedFilters"):]


def test_lists_stay_small(spark, index):
    _, path = index
    lists = spark.read.parquet(f"{path}/grams")
    assert lists.selectExpr("max(size(rows)) AS n").first()["n"] <= S.RANGE
    table = spark.createDataFrame([], FIELDS)
    S.build(table, path + "-empty")
    assert S.search(spark, path + "-empty", "needle").count() == 0

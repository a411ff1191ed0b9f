"""Pages at any depth: the table is laid out once in its order, and a page reads the range it lies in.

Rows are dealt by ranges of the order, newest first and then by id, and each range is a partition,
``shelf``, sorted in itself. Spark finds the borders from a sample; the exact places follow from the counted rows
of the ranges, one small row each, whose running sum says where each begins. A page is found
by its place in these sums, so all pages together are the table once, whatever the borders are.

Defined cases: rows without a time come last; rows of equal time are ordered by id, NULL first, and rows equal
in both by their other columns; pages behind the end are empty; a page may reach over several ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Rows of a range, about; a range that a border cannot cut, as of equal rows, is larger.
SHELF_ROWS = 200_000
SHELF = "__shelf"


def _order(columns: list[str]) -> list:
    rest = [c for c in columns if c not in ("created_at", "id", SHELF)]
    return [F.desc_nulls_last("created_at"), "id", *rest]


def build(df: DataFrame, path: str, shelf_rows: int = SHELF_ROWS) -> None:
    """Lay out a table with ``created_at`` and ``id`` below ``path``."""
    shelves = max(1, -(-df.count() // shelf_rows))
    order = _order(df.columns)
    dealt = df.repartitionByRange(shelves, *order[:2]).withColumn(SHELF, F.spark_partition_id())
    dealt.sortWithinPartitions(*order).write.partitionBy(SHELF).parquet(f"{path}/rows")
    df.limit(0).withColumn(SHELF, F.lit(0)).write.parquet(f"{path}/columns")
    counted = read(df.sparkSession, path).groupBy(SHELF).agg(F.count("*").alias("n"))
    before = Window.orderBy(SHELF).rowsBetween(Window.unboundedPreceding, -1)
    # A row per range, so one task can add them up.
    counted.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).write.parquet(f"{path}/starts")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def shelves_of(spark: SparkSession, path: str, limit: int, offset: int) -> list:
    """``shelf`` and ``start`` of the ranges in which the page lies."""
    starts = spark.read.parquet(f"{path}/starts")
    return sorted(starts.where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)).select(SHELF, "start").collect(), key=lambda r: r["start"])


def page(spark: SparkSession, path: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the order; ranges before the page are not read."""
    found = shelves_of(spark, path, limit, offset)
    rows = read(spark, path)
    if not found:
        return rows.drop(SHELF).limit(0)
    mine = rows.where(F.col(SHELF).isin([r[SHELF] for r in found])).orderBy(*_order(rows.columns)).drop(SHELF)
    return mine.offset(offset - found[0]["start"]).limit(limit)

"""Changes of tables that are partitioned by columns of their own: only the partitions they touch are written.

A row may move to another partition, as an object that goes to another project; its old partition is found by
its key, for which the key and the partition columns of the table are read. Touched partitions are put
together completely, in the shared folder, before one of them is replaced, so a merge that is
repeated gives the same table.

Defined cases: a NULL partition value is a partition like others; of several rows of a key the greatest in
``order`` stays; rows with a NULL key are added and replace none; an empty change writes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from contentloom.operators.skew import pick
from contentloom.session import materialize


def write(df: DataFrame, path: str, partition_by: Sequence[str], mode: str = "errorifexists") -> None:
    """Write a table; the rebalance groups rows by partition, and adaptive execution cuts large ones."""
    df.hint("rebalance", *partition_by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table with its declared columns; conditions on partition columns prune."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def _within(partitions: Sequence[T.Row], partition_by: Sequence[str]) -> Column:
    """A condition that prunes to these partitions."""
    one = lambda r: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c])) for c in partition_by])
    return reduce(lambda a, b: a | b, [one(r) for r in partitions], F.lit(False))


def merge(changes: DataFrame, path: str, schema: T.StructType, partition_by: Sequence[str], key: str, order: Sequence[str]) -> list[T.Row]:
    """Add or replace rows by key; returns the partitions that were written.

    ``order`` decides between stored and new rows, and among several new ones. The list of touched
    partitions is on the driver; there are no more than the change has rows.
    """
    spark, cols = changes.sparkSession, list(partition_by)
    new = materialize(changes.select(*schema.names), "changes")
    stored = read(spark, path, schema)
    moved = stored.select(key, *cols).join(new.select(key).distinct(), key, "left_semi").select(*cols)
    touched = sorted(new.select(*cols).union(moved).distinct().collect(), key=repr)
    if not touched:
        return []
    both = stored.where(_within(touched, cols)).unionByName(new)
    known = pick(both.where(F.col(key).isNotNull()), [key], order)
    now = materialize(known.unionByName(both.where(F.col(key).isNull())), "partitions")
    write(now, path, cols, "overwrite")
    left = {tuple(r) for r in now.select(*cols).distinct().collect()}
    for r in touched:
        if tuple(r) not in left:  # all its rows have moved away
            write_empty(spark, path, schema, r, cols)
    return touched


def write_empty(spark: SparkSession, path: str, schema: T.StructType, partition: T.Row, partition_by: Sequence[str]) -> None:
    """Replace the rows of a partition by none, which a dynamic overwrite of no rows does not."""
    fields = T.StructType([f for f in schema.fields if f.name not in partition_by])
    names = spark.createDataFrame([partition], T.StructType([schema[c] for c in partition_by])).select(*[F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias(c) for c in partition_by]).first()
    folder = "/".join(f"{c}={_escaped(names[c])}" for c in partition_by)
    spark.createDataFrame([], fields).coalesce(1).write.mode("overwrite").parquet(f"{path}/{folder}")


def _escaped(value: str) -> str:
    """A partition value as Spark writes it into the folder's name."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "\"#%'*/:=?\\{[]^\x7f" else c for c in value)


def period(key: str, unit: str) -> Column:
    """The start of the key's period, by which large tables are partitioned."""
    return F.date_trunc(unit, key).cast("timestamp_ntz")


def by_period(df: DataFrame, key: str = "created_at", unit: str = "year") -> DataFrame:
    """The table with the column to partition it by, ``{key}_{unit}``."""
    return df.withColumn(f"{key}_{unit}", period(key, unit))


def between(df: DataFrame, low: str, high: str, key: str = "created_at", unit: str = "year") -> DataFrame:
    """Rows with ``low <= key < high`` of a table partitioned by period; only the periods between are read."""
    part, at = F.col(f"{key}_{unit}"), lambda x: F.lit(x).cast("timestamp_ntz")
    periods = (part >= F.date_trunc(unit, at(low)).cast("timestamp_ntz")) & (part < at(high))
    return df.where(periods & (F.col(key) >= at(low)) & (F.col(key) < at(high)))

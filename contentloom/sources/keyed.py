"""Tables cut by the hash of a key, so that a set of keys reads and rewrites its own parts only.

The table is partitioned by ``__part``, a hash of the key modulo the number of parts. A lookup reads the
parts of its keys; a change writes the parts it touches anew and leaves the others alone, with
Spark's dynamic partition overwrite. With many more parts than changed keys both
cost what the change holds.

Defined cases: rows with a NULL key are spread over all parts and found by no lookup; repeated keys are
rows of their own; an empty change rewrites nothing; a table has one writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from contentloom.operators.skew import FEW_KEYS, matching, without

PART = "__part"
# Up to so many parts every task may write all of them.
DIRECT_PARTS = 32


@dataclass(frozen=True)
class Keyed:
    """A table below ``path`` with the rows of ``schema``, cut by ``key``."""

    path: str
    key: str
    parts: int
    schema: T.StructType

    def _part(self, columns: list[str]) -> Column:
        spread = F.when(F.col(self.key).isNull(), F.xxhash64(*columns)).otherwise(F.xxhash64(self.key))
        return F.pmod(spread, F.lit(self.parts)).cast("int")

    def _write(self, df: DataFrame, mode: str) -> list[int]:
        """Write the rows; returns the parts that have some."""
        rows = df.select(*self.schema.names).withColumn(PART, self._part(self.schema.names))
        seen = Observation()
        rows = rows.observe(seen, F.collect_set(PART).alias("parts"))
        # With few parts each task writes files of its own for them, which saves a shuffle of the table. With
        # many the rebalance gathers a part, and cuts large ones; adaptive execution then gives them to several tasks.
        dealt = rows if self.parts <= DIRECT_PARTS else rows.hint("rebalance", PART)
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(PART).parquet(self.path)
        return sorted(seen.get["parts"])

    def _all(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField(PART, T.IntegerType())])).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._all(spark).drop(PART)

    def _counts(self, keys: DataFrame) -> dict[int, int]:
        known = keys.where(F.col(self.key).isNotNull()).groupBy(self._part([self.key]).alias("p")).agg(F.count("*").alias("n"))
        return {r["p"]: r["n"] for r in known.collect()}

    def parts_of(self, keys: DataFrame) -> list[int]:
        """The parts of the keys in the column of the table's key; at most as many as there are parts."""
        return sorted(self._counts(keys))

    def _in(self, spark: SparkSession, parts: list[int]) -> DataFrame:
        rows = self._all(spark)
        return rows.where(F.col(PART).isin(parts)) if parts else rows.where(F.lit(False))

    def near(self, keys: DataFrame) -> DataFrame:
        """All rows of the parts in which the keys lie, with the part."""
        return self._in(keys.sparkSession, self.parts_of(keys))

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys; only their parts are read. Many keys also go through a filter, so few other rows are shuffled."""
        counts, keys = self._counts(keys), keys.select(self.key)
        rows = self._in(keys.sparkSession, sorted(counts)).drop(PART)
        return matching(rows, keys, self.key) if sum(counts.values()) > FEW_KEYS else rows.join(keys.distinct(), self.key, "left_semi")

    def replace(self, keys: DataFrame, rows: DataFrame) -> list[int]:
        """Put ``rows`` in the place of all rows of the keys; returns the parts that were written.

        ``rows`` may have other keys too. The new parts are complete before one of them replaces an old
        one, and a repeated call leaves the same rows. A part that loses all its rows becomes an
        empty file of that part.
        """
        spark, keys = keys.sparkSession, keys.select(self.key)
        counts = self._counts(keys.union(rows.select(self.key)))
        parts = sorted(counts)
        if not parts:
            return parts
        old = self._in(spark, parts).drop(PART)
        many = sum(counts.values()) > FEW_KEYS
        kept = without(old, keys, self.key) if many else old.join(keys.distinct(), self.key, "left_anti")
        # A dynamic overwrite reads the old parts to the end before new ones take their places, so the rows are written once.
        left = self._write(kept.unionByName(rows.select(*self.schema.names)), "overwrite")
        for part in sorted(set(parts) - set(left)):
            spark.createDataFrame([], self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{PART}={part}")
        return parts


def create(df: DataFrame, path: str, key: str, parts: int) -> Keyed:
    """Write a table cut by a key."""
    table = Keyed(path, key, parts, df.schema)
    table._write(df, "errorifexists")
    return table

"""A table kept as a full state and the changes since, merged when it is read.

Parquet has no MERGE. Full states are written to ``state`` and changed rows to ``deltas``, each write
in a partition ``version=N`` of its own, so that the changes are one table and one scan however many
there are. A row in ``log`` makes a write count: readers see it whole or not at all, and
a failed one leaves only a partition that no row names and that the next attempt replaces.

Readers take the newest row per key with one aggregate over state and changes. ``compact`` folds the
changes into a new state, carries over which writes are in it, and drops what the state before it
replaced; readers that planned on that state still find its files until the next fold.
The log therefore has as many rows as there were writes since the last but one fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from contentloom.operators.skew import pick

LOG = "version bigint, kind string, source string, number bigint, sources array<string>, streams map<string,bigint>"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The writes since the last but one fold: ``version``, ``kind`` (``state`` or ``deltas``), ``source`` and ``number``.

    A state also has the ``sources`` in it and the last number of each of the ``streams``.
    """
    try:
        return spark.read.schema(LOG).parquet(f"{root}/log")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG)


def _now(spark: SparkSession, root: str):
    """Version of the state (0 without one), of the last write, and how many deltas follow the state."""
    log = manifest(spark, root)
    state = F.max(F.when(F.col("kind") == "state", F.col("version")))
    known = log.agg(F.coalesce(state, F.lit(0)).alias("state"), F.coalesce(F.max("version"), F.lit(0)).alias("last"))
    return known.join(log, F.col("version") > F.col("state"), "left").groupBy("state", "last").agg(F.count("version").alias("deltas")).first()


def _carried(spark: SparkSession, root: str) -> tuple[list[str], dict[str, int]]:
    """Named writes, and the last number of each stream, in the table as it is now."""
    log = manifest(spark, root)
    named = log.select(F.explode("sources").alias("s")).union(log.where("number IS NULL AND source <> ''").select("source")).distinct()
    streams = log.select(F.explode("streams")).union(log.where("number IS NOT NULL").select("source", "number")).groupBy("key").agg(F.max("value").alias("n"))
    return sorted(r["s"] for r in named.collect()), {r["key"]: r["n"] for r in streams.collect()}


def _add(df: DataFrame, root: str, kind: str, source: str, number: int | None, partition_by: Sequence[str] = (), carry: bool = False) -> int:
    spark = df.sparkSession
    version = _now(spark, root)["last"] + 1
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{kind}/version={version}")
    named, streams = _carried(spark, root) if carry else ([], {})
    spark.createDataFrame([(version, kind, source, number, named, streams)], LOG).coalesce(1).write.mode("overwrite").parquet(f"{root}/log/v={version}")
    return version


def published(spark: SparkSession, root: str, source: str, number: int | None = None) -> bool:
    """True if the write named ``source``, or a stream's write of this or a later number, is part of the table."""
    log = manifest(spark, root)
    if number is None:
        return not log.where((F.col("source") == source) | F.array_contains("sources", source)).isEmpty()
    last = F.greatest(F.coalesce(F.when(F.col("source") == source, F.col("number")), F.lit(-1)), F.coalesce(F.try_element_at("streams", F.lit(source)), F.lit(-1)))
    return not log.where(last >= number).isEmpty()


def publish(df: DataFrame, root: str, source: str = "", partition_by: Sequence[str] = ()) -> int:
    """Make a DataFrame the new full state; returns its version.

    A table has one writer at a time. ``source`` names the write, so that a
    repeated one can be recognised; each name stays in the log.
    """
    return _add(df, root, "state", source, None, partition_by, carry=True)


def publish_delta(df: DataFrame, root: str, source: str = "", number: int | None = None) -> int:
    """Add changed rows to the table. A stream gives its name and the number of the batch, of which only the last is kept."""
    return _add(df, root, "deltas", source, number)


def read(spark: SparkSession, root: str, key: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame | None:
    """The current state, None if nothing was published.

    With deltas, ``key`` and ``order`` tell which row of a key is the newest; of
    equal ones the later write counts.
    """
    now = _now(spark, root)
    if now["last"] == 0:
        return None
    state = spark.read.parquet(f"{root}/state/version={now['state']}") if now["state"] else None
    if not now["deltas"]:
        return state
    # One scan; the condition prunes the partitions of folded and unfinished writes.
    version = F.col("version")
    rows = spark.read.parquet(f"{root}/deltas").where((version > now["state"]) & (version <= now["last"])).withColumn("version", version.cast("bigint"))
    if state is not None:
        rows = state.withColumn("version", F.lit(now["state"]).cast("bigint")).unionByName(rows)
    return pick(rows, list(key), [*order, "version"]).drop("version")


def waiting(spark: SparkSession, root: str) -> int:
    """How many deltas a reader merges."""
    return _now(spark, root)["deltas"]


def compact(spark: SparkSession, root: str, key: Sequence[str], order: Sequence[str]) -> int:
    """Fold all deltas into a new full state, and drop what the state before this one replaced."""
    before = _now(spark, root)["state"]
    version = publish(read(spark, root, key, order), root)
    old = [r["version"] for r in manifest(spark, root).where(F.col("version") < before).select("version").collect()]
    for v in old:  # as many as were written between two folds
        for path in (f"state/version={v}", f"deltas/version={v}", f"log/v={v}"):
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return version

"""An inverted trigram index for the free-text search of ``store.search``.

The index is two Parquet tables below one folder. ``rows`` holds the table with a number per row: ranges of
``RANGE`` rows in the order in which a task read them, kept in ``SHELVES`` partitions. ``grams`` holds, for
each three characters in lower case that occur in a range, the places of the rows in it, partitioned by
``BUCKETS`` of the trigram's value and sorted by it. Rows are numbered without a
shuffle, and lists are gathered in the task that read the range, so a list has at most ``RANGE``
entries however often a trigram occurs.

A query reads the lists of the trigrams of its literal parts, intersects them range by range,
reads only the shelves and ranges that are left, and checks the rows with ILIKE. Trigrams do
not see which column they come from nor how they follow each other; the check does. A pattern without
three literal characters in a row has no trigram and scans the rows. All ways give the rows of
``store.search``.

Defined cases: NULL columns match nothing; ``%`` and ``_`` are wildcards; an empty pattern matches
every row with a text that is not NULL; rows without an id and repeated rows are found like others;
texts of any length are indexed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from contentloom.operators import store
from contentloom.session import materialize

RANGE, SHELVES, BUCKETS = 1024, 4096, 64
COLUMNS = ("title", "content", "metadata")
# Lists of so many ranges become conditions of the scan; longer ones meet the rows in a join only.
SEND_RANGES = 10_000
# Characters of text that are cut into trigrams at a time.
CHARACTERS = 1 << 20
PLACES = ["__shelf", "__range", "__row"]


def grams_of(text: str) -> np.ndarray:
    """The different trigrams of a text: three code points in one number."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else np.zeros(0, np.int64)


def bucket_of(gram):
    """The partition of trigrams, for a number or an array."""
    return (gram ^ gram >> 19 ^ gram >> 37) % BUCKETS


def _gathered(rows: DataFrame) -> DataFrame:
    """One row per range and trigram: ``bucket``, ``gram``, ``__range`` and ``rows``, the places in the range."""

    def lists(range_: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, row = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((row, gram))
        gram, row = gram[order], row[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
        gram, row = gram[new], row[new]
        at = np.flatnonzero(np.concatenate([np.ones(min(len(gram), 1), bool), gram[1:] != gram[:-1]]))
        ends = np.concatenate([at, [len(gram)]]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(bucket_of(gram[at])), pa.array(gram[at]), pa.array(np.full(len(at), range_)), pa.ListArray.from_arrays(pa.array(ends), pa.array(row.astype(np.int32)))], names=["bucket", "gram", "__range", "rows"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, size = [], None, 0
        for batch in batches:
            for cut in range(0, batch.num_rows, 64):
                part = batch.slice(cut, 64)
                texts = [part.column(c).to_pylist() for c in COLUMNS]
                for range_, row, *text in zip(part.column("__range").to_pylist(), part.column("__row").to_pylist(), *texts):
                    # A range whose trigrams are too many comes in several lists; readers add them up.
                    if held and (range_ != own or size > CHARACTERS):
                        yield lists(own, held)
                        held, size = [], 0
                    own = range_
                    for t in text:
                        if t:
                            g = grams_of(t)
                            held.append((g, np.full(len(g), row)))
                            size += len(g)
        if held:
            yield lists(own, held)

    return rows.mapInArrow(make, "bucket long, gram long, __range long, rows array<int>")


def build(df: DataFrame, path: str) -> None:
    """Write the table and its trigrams below ``path``; the rows move once, from the source to their shelves."""
    n = F.monotonically_increasing_id()
    numbered = df.withColumns({"__number": n, "__shelf": F.pmod(F.spark_partition_id(), F.lit(SHELVES))})
    placed = numbered.withColumns({"__range": F.floor(F.col("__number") / RANGE).cast("long"), "__row": (F.col("__number") % RANGE).cast("int")}).drop("__number")
    placed.write.partitionBy("__shelf").parquet(f"{path}/rows")
    # An empty table has no file of its own that tells its columns.
    placed.limit(0).write.parquet(f"{path}/columns")
    # Lower case as ILIKE sees it.
    rows = stored(df.sparkSession, path).select("__range", "__row", *[F.lower(c).alias(c) for c in COLUMNS])
    _gathered(rows).hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/grams")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The indexed rows with their places."""
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def literal_grams(spark: SparkSession, query: str) -> list[int]:
    """Trigrams that a row must have to match; none if no literal part is long enough."""
    low = spark.range(1).select(F.lower(F.lit(query)).alias("q")).first()["q"]
    found = [grams_of(part) for part in re.split("[%_]", low)]
    return sorted({int(g) for part in found for g in part})


def candidates(spark: SparkSession, path: str, grams: Sequence[int]) -> DataFrame:
    """``__range`` and ``__row`` of the rows that have all trigrams; only their buckets are read."""
    lists = spark.read.schema("gram long, __range long, rows array<int>, bucket long").parquet(f"{path}/grams")
    wanted = lists.where(F.col("bucket").isin(sorted({bucket_of(g) for g in grams})) & F.col("gram").isin(list(grams)))
    # At most RANGE places per range and trigram, and a trigram per character of the pattern.
    of_gram = wanted.groupBy("__range", "gram").agg(F.flatten(F.collect_list("rows")).alias("rows"))
    of_range = of_gram.groupBy("__range").agg(F.collect_list("rows").alias("lists"))
    common = F.aggregate("lists", F.get("lists", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    return of_range.where(F.size("lists") == len(grams)).select("__range", F.explode(common).alias("__row"))


def rows_read(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """The rows that are read for the candidates: their ranges if those are few, else the table."""
    rows = stored(spark, path)
    ranges = [r[0] for r in found.select("__range").distinct().limit(SEND_RANGES + 1).collect()]
    if len(ranges) > SEND_RANGES:
        return rows
    # A range's task number is in its upper bits, as monotonically_increasing_id puts it there.
    shelves = sorted({(r * RANGE >> 33) % SHELVES for r in ranges})
    return rows.where(F.col("__shelf").isin(shelves) & F.col("__range").isin(ranges)) if ranges else rows.where(F.lit(False))


def search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The rows that ``store.search`` finds in the indexed table."""
    grams = literal_grams(spark, query)
    if not grams:
        return store.search(stored(spark, path), query).drop(*PLACES)
    found = materialize(candidates(spark, path, grams), "candidates")
    return store.search(rows_read(spark, path, found).join(found, ["__range", "__row"], "left_semi"), query).drop(*PLACES)

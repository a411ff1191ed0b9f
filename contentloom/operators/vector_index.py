"""An inverted-file index of vectors, searched exactly.

Spherical k-means in Spark cuts the unit vectors into cells. The table is written once,
partitioned by cell; for each cell the index knows its centroid, its number of rows
and its radius, the largest angle between the centroid and a vector of the cell.

By the triangle inequality no vector of a cell is closer to a query than the angle to the
centroid less the radius. A search therefore reads the nearest cells first, which gives the
k-th score found so far, and then only those other cells whose bound reaches that score. The
result is that of ``vectors.top_k``, ties included; the bound only decides what is read.

Queries and cells meet in groups of at most ``QUERY_ROWS`` queries and ``CELL_ROWS`` vectors, as
many as the counted rows need, so neither a large cell nor a popular one fills a task.

Defined cases: NULL and empty vectors and those with a NULL or NaN inside are not in the index, and
such queries find nothing; vectors are compared with queries of their own length; a zero vector has
score 0 with everything and lies in a cell of its own; equal scores go to the smaller id; repeated ids
are rows of their own; an empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F, types as T

from contentloom.operators.vectors import SCORES_DDL, filtered, scores_in_group, usable
from contentloom.session import materialize

# Rows that k-means sees per cell, and its rounds; every row is indexed.
SAMPLE_PER_CELL, ROUNDS = 64, 6
MAX_CELLS = 16_384
QUERY_ROWS, CELL_ROWS = 1024, 65_536
# Scores are rounded to six digits before they are ranked.
SLACK = 1e-6


@dataclass
class VectorIndex:
    """Where the cells lie and what is known of them, one entry per cell in each array."""

    path: str
    length: np.ndarray
    centroid: list[np.ndarray]
    radius: np.ndarray
    rows: np.ndarray

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells for unit queries of one length and, per query, the highest score each may hold."""
        cells = np.flatnonzero((self.length == queries.shape[1]) & (self.rows > 0))
        if not len(cells):
            return cells, np.zeros((len(queries), 0))
        centroids = np.stack([self.centroid[c] for c in cells])
        angle = np.arccos(np.clip(queries @ centroids.T, -1, 1))
        bound = np.cos(np.maximum(angle - self.radius[cells], 0))
        # The zero vectors' cell, and queries that are zero, score 0 and nothing else.
        return cells, np.where((np.linalg.norm(centroids, axis=1) == 0)[None, :] | (np.linalg.norm(queries, axis=1) == 0)[:, None], 0.0, bound)


def _units(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of the rows of each length."""
    values = batch.column("embedding")
    sizes = np.asarray(values.value_lengths())
    flat, starts = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        m = flat[starts[at][:, None] + np.arange(n)]
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        yield at, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _fitted(rows: DataFrame, length: int, count: int, n_cells: int) -> np.ndarray:
    """Centroids of the ``count`` vectors of one length: k-means over about ``SAMPLE_PER_CELL`` rows per cell, chosen by the hash of id and vector.

    A round assigns the rows in their tasks and adds up one vector per task and cell; the
    driver holds the centroids only.
    """
    part = int(min(1.0, n_cells * SAMPLE_PER_CELL / count) * (1 << 30))
    same = rows.where(F.size("embedding") == length).select("embedding", F.xxhash64("content_id", "embedding").alias("h"))
    sample = materialize(same.where(F.pmod("h", F.lit(1 << 30)) < part).repartition(max(1, n_cells * SAMPLE_PER_CELL // 50_000)), "vector-sample")
    held = sample.dropDuplicates(["embedding"]).orderBy("h").limit(n_cells).select("embedding").collect()
    made = np.array([r[0] for r in held], np.float64)
    norm = np.linalg.norm(made, axis=1, keepdims=True)
    centroids = made[(norm > 0).ravel()] / norm[norm > 0][:, None]
    for _ in range(ROUNDS):
        if len(centroids) < 2:
            break
        now = sample.sparkSession.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            c = now.value
            total, n = np.zeros_like(c), 0
            for batch in batches:
                for _, units in _units(batch):
                    np.add.at(total, (units @ c.T).argmax(axis=1), units)
                    n += len(units)
            used = np.flatnonzero(np.abs(total).sum(axis=1)) if n else []
            yield pa.RecordBatch.from_pydict({"cell": pa.array(used, pa.int64()), "total": pa.array([total[i] for i in used], pa.list_(pa.float64()))})

        add = lambda a, x: F.zip_with(a, x, lambda p, q: p + q)
        parts = sample.mapInArrow(sums, "cell long, total array<double>").groupBy("cell").agg(F.collect_list("total").alias("totals"))
        # As many vectors per cell as the bounded sample has tasks.
        merged = parts.select("cell", F.aggregate(F.slice("totals", 2, 1 << 20), F.get("totals", F.lit(0)), add).alias("total")).collect()
        for r in merged:
            total = np.array(r["total"])
            if (size := np.linalg.norm(total)) > 0:
                centroids[r["cell"]] = total / size
        now.destroy()
    return centroids


def build(vectors: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
    """Index ``content_id``, ``embedding``, ``content_type`` and ``metadata`` below ``path``.

    By default there are about as many cells as rows in a cell, ``MAX_CELLS`` at most.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select("content_id", "embedding", "content_type", "metadata"))
    lengths = {r["n"]: r["rows"] for r in rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).collect()}
    centroid: list[np.ndarray] = []
    for n, count in sorted(lengths.items()):
        made = _fitted(rows, n, count, min(MAX_CELLS, cells or max(1, round(count**0.5))))
        centroid += [*made, np.zeros(n)]
    length = np.array([len(c) for c in centroid], np.int64)
    known = spark.sparkContext.broadcast((length, centroid))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, centroid = known.value
        stacked = {n: (np.flatnonzero(length == n), np.stack([c for c in centroid if len(c) == n])) for n in set(length.tolist())}
        for batch in batches:
            cell, angle = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for at, units in _units(batch):
                ids, c = stacked[units.shape[1]]
                near = units @ c.T
                best = near[:, :-1].argmax(axis=1) if len(ids) > 1 else np.zeros(len(at), np.int64)
                zero = ~units.any(axis=1)
                best[zero] = len(ids) - 1  # the last one is for zero vectors
                cell[at] = ids[best]
                angle[at] = np.where(zero, 0.0, np.arccos(np.clip(near[np.arange(len(at)), best], -1, 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(cell)], names=[*batch.schema.names, "angle", "cell"])

    schema = T.StructType([*rows.schema.fields, T.StructField("angle", T.DoubleType()), T.StructField("cell", T.LongType())])
    # The rebalance cuts cells above the advisory size, so a large one is written by many tasks.
    rows.mapInArrow(assign, schema).hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    stats = read(spark, path, rows.schema).groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect() if lengths else []
    radius, n_rows = np.zeros(len(centroid)), np.zeros(len(centroid), np.int64)
    for r in stats:
        radius[r["cell"]], n_rows[r["cell"]] = r["r"] + 1e-7, r["n"]
    return VectorIndex(path, length, centroid, radius, n_rows)


def read(spark, path: str, rows: T.StructType | None = None) -> DataFrame:
    """The indexed rows; a condition on ``cell`` prunes partitions."""
    fields = T.StructType.fromDDL("content_id string, embedding array<float>, content_type string, metadata string") if rows is None else rows
    return spark.read.schema(T.StructType([*fields.fields, T.StructField("angle", T.DoubleType()), T.StructField("cell", T.LongType())])).parquet(path)


def probes(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """Which cells a query reads: ``query_id``, ``embedding``, ``cell``.

    Without a column ``kth`` these are the nearest cells that hold k rows together; with it,
    the other cells that may hold a score of ``kth`` or more.
    """
    known = queries.sparkSession.sparkContext.broadcast(index)
    second = "kth" in queries.columns

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = known.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, found = [], []
                for places, units in _units(batch):
                    cells, bound = index.bounds(units)
                    order = np.argsort(-bound, axis=1, kind="stable")
                    enough = np.cumsum(index.rows[cells][order], axis=1)
                    first = np.concatenate([np.zeros((len(units), 1), np.int64), enough[:, :-1]], axis=1)[:, :len(cells)] < k
                    take = first
                    if second:
                        kth = batch.column("kth").to_numpy(zero_copy_only=False)[places]
                        take = ~first & (np.take_along_axis(bound, order, axis=1) >= kth[:, None] - SLACK)
                    q, c = np.nonzero(take)
                    rows.append(places[q])
                    found.append(cells[order[q, c]])
                at_rows = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at_rows), batch.column("embedding").take(at_rows), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["query_id", "embedding", "cell"])

    fields = [f for f in queries.schema.fields if f.name in ("query_id", "embedding")]
    return queries.select(*[f.name for f in fields], *(["kth"] if second else [])).mapInArrow(make, T.StructType([*fields, T.StructField("cell", T.LongType())]))


def _scanned(index: VectorIndex, asked: DataFrame, k: int, content_type: str | None, filters: Mapping[str, str] | None) -> DataFrame:
    """The k best scores per query and group among the cells asked for."""
    spark = asked.sparkSession
    counted = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per cell
    sizes = spark.createDataFrame([Row(cell=c, blocks=-(-n // QUERY_ROWS), parts=int(-(-index.rows[c] // CELL_ROWS))) for c, n in counted.items()], "cell long, blocks long, parts long")
    vectors = filtered(read(spark, index.path), content_type, filters)
    vectors = vectors.where(F.col("cell").isin(sorted(counted))) if counted else vectors.where(F.lit(False))
    spread = lambda key, n: F.pmod(F.xxhash64(key), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(F.broadcast(sizes), "cell").withColumn("block", spread("query_id", F.col("blocks"))).withColumn("part", every("parts")).select("query_id", "embedding", "cell", "block", "part")
    right = vectors.join(F.broadcast(sizes), "cell").withColumn("part", spread("content_id", F.col("parts"))).withColumn("block", every("blocks")).select("content_id", "embedding", "cell", "block", "part")
    key = ["cell", "block", "part"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda q, v: scores_in_group(q, v, k), SCORES_DDL)


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "content_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    index: VectorIndex, queries: DataFrame, k: int = 10, content_type: str | None = None,
    filters: Mapping[str, str] | None = None, threshold: float | None = None,
) -> DataFrame:
    """The k most similar contents per query, as ``vectors.top_k`` gives them; queries have different ids.

    Filters apply inside the cells. A query that finds fewer than k rows in its nearest cells reads all others that
    its threshold allows.
    """
    asked = materialize(usable(queries.select("query_id", "embedding")), "queries")
    near = materialize(probes(index, asked, k), "probes")
    first = materialize(_scanned(index, near, k, content_type, filters), "first-scores")
    kth = _best(first, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    least = F.greatest(F.when(F.col("n") == k, F.col("s")), F.lit(threshold).cast("double"), F.lit(-2.0))
    rest = materialize(probes(index, asked.join(kth, "query_id", "left").withColumn("kth", least), k), "probes")
    best = _best(first.union(_scanned(index, rest, k, content_type, filters)), k)
    return best if threshold is None else best.where(F.col("score") >= threshold)

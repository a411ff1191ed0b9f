"""Similar content by vector, and keeping the vector table in step with the contents."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from contentloom.functions import payload as P
from contentloom.operators.skew import fold

# Rows that are compared at a time inside a task.
QUERY_BLOCK, VECTOR_BLOCK = 512, 4096
# Rows of one meeting of queries and vectors.
QUERY_ROWS, VECTOR_ROWS = 4096, 65_536
SCORES = pa.schema([("query_id", pa.string()), ("content_id", pa.string()), ("score", pa.float64())])
SCORES_DDL = "query_id string, content_id string, score double"


def filtered(vectors: DataFrame, content_type: str | None = None, filters: Mapping[str, str] | None = None) -> DataFrame:
    """Vectors of one type whose metadata has the given values; applied before ranking."""
    if content_type is not None:
        vectors = vectors.where(F.col("content_type") == content_type)
    for key, value in (filters or {}).items():
        vectors = vectors.where(P.json_text(F.col("metadata"), key) == value)
    return vectors


def _units(column: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length of the vectors in a column, with the places and the unit vectors of its rows."""
    values = column.combine_chunks()
    sizes, flat = np.asarray(values.value_lengths()), values.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        m = np.empty((len(at), n))
        for i in range(0, len(at), VECTOR_BLOCK):
            some = flat[starts[at[i : i + VECTOR_BLOCK]][:, None] + np.arange(n)].astype(np.float64)
            norms = np.linalg.norm(some, axis=1, keepdims=True)
            m[i : i + VECTOR_BLOCK] = np.divide(some, norms, out=np.zeros_like(some), where=norms > 0)
        yield n, at, m


def _cut(rank: np.ndarray, place: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k smallest ranks of each row, with their places and scores."""
    if rank.shape[1] <= k:
        return rank, place, scores
    top = np.argpartition(rank, k - 1, axis=1)[:, :k]
    return tuple(np.take_along_axis(x, top, axis=1) for x in (rank, place, scores))


def _best_of(queries: np.ndarray, units: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best vectors per query; equal scores go to the smaller place.

    Vectors are taken ``VECTOR_BLOCK`` at a time and meet the best ones so far.
    """
    n, best = len(units), None
    for at in range(0, n, VECTOR_BLOCK):
        scores = np.round(queries @ units[at : at + VECTOR_BLOCK].T, 6)
        place = np.broadcast_to(np.arange(at, at + scores.shape[1]), scores.shape)
        # Score and place in one number, so that ties are cut here as well.
        rank = place - np.rint(scores * 1e6).astype(np.int64) * n
        found = _cut(rank, place, scores, k)
        best = found if best is None else _cut(*(np.concatenate(x, axis=1) for x in zip(best, found, strict=True)), k)
    return best[1], best[2]


def usable(df: DataFrame) -> DataFrame:
    """Rows whose vector can be compared."""
    return df.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))


def unusable(vectors: DataFrame) -> DataFrame:
    """Ids of vectors that ``top_k`` cannot compare: NULL, empty, or with a NULL or NaN inside."""
    return vectors.select("content_id", "embedding").join(usable(vectors).select("content_id"), "content_id", "left_anti").select("content_id")


def scores_in_group(q: pa.Table, v: pa.Table, k: int, threshold: float | None = None) -> pa.Table:
    """The k best vectors of a group for each of its queries, among those of the query's length."""
    v = v.take(pc.sort_indices(v["content_id"]))
    near = {n: (at, units) for n, at, units in _units(v["embedding"])}
    found = [pa.table([[], [], []], SCORES)]
    for n, asked, queries in _units(q["embedding"]):
        if n not in near:
            continue
        at, units = near[n]
        for i in range(0, len(asked), QUERY_BLOCK):
            place, score = _best_of(queries[i : i + QUERY_BLOCK], units, k)
            who, score = np.repeat(asked[i : i + QUERY_BLOCK], place.shape[1]), score.ravel()
            kept = np.ones(len(score), bool) if threshold is None else score >= threshold
            found.append(pa.table([q["query_id"].take(pa.array(who[kept])), v["content_id"].take(pa.array(at[place.ravel()[kept]])), score[kept]], SCORES))
    return pa.concat_tables(found)


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 10, content_type: str | None = None,
    filters: Mapping[str, str] | None = None, threshold: float | None = None, blocks: int | None = None, shards: int | None = None,
) -> DataFrame:
    """The k most similar contents per query vector by cosine, exactly.

    ``queries`` holds (query_id, embedding), ``vectors`` (content_id, embedding,
    content_type, metadata). Queries in ``blocks`` meet vectors in ``shards``; each
    meeting keeps its k best per query, which a ranking then joins. Both numbers only
    set the size of a task: a vector is sent ``blocks`` times, a query ``shards`` times. They are the least: more
    are made as the counted rows need, so a meeting has about ``QUERY_ROWS`` queries and ``VECTOR_ROWS`` vectors at any size.
    Vectors are compared with queries of their own length; unusable ones (see
    ``unusable``) are no candidates, and a query of that kind finds nothing.
    ``vector_index`` reads less where vectors are searched more than once.
    """
    spread = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = usable(queries.select("query_id", "embedding"))
    rows = usable(filtered(vectors, content_type, filters).select("content_id", "embedding"))
    blocks = max(blocks or 1, -(-queries.count() // QUERY_ROWS))
    # A shard per core is the least unless given, so that few rows still meet in parallel.
    shards = max(shards or queries.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() // VECTOR_ROWS))
    left = asked.withColumn("block", spread("query_id", blocks)).withColumn("shard", every(shards))
    right = rows.withColumn("shard", spread("content_id", shards)).withColumn("block", every(blocks))
    best = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(lambda q, v: scores_in_group(q, v, k, threshold), SCORES_DDL)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "content_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def extract_text(content: Column, fields: tuple[str, ...] = ("title", "text", "summary", "description")) -> Column:
    """The text of a content payload to make vectors from: its text fields, joined by blanks."""
    v = P.safe_json(content)
    return F.concat_ws(" ", *[F.nullif(P.get_text(v, f), F.lit("")) for f in fields])


def join_vectors(contents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Contents with their vectors."""
    return contents.join(vectors.withColumnRenamed("content_id", "id"), "id")


def sync_report(contents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids only one store has: ``missing_vector`` or ``orphan_vector``."""
    left = contents.select("id", F.lit(1).alias("c"), F.lit(0).alias("v"))
    right = vectors.select(F.col("content_id").alias("id"), F.lit(0), F.lit(1))
    merged = left.union(right).groupBy("id").agg(F.max("c").alias("c"), F.max("v").alias("v"))
    return merged.where("c + v = 1").select("id", F.when(F.col("c") == 1, "missing_vector").otherwise("orphan_vector").alias("issue"))


def update_vectors(current: DataFrame, updates: DataFrame, order: Sequence[str]) -> DataFrame:
    """Replace embedding and metadata where given; unknown ids are skipped.

    Of several updates each column takes the last value given in ``order``.
    """
    # an empty object gives no new metadata
    given = updates.withColumn("metadata", F.nullif("metadata", F.lit("{}")))
    one = fold(given, ["content_id"], order, ["embedding", "metadata"])
    new = one.select("content_id", F.col("embedding").alias("__embedding"), F.col("metadata").alias("__metadata"))
    joined = current.join(new, "content_id", "left")
    keep = lambda c: F.coalesce(f"__{c}", c).alias(c) if c in ("embedding", "metadata") else F.col(c)
    return joined.select(*[keep(c) for c in current.columns])

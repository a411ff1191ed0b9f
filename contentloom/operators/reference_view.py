"""Back references kept up to date by what changes, instead of being computed anew.

The view is that of ``references.back_references``: each source once per existing target, with the
source's type. Edges lie in a table cut by source and objects in one cut by id (``sources.keyed``),
the view is a snapshot with changes (``sources.snapshots``).

When sources get new edges, their old and new targets are compared: a pair that only the new
edges have comes in, one that only the old ones have goes out, and nothing else is read or written. The rows
say what is, not what is added, so a batch that runs twice, or again after it failed half way, gives the same
view. When objects come, go or change their type, the pairs they take part in are looked up.

Defined cases: a source that several edges of different types join to one target is one pair; sources of
unknown type, or that are deleted, count as ``unknown``; pairs of targets that do not exist are left out
and come in with the target; NULL ids take part in nothing; an empty batch changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from contentloom.operators import references as X
from contentloom.operators.skew import matching, salted_join, without
from contentloom.session import materialize
from contentloom.sources import keyed, snapshots

FOLD_AFTER = 16
KEY = ["target_id", "id"]


@dataclass(frozen=True)
class ReferenceView:
    edges: keyed.Keyed
    objects: keyed.Keyed
    root: str

    def read(self, spark: SparkSession) -> DataFrame:
        """The back references: ``target_id``, ``id`` and ``type``."""
        return snapshots.read(spark, self.root, KEY, []).where(~F.col("removed")).drop("removed")


def create(edges: DataFrame, objects: DataFrame, path: str, parts: int) -> ReferenceView:
    """Lay the tables out and compute the view once. ``objects`` has ``id`` and ``object_type``."""
    spark = edges.sparkSession
    known = objects.select("id", "object_type").where(F.col("id").isNotNull())
    # Edges are shuffled once; the table of edges and the view are both written from what lies together then.
    rows = materialize(X.with_source_type(edges, known), "edges", "zstd")
    view = ReferenceView(
        keyed.create(rows.select("source_id", "target_id", "reference_type"), f"{path}/edges", "source_id", parts), keyed.create(known, f"{path}/objects", "id", parts), f"{path}/view",
    )
    ends = rows.where(F.col("first") & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    lost = materialize(X.missing_targets(ends, known), "missing")
    back = without(ends.select("target_id", F.col("source_id").alias("id"), "type"), lost, "target_id", ["id"])
    snapshots.publish(back.withColumn("removed", F.lit(False)), view.root, "start")
    return view


def _publish(view: ReferenceView, changes: DataFrame, source: str) -> None:
    snapshots.publish_delta(changes.select("target_id", "id", "type", "removed"), view.root, source)
    spark = changes.sparkSession
    if snapshots.waiting(spark, view.root) >= FOLD_AFTER:
        snapshots.compact(spark, view.root, KEY, [])


def _typed(view: ReferenceView, pairs: DataFrame) -> DataFrame:
    """Pairs ``target_id``, ``id`` as rows of the view: those of existing targets, with the source's type."""
    kinds = view.objects.of(pairs.select("id")).select("id", F.col("object_type").alias("type"))
    there = view.objects.of(pairs.select(F.col("target_id").alias("id"))).select(F.col("id").alias("target_id"))
    known = salted_join(pairs, there, ["target_id"], ["id"], "left_semi")
    return salted_join(known, kinds, ["id"], ["target_id"], "left").select("target_id", "id", F.coalesce("type", F.lit("unknown")).alias("type"), F.lit(False).alias("removed"))


def changed_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """``target_id``, ``id`` and ``is_new`` of the pairs that only one of two edge tables has."""
    both = old.select("target_id", F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("n")).union(new.select("target_id", "source_id", F.lit(0), F.lit(1)))
    seen = both.where(F.col("target_id").isNotNull() & F.col("id").isNotNull()).groupBy("target_id", "id").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return seen.where("o <> n").select("target_id", "id", (F.col("n") == 1).alias("is_new"))


def replace_edges(view: ReferenceView, sources: DataFrame, new: DataFrame, batch: str = "") -> None:
    """Swap all edges of the sources (``id``) for the new ones and bring the view along."""
    changed = sources.select(F.col("id").alias("source_id")).where(F.col("source_id").isNotNull()).distinct()
    now = X.unique_edges(new)
    old = materialize(view.edges.of(changed), "replaced", "zstd")
    pairs = materialize(changed_pairs(old, now), "pairs", "zstd")
    gone = pairs.where("NOT is_new").select("target_id", "id", F.lit(None).cast("string").alias("type"), F.lit(True).alias("removed"))
    # The view first: if the edges are not replaced afterwards, the next attempt finds the same changes.
    _publish(view, _typed(view, pairs.where("is_new").select("target_id", "id")).union(gone), batch)
    # Sources without edges before touch no part of the table.
    view.edges.replace(old.select("source_id").distinct(), now)


def change_objects(view: ReferenceView, objects: DataFrame, deleted: DataFrame, batch: str = "") -> None:
    """Objects (``id``, ``object_type``) that are new or change their type, and ids that go; the edges stay.

    Pairs by source come from the parts of those sources; pairs by target need two columns of all edges.
    """
    spark = objects.sparkSession
    gone = deleted.select("id").where(F.col("id").isNotNull()).distinct()
    rows = objects.select("id", "object_type").where(F.col("id").isNotNull()).join(gone, "id", "left_anti")
    ids = materialize(rows.select("id").union(gone).distinct(), "ids", "zstd")
    view.objects.replace(ids, rows)
    mine = view.edges.of(ids.select(F.col("id").alias("source_id"))).select("target_id", "source_id")
    at_me = matching(view.edges.read(spark).select("target_id", "source_id"), ids.select(F.col("id").alias("target_id")), "target_id", ["source_id"])
    pairs = materialize(mine.union(at_me).where(F.col("target_id").isNotNull() & F.col("source_id").isNotNull()).distinct().select("target_id", F.col("source_id").alias("id")), "pairs", "zstd")
    now = _typed(view, pairs)
    lost = pairs.join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("target_id", "id", F.lit(None).cast("string").alias("type"), F.lit(True).alias("removed"))
    _publish(view, now.union(lost), batch)

"""Levels of a hierarchy kept up to date when objects move.

The table holds (id, parent_id, level, issue) cut by id, and (parent_id, id) cut by parent, so
both a row and its children are found without reading the rest. A batch of moves, new and
deleted objects changes the levels of what lies below them and of nothing else: those rows are
found by going down from the changed ones, a round per level, and then get
their level from the parent outside of them by the doubling of ``hierarchy.levels``.

Defined cases: levels and issues are those of ``hierarchy.levels``, cycles and what hangs below them included; an
empty parent is none; an object that comes in finds the children that waited for it; children of a
deleted object are lost; an id that is deleted and moved in one batch stays; of several moves of one id
the greatest parent counts, none being the smallest; NULL ids are left out; an empty batch changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from contentloom.operators import hierarchy
from contentloom.operators.skew import salted_join
from contentloom.session import materialize
from contentloom.sources import keyed


@dataclass(frozen=True)
class LevelTable:
    nodes: keyed.Keyed
    children: keyed.Keyed

    def read(self, spark: SparkSession) -> DataFrame:
        """``id``, ``parent_id``, ``level`` and ``issue``."""
        return self.nodes.read(spark)


def create(df: DataFrame, path: str, parts: int) -> LevelTable:
    """Compute the levels of a table with ``id`` and ``parent_id`` once and lay it out."""
    rows = df.where(F.col("id").isNotNull()).select("id", F.nullif("parent_id", F.lit("")).alias("parent_id"))
    known = hierarchy.levels(rows).join(rows, "id").select("id", "parent_id", "level", "issue")
    return LevelTable(keyed.create(known, f"{path}/nodes", "id", parts), keyed.create(rows.where(F.col("parent_id").isNotNull()).select("parent_id", "id"), f"{path}/children", "parent_id", parts))


def below(table: LevelTable, ids: DataFrame) -> DataFrame:
    """The ids and all that lies below them; each round reads the children of the one before."""
    fronts = [front := materialize(ids.select("id").distinct(), "below", "zstd")]
    while not front.isEmpty():
        found = reduce(DataFrame.union, fronts)
        next_ = table.children.of(front.select(F.col("id").alias("parent_id"))).select("id").distinct()
        # A round writes its own rows only.
        fronts.append(front := materialize(next_.join(found, "id", "left_anti"), "below", "zstd"))
    return reduce(DataFrame.union, fronts)


def change(table: LevelTable, moved: DataFrame, deleted: DataFrame) -> DataFrame:
    """Give objects (``id``, ``parent_id``) a new parent, add those that are new, delete others; returns the rows that were written."""
    now = materialize(moved.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.nullif("parent_id", F.lit(""))).alias("parent_id")), "moves")
    gone = materialize(deleted.select("id").where(F.col("id").isNotNull()).distinct().join(now, "id", "left_anti"), "deleted")
    ids = now.select("id").union(gone)

    # Children leave their old parents and come to the new ones.
    before = table.nodes.of(ids).select("id", "parent_id")
    parents = materialize(before.select("parent_id").union(now.select("parent_id")).where(F.col("parent_id").isNotNull()).distinct(), "parents")
    stay = table.children.of(parents).join(ids, "id", "left_anti").select("parent_id", "id")
    table.children.replace(parents, stay.union(now.where(F.col("parent_id").isNotNull()).select("parent_id", "id")))

    seeds = now.select("id").union(table.children.of(gone.select(F.col("id").alias("parent_id"))).select("id"))
    found = below(table, seeds).join(gone, "id", "left_anti")
    old = table.nodes.of(found).select("id", "parent_id").join(now, "id", "left_anti")
    rows = materialize(old.union(now.select("id", "parent_id")), "moved-rows")

    # A parent among the changed rows is looked up later; one outside of them is known, or missing.
    inside = rows.select(F.col("id").alias("parent_id"), F.lit(True).alias("inside"))
    outside = table.nodes.of(rows.select(F.col("parent_id").alias("id"))).join(ids.union(rows.select("id")), "id", "left_anti").select(F.col("id").alias("parent_id"), F.col("level").alias("above"), F.col("issue").alias("trouble"), F.lit(True).alias("known"))
    met = salted_join(salted_join(rows, inside, ["parent_id"], ["id"], "left"), outside, ["parent_id"], ["id"], "left")
    root, waits, known = F.col("parent_id").isNull(), F.col("inside").isNotNull(), F.col("known").isNotNull()
    state = materialize(met.select(
        "id", F.when(waits, F.col("parent_id")).alias("up"),
        F.when(root, 0).when(waits, 1).otherwise(F.coalesce(F.col("above") + 1, F.lit(0))).cast("bigint").alias("dist"),
        F.when(root | waits, None).when(~known, "parent_not_found").when(F.col("trouble") == "cycle", "cycle").when(F.col("trouble").isNotNull(), "ancestor_not_found").alias("issue"),
    ), "levels")
    written = materialize(hierarchy.doubled(state).join(rows, "id").select("id", "parent_id", "level", "issue"), "relevelled")
    table.nodes.replace(written.select("id").union(gone), written)
    return written

"""Batch writes: enrich, insert, update, upsert and delete.

Each operator returns the rows of the next table state; ``sources.snapshots``
publishes them. Ids and times are arguments or hashes, never random or "now",
so a task that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from contentloom.functions import payload as P
from contentloom.functions.text import slug
from contentloom.operators.hierarchy import with_parent_level
from contentloom.operators.references import embedded_refs
from contentloom.operators.skew import fold, pick
from contentloom.operators.validation import once
from contentloom.sources.keyed import Keyed


def at(now: datetime | str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def collapse(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key, for batches that name a key more than once."""
    return pick(df, list(key), order)


def object_id(*parts: Column) -> Column:
    """A stable id for rows that bring none."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def enrich(batch: DataFrame, current: DataFrame, references: Column | None = None) -> DataFrame:
    """Fill the reserved metadata of a batch: level, type, parent and reference lists.

    Rows with an unknown parent keep a NULL level and carry an issue. Reference
    lists start empty unless the metadata has them or ``references`` is given.
    """
    leveled = with_parent_level(batch, current)
    changes = {
        "hierarchy_level": F.col("hierarchy_level").cast("string"),
        "object_type": P.quoted(F.col("content_type")),
        "parent_id": P.quoted(F.nullif("parent_id", F.lit(""))),
        "references": F.lit("[]") if references is None else references,
        "referenced_by": F.lit("[]"),
    }
    kept = {"references", "referenced_by"} if references is None else {"referenced_by"}
    filled = F.coalesce(F.col("metadata"), F.lit("{}"))
    enriched = once(leveled, __meta=P.merge_object(filled, changes, frozenset(kept)))
    return enriched.withColumn("object_type", F.col("content_type")).withColumn("metadata", F.col("__meta")).drop("__meta")


def _first_refs(refs: Column) -> Column:
    """References as JSON text, each id once, the first one winning."""
    entry = lambda r: F.struct(r["id"].alias("id"), F.coalesce(r["type"], F.lit("unknown")).alias("type"))
    # Sorted by id and place, the first of each id stands behind a different one.
    placed = lambda rs: F.array_sort(F.transform(rs, lambda r, i: F.struct(r["id"].alias("id"), i.alias("at"), r["type"].alias("type"))))
    first = lambda rs: F.filter(rs, lambda r, i: (i == 0) | ~r["id"].eqNullSafe(F.get(rs, i - 1)["id"]))
    by_place = lambda rs: F.array_sort(F.transform(P.let(placed(rs), first), lambda r: F.struct(r["at"], r["id"], r["type"])))
    return F.to_json(F.transform(P.let(refs, by_place), entry))


def insert(batch: DataFrame, current: DataFrame, now: datetime | str) -> DataFrame:
    """The rows to append for a batch of new objects.

    Missing ids are hashed from type, title and content. The references found in
    content and metadata are stored on the new row.
    """
    made = object_id(F.col("content_type"), F.col("title"), F.coalesce("content", F.lit("{}")))
    given = F.col("id") if "id" in batch.columns else F.lit(None).cast("string")
    ready = batch.withColumn("id", F.coalesce(given, made)).withColumn("content", F.coalesce("content", F.lit("{}")))
    found = _first_refs(embedded_refs(P.safe_json(F.col("content")), P.safe_json(F.col("metadata"))))
    out = enrich(ready, current, found)
    return out.withColumn("slug", slug(F.col("title"))).withColumn("created_at", at(now)).withColumn("updated_at", at(now))


def update(current: DataFrame, updates: DataFrame, now: datetime | str, order: Sequence[str]) -> DataFrame:
    """All rows with new content and metadata where an update gives them.

    NULL keeps the current value; unknown ids are skipped. Of several updates of an
    id the last one in ``order`` counts as a whole.
    """
    one = collapse(updates, ["id"], order)
    new = one.select("id", F.col("content").alias("__content"), F.col("metadata").alias("__metadata"), F.lit(True).alias("__hit"))
    joined = current.join(new, "id", "left")
    replaced = {
        "content": F.coalesce("__content", "content"),
        "metadata": F.coalesce("__metadata", "metadata"),
        "updated_at": F.when(F.col("__hit"), at(now)).otherwise(F.col("updated_at")),
    }
    return joined.select(*[replaced.get(c, F.col(c)).alias(c) for c in current.columns])


def updated_ids(current: DataFrame, updates: DataFrame) -> DataFrame:
    """The ids an update reaches."""
    return updates.select("id").distinct().join(current.select("id"), "id", "left_semi")


def upsert(current: DataFrame, batch: DataFrame, key: str, now: datetime | str, order: Sequence[str] = ("version",)) -> DataFrame:
    """Insert new keys and overwrite the given columns of known ones."""
    one = collapse(batch, [key], order)
    given = [c for c in one.columns if c != key]
    left = current.select(F.col(key), F.struct(*[c for c in current.columns if c != key]).alias("old"))
    right = one.select(F.col(key), F.struct(*given).alias("new"))
    joined = left.join(right, key, "full")
    is_new, touched = F.col("old").isNull(), F.col("new").isNotNull()

    def column(name: str) -> Column:
        if name == key:
            return F.col(key)
        if name == "updated_at":
            return F.when(touched, at(now)).otherwise(F.col("old.updated_at"))
        if name == "created_at":
            return F.when(is_new, at(now)).otherwise(F.col("old.created_at"))
        if name == "id" and "id" not in given:
            return F.coalesce("old.id", object_id(F.col(key)))
        if name == "id":
            return F.coalesce("old.id", "new.id")
        return F.coalesce(f"new.{name}", f"old.{name}") if name in given else F.col(f"old.{name}")

    return joined.select(*[column(c).alias(c) for c in current.columns])


def append_definitions(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Plain registration: always a new row, so names may repeat."""
    return current.unionByName(batch.select(*current.columns))


def duplicate_names(df: DataFrame, key: str = "name") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def upsert_parts(table: Keyed, batch: DataFrame, now: datetime | str, order: Sequence[str] = ("version",)) -> list[int]:
    """``upsert`` into a table cut by the key: reads and writes the batch's parts only; returns those.

    A batch that runs again gives the same rows.
    """
    done = upsert(table.of(batch), batch, table.key, now, order)
    return table.replace(batch, done.select(*table.schema.names))


def sparse_update_parts(table: Keyed, updates: DataFrame, now: datetime | str, order: Sequence[str]) -> list[int]:
    """``sparse_update`` of a table cut by the key, likewise."""
    done = sparse_update(table.of(updates), updates, now, order, table.key)
    return table.replace(updates, done.select(*table.schema.names))


def sparse_update(current: DataFrame, updates: DataFrame, now: datetime | str, order: Sequence[str], key: str = "id") -> DataFrame:
    """Change only the attributes an update gives; an update without any changes nothing.

    Several updates of a key add up: each attribute takes the last value given in ``order``.
    """
    fields = [c for c in updates.columns if c not in (key, *order) and c in current.columns]
    some = F.greatest(*[F.col(f"__{c}").isNotNull() for c in fields]) if len(fields) > 1 else F.col(f"__{fields[0]}").isNotNull()
    new = fold(updates, [key], order, fields).select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    joined = current.join(new, key, "left")
    cols = []
    for c in current.columns:
        if c in fields:
            cols.append(F.coalesce(f"__{c}", c).alias(c))
        elif c == "updated_at":
            cols.append(F.when(some, at(now)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return joined.select(*cols)


def delete(current: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows left after deleting ids."""
    return current.join(ids.select(key), key, "left_anti").select(*current.columns)


def deleted_ids(current: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The requested ids that existed."""
    return ids.select(key).distinct().join(current.select(key), key, "left_semi")


def _may_touch(project: str | None) -> Column:
    return (F.col("project_id") == F.lit(project).cast("string")) | F.col("project_id").isNull()


def update_contexts(current: DataFrame, updates: DataFrame, now: datetime | str, order: Sequence[str], project: str | None = None) -> DataFrame:
    """Replace the context of the ids that the project may see; the last update in ``order`` counts."""
    new = fold(updates, ["id"], order, ["context"]).withColumnRenamed("context", "__context")
    joined = current.join(new, "id", "left")
    hit = F.col("__context").isNotNull() & F.coalesce(_may_touch(project), F.lit(False))
    replaced = {
        "context": F.when(hit, F.col("__context")).otherwise(F.col("context")),
        "updated_at": F.when(hit, at(now)).otherwise(F.col("updated_at")),
    }
    return joined.select(*[replaced.get(c, F.col(c)).alias(c) for c in current.columns])


def delete_contexts(current: DataFrame, ids: DataFrame, project: str | None = None) -> DataFrame:
    """The contexts left after deleting those of the ids that the project may see."""
    gone = ids.select("id").distinct().withColumn("__gone", F.lit(True))
    hit = F.coalesce(F.col("__gone") & F.coalesce(_may_touch(project), F.lit(False)), F.lit(False))
    return current.join(gone, "id", "left").where(~hit).select(*current.columns)

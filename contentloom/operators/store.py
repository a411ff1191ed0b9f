"""Reading content tables: selections, search and paging."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from contentloom.functions import payload as P
from contentloom.functions.model import Model
from contentloom.operators.skew import pick
from contentloom.operators.validation import validate

# The columns every content query returns.
COLUMNS = ("id", "content_type", "title", "slug", "content", "metadata", "created_at", "updated_at")


def project_columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Objects whose id is in a table of ids."""
    return df.join(ids.select("id"), "id", "left_semi")


def by_type(df: DataFrame, content_type: str) -> DataFrame:
    return df.where(F.col("content_type") == content_type)


def by_parent(df: DataFrame, parent_id: str) -> DataFrame:
    return df.where(F.col("parent_id") == parent_id)


def by_level(df: DataFrame, level: int) -> DataFrame:
    return df.where(F.col("hierarchy_level") == level)


def by_parent_json(df: DataFrame, parent_id: str) -> DataFrame:
    """As by_parent for tables that hold the parent only inside the metadata."""
    return df.where(P.json_text(F.col("metadata"), "parent_id") == parent_id)


def by_level_json(df: DataFrame, level: int) -> DataFrame:
    return df.where(P.json_int(F.col("metadata"), "hierarchy_level") == level)


def _in_metadata(df: DataFrame, key: str, ref_id: str) -> DataFrame:
    return df.where(P.contains_ref(P.get(P.safe_json(F.col("metadata")), key), ref_id))


def referencing_json(df: DataFrame, ref_id: str) -> DataFrame:
    """Objects whose embedded references hold the id."""
    return _in_metadata(df, "references", ref_id)


def referenced_by_json(df: DataFrame, ref_id: str) -> DataFrame:
    """Objects whose embedded back references hold the id."""
    return _in_metadata(df, "referenced_by", ref_id)


def referencing(df: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Objects that reference any id of a set, by the edge table."""
    hits = edges.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return df.join(hits.select(F.col("source_id").alias("id")), "id", "left_semi")


def referenced_by(df: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Objects that any id of a set references, by the edge table."""
    hits = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return df.join(hits.select(F.col("target_id").alias("id")), "id", "left_semi")


def search(df: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring in title, content or metadata; ``%`` and ``_`` are wildcards."""
    like = "%" + query.replace("\\", "\\\\") + "%"
    return df.where(F.col("title").ilike(like) | F.col("content").ilike(like) | F.col("metadata").ilike(like))


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "active")


def title_ci(df: DataFrame, query: str, prefix: bool = False) -> DataFrame:
    """Titles that equal, or start with, the query in any case."""
    title = F.lower("title")
    return df.where(title.startswith(query.lower()) if prefix else title == query.lower())


def with_tag(df: DataFrame, tag: str) -> DataFrame:
    return df.where(F.array_contains("tags", tag))


def with_custom(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(P.json_text(F.col("metadata"), "custom_fields", key) == value)


def newest(df: DataFrame) -> DataFrame:
    """Newest first; the id makes the order total."""
    return df.orderBy(F.desc("created_at"), "id")


def page(df: DataFrame, limit: int = 100, offset: int = 0, after: tuple[datetime, str] | None = None) -> DataFrame:
    """One page, newest first.

    ``offset`` reads and drops the rows before the page. For deep pages pass
    ``after``, the last (created_at, id) seen: then the scan skips them.
    """
    if after is not None:
        at, last_id = F.lit(after[0]).cast("timestamp_ntz"), after[1]
        created = F.col("created_at")
        df = df.where((created < at) | ((created == at) & (F.col("id") > last_id)))
    ordered = newest(df)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def children_valid(df: DataFrame, container_id: str, m: Model, limit: int = 10, offset: int = 0) -> DataFrame:
    """Valid objects whose ``belongs_to`` names the container, newest first."""
    mine = df.where(P.json_text(F.col("content"), "belongs_to", "id") == container_id)
    checked = validate(page(mine, limit, offset), "content", m)
    return newest(checked.where("is_valid").select(*df.columns))


def _visible(project: str | Column | None) -> Column:
    same = F.col("project_id") == (F.lit(project).cast("string") if not isinstance(project, Column) else project)
    return same | F.col("project_id").isNull()


def visible_contexts(df: DataFrame, ids: DataFrame | None = None, project: str | None = None) -> DataFrame:
    """Contexts of the project and those of no project; no project sees only the latter."""
    seen = df.where(_visible(project))
    return seen if ids is None else by_ids(seen, ids)


def contexts_by(df: DataFrame, project: str | None = None, type: str | None = None, id: str | None = None) -> DataFrame:
    for name, value in (("project_id", project), ("type", type), ("id", id)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def latest_context(df: DataFrame, by: tuple[str, ...] = ("params",), project: str | None = None) -> DataFrame:
    """The latest context per key among those the project may see."""
    seen = df.where(_visible(project)) if project is not None or "project_id" not in by else df
    return pick(seen, by, ["updated_at", "id"])


def templates_in(df: DataFrame, category: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of templates; the category is applied before paging."""
    if category is not None:
        df = df.where(F.coalesce(P.json_text(F.col("metadata"), "category"), F.lit("")) == category)
    return page(df, limit, offset)

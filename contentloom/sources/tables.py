"""Content, project, context and vector tables: schemas, defaults, reading and writing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contentloom.functions import payload as P
from contentloom.functions.text import slug

# The content table.
CONTENTS = (
    "id string, content_type string, title string, slug string, content string, metadata string, "
    "parent_id string, hierarchy_level int, object_type string, status string, tags array<string>, "
    "project_id string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
# Columns a content row must fill.
NOT_NULL = ("id", "content_type", "title", "slug", "content", "metadata", "created_at", "updated_at")


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """The content table with its declared schema; nothing is inferred from data."""
    return spark.read.schema(CONTENTS).parquet(path)


def promoted(metadata: Column) -> dict[str, Column]:
    """Typed columns for the reserved metadata keys, so that filters reach the files."""
    m = P.safe_json(metadata)
    return {
        "parent_id": P.get_text(m, "parent_id"),
        "hierarchy_level": P.get_int(m, "hierarchy_level"),
        "object_type": P.get_text(m, "object_type"),
        "status": P.get_text(m, "status"),
        "tags": F.try_variant_get(m, "$.tags", "array<string>"),
        "project_id": P.get_text(m, "project_id"),
    }


def conform_contents(df: DataFrame, now: datetime | str) -> DataFrame:
    """Rows as the content table stores them: defaults filled, metadata keys promoted."""
    at = F.lit(now).cast("timestamp_ntz")
    have = lambda c, t="string": F.col(c) if c in df.columns else F.lit(None).cast(t)
    filled = df.select(
        "id", "content_type", "title",
        F.coalesce(have("slug"), slug(F.col("title"))).alias("slug"),
        F.coalesce(have("content"), F.lit("{}")).alias("content"),
        F.coalesce(have("metadata"), F.lit("{}")).alias("metadata"),
        F.coalesce(have("created_at", "timestamp_ntz"), at).alias("created_at"),
        F.coalesce(have("updated_at", "timestamp_ntz"), at).alias("updated_at"),
        *[F.col(c).alias(f"__{c}") for c in ("project_id",) if c in df.columns],
    )
    keys = promoted(F.col("metadata"))
    if "project_id" in df.columns:
        keys["project_id"] = F.coalesce("__project_id", keys["project_id"])
    out = filled.withColumns(keys)
    return out.select(*[c.strip().split(" ")[0] for c in CONTENTS.split(", ")])


def null_violations(df: DataFrame) -> DataFrame:
    """Rows that leave a required column empty, with the names of those columns."""
    empty = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in NOT_NULL]), lambda e: e.isNotNull())
    return df.withColumn("null_columns", empty).where(F.size("null_columns") > 0)


def complete(df: DataFrame) -> DataFrame:
    """Rows that fill all required columns."""
    ok = F.lit(True)
    for c in NOT_NULL:
        ok = ok & F.col(c).isNotNull()
    return df.where(ok)


def write_contents(df: DataFrame, path: str, by_project: bool = False, mode: str = "errorifexists") -> None:
    """Write the content table, partitioned by type (and project), newest rows first in each file.

    The rebalance groups rows by partition for few files, and adaptive execution
    cuts groups above the advisory size, so a dominant type is written by many tasks.
    """
    keys = (["project_id"] if by_project else []) + ["content_type"]
    rows = complete(df).hint("rebalance", *keys).sortWithinPartitions(*keys, F.desc("created_at"), "slug")
    rows.write.partitionBy(*keys).mode(mode).parquet(path)


def for_project(df: DataFrame, project_id: str) -> DataFrame:
    """The contents of one project; prunes partitions of a table written by project."""
    return df.where(F.col("project_id") == project_id)


def build_projects(df: DataFrame, now: datetime | str) -> DataFrame:
    at = F.lit(now).cast("timestamp_ntz")
    return df.select("id", "name", "description", F.coalesce("metadata", F.lit("{}")).alias("metadata"), at.alias("created_at"), at.alias("updated_at"))


def projects_by(df: DataFrame, id: str | None = None, name: str | None = None) -> DataFrame:
    for column, value in (("id", id), ("name", name)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def build_contexts(df: DataFrame, now: datetime | str) -> DataFrame:
    """Context rows; parameters are stored in canonical form so that key order does not matter."""
    at = F.lit(now).cast("timestamp_ntz")
    return df.select(
        "id", "type", P.canonical_json(F.col("params")).alias("params"), "context", "project_id",
        at.alias("created_at"), at.alias("updated_at"),
    )


def build_vectors(df: DataFrame, collection: str = "default") -> DataFrame:
    """Vector rows by content id, with an empty object as default metadata."""
    return df.select(
        "content_id", F.col("embedding").cast("array<float>").alias("embedding"), "content_type",
        F.coalesce("metadata", F.lit("{}")).alias("metadata"), F.lit(collection).alias("collection"),
    )


def write_vectors(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.partitionBy("collection").mode(mode).parquet(path)


def write_split(validated: DataFrame, path: str, mode: str = "append") -> None:
    """Store valid and quarantined rows in one pass, as ``is_valid=true`` and ``is_valid=false``."""
    validated.drop("validated_data").write.partitionBy("is_valid").mode(mode).parquet(path)

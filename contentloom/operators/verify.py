"""Compare model definitions with the physical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contentloom.functions.model import Model, spark_type, struct_for

# Column types that satisfy each model type; other types expect a string.
EXPECTED = {
    "str": "string", "string": "string", "int": "bigint", "float": "double", "bool": "boolean",
    "datetime": "timestamp_ntz", "date": "date", "UUID": "string", "uuid": "string", "json": "string",
}
# Model types that map to no single column.
SKIPPED = r"^(Dict|List|dict|list)(\[.*)?$"
# Column types that count as equal for verification.
SAME = {"int": "bigint", "timestamp": "timestamp_ntz"}


def _lookup(mapping: dict[str, str], key: Column, other: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), other)


def issues(fields: DataFrame, columns: DataFrame, prefix: str | None = None) -> DataFrame:
    """Missing columns and wrong types of required fields, one row each.

    ``fields`` is the field catalog with its table name, ``columns`` the table
    columns. Definitions whose table does not exist are left to ``unresolved``.
    """
    if prefix is not None:
        fields = fields.where(F.col("model").startswith(prefix))
    checked = fields.where(F.col("required") & ~F.col("type").rlike(SKIPPED))
    wanted = checked.select(
        "model", F.col("table_name").alias("table"), F.col("field").alias("column"),
        _lookup(EXPECTED, F.col("type"), F.lit("string")).alias("expected"),
    )
    actual = columns.select("table", "column", _lookup(SAME, F.col("data_type"), F.col("data_type")).alias("actual"))
    there = wanted.join(columns.select("table").distinct(), "table", "left_semi")
    joined = there.join(actual, ["table", "column"], "left")
    kind = F.when(F.col("actual").isNull(), "missing_column").when(F.col("actual") != F.col("expected"), "type_mismatch")
    return joined.withColumn("issue", kind).where("issue IS NOT NULL").select("model", "table", "column", "issue", "expected", "actual")


def verify(fields: DataFrame, columns: DataFrame, prefix: str | None = None) -> DataFrame:
    """One row per model with a table: validity and its issues.

    The lists hold fields of one definition, which was one value to begin with.
    """
    if prefix is not None:
        fields = fields.where(F.col("model").startswith(prefix))
    definitions = fields.select("model", F.col("table_name").alias("table")).distinct()
    definitions = definitions.join(columns.select("table").distinct(), "table", "left_semi")
    found = issues(fields, columns).groupBy("model").agg(
        F.sort_array(F.collect_list(F.when(F.col("issue") == "missing_column", F.col("column")))).alias("missing_columns"),
        F.sort_array(F.collect_list(F.when(F.col("issue") == "type_mismatch", F.struct("column", "expected", "actual")))).alias("type_mismatches"),
    )
    out = definitions.join(found, "model", "left")
    empty = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return out.select(
        "model", "table",
        (F.coalesce(F.size("missing_columns") + F.size("type_mismatches"), F.lit(0)) == 0).alias("is_valid"),
        empty("missing_columns", "array<string>"),
        empty("type_mismatches", "array<struct<column:string,expected:string,actual:string>>"),
    )


def unresolved(wanted: DataFrame, definitions: DataFrame, columns: DataFrame, schema: str = "public") -> DataFrame:
    """Requested model names that cannot be verified, and why."""
    named = wanted.select("model").distinct().join(
        definitions.select(F.col("name").alias("model"), F.col("table_name").alias("table"), F.lit(True).alias("__known")).distinct(), "model", "left"
    )
    tables = columns.select("table", F.lit(True).alias("__there")).distinct()
    joined = named.join(tables, "table", "left")
    error = F.when(
        F.col("__known").isNull(), F.concat(F.lit("Model '"), "model", F.lit("' not found in registry"))
    ).when(F.col("__there").isNull(), F.concat(F.lit("Table '"), "table", F.lit(f"' not found in schema '{schema}'")))
    return joined.select("model", error.alias("error")).where("error IS NOT NULL")


def missing_tables(definitions: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables that definitions define but the catalog lacks, with one of their definitions."""
    wanted = definitions.groupBy(F.col("table_name").alias("table")).agg(F.max("name").alias("model"))
    return wanted.join(columns.select("table").distinct(), "table", "left_anti")


def primary_keys(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Key columns of tables: declared keys (table, column) that are columns."""
    return columns.select("table", "column", "pos").join(keys.select("table", "column").distinct(), ["table", "column"])


def table_schema(fields: DataFrame) -> DataFrame:
    """Target column, Spark type, nullability and key flag of every field."""
    known = F.array(*[F.lit(k) for k in EXPECTED])
    column_type = F.when(F.array_contains(known, F.col("type")), _lookup(EXPECTED, F.col("type"), F.lit("string"))).otherwise("string")
    return fields.select(
        F.col("table_name").alias("table"), F.col("field").alias("column"), column_type.alias("data_type"),
        (~F.col("required")).alias("nullable"), (F.col("primary_key") | (F.col("field") == "id")).alias("primary_key"), "pos",
    )


def conform(df: DataFrame, m: Model) -> DataFrame:
    """The table with the columns its model lacks added as NULLs; the rest stays as it is."""
    missing = [f for f in struct_for(m).fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def repair(df: DataFrame | None, m: Model, spark=None) -> DataFrame:
    """The repaired table: missing columns added, or an empty table where there is none."""
    return spark.createDataFrame([], struct_for(m)) if df is None else conform(df, m)


def with_range_partition(df: DataFrame, key: str = "created_at", unit: str = "year") -> DataFrame:
    """Add the start of the key's period, to partition written tables by."""
    return df.withColumn(f"{key}_{unit}", F.date_trunc(unit, key).cast("timestamp_ntz"))


__all__ = [
    "conform", "issues", "missing_tables", "primary_keys", "repair", "spark_type", "table_schema", "unresolved",
    "verify", "with_range_partition",
]

"""Physical table schemas as a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

COLUMNS = "db string, table string, column string, data_type string, nullable boolean, pos int"


def columns_of(spark: SparkSession, schemas: Mapping[str, StructType], db: str = "default") -> DataFrame:
    """Columns of named schemas: (db, table, column, data_type, nullable, pos)."""
    rows = [
        (db, table, f.name, f.dataType.simpleString(), f.nullable, pos)
        for table, schema in schemas.items()
        for pos, f in enumerate(schema.fields, 1)
    ]
    return spark.createDataFrame(rows, COLUMNS)


def table_columns(spark: SparkSession, db: str = "default", tables: Iterable[str] | None = None) -> DataFrame:
    """Columns of all tables of a database, from the session catalog."""
    names = tables if tables is not None else [t.name for t in spark.catalog.listTables(db) if not t.isTemporary]
    return columns_of(spark, {n: spark.table(f"{db}.{n}").schema for n in names}, db)


def parquet_columns(spark: SparkSession, paths: Mapping[str, str], db: str = "default") -> DataFrame:
    """Columns of parquet tables; only the file footers are read."""
    return columns_of(spark, {n: spark.read.parquet(p).schema for n, p in paths.items()}, db)


def primary_keys(spark: SparkSession, db: str = "default", tables: Iterable[str] | None = None) -> DataFrame:
    """Declared keys (table, column): the table property ``primary_key``, comma-separated."""
    names = tables if tables is not None else [t.name for t in spark.catalog.listTables(db) if not t.isTemporary]
    rows = []
    for n in names:
        for p in spark.sql(f"SHOW TBLPROPERTIES `{db}`.`{n}`").collect():
            if p["key"] == "primary_key":
                rows += [(n, c.strip()) for c in p["value"].split(",")]
    return spark.createDataFrame(rows, "table string, column string")


def create_table(spark: SparkSession, name: str, ddl: str, keys: Iterable[str] = (), db: str = "default") -> None:
    """Create an empty parquet table from a column list; keys are kept as a table property."""
    keys = ", ".join(keys)
    props = f" TBLPROPERTIES ('primary_key' = '{keys}')" if keys else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{db}`.`{name}` ({ddl}) USING parquet{props}")

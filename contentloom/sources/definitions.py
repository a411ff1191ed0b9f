"""Model definitions from and to JSON files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from contentloom.functions import payload as P
from contentloom.operators.validation import once


def parse_definitions(df: DataFrame, now: datetime | str, object_type: str = "alpha", version: str = "1.0") -> DataFrame:
    """Definition texts (path, value) as model rows with an ``error`` for unusable ones."""
    v = F.col("__d")
    parsed = df.withColumn("__d", P.safe_json(F.col("value")))
    name = P.get_text(v, "name")
    fault = F.when(v.isNull(), "invalid JSON").when(P.as_map(v).isNull(), "not an object").when(F.coalesce(name, F.lit("")) == "", "name is required")
    read = once(parsed, name=name, error=fault, description=F.coalesce(P.get_text(v, "description"), F.concat(name, F.lit(" model definition"))))
    at = F.lit(now).cast("timestamp_ntz")
    return read.select(
        "path", F.sha2("name", 256).alias("id"), "name", F.lit(object_type).alias("object_type"), F.lit(version).alias("version"),
        "description", F.col("value").alias("definition"), at.alias("created_at"), at.alias("updated_at"), "error",
    )


def load_definitions(
    spark: SparkSession, path: str, now: datetime | str, object_type: str = "alpha", version: str = "1.0"
) -> tuple[DataFrame, DataFrame]:
    """Model rows of all JSON files below a path, and the files that hold no usable one."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    rows = parse_definitions(files.select(F.input_file_name().alias("path"), "value"), now, object_type, version)
    return rows.where("error IS NULL").drop("error", "path"), rows.where("error IS NOT NULL").select("path", "error", F.col("definition").alias("value"))


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Export documents as JSON lines, one model per line."""
    documents.select(F.col("document").alias("value")).write.mode(mode).text(path)

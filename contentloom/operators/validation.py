"""Validate whole tables of JSON records against definitions.

Validation is one narrow stage: parse the payload once, evaluate an array of
checks, keep the ones that failed. Nothing is shuffled and no row reaches a
Python worker.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from contentloom.functions import payload as P
from contentloom.functions.model import FieldDef, Model, from_struct
from contentloom.functions.rules import RECORD, Record
from contentloom.functions.typespec import check

ERROR = "struct<path:string,message:string,code:string>"
ERRORS = f"array<{ERROR}>"
RESULT = ("is_valid", "errors", "warnings", "validated_data")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Append costly columns so that they are evaluated once per row.

    A filter on a projected column is pushed below the projection and repeats
    the whole expression, one JSON parse per mention. A generated column stops
    that, while filters on the other columns still move down to the scan.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def error(path: str, message: Column | str, code: str = "invalid") -> Column:
    """One error entry; an entry with a NULL message is no error."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(path).alias("path"), text.alias("message"), F.lit(code).alias("code"))


def errors_array(*checks: Column) -> Column:
    """The checks that failed, in order."""
    if not checks:
        return F.array().cast(ERRORS)
    return F.filter(F.array(*checks), lambda e: e["message"].isNotNull())


def _exempt(f: FieldDef, strict_reference: bool) -> bool:
    return f.has_default_key if strict_reference else f.default is not None


def _field_check(v: Column, f: FieldDef, partial: bool, strict_reference: bool) -> Column:
    value = P.get(v, *f.path)
    needed = f.required and not partial and not _exempt(f, strict_reference)
    missing = F.lit(f"Missing required field: {f.name}") if needed else F.lit(None).cast("string")
    wrong = F.concat(F.lit(f"Invalid type for {f.name}: "), check(value, f.spec))
    return error(f.name, F.when(value.isNull(), missing).otherwise(wrong))


def field_errors(v: Column, m: Model, partial: bool = False, strict_reference: bool = False) -> Column:
    """Missing fields and wrong types of a parsed record."""
    return errors_array(*[_field_check(v, f, partial, strict_reference) for f in m.fields])


def rule_errors(v: Column, m: Model) -> Column:
    return errors_array(*[error(r.path, r.error(Record(v))) for r in m.rules])


def _metadata_gaps(v: Column, keys: tuple[str, ...], what: str) -> Column:
    return errors_array(*[
        error(f"metadata.{k}", F.when(P.get(v, "metadata", k).isNull(), F.lit(f"{what} metadata is missing: {k}")))
        for k in keys
    ])


def _checked(text: Column, v: Column, found: Column) -> Column:
    """Field checks only for objects; other payloads get the one root error."""
    is_object = v.isNotNull() & F.ltrim(text, F.lit(" \t\n\r")).startswith("{")
    root = F.when(v.isNull(), F.lit("payload is not valid JSON")).when(~is_object, F.lit("payload is not an object"))
    return F.when(is_object, found).otherwise(F.array(error("", root, "invalid_json")))


def _finish(df: DataFrame, payload: str, *helpers: str) -> DataFrame:
    kept = [c for c in df.columns if c not in (*helpers, "errors", "warnings")]
    valid = F.size("errors") == 0
    return df.select(
        *kept, valid.alias("is_valid"), "errors", "warnings", F.when(valid, F.col(payload)).alias("validated_data")
    )


def validate(
    df: DataFrame, payload: str, m: Model, partial: bool = False, strict_reference: bool = False
) -> DataFrame:
    """Append ``is_valid, errors, warnings, validated_data`` to a table of JSON records.

    Unknown keys are allowed and kept; nothing is coerced. Rules run only for
    records without field errors. ``partial`` accepts absent fields.
    ``strict_reference`` exempts every field whose args name a default, even null.
    """
    v = F.col(RECORD)
    parsed = df.withColumn(RECORD, P.safe_json(F.col(payload)))
    fields = F.concat(field_errors(v, m, partial, strict_reference), _metadata_gaps(v, m.metadata_required, "required"))
    warnings = F.when(v.isNotNull(), _metadata_gaps(v, m.metadata_recommended, "recommended")).otherwise(errors_array())
    out = once(parsed, errors=_checked(F.col(payload), v, fields), warnings=warnings)
    if m.rules:
        ruled = F.when(F.size("errors") == 0, rule_errors(v, m)).otherwise(F.col("errors"))
        out = once(out, __ruled=ruled).drop("errors").withColumnRenamed("__ruled", "errors")
    return _finish(out, payload, RECORD)


def validate_mixed(df: DataFrame, payload: str, model_column: str, definitions: Mapping[str, Model], partial: bool = False) -> DataFrame:
    """Validate a table whose rows name their own model; unknown names are an error."""
    v, name = F.col(RECORD), F.col(model_column)
    found = F.array(error("", F.concat(F.lit("Model not found: "), F.coalesce(name, F.lit("null"))), "model_not_found"))
    ruled, warnings = F.col("errors"), errors_array()
    for key, m in definitions.items():
        own = F.concat(field_errors(v, m, partial), _metadata_gaps(v, m.metadata_required, "required"))
        found = F.when(name == key, own).otherwise(found)
        if m.metadata_recommended:
            warnings = F.when(v.isNotNull() & (name == key), _metadata_gaps(v, m.metadata_recommended, "recommended")).otherwise(warnings)
        if m.rules:
            ruled = F.when((F.size("errors") == 0) & (name == key), rule_errors(v, m)).otherwise(ruled)
    out = once(df.withColumn(RECORD, P.safe_json(F.col(payload))), errors=_checked(F.col(payload), v, found), warnings=warnings)
    if any(m.rules for m in definitions.values()):
        out = once(out, __ruled=ruled).drop("errors").withColumnRenamed("__ruled", "errors")
    return _finish(out, payload, RECORD)


def validate_struct(df: DataFrame, payload: str, schema: T.StructType, name: str = "Record", partial: bool = False) -> DataFrame:
    """Validate against a typed class given as a Spark schema; errors keep dotted paths."""
    return validate(df, payload, from_struct(schema, name), partial)


def validate_object(df: DataFrame, m: Model, partial: bool = False) -> DataFrame:
    """Validate the combined object of content_type, title, content and metadata."""
    whole = F.concat(
        F.lit('{"content_type":'), F.coalesce(P.quoted(F.col("content_type")), F.lit("null")),
        F.lit(',"title":'), F.coalesce(P.quoted(F.col("title")), F.lit("null")),
        F.lit(',"content":'), F.coalesce("content", F.lit("{}")),
        F.lit(',"metadata":'), F.coalesce("metadata", F.lit("{}")), F.lit("}"),
    )
    return validate(df.withColumn("object", whole), "object", m, partial)


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rows without the result columns, and the rows to quarantine."""
    return validated.where("is_valid").drop(*RESULT), validated.where("NOT is_valid").drop("validated_data")


def audit(df: DataFrame, payload: str, m: Model, *by: str) -> DataFrame:
    """Validate stored rows and summarise, optionally per group."""
    return summary(validate(df, payload, m), *by)


def summary(validated: DataFrame, *by: str) -> DataFrame:
    """Rows, valid rows, invalid rows and errors."""
    return validated.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if("is_valid").alias("n_valid"),
        F.count_if(~F.col("is_valid")).alias("n_invalid"),
        F.coalesce(F.sum(F.size("errors").cast("bigint")), F.lit(0).cast("bigint")).alias("n_errors"),
    )


def error_histogram(validated: DataFrame) -> DataFrame:
    """How often each (path, code) occurs."""
    return (
        validated.select(F.inline("errors"))
        .groupBy("path", "code")
        .agg(F.count("*").alias("n"))
    )


def all_or_nothing(validated: DataFrame) -> DataFrame:
    """All rows if every row is valid, none otherwise.

    The gate is a scalar subquery, so the rows themselves are not shuffled.
    """
    broken = validated.where(~F.col("is_valid")).agg(F.count("*").alias("n"))
    return validated.where(broken.scalar() == 0)


def with_gate(validated: DataFrame) -> DataFrame:
    """Every row with its own result and the decision for the whole batch."""
    broken = validated.where(~F.col("is_valid")).agg(F.count("*").alias("n"))
    return validated.withColumn("batch_valid", broken.scalar() == 0)


def error_text(errors: Column) -> Column:
    """Errors as one readable line, for reports and comparisons."""
    return F.concat_ws("; ", F.transform(errors, lambda e: F.concat_ws("|", e["path"], e["code"], e["message"])))

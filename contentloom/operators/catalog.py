"""Bulk work on model definitions: lint, field catalog, conversion, export, migration.

Definitions are JSON, one per row. Conversions rewrite each definition inside its
row; before that the rows are dealt over all cores.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from contentloom.functions import payload as P
from contentloom.operators.hierarchy import MODEL_TYPES
from contentloom.operators.validation import error, errors_array, once


def _parsed(df: DataFrame, column: str = "definition") -> DataFrame:
    return df.withColumn("__d", P.safe_json(F.col(column)))


def _spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores: a file of short definitions has few splits, but each row is long work."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "name", "definition")


def _entries(v: Column) -> Column:
    return F.coalesce(F.map_entries(P.as_map(v)), F.array().cast("array<struct<key:string,value:variant>>"))


def _names(v: Column) -> Column:
    return F.coalesce(F.transform(P.as_list(v), lambda e: P.as_text(e)), F.array().cast("array<string>"))


def _table_name(d: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(P.get_text(d, "table_name"), F.lit("")), F.lower(name))


# A field of a definition; values of another shape read as NULL.
FIELDS = "map<string,struct<type:string,required:boolean,primary_key:boolean,primary:boolean,default:variant,description:string,args:struct<default:variant,description:string>>>"


def field_catalog(df: DataFrame) -> DataFrame:
    """Fields of all definitions, one row each; fields come in sorted order.

    ``default`` is JSON text. Both places a definition may keep its default are read.
    """
    fields = F.try_variant_get(F.col("__d"), P.json_path("fields"), FIELDS)
    rows = _parsed(df).select(
        F.col("name").alias("model"), _table_name(F.col("__d"), F.col("name")).alias("table_name"), F.posexplode(F.map_entries(fields)).alias("pos", "e"),
    )
    d = F.col("e.value")
    inner, outer = d["args"]["default"], d["default"]
    default = F.when(P.present(inner), inner).otherwise(F.coalesce(outer, inner))
    flag = lambda key: F.coalesce(d[key], F.lit(False))
    return rows.select(
        "model", "table_name", F.col("e.key").alias("field"), "pos",
        F.coalesce(d["type"], F.lit("Any")).alias("type"),
        F.coalesce(d["required"], F.lit(True)).alias("required"),
        (default.isNotNull() & ~F.coalesce(F.is_variant_null(default), F.lit(True))).alias("has_default"),
        F.when(P.present(default), F.to_json(default)).alias("default"),
        F.coalesce(d["args"]["description"], d["description"], F.lit("")).alias("description"),
        (flag("primary_key") | flag("primary") | (F.col("e.key") == "id")).alias("primary_key"),
    )


def lint(df: DataFrame) -> DataFrame:
    """Check the structure of stored definitions; appends ``errors`` and ``is_valid``."""
    d = F.col("__d")
    fields, validators, contract = P.get(d, "fields"), P.get(d, "validators"), P.get(d, "metadata_schema")
    is_object = lambda v: P.as_map(v).isNotNull()
    not_object = lambda v: v.isNotNull() & ~is_object(v)
    need = F.array_except(F.array(F.lit("name"), F.lit("fields")), F.coalesce(F.map_keys(P.as_map(d)), F.array().cast("array<string>")))
    first = lambda found: F.get(F.filter(found, lambda e: e.isNotNull()), F.lit(0))
    field_fault = first(F.transform(_entries(fields), lambda e: F.when(
        ~is_object(e["value"]), F.concat(F.lit("Field definition for '"), e["key"], F.lit("' must be a dictionary"))
    ).when(P.get(e["value"], "type").isNull(), F.concat(F.lit("Missing required keys in field '"), e["key"], F.lit("': type")))))
    # The keys every validator needs.
    validator_fault = first(F.transform(P.as_list(validators), lambda v: F.when(
        ~is_object(v), F.lit("Each validator must be a dictionary")
    ).otherwise(F.coalesce(*[F.when(P.get(v, k).isNull(), F.lit(f"Each validator must have a '{k}' key")) for k in ("name", "fields", "code")]))))
    known = F.coalesce(F.col("object_type").isin(*MODEL_TYPES), F.lit(False))
    checks = errors_array(
        error("object_type", F.when(~known, F.concat(F.lit("Invalid model type: "), F.coalesce("object_type", F.lit("null"))))),
        error("", F.when(d.isNull(), F.lit("definition is not valid JSON"))),
        error("", F.when(d.isNotNull() & (F.size(need) > 0), F.concat(F.lit("Missing required keys in model definition: "), F.concat_ws(", ", need)))),
        error("fields", F.when(not_object(fields), F.lit("'fields' must be a dictionary")).otherwise(field_fault)),
        error("validators", F.when(validators.isNotNull() & P.as_list(validators).isNull(), F.lit("'validators' must be a list")).otherwise(validator_fault)),
        error("metadata_schema", F.when(not_object(contract), F.lit("'metadata_schema' must be a dictionary"))),
    )
    out = once(_parsed(df), errors=checks)
    return out.select(*df.columns, "errors", (F.size("errors") == 0).alias("is_valid"))


# Levels of nested items that one cast reads; what lies deeper stays JSON and is read by the next one.
LEVELS = 4
# A property and its nested items; values of another shape read as NULL.
ITEMS = reduce(lambda inner, _: f"struct<type:string,format:string,items:{inner}>", range(LEVELS), "variant")
PROPERTIES = "map<string,struct<type:string,format:string,description:string,default:variant,items:variant>>"


def _properties(d: Column) -> Column:
    """The properties of a JSON Schema as entries, in sorted order; no property is copied for its parts."""
    found = F.map_entries(F.try_variant_get(d, P.json_path("properties"), PROPERTIES))
    return F.coalesce(found, F.array().cast("array<struct<key:string,value:" + PROPERTIES[len("map<string,"):-1] + ">>"))


def model_type(prop: Column) -> Column:
    """Model type of a JSON Schema property of ``_properties``; arrays nest to any depth.

    Arrays whose items are absent or no object are lists of anything.
    """
    state = lambda kind, form, depth, rest: F.struct(kind.alias("type"), form.alias("format"), depth.alias("depth"), rest.alias("rest"))
    nothing = F.lit(None).cast("variant")
    is_list = lambda kind: F.coalesce(kind == "array", F.lit(False))

    def inner(a: Column, v: Column, level: int = 1) -> Column:
        """The state ``level`` items further down than ``a``, ``v`` being those items."""
        here = F.lit(level) + a["depth"]
        if level == LEVELS:
            return state(v["type"], v["format"], here, F.when(is_list(v["type"]), v["items"]))
        ends = ~is_list(v["type"]) | v["items"].isNull()
        return F.when(ends, state(v["type"], v["format"], here, nothing)).otherwise(inner(a, v["items"], level + 1))

    def down(a: Column, _: Column) -> Column:
        deeper = lambda v: F.when(v.isNotNull(), inner(a, v)).otherwise(state(a["type"], a["format"], a["depth"], nothing))
        return F.when(a["rest"].isNull(), a).otherwise(P.let(F.try_variant_get(a["rest"], "$", ITEMS), deeper))

    start = state(prop["type"], prop["format"], F.lit(0), F.when(is_list(prop["type"]), prop["items"]))

    # As many steps as there can be items in the text, LEVELS at a time.
    steps = F.sequence(F.lit(0), F.floor((F.size(F.split(F.to_json(prop["items"]), '"items"')) - 1) / LEVELS).cast("int"))
    walked = F.when(is_list(prop["type"]) & prop["items"].isNotNull(), F.aggregate(steps, start, down)).otherwise(start)

    def text(a: Column) -> Column:
        kind = a["type"]
        leaf = (
            F.when((kind == "string") & F.coalesce(a["format"] == "date-time", F.lit(False)), "datetime")
            .when(kind == "string", "str").when(kind == "number", "float").when(kind == "integer", "int")
            .when(kind == "boolean", "bool").when(kind == "null", "None").when(kind == "array", "List[Any]")
            .when(kind == "object", "Dict[str, Any]").otherwise("Any")
        )
        return F.concat(F.repeat(F.lit("List["), a["depth"]), leaf, F.repeat(F.lit("]"), a["depth"]))

    return P.let(walked, text)


def from_json_schema(df: DataFrame) -> DataFrame:
    """JSON Schemas to a field catalog (model, field, pos, type, required, default, description)."""
    d = F.col("__d")
    read = once(_parsed(_spread(df)), __model=F.coalesce("name", P.get_text(d, "title"), F.lit("UnnamedModel")), __required=_names(P.get(d, "required")), __properties=_properties(d))
    rows = read.select(F.col("__model").alias("model"), "__required", F.posexplode("__properties").alias("pos", "e"))
    prop = F.col("e.value")
    typed = once(rows, type=model_type(prop))
    return typed.select(
        "model", F.col("e.key").alias("field"), "pos", "type",
        F.array_contains("__required", F.col("e.key")).alias("required"),
        F.when(P.present(prop["default"]), F.to_json(prop["default"])).alias("default"),
        F.coalesce(prop["description"], F.lit("")).alias("description"),
    )


def json_schema_type(model_type_text: Column) -> Column:
    """JSON Schema type of a model type."""
    # Scalar types; lists are arrays and anything else is an object.
    scalar = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "None": "null", "datetime": "string"}
    pairs = F.create_map(*[F.lit(x) for kv in scalar.items() for x in kv])
    return F.coalesce(F.element_at(pairs, model_type_text), F.when(model_type_text.rlike(r"^List\[.*\]"), "array"), F.lit("object"))


def to_json_schema(df: DataFrame) -> DataFrame:
    """Stored definitions to JSON Schema documents (name, json_schema)."""
    d = F.col("__d")
    text = lambda v: F.coalesce(P.get_text(v, "type"), F.lit("Any"))
    entries = _entries(P.get(d, "fields"))
    properties = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], F.struct(
        json_schema_type(text(e["value"])).alias("type"),
        F.when(text(e["value"]) == "datetime", "date-time").alias("format"),
        F.nullif(P.get_text(e["value"], "args", "description"), F.lit("")).alias("description"),
        F.when(P.present(P.get(e["value"], "args", "default")), P.get(e["value"], "args", "default")).alias("default"),
    ))))
    needed = F.filter(entries, lambda e: F.coalesce(F.try_variant_get(e["value"], "$.required", "boolean"), F.lit(True)))
    title = F.coalesce(P.get_text(d, "model_name"), P.get_text(d, "name"), F.lit("UnnamedModel"))
    document = F.to_json(F.struct(
        title.alias("title"), F.lit("object").alias("type"), properties.alias("properties"),
        F.transform(needed, lambda e: e["key"]).alias("required"),
    ))
    return _parsed(df).where(d.isNotNull()).select("name", document.alias("json_schema"))


def export(df: DataFrame) -> DataFrame:
    """The export document of every definition (name, document).

    A field counts as required only where the definition says so. Defaults are
    kept if they are scalars.
    """
    d = F.col("__d")

    def scalar_default(v: Column) -> Column:
        c = P.get(v, "args", "default")
        return F.when(P.present(c) & P.as_map(c).isNull() & P.as_list(c).isNull(), c)

    fields = F.map_from_entries(F.transform(_entries(P.get(d, "fields")), lambda e: F.struct(e["key"], F.struct(
        F.coalesce(P.get_text(e["value"], "type"), F.lit("Any")).alias("type"),
        F.coalesce(F.try_variant_get(e["value"], "$.required", "boolean"), F.lit(False)).alias("required"),
        F.coalesce(P.get_text(e["value"], "args", "description"), F.lit("")).alias("description"),
        scalar_default(e["value"]).alias("default"),
    ))))
    document = F.to_json(F.struct(F.coalesce(P.get_text(d, "model_name"), F.col("name")).alias("model_name"), fields.alias("fields")))
    return _parsed(df).where(d.isNotNull()).select("name", document.alias("document"))


def export_named(df: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Export documents of the requested names, and the names that have none."""
    wanted = names.select("name").distinct()
    documents = export(df.join(wanted, "name", "left_semi"))
    return documents, wanted.join(df.where(P.safe_json(F.col("definition")).isNotNull()).select("name"), "name", "left_anti")


def export_json(df: DataFrame, names: DataFrame) -> DataFrame:
    """As export_named, raising if no requested name can be exported at all."""
    documents, failed = export_named(df, names)
    if documents.isEmpty() and not failed.isEmpty():
        raise ValueError("no requested model could be exported")
    return documents


def list_definitions(df: DataFrame, timestamps: bool = False) -> DataFrame:
    """Definitions by name; times are given as text."""
    times = [F.col(c).cast("string").alias(c) for c in ("created_at", "updated_at")] if timestamps else []
    return df.select("id", "name", "description", "object_type", "version", *times).orderBy("name", "id")


def model_names(registered: DataFrame, stored: DataFrame) -> DataFrame:
    """Names known to the registry or stored in the table."""
    return registered.select("name").union(stored.select("name")).distinct()


def by_name(df: DataFrame, name: str | None = None, prefix: str | None = None) -> DataFrame:
    if name is not None:
        df = df.where(F.col("name") == name)
    return df if prefix is None else df.where(F.col("name").startswith(prefix))


def counts(df: DataFrame) -> DataFrame:
    """Fields and validators per model."""
    d = F.col("__d")
    size = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    return _parsed(df).select(
        "name", size(P.as_map(P.get(d, "fields"))).alias("n_fields"), size(P.as_list(P.get(d, "validators"))).alias("n_validators")
    )


def _definition(name: Column, fields: Column, validators: Column) -> Column:
    return F.to_json(F.struct(
        name.alias("model_name"), F.lit("content").alias("model_type"), fields.alias("fields"), validators.alias("validators")
    ))


def migrate_a(df: DataFrame) -> DataFrame:
    """Definitions already in field form: keep fields and validators, set the type."""
    d = F.col("__d")
    fields = F.coalesce(P.get(d, "fields"), F.parse_json(F.lit("{}")))
    validators = F.coalesce(P.get(d, "validators"), F.parse_json(F.lit("[]")))
    return _parsed(_spread(df)).where(d.isNotNull()).select(
        "name", F.lit("content").alias("object_type"), _definition(F.col("name"), fields, validators).alias("definition")
    )


def migrate_b(df: DataFrame) -> DataFrame:
    """JSON Schemas of several namespaces: convert the properties, key by namespace and name."""
    d = F.col("__d")
    needed = _names(P.get(d, "required"))
    entries = lambda names: F.map_from_entries(F.transform(_properties(d), lambda e: F.struct(e["key"], F.struct(
        e["key"].alias("name"), model_type(e["value"]).alias("type"), F.array_contains(names, e["key"]).alias("required"),
        F.struct(e["value"]["default"].alias("default"), F.coalesce(e["value"]["description"], F.lit("")).alias("description")).alias("args"),
    ))))
    fields = P.let(needed, entries)
    return _parsed(_spread(df)).where(d.isNotNull()).select(
        F.concat_ws("_", "source_schema", "name").alias("name"), F.lit("content").alias("object_type"),
        _definition(F.col("name"), fields, F.array().cast("array<string>")).alias("definition"),
    )


# Namespaces that hold no definitions of their own.
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast")


def read_legacy(inputs: Sequence[tuple[str, DataFrame]], skipped: Sequence[str] = SYSTEM_SCHEMAS) -> DataFrame:
    """Definitions of many namespaces as one table with their ``source_schema``.

    The namespaces in ``skipped`` and inputs that are no definition tables are left out.
    """
    kept = [
        df.select("name", "definition", F.lit(schema).alias("source_schema"))
        for schema, df in inputs
        if schema not in skipped and {"name", "definition"} <= set(df.columns)
    ]
    if not kept:
        raise ValueError("no namespace holds model definitions")
    out = kept[0]
    for df in kept[1:]:
        out = out.unionByName(df)
    return out

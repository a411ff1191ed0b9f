"""Model definitions: the metadata-sized driver-side view of one stored model."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from contentloom.functions import rules as R
from contentloom.functions.typespec import TypeSpec, parse_type


@dataclass(frozen=True)
class FieldDef:
    name: str
    type: str = "Any"
    required: bool = True
    default: Any = None
    has_default_key: bool = False
    description: str = ""
    primary_key: bool = False
    # Keys that lead to a nested field; a plain name is one key, dots included.
    keys: tuple[str, ...] = ()

    @property
    def path(self) -> tuple[str, ...]:
        return self.keys or (self.name,)

    @property
    def spec(self) -> TypeSpec:
        return parse_type(self.type)

    @staticmethod
    def read(name: str, d: dict[str, Any]) -> "FieldDef":
        args = d.get("args") or {}
        default = args.get("default")
        return FieldDef(
            name=name,
            type=d.get("type", "Any"),
            required=bool(d.get("required", True)),
            default=d.get("default") if default is None else default,
            has_default_key="default" in args,
            description=args.get("description") or d.get("description") or "",
            primary_key=bool(d.get("primary_key") or d.get("primary") or name == "id"),
        )


@dataclass(frozen=True)
class Model:
    name: str
    fields: tuple[FieldDef, ...] = ()
    rules: tuple[R.Rule, ...] = ()
    table_name: str = ""
    object_type: str = ""
    metadata_required: tuple[str, ...] = ()
    metadata_recommended: tuple[str, ...] = ()

    @staticmethod
    def read(definition: dict[str, Any] | str, name: str | None = None) -> "Model":
        """Read a stored definition.

        Validators are rules by name: ``{"rule": "not_blank", "with": {...}}``
        for a built-in one or ``{"name": ...}`` for a registered one. Program
        text stored in a definition is never run.
        """
        d = json.loads(definition) if isinstance(definition, str) else definition
        title = name or d.get("model_name") or d.get("name") or "UnnamedModel"
        found = []
        for item in d.get("validators") or []:
            if item.get("rule") in R.BUILDERS:
                found.append(R.BUILDERS[item["rule"]](**item.get("with", {})))
            elif R.registered(item.get("name", "")):
                found.append(R.registered(item["name"]))
        contract = d.get("metadata_schema") or {}
        return Model(
            name=title,
            fields=tuple(FieldDef.read(k, v) for k, v in (d.get("fields") or {}).items()),
            rules=tuple(found),
            table_name=d.get("table_name") or title.lower(),
            object_type=d.get("object_type") or "",
            metadata_required=tuple(contract.get("required") or ()),
            metadata_recommended=tuple(contract.get("recommended") or ()),
        )

    def with_rules(self, *more: R.Rule) -> "Model":
        return Model(**{**self.__dict__, "rules": self.rules + more})


def model(name: str, rules: tuple[R.Rule, ...] = (), **fields: str) -> Model:
    """A model in one line: ``model("Post", title="str", tags="Optional[List[str]]?")``.

    A type that ends in ``?`` makes the field optional.
    """
    defs = tuple(FieldDef(n, t.rstrip("?"), required=not t.endswith("?")) for n, t in fields.items())
    return Model(name, defs, rules, name.lower())


def _type_text(t: T.DataType) -> str:
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "str"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, T.NullType):
        return "None"
    if isinstance(t, T.ArrayType):
        return f"List[{_type_text(t.elementType)}]"
    if isinstance(t, T.MapType):
        return f"Dict[{_type_text(t.keyType)}, {_type_text(t.valueType)}]"
    if isinstance(t, T.StructType):
        return "Dict[str, Any]"
    return "Any"


def from_struct(schema: T.StructType, name: str) -> Model:
    """The model of a typed class, given as a Spark schema.

    Nested structs contribute their own fields under dotted names; nullable
    columns become optional.
    """
    found: list[FieldDef] = []

    def walk(s: T.StructType, keys: tuple[str, ...], needed: bool) -> None:
        for f in s.fields:
            text = _type_text(f.dataType)
            must = needed and not f.nullable
            nested = isinstance(f.dataType, T.StructType)
            path = (*keys, f.name)
            found.append(FieldDef(".".join(path), text if not f.nullable else f"Optional[{text}]", required=must, primary_key=path == ("id",), keys=path))
            if nested:
                walk(f.dataType, path, must)

    walk(schema, (), True)
    return Model(name, tuple(found), table_name=name.lower())


# Spark types of the scalar model types.
SPARK_TYPES = {
    "str": "string", "string": "string", "int": "bigint", "float": "double", "bool": "boolean",
    "datetime": "timestamp_ntz", "date": "date", "UUID": "string", "uuid": "string", "json": "string",
    "dict": "string", "list": "string", "None": "void", "none": "void",
}


def spark_type(text: str) -> str:
    """The Spark DDL type of a model type; open-ended types stay JSON text."""
    if text in SPARK_TYPES:
        return SPARK_TYPES[text]

    def of(spec: TypeSpec) -> str:
        if spec.kind == "list":
            return f"array<{of(spec.args[0])}>"
        if spec.kind == "dict":
            return f"map<string,{of(spec.args[1])}>"
        if spec.kind == "optional":
            return of(spec.args[0])
        if spec.kind in ("any", "union", "unsupported"):
            return SPARK_TYPES.get(spec.text, "string")
        return SPARK_TYPES["None" if spec.kind == "none" else spec.kind]

    return of(parse_type(text))


def ddl_for(m: Model) -> str:
    """Column list for CREATE TABLE, with NOT NULL for required fields."""
    return ", ".join(f"`{f.name}` {spark_type(f.type)}{' NOT NULL' if f.required else ''}" for f in m.fields if len(f.path) == 1)


def struct_for(m: Model) -> T.StructType:
    """The Spark schema of a model; void columns are not storable and read as text."""
    return T.StructType([
        T.StructField(f.name, T._parse_datatype_string(spark_type(f.type).replace("void", "string")), not f.required)
        for f in m.fields if len(f.path) == 1
    ])

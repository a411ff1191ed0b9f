"""Model type strings such as ``Dict[str, List[int]]`` compiled to Spark columns.

The type string is parsed once per model on the driver. ``check`` turns the
parsed type into a column that is NULL for a valid value and holds the error
text otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from contentloom.functions import payload as P

# The scalar type names of the model language.
SCALARS = ("str", "int", "float", "bool", "datetime", "None", "none", "Any", "any")
# The container type names.
CONTAINERS = ("List", "Dict", "Union", "Optional")
# Names for a container without item types.
BARE = {"List": "List[Any]", "list": "List[Any]", "Dict": "Dict[str, Any]", "dict": "Dict[str, Any]"}
# Type names in error texts.
EXPECTED = {
    "str": "expected string",
    "int": "expected integer",
    "float": "expected number",
    "bool": "expected boolean",
    "none": "expected None",
    "datetime": "expected datetime or ISO format string",
    "list": "expected list",
    "dict": "expected dictionary",
}

# A date, then possibly hours, minutes, seconds with a fraction, and an offset.
ISO_FORM = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}:\d{2}(:\d{2})?)?)?$"


@dataclass(frozen=True)
class TypeSpec:
    """A parsed type: its kind, its type arguments and the text it came from."""

    kind: str
    args: tuple["TypeSpec", ...] = ()
    text: str = ""


def split_args(text: str) -> list[str]:
    """Split at the commas outside all brackets."""
    parts, depth, current = [], 0, ""
    for ch in text:
        depth += (ch == "[") - (ch == "]")
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [p.strip() for p in [*parts, current]]


def parse_type(text: str) -> TypeSpec:
    """Parse a type string; anything outside the language becomes ``unsupported``."""
    text = text.strip()
    text = BARE.get(text, text)
    if text in SCALARS:
        return TypeSpec(text.lower() if text in ("None", "Any") else text, (), text)
    head, bracket, rest = text.partition("[")
    if not bracket or head not in CONTAINERS or not rest.endswith("]"):
        return TypeSpec("unsupported", (), text)
    args = tuple(parse_type(a) for a in split_args(rest[:-1]))
    wanted = {"List": 1, "Dict": 2, "Optional": 1}.get(head)
    if wanted is not None and len(args) != wanted:
        return TypeSpec("unsupported", (), text)
    return TypeSpec(head.lower(), args, text)


def value_type(v: Column) -> Column:
    """The Python name of a JSON value's type, as error texts give it."""
    s = F.schema_of_variant(v)
    whole = s.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    return (
        F.when(s == "STRING", "str")
        .when((s == "BIGINT") | whole, "int")
        .when(s == "BOOLEAN", "bool")
        .when(s == "VOID", "NoneType")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "float")
        .when(s.startswith("ARRAY"), "list")
        .otherwise("dict")
    )


def is_iso_datetime(text: Column) -> Column:
    """ISO dates with an optional time; bare years and bare times do not count."""
    return text.rlike(ISO_FORM) & text.try_cast("timestamp").isNotNull()


def _unless(ok: Column, kind: str, got: Column) -> Column:
    return F.when(~ok, F.concat(F.lit(EXPECTED[kind] + ", got "), got))


def check(v: Column, spec: TypeSpec) -> Column:
    """Error text of a VARIANT value against a type, NULL if it is valid."""
    kind = spec.kind
    if kind == "any":
        return F.lit(None).cast("string")
    if kind == "unsupported":
        return F.lit(f"unsupported type: {spec.text}")
    if kind == "optional":
        return F.when(~F.is_variant_null(v), check(v, spec.args[0]))
    if kind == "union":
        # concat is NULL as soon as one member reports no error
        errors = [check(v, a) for a in spec.args]
        joined = [c for e in errors for c in (F.lit(", "), e)][1:]
        return F.concat(F.lit("value did not match any of the expected types: "), *joined)
    got = value_type(v)
    if kind == "list":
        items = P.as_list(v)
        if spec.args[0].kind == "any":
            return F.when(items.isNull(), F.concat(F.lit(EXPECTED[kind] + ", got "), got))
        found = F.transform(
            items,
            lambda e, i: F.concat(F.lit("invalid item at index "), i.cast("string"), F.lit(": "), check(e, spec.args[0])),
        )
        return F.when(items.isNull(), F.concat(F.lit(EXPECTED[kind] + ", got "), got)).otherwise(_first(found))
    if kind == "dict":
        key_spec, value_spec = spec.args
        if key_spec.kind in ("str", "any") and value_spec.kind == "any":
            return F.when(P.as_map(v).isNull(), F.concat(F.lit(EXPECTED[kind] + ", got "), got))
        entries = F.map_entries(P.as_map(v))
        found = F.transform(
            entries,
            lambda e: F.coalesce(
                F.concat(F.lit("invalid key: "), check_key(e["key"], key_spec)),
                F.concat(F.lit("invalid value for key '"), e["key"], F.lit("': "), check(e["value"], value_spec)),
            ),
        )
        return F.when(entries.isNull(), F.concat(F.lit(EXPECTED[kind] + ", got "), got)).otherwise(_first(found))
    if kind == "datetime":
        text = P.as_text(v)
        return F.when(got != "str", F.concat(F.lit(EXPECTED[kind] + ", got "), got)).when(
            ~is_iso_datetime(text), F.lit("invalid datetime format")
        )
    # The value types each scalar type accepts.
    accepted = {"str": ["str"], "int": ["int"], "float": ["int", "float"], "bool": ["bool"], "none": ["NoneType"]}
    return _unless(got.isin(accepted[kind]), kind, got)


def check_key(key: Column, spec: TypeSpec) -> Column:
    """Error text of an object key, which JSON always makes a string."""
    kind = spec.kind
    if kind in ("str", "any"):
        return F.lit(None).cast("string")
    if kind == "unsupported":
        return F.lit(f"unsupported type: {spec.text}")
    if kind == "optional":
        return check_key(key, spec.args[0])
    if kind == "union":
        errors = [check_key(key, a) for a in spec.args]
        joined = [c for e in errors for c in (F.lit(", "), e)][1:]
        return F.concat(F.lit("value did not match any of the expected types: "), *joined)
    if kind == "datetime":
        return F.when(~is_iso_datetime(key), F.lit("invalid datetime format"))
    return F.lit(f"{EXPECTED[kind]}, got str")


def _first(errors: Column) -> Column:
    return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))

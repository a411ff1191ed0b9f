"""JSON payload columns: parsing, extraction and canonical text.

Payloads are strings at rest. Inside a query they are parsed once to VARIANT,
which tells an absent key (SQL NULL) from a JSON null. VARIANT cannot be a
shuffle key, so operators drop it before any grouping.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

ANY_MAP = "map<string,variant>"
ANY_LIST = "array<variant>"


def json_path(*keys: str) -> str:
    """A JSON path that reads the keys literally, dots and blanks included."""
    parts = []
    for key in keys:
        quote = '"' if "'" in key else "'"
        if quote in key:
            raise ValueError(f"a field name may not hold both kinds of quotes: {key!r}")
        parts.append(f"[{quote}{key}{quote}]")
    return "$" + "".join(parts)


def safe_json(text: Column) -> Column:
    """Parse JSON text; malformed text becomes NULL."""
    return F.try_parse_json(text)


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys: equal payloads give equal text."""
    return F.to_json(F.try_parse_json(text))


def get(v: Column, *keys: str) -> Column:
    """The value below the keys as VARIANT; NULL only if it is absent."""
    return F.try_variant_get(v, json_path(*keys), "variant")


def get_text(v: Column, *keys: str) -> Column:
    """The value below the keys as text; containers give their JSON."""
    return F.try_variant_get(v, json_path(*keys), "string")


def get_int(v: Column, *keys: str) -> Column:
    return F.try_variant_get(v, json_path(*keys), "int")


def as_list(v: Column) -> Column:
    """The elements of a JSON array, NULL for anything else."""
    return F.try_variant_get(v, "$", ANY_LIST)


def as_map(v: Column) -> Column:
    """The entries of a JSON object, NULL for anything else."""
    return F.try_variant_get(v, "$", ANY_MAP)


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def json_text(text: Column, *keys: str) -> Column:
    """Extract one value as text straight from JSON text."""
    return F.get_json_object(text, json_path(*keys))


def json_int(text: Column, *keys: str) -> Column:
    """Extract one value as an integer; text that holds digits counts, junk is NULL."""
    return get_int(safe_json(text), *keys)


def is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def present(v: Column) -> Column:
    """True if the value is there and is not JSON null."""
    return v.isNotNull() & ~F.is_variant_null(v)


def contains_ref(refs: Column, ref_id: str | Column) -> Column:
    """True if a JSON array of objects holds one whose id equals ref_id."""
    wanted = F.lit(ref_id) if isinstance(ref_id, str) else ref_id
    hit = F.exists(
        as_list(refs),
        lambda r: is_text(get(r, "id")) & (get_text(r, "id") == wanted),
    )
    return F.coalesce(hit, F.lit(False))


def quoted(text: Column) -> Column:
    """A string as a JSON string literal, NULL for NULL."""
    inner = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(inner, F.lit(2), F.length(inner) - 2))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge_object(text: Column, changes: dict[str, Column], keep: frozenset[str] = frozenset()) -> Column:
    """JSON object text with keys set to new JSON values.

    A NULL change leaves its key alone. Keys in ``keep`` are only set where the
    object does not hold them yet. The result is canonical JSON.
    """
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(ANY_LIST))
    base = F.coalesce(as_map(safe_json(text)), nothing)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.try_parse_json(c).alias("value")) for k, c in changes.items()])
    fixed = [k for k in changes if k in keep]

    def applies(m: Column, e: Column) -> Column:
        given = e["value"].isNotNull()
        return given & ~(e["key"].isin(fixed) & F.map_contains_key(m, e["key"])) if fixed else given

    def merged(m: Column, added: Column) -> Column:
        return let(F.transform(added, lambda e: e["key"]), lambda names: F.map_concat(
            F.map_filter(m, lambda k, _: ~F.array_contains(names, k)), F.map_from_entries(added)
        ))

    return F.to_json(let(base, lambda m: let(F.filter(entries, lambda e: applies(m, e)), lambda added: merged(m, added))))

"""Declarative validation rules on parsed records.

A rule is a named condition that marks a record as broken. It sees the record
through ``Record``, which hands out fields as columns. Users add their own with
``register``: a function from Record to Column, or a Spark SQL condition.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from contentloom.functions import payload as P


# The column that holds the parsed record while rules run.
RECORD = "__record"


@dataclass(frozen=True)
class Record:
    """Field access on a VARIANT column that holds one record."""

    v: Column

    def get(self, name: str) -> Column:
        return P.get(self.v, *name.split("."))

    def text(self, name: str) -> Column:
        return P.get_text(self.v, *name.split("."))

    def number(self, name: str) -> Column:
        return F.try_variant_get(self.v, P.json_path(*name.split(".")), "double")


@dataclass(frozen=True)
class Rule:
    """``broken(record)`` is true for records that violate the rule."""

    name: str
    fields: tuple[str, ...]
    broken: Callable[[Record], Column]
    message: str | Callable[[Record], Column]
    path: str = ""

    def error(self, record: Record) -> Column:
        """The error text, NULL for records that keep the rule."""
        text = F.lit(self.message) if isinstance(self.message, str) else self.message(record)
        full = text if self.path else F.concat(F.lit(f"Validator {self.name} failed: "), text)
        return F.when(self.broken(record), full)


def not_blank(field: str, message: str | None = None) -> Rule:
    """The text is not empty after trimming white space."""
    return Rule(
        f"{field}_not_empty", (field,),
        lambda r: F.regexp_replace(r.text(field), r"^\s+|\s+$", "") == "",
        message or f"{field} cannot be empty",
    )


def length_between(field: str, low: int | None = None, high: int | None = None) -> Rule:
    def broken(r: Record) -> Column:
        size = F.char_length(r.text(field))
        bad = F.lit(False)
        if low is not None:
            bad = bad | (size < low)
        if high is not None:
            bad = bad | (size > high)
        return bad

    return Rule(f"{field}_length", (field,), broken, f"{field} must have {low or 0} to {'any number of' if high is None else high} characters")


def has_keys(field: str, keys: Sequence[str]) -> Rule:
    """The field is an object that holds all the keys."""

    def missing(r: Record) -> Column:
        held = F.coalesce(F.map_keys(P.as_map(r.get(field))), F.array().cast("array<string>"))
        return F.array_except(F.array(*map(F.lit, keys)), held)

    return Rule(
        f"{field}_keys", (field,),
        lambda r: r.get(field).isNotNull() & (F.size(missing(r)) > 0),
        lambda r: F.concat(F.lit(f"{field} lacks "), F.concat_ws(", ", missing(r))),
    )


def any_of(*fields: str) -> Rule:
    """At least one of the fields is there and not empty."""

    def filled(c: Column) -> Column:
        # Texts are empty only as ""; other values if they are an empty container, false or zero.
        return P.present(c) & F.when(P.is_text(c), P.as_text(c) != "").otherwise(~P.as_text(c).isin("{}", "[]", "false", "0"))

    def broken(r: Record) -> Column:
        some = F.lit(False)
        for f in fields:
            some = some | F.coalesce(filled(r.get(f)), F.lit(False))
        return ~some

    return Rule("any_of_" + "_".join(fields), fields, broken, "at least one must be given: " + ", ".join(fields))


def each_has_key(field: str, key: str) -> Rule:
    """The field is a non-empty list of objects that all hold the key."""

    def broken(r: Record) -> Column:
        items = P.as_list(r.get(field))
        whole = F.forall(items, lambda e: F.coalesce(P.get(e, key).isNotNull(), F.lit(False)))
        return r.get(field).isNotNull() & ~F.coalesce((F.size(items) > 0) & whole, F.lit(False))

    return Rule(f"{field}_items", (field,), broken, f"{field} must be a non-empty list of objects with {key}")


def one_of(field: str, values: Sequence[str]) -> Rule:
    return Rule(f"{field}_allowed", (field,), lambda r: ~r.text(field).isin(*values), f"{field} must be one of: " + ", ".join(values))


def pattern(field: str, regex: str) -> Rule:
    return Rule(f"{field}_pattern", (field,), lambda r: ~r.text(field).rlike(regex), f"{field} does not match the pattern")


def min_value(field: str, low: float) -> Rule:
    return Rule(f"{field}_minimum", (field,), lambda r: r.number(field) < low, f"{field} must be at least {low}")


# Text forms of the named formats.
FORMATS = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^ ]+$",
    "date-time": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$",
}


def format_is(field: str, name: str) -> Rule:
    return Rule(f"{field}_format", (field,), lambda r: ~r.text(field).rlike(FORMATS[name]), f"{field} is no {name}")


def contains_field(field: str, inside: str, message: str | None = None) -> Rule:
    """The text of one field occurs in the text of another."""
    return Rule(
        f"{field}_in_{inside}", (field, inside),
        lambda r: ~F.contains(r.text(inside), r.text(field)),
        message or f"{field} must be derived from {inside}",
        path=field,
    )


_REGISTERED: dict[str, Rule] = {}


def register(name: str, fields: Sequence[str], holds: Callable[[Record], Column] | str, message: str = "rule broken") -> Rule:
    """Add a rule under a name that model definitions can use.

    ``holds`` says when a record is fine: a function from Record to a boolean
    column, or a Spark SQL condition with field names in square brackets, such
    as ``[price] > 0 AND [currency] IS NOT NULL``. Bracketed fields read as text.
    """
    if isinstance(holds, str):
        condition = holds

        def keeps(r: Record) -> Column:
            return F.expr(re.sub(r"\[([^\]]+)\]", lambda m: f"try_variant_get({RECORD}, \"{P.json_path(*m[1].split('.'))}\", 'string')", condition))
    else:
        keeps = holds
    rule = Rule(name, tuple(fields), lambda r: ~F.coalesce(keeps(r), F.lit(False)), message)
    _REGISTERED[name] = rule
    return rule


def registered(name: str) -> Rule | None:
    return _REGISTERED.get(name)


# The parameters each named rule takes in a stored definition.
BUILDERS: dict[str, Callable[..., Rule]] = {
    "not_blank": not_blank,
    "length_between": length_between,
    "has_keys": has_keys,
    "any_of": any_of,
    "each_has_key": each_has_key,
    "one_of": one_of,
    "pattern": pattern,
    "min_value": min_value,
    "format_is": format_is,
    "contains_field": contains_field,
}

"""Registered queries: a Spark plan with the SQL that must give the same rows.

Texts of derived tables are written once for both engines. ``@name`` stands for a
table or another derived table; ``$TS`` and ``$OBJ`` for the spelling of a
timestamp type and of a JSON object constructor, ``$Q`` for the identifier quote.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The given tables.
BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
# Spellings that differ between the engines.
SPARK = {"$TS": "TIMESTAMP_NTZ", "$OBJ": "named_struct", "$SPLIT": "split", "$Q": "`"}
DUCK = {"$TS": "TIMESTAMP", "$OBJ": "json_object", "$SPLIT": "string_split", "$Q": '"'}
NAME = re.compile(r"@(\w+)")
DERIVED: dict[str, str] = {}
PLANS: dict[str, Callable[["Tables"], DataFrame]] = {}


@dataclass(frozen=True)
class Query:
    plan: Callable[["Tables"], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def _spell(text: str, words: dict[str, str]) -> str:
    for token, word in words.items():
        text = text.replace(token, word)
    return text


def derive(name: str, text: str, spark: Callable[["Tables"], DataFrame] | None = None) -> None:
    """Add a derived table, in SQL that both engines run unless a Spark plan is given."""
    DERIVED[name] = text
    if spark is not None:
        PLANS[name] = spark


def query(name: str, sql: str | None = None):
    """Register a plan under a name, with its SQL twin."""

    def add(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(plan, sql)
        return plan

    return add


class Tables:
    """The given and derived tables of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str, made: dict[str, DataFrame] | None = None):
        self.spark, self.folder, self._made = spark, folder, dict(made or {})

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(self.path(name))
            elif name in PLANS:
                self._made[name] = PLANS[name](self)
            elif name in DERIVED:
                self._made[name] = self.sql(DERIVED[name])
            else:
                raise AttributeError(name)
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        text = _spell(text, SPARK)
        used = {n: getattr(self, n) for n in NAME.findall(text)}
        escaped = text.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(NAME.sub(r"{\1}", escaped), **used)


def duck_sql(text: str) -> str:
    """The SQL twin with its derived tables as common table expressions."""
    found: dict[str, str] = {}

    def need(body: str) -> None:
        for n in NAME.findall(body):
            if n in DERIVED and n not in found:
                need(DERIVED[n])
                found[n] = DERIVED[n]

    need(text)
    spell = lambda s: NAME.sub(r"\1", _spell(s, DUCK))
    ctes = [f"{n} AS ({spell(b)})" for n, b in found.items()]
    own = spell(text).strip()
    if own.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*ctes, own[len("WITH RECURSIVE "):]])
    if own.upper().startswith("WITH "):
        return "WITH " + ", ".join([*ctes, own[len("WITH "):]])
    return (f"WITH {', '.join(ctes)} " if ctes else "") + own


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: q.plan(Tables(spark, folder))

    return {name: bind(q) for name, q in QUERIES.items()}


def oracle_queries() -> dict[str, str]:
    return {name: duck_sql(q.sql) for name, q in QUERIES.items() if q.sql is not None}

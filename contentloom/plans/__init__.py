"""Registered queries over the given tables, each with its SQL twin."""

from contentloom.plans import derived, graph, modelling, prompting, reading, validating, writing  # noqa: F401
from contentloom.plans.registry import oracle_queries as registered_sql, spark_queries as registered_queries  # noqa: F401

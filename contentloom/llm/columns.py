"""Columns of the input that have the names of an operator's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Names that operators use beside the columns of their input.
OWN = (
    "__of", "__t1", "__t2", "__places", "__list_id", "__list_t1", "__list_t2", "__n_words", "__n_lines", "__n_removed", "__spans", "__matches",
    "__n_best", "__scores", "__decoded", "__pieces",
)


def free(docs: DataFrame) -> DataFrame:
    """The table without columns of those names; operators that add columns replace them."""
    return docs.drop(*OWN)


def apart(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that an operator uses, and all others in one column ``row``, where no name can clash."""
    others = [c for c in docs.columns if c not in used]
    return docs.select(*used, *([F.struct(*others).alias("row")] if others else []))


def together(df: DataFrame, columns: list[str], *used: str) -> DataFrame:
    """The columns as they were before ``apart``."""
    return df.select(*[F.col(c) if c in used else F.col("row").getField(c).alias(c) for c in columns])

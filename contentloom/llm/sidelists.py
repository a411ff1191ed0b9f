"""Lists of places in texts, brought back to the texts.

Rows of a table are known by their id and, as an id may come twice, by a hash of 128
bits of the text. A null id counts as the largest one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

LAST = (1 << 63) - 1
# Lists up to this size are sent to the texts instead of shuffling the texts.
SEND_BYTES = 16 << 20
# What a row is known by; t1 and t2 are the hash of its text.
ROW = ["id", "t1", "t2"]


def hash_of(text: str = "text") -> dict:
    """The 128 bits of each text's hash, as two numbers of different seeds."""
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)}


def beside(docs: DataFrame, lists: DataFrame, key: str, how: str, hashes: dict | None = None) -> DataFrame:
    """The texts with their list in ``__places``, and ``__t1`` and ``__t2``. ``lists`` has one row for each id and text.

    Lists are sent to the texts if their counted size is below ``SEND_BYTES``; larger
    ones meet the texts in a shuffle by id and text. The rows are the same. ``hashes`` are those of the lists, if not the usual ones.
    """
    size = lists.agg(F.coalesce(F.sum(F.length("places") + 32), F.lit(0)).alias("n")).first()["n"]
    named_lists = lists.select(*[F.col(c).alias(f"__list_{c}") for c in ROW], F.col("places").alias("__places"))
    named = docs.withColumns({"__of": F.coalesce(F.col(key).cast("long"), F.lit(LAST))} | {f"__{c}": x for c, x in (hashes or hash_of()).items()})
    same = (F.col("__of") == F.col("__list_id")) & (F.col("__t1") == F.col("__list_t1")) & (F.col("__t2") == F.col("__list_t2"))
    return named.join(F.broadcast(named_lists) if size <= SEND_BYTES else named_lists.hint("shuffle_hash"), same, how)


def pairs_of(places: bytes | None) -> np.ndarray:
    """The pairs of a list."""
    return np.frombuffer(places or b"", np.int32).reshape(-1, 2)

"""Joins and reductions that stay balanced when one key holds a large share of the rows.

Adaptive execution splits the large partitions of a join by itself, but not where
the join's output partitioning is used again by a later grouping, and only if it
is enabled. The joins of the reference graph and the hierarchy, where popular
targets are the rule, therefore salt their heavy keys explicitly.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Rows of one key that one task may take.
TASK_ROWS = 1_000_000
# Groups of keys that are counted first; with as many rows as a key may have each, that is 65 billion rows.
BUCKETS = 1 << 16
# Words of 64 bits of a key filter. With 10 million keys about one row in ten that is not asked for passes.
FILTER_WORDS = 1 << 19
# Up to so many keys a plain join, which adaptive execution broadcasts, is cheaper than a filter.
FEW_KEYS = 100_000


def heavy_keys(df: DataFrame, keys: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Keys with more than ``task_rows`` rows and into how many parts, ``__parts``, each is cut.

    The threshold is absolute, so a key of half a percent of a very large table counts
    as heavy too. At most one key per ``task_rows`` rows can be heavy, so the list is a
    millionth of the table. Counts combine on the map side. Groups of keys are counted first, and keys one by one only in
    groups that have enough rows to hold a heavy one, mostly none, so the counts of all keys are not shuffled.
    """
    rows = df.select(*keys).dropna().withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    full = rows.groupBy("__bucket").agg(F.count("*").alias("n")).where(F.col("n") > task_rows).select("__bucket")
    counts = rows.join(F.broadcast(full), "__bucket", "left_semi").groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > task_rows).select(*keys, F.ceil(F.col("n") / task_rows).cast("bigint").alias("__parts"))


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "left",
    task_rows: int = TASK_ROWS, measure: DataFrame | None = None,
) -> DataFrame:
    """Equi-join of a skewed left side with a right side that has few rows per key.

    Rows of a heavy left key are spread over as many join keys as its rows need, by a
    hash of the ``spread`` columns, and the matching right rows are repeated that often.
    Rows with a NULL key match nothing and are spread as well. The hash is
    deterministic, so a task that runs again gives the same rows.

    Heavy keys are counted on ``measure``: a table with the key columns that the
    left side is made from and that is cheaper to read than it. Any choice gives
    the same result; it only decides which keys are spread.
    """
    on = list(on)
    hot = F.broadcast(heavy_keys(left if measure is None else measure, on, task_rows))
    return _salted(left, hot, on, spread).join(_repeated(right, hot, on), [*on, "__salt"], how).drop("__salt")


def _salted(left: DataFrame, hot: DataFrame, on: list[str], spread: Sequence[str]) -> DataFrame:
    unmatched = F.lit(False)
    for key in on:
        unmatched = unmatched | F.col(key).isNull()
    parts = F.when(unmatched, F.lit(1024)).otherwise(F.coalesce("__parts", F.lit(1))).cast("bigint")
    return left.join(hot, on, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), parts)).drop("__parts")


def _repeated(right: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    every = F.sequence(F.lit(0).cast("bigint"), F.coalesce("__parts", F.lit(1).cast("bigint")) - 1)
    return right.join(hot, on, "left").withColumn("__salt", F.explode(every)).drop("__parts")


@dataclass(frozen=True)
class Dealt:
    """Rows dealt by a key and ``__salt``, so that what groups or joins by both shuffles them no more."""

    rows: DataFrame
    hot: DataFrame
    on: list[str]

    def join(self, rows: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """Rows made from the dealt ones, with the key and ``__salt``, and a right side that has few rows per key."""
        return rows.join(_repeated(right, self.hot, self.on), [*self.on, "__salt"], how).drop("__salt")


def dealt_by(
    df: DataFrame, on: Sequence[str], spread: Sequence[str], task_rows: int = TASK_ROWS, measure: DataFrame | None = None,
) -> Dealt:
    """Deal a table by a skewed key, heavy keys cut into parts by a hash of ``spread`` as in ``salted_join``."""
    on = list(on)
    hot = F.broadcast(heavy_keys(df if measure is None else measure, on, task_rows))
    return Dealt(_salted(df, hot, on, spread).repartition(*on, "__salt"), hot, on)


def _filter(keys: DataFrame, on: str) -> DataFrame:
    """A Bloom filter of the keys: for each of ``FILTER_WORDS`` words its bits, two per key."""
    return keys.select(_word(on).alias("__word"), _bits(on).alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits"))


def _word(on: str) -> Column:
    return F.pmod(F.xxhash64(on), F.lit(FILTER_WORDS))


def _bits(on: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(`{on}`), 40) & 63 AS INT)) | shiftleft(1L, cast(shiftrightunsigned(xxhash64(`{on}`), 48) & 63 AS INT))")


def _flagged(rows: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    bits = F.broadcast(_filter(keys, on))
    return rows.join(bits, (_word(on) == bits["__word"]) & (bits["__bits"].bitwiseAND(_bits(on)) == _bits(on)), how)


def matching(rows: DataFrame, keys: DataFrame, on: str, spread: Sequence[str] = ()) -> DataFrame:
    """The rows whose key ``on`` is among ``keys``, for many keys: a filter of at most 8 MB drops most others before the join, so they are not shuffled.

    With ``spread`` the join is salted.
    """
    near, known = _flagged(rows, keys, on, "left_semi"), keys.select(on).distinct()
    return salted_join(near, known, [on], spread, "left_semi") if spread else near.join(known, on, "left_semi")


def without(rows: DataFrame, keys: DataFrame, on: str, spread: Sequence[str] = ()) -> DataFrame:
    """The rows whose key ``on`` is not among ``keys``; only those that the filter takes for one of them are shuffled. Rows with a NULL key stay."""
    near, known = _flagged(rows, keys, on, "left_semi"), keys.select(on).distinct()
    kept = salted_join(near, known, [on], spread, "left_anti") if spread else near.join(known, on, "left_anti")
    return _flagged(rows, keys, on, "left_anti").unionByName(kept.select(*rows.columns))


def _rank(df: DataFrame, rest: Sequence[str], order: Sequence[str | Column]) -> Column:
    """The order, then every other column that can be compared."""
    more = [c for c in rest if c not in order and not re.search("map|variant", df.schema[c].dataType.simpleString())]
    return F.struct(*[c if isinstance(c, Column) else F.col(c) for c in [*order, *more]])


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per key that holds, field by field, the last value given in the order.

    For sparse changes: a later row that leaves a field NULL does not undo an earlier
    one. One aggregate, combined before the shuffle; equal orders go to the greater value.
    """
    given = lambda c: F.when(F.col(c).isNotNull(), F.struct(*order, c))
    return df.groupBy(*keys).agg(*[F.max_by(F.col(c), given(c)).alias(c) for c in fields])


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], last: bool = True) -> DataFrame:
    """One row per key: the last (or first) in the given order.

    An aggregate with map-side combine instead of a window: a hot key is reduced
    in every map task before the shuffle and no key's rows are sorted in one task.
    Rows of equal order are told apart by their other columns, so the choice does
    not depend on how rows arrive.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = _rank(df, rest, list(dict.fromkeys(order)))
    named = set(df.select(rank.alias("r")).schema["r"].dataType.names)
    # A column that ranks comes back out of the rank; only the others are carried beside it.
    beside = [c for c in rest if c not in named]
    if beside:
        choose = F.max_by if last else F.min_by
        best = df.groupBy(*keys).agg(choose(F.struct(rank.alias("r"), *beside), rank).alias("__row"))
        found = [F.col(f"__row.{c}" if c in beside else f"__row.r.{c}").alias(c) for c in rest]
    else:
        best = df.groupBy(*keys).agg((F.max if last else F.min)(rank).alias("__row"))
        found = [F.col(f"__row.{c}").alias(c) for c in rest]
    return best.select(*keys, *found).select(*df.columns)

"""Chat transcripts: roles by a hidden Markov model, then canonical turns.

A state is a role together with whether a line begins a turn or goes on with it. A line
shows a speaker marker or none, its length and whether it asks. Emissions and transitions
are counted over labelled transcripts in Spark; the counts are a few dozen rows.

Viterbi's algorithm is a chain of (max, +) matrix products, and those may be grouped at
will. A transcript is therefore cut into chunks of ``CHUNK`` lines. Lines get their numbers from ranges of
(conversation, place): counts within a range, plus those of the ranges before it, which at most two
conversations per range need. Each chunk of a longer transcript becomes one matrix, matrices are
multiplied level by level, and the best states at the borders are handed down again. Then
all chunks of a batch are decoded together, step by step. A turn that goes on over a border comes in parts, which
are put together by the line where it began. No task holds more than a few chunks, and a turn comes out whole.

Defined cases: null and empty texts are one empty line; each row without a conversation or a place is
a transcript of its own, also if others equal it; repeated rows follow each other; rows of one place are
ordered by the hash of their text; of equally likely states the first is taken; texts of any length count whole, a turn is one row;
an empty table gives no turns; other columns are not read, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from contentloom.session import materialize

# Lines of a chunk, and matrices multiplied in one group.
CHUNK, FAN = 1024, 64
ROLES = ("system", "user", "assistant")
# Names by which speakers are marked.
NAMES = {"system": ("system", "instruction", "instructions"), "user": ("user", "human", "question"), "assistant": ("assistant", "bot", "ai", "answer")}
MARKER = r"(?i)^\s*(?:(?:#{1,4}\s*|\*\*)?(NAMES)(?:\*\*)?\s*:\s*|(?:\[|<\|)(NAMES)(?:\]|\|>)\s*:?\s*|#{1,4}\s*(NAMES)\s*$)".replace("NAMES", "|".join(n for r in ROLES for n in NAMES[r]))
LENGTHS = 8
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
N = len(STATES)


@dataclass
class Model:
    """Logarithms: start, transition, and emission by marker, length and question."""

    start: np.ndarray
    step: np.ndarray
    marker: np.ndarray
    length: np.ndarray
    asks: np.ndarray

    def emission(self, marker: np.ndarray, length: np.ndarray, asks: np.ndarray) -> np.ndarray:
        return (self.marker[:, marker] + self.length[:, length] + self.asks[:, asks]).T


def _seen(line: Column) -> dict[str, Column]:
    """What the model sees of a line: marker, length and whether it asks."""
    found = F.when(line.rlike(MARKER), F.lower(F.concat(*[F.regexp_extract(line, MARKER, g) for g in (1, 2, 3)])))
    role: Column = F.lit(0)
    for i, r in enumerate(ROLES):
        role = F.when(found.isin(*NAMES[r]), i + 1).otherwise(role)
    size = F.least(F.lit(LENGTHS - 1), F.floor(F.log2(F.length(line) + 1) * 0.75)).cast("int")
    return {"marker": role, "length": size, "asks": line.rlike(r"\?\s*$").cast("int")}


def numbered(rows: DataFrame) -> DataFrame:
    """Rows ``key``, ``place``, ``text``, ... with ``before``, the lines of the key's rows before each; no key is gathered.

    A range of rows counts for itself; only keys that lie in several ranges, at most two for each
    range, need what came before it.
    """
    sized = rows.withColumns({"h": F.xxhash64("text"), "lines": F.size(F.split("text", "\n")).cast("long")})
    dealt = sized.repartitionByRange("key", "place", "h").sortWithinPartitions("key", "place", "h").withColumn("part", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, lines = batch.column("key").to_pylist(), batch.column("lines").to_numpy()
            new = np.array([a != b for a, b in zip(key, [last, *key[:-1]])])
            upto = np.cumsum(lines) - lines
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            start = np.where(first < 0, -total, upto[np.maximum(first, 0)])
            before = upto - start
            last, total = key[-1], int(before[-1] + lines[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], names=[*batch.schema.names, "before"])

    counted = materialize(dealt.mapInArrow(count, T.StructType([*dealt.schema.fields, T.StructField("before", T.LongType())])), "numbered")
    parts = counted.groupBy("key", "part").agg(F.sum("lines").alias("n"))
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Only one key can go on from a range to the next, so there are no more rows than ranges.
    starts = parts.withColumn("shift", F.sum("n").over(ahead)).where("shift > 0").select("key", "part", "shift")
    return counted.join(F.broadcast(starts), ["key", "part"], "left").withColumn("before", F.col("before") + F.coalesce("shift", F.lit(0)))


def lines_of(rows: DataFrame, conversation: str, place: str, text: str) -> DataFrame:
    """One row per line: transcript ``key``, line ``number`` and ``chunk``, place, line in the row, what the model sees of it, ``copies`` of the transcript."""
    body = F.coalesce(F.col(text), F.lit(""))
    whole = F.col(conversation).isNotNull() & F.col(place).isNotNull()
    kept = rows.where(whole).select(F.concat(F.lit("c"), F.col(conversation).cast("string")).alias("key"), F.col(conversation).alias("conv"), F.col(place).cast("long").alias("place"), body.alias("text"))
    # Equal rows without a key are read once and written as often as they come.
    alone = rows.where(~whole).groupBy(F.col(conversation).alias("conv"), F.col(place).cast("long").alias("place"), body.alias("text")).agg(F.count("*").alias("copies"))
    own = alone.select(F.concat(F.lit("r"), F.hex(F.xxhash64("conv", "place", "text")), F.hex(F.xxhash64(F.lit(1), "conv", "place", "text"))).alias("key"), "conv", "place", "text", F.lit(0).cast("long").alias("before"), "copies")
    both = numbered(kept).select("key", "conv", "place", "text", "before", F.lit(1).cast("long").alias("copies")).union(own)
    cut = both.select("key", "conv", "place", "before", "copies", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    number = F.col("before") + F.col("n")
    return cut.withColumns({"number": number, "chunk": F.floor(number / CHUNK)} | _seen(F.col("line"))).drop("before")


def fitted(labelled: DataFrame, conversation: str = "conv_id", place: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Count emissions and transitions; every count starts at one."""
    known = labelled.where(F.col(role).isin(*ROLES) & F.col(conversation).isNotNull() & F.col(place).isNotNull())
    cut = known.select(role, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line"))
    lines = cut.withColumns(_seen(F.col("line")))
    marker, length, asks = np.ones((N, len(ROLES) + 1)), np.ones((N, LENGTHS)), np.ones((N, 2))
    inside, last = np.ones(len(ROLES)), np.ones(len(ROLES))
    for r in lines.groupBy(role, (F.col("n") == 0).alias("begins"), "marker", "length", "asks").agg(F.count("*").alias("rows")).collect():
        s = STATES.index((r[role], r["begins"]))
        marker[s, r["marker"]] += r["rows"]
        length[s, r["length"]] += r["rows"]
        asks[s, r["asks"]] += r["rows"]
        (last if r["begins"] else inside)[ROLES.index(r[role])] += r["rows"]
    turns = known.select(F.col(conversation).alias("c"), F.col(place).cast("long").alias("p"), F.col(role).alias("r"))
    after = turns.join(turns.select("c", (F.col("p") - 1).alias("p"), F.col("r").alias("next")), ["c", "p"])
    follows, start = np.ones((len(ROLES), len(ROLES))), np.ones(len(ROLES))
    for r in after.groupBy("r", "next").agg(F.count("*").alias("n")).collect():
        follows[ROLES.index(r["r"]), ROLES.index(r["next"])] += r["n"]
    for r in turns.where("p = 0").groupBy("r").agg(F.count("*").alias("n")).collect():
        start[ROLES.index(r["r"])] += r["n"]
    goes_on = inside / (inside + last)  # share of lines that are followed by a line of the same turn
    follows /= follows.sum(axis=1, keepdims=True)
    step, first = np.full((N, N), -np.inf), np.full(N, -np.inf)
    for a, (x, _) in enumerate(STATES):
        i = ROLES.index(x)
        for b, (y, begins) in enumerate(STATES):
            p = (1 - goes_on[i]) * follows[i, ROLES.index(y)] if begins else goes_on[i] * (x == y)
            step[a, b] = np.log(p) if p else -np.inf
    for b, (y, begins) in enumerate(STATES):
        first[b] = np.log(start[ROLES.index(y)] / start.sum()) if begins else -np.inf
    share = lambda c: np.log(c / c.sum(axis=1, keepdims=True))
    return Model(first, step, share(marker), share(length), share(asks))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product; row N of a matrix stands for the start of a transcript."""
    return (a[:, :, None] + b[None, :N, :]).max(axis=1)


def product(emission: np.ndarray, model: Model) -> np.ndarray:
    """The matrix of a run of lines: from the state before it, or the start, to its last state."""
    m = np.concatenate([model.step, model.start[None]]) + emission[0]
    for e in emission[1:]:
        m = times(m, model.step + e)
    return m


def decoded(emission: np.ndarray, sizes: np.ndarray, before: np.ndarray, last: np.ndarray, model: Model) -> np.ndarray:
    """The best states of many runs of lines that stand one after another.

    ``before`` is the state ahead of each run (-1: start) and ``last`` its last state (-1: any).
    All runs take a step at a time together, the longest ones first in the order.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    size, before, last = sizes[order], before[order], last[order]
    first = np.concatenate([model.step, model.start[None]])  # the last row, -1, is the start
    score = first[before] + emission[starts]
    back = np.zeros((len(emission), N), np.int8)
    ends = score.copy()
    for t in range(1, int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, side="left"))  # runs longer than t
        through = score[:live, :, None] + model.step[None]
        back[starts[:live] + t] = through.argmax(axis=1)
        score = through.max(axis=1) + emission[starts[:live] + t]
        ends[:live] = score
    state = np.where(last < 0, ends.argmax(axis=1), last)
    out = np.zeros(len(emission), np.int8)
    for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left"))
        at = starts[:live] + t
        out[at] = state[:live]
        state[:live] = back[at, state[:live]]
    return out


def products(emission: np.ndarray, sizes: np.ndarray, model: Model) -> list[np.ndarray]:
    """The matrix of each run of lines: from the state before it, or the start, to its last state."""
    ends = np.cumsum(sizes)
    return [product(emission[a:b], model) for a, b in zip(ends - sizes, ends)]


class _Chunks:
    """Whole chunks of lines out of batches that come sorted by chunk."""

    def __init__(self):
        self.rest = None

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Tables of whole chunks with the number of lines of each."""
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if self.rest is not None:
                table = pa.concat_tables([self.rest, table])
            if len(table):
                starts = self.starts(table)
                self.rest = table.slice(starts[-1])
                if starts[-1]:
                    yield table.slice(0, starts[-1]).combine_chunks(), np.diff(starts)
        if self.rest is not None and len(self.rest):
            yield self.rest.combine_chunks(), np.array([len(self.rest)])

    @staticmethod
    def starts(table: pa.Table) -> np.ndarray:
        key, chunk = table["key"].combine_chunks().dictionary_encode(), table["chunk"].to_numpy()
        code = np.asarray(key.indices)
        return np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])]))


def _borders(lines: DataFrame, model: Model) -> DataFrame | None:
    """Per chunk of transcripts with several ones the state before it and its last state; None if there is no such transcript."""
    long = materialize(lines.where("chunk > 0").select("key").distinct(), "long-transcripts")
    if long.isEmpty():
        return None
    schema, fan = "key string, c long, m array<double>", FAN

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in _Chunks().of(batches):
            m = products(_emission(table, model), sizes, model)
            at = pa.array(np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([table["key"].take(at).combine_chunks(), table["chunk"].take(at).combine_chunks(), pa.array([x.reshape(-1) for x in m], pa.list_(pa.float64()))], names=["key", "c", "m"])

    def level(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("c")
        m = np.array(g["m"].iloc[0]).reshape(N + 1, N)
        for x in g["m"].iloc[1:]:
            m = times(m, np.array(x).reshape(N + 1, N))
        return pd.DataFrame({"key": [g["key"].iloc[0]], "c": [g["c"].iloc[0] // fan], "m": [m.reshape(-1)]})

    def down(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("c")
        m = [np.array(x).reshape(N + 1, N) for x in g["m"]]
        before, last = int(g["before"].iloc[0]), int(g["last"].iloc[0])
        sums = [m[0][before]]
        for x in m[1:]:
            sums.append((sums[-1][:, None] + x[:N]).max(axis=0))
        ends = [int(sums[-1].argmax()) if last < 0 else last]
        for s, x in zip(reversed(sums[:-1]), reversed(m[1:])):
            ends.append(int((s + x[:N, ends[-1]]).argmax()))
        ends = ends[::-1]
        return pd.DataFrame({"key": g["key"], "c": g["c"], "before": [before, *ends[:-1]], "last": ends})

    mine = lines.join(long, "key", "left_semi").select("key", "chunk", "number", "marker", "length", "asks")
    levels = [materialize(mine.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "number").mapInArrow(leaf, schema), "matrices")]
    top = levels[0].agg(F.max("c")).first()[0]
    while top >= fan:
        levels.append(materialize(levels[-1].groupBy("key", F.floor(F.col("c") / fan)).applyInPandas(level, schema), "matrices"))
        top //= fan
    known = levels[-1].select("key").distinct().select("key", F.lit(0).cast("long").alias("up"), F.lit(-1).cast("long").alias("before"), F.lit(-1).cast("long").alias("last"))
    for matrices in reversed(levels):
        here = matrices.withColumn("up", F.floor(F.col("c") / fan)).join(known, ["key", "up"])
        known = here.groupBy("key", "up").applyInPandas(down, "key string, c long, before long, last long").withColumnRenamed("c", "up")
    return materialize(known.withColumnRenamed("up", "chunk"), "borders")


def _emission(table: pa.Table, model: Model) -> np.ndarray:
    return model.emission(*(table[c].to_numpy() for c in ("marker", "length", "asks")))


def parsed(rows: DataFrame, model: Model, conversation: str = "conv_id", place: str = "turn", text: str = "text") -> DataFrame:
    """Recovered turns: conversation, where they begin, role, lines, text and canonical form."""
    lines = materialize(lines_of(rows, conversation, place, text), "lines")
    borders = _borders(lines, model)
    any_ = F.lit(-1).cast("long")
    lines = lines.withColumns({"before": any_, "last": any_}) if borders is None else lines.join(borders, ["key", "chunk"], "left").fillna(-1, ["before", "last"])
    kind = rows.schema[conversation].dataType.simpleString()
    fields = f"key string, chunk long, start long, number long, conv {kind}, place long, line int, copies long, role string, marked boolean, n_lines long, body string, at_border boolean"

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in _Chunks().of(batches):
            ends = np.cumsum(sizes)
            heads = ends - sizes
            before, last = (table[c].to_numpy()[heads] for c in ("before", "last"))
            states = decoded(_emission(table, model), sizes, before, last, model)
            begins = states % 2 == 0  # STATES has each role's beginning first
            head = np.zeros(len(states), bool)
            head[heads] = True
            at = np.flatnonzero(begins | head)
            stop = np.append(at[1:], len(states))
            line = table["line"].to_pylist()
            number, more = table["number"].to_numpy(), np.repeat(last >= 0, sizes)
            border = np.zeros(len(states), bool)  # what may go on in another chunk: the first and last part of a chunk with neighbours
            border[heads] = True
            border[at[np.searchsorted(at, ends - 1, side="right") - 1]] = True
            taken = pa.array(at)
            columns = [
                table["key"].take(taken), table["chunk"].take(taken), pa.array(np.where(begins[at], number[at], -1)), pa.array(number[at]), table["conv"].take(taken), table["place"].take(taken), table["n"].take(taken), table["copies"].take(taken),
                pa.array([ROLES[s // 2] for s in states[at]], pa.string()), pa.array((table["marker"].to_numpy()[at] > 0) & begins[at]), pa.array(stop - at),
                pa.array(["\n".join(line[a:b]) for a, b in zip(at, stop)], pa.string()), pa.array(border[at] & more[at]),
            ]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=[x.split()[0] for x in fields.split(", ")])

    dealt = lines.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "number")
    found = dealt.mapInArrow(render, fields)
    if borders is not None:
        found = materialize(found, "turn-parts")
        found = found.where("NOT at_border").unionByName(_joined(found))
    first = F.substring_index("body", "\n", 1)
    bare = F.when(F.col("marked"), F.regexp_replace(first, MARKER, "")).otherwise(first)
    body = F.trim(F.concat(bare, F.substr("body", F.length(first) + 1)))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(
        F.col("conv").alias(conversation), "place", "line", "role", "n_lines", body.alias("text"),
        F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), body, F.lit("<|im_end|>")).alias("chat"),
    )


def _joined(parts: DataFrame) -> DataFrame:
    """Turns whose parts lie on both sides of a border, by the line where they began."""
    open_ = parts.where("at_border")
    # Per chunk the last beginning; a chunk inside a turn has none and hands on what came before it.
    begun = open_.groupBy("key", "chunk").agg(F.max("start").alias("s"))
    ahead = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = begun.select("key", "chunk", F.max("s").over(ahead).alias("carried"))
    known = open_.join(carried, ["key", "chunk"]).withColumn("start", F.when(F.col("start") >= 0, F.col("start")).otherwise(F.col("carried")))
    lead = lambda c: F.min_by(c, "number").alias(c)
    return known.groupBy("key", "start").agg(
        F.min("chunk").alias("chunk"), F.min("number").alias("number"), *[lead(c) for c in ("conv", "place", "line", "copies", "role", "marked")], F.sum("n_lines").alias("n_lines"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "body"))), lambda x: x["body"]), "\n").alias("body"), F.lit(True).alias("at_border"),
    ).select(*parts.columns)

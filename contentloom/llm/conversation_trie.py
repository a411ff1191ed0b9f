"""Prefix trie of rebuilt conversations by whole-sequence collapse.

A conversation is rebuilt as the first turns of the head of its block and its own
turns after as many. Every different sequence of first turns is a node of the trie.

1. Turns get their places. Rows are dealt by ranges of (conversation, turn), counted per
   range, and the counts before a range are added, so a conversation of any length is
   spread over tasks. Only fingerprints of the texts are moved.
2. Identical rebuilt conversations collapse into one weighted sequence with the list of
   its conversations, which comes in parts of at most ``LIST`` ids.
3. Each sequence gives its prefixes once. A prefix of n turns is known by n and by 128
   bits: the exclusive or of the hashes of (place, role, text) of its turns, so prefixes
   are running aggregates over chunks of ``CHUNK`` turns.
4. Sequences that are proper prefixes go by an anti-join; the others are the leaves.
5. Weighted prefixes are summed. What a subtree saves needs no walk: a sequence adds its
   weight times the bytes it has from the node on, and each node's own bytes are taken off
   once, by the sequence that owns it: the one with the smallest conversation. The nodes
   a sequence owns are the end of its path, so two numbers per sequence are enough.

Defined cases: rows without a conversation belong to none; a null turn stands before all
others; rows of one turn are ordered by role and then by the SHA-256 of the text; repeated rows
are turns of their own; null roles and texts are empty ones, also very long texts count
as their fingerprint; a conversation that keeps no turn ends at the root; an empty table has no
nodes; other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from contentloom.operators.skew import salted_join
from contentloom.session import materialize

BLOCK, HEADS = 5, 9
# Turns of one conversation that are summed in one group.
CHUNK = 4096
# Conversation ids that are gathered into one part of a list.
LIST = 512
# Repeated rows written out at a time.
REPEATS = 65_536
KEY = ["depth", "x", "y"]
LONG = "long"


@dataclass
class Trie:
    """``nodes``: one row per node, with its key and its parent's.

    ``turns``: place, role and SHA-256 of the text of all turns of the rebuilt conversations.
    ``sequences``: the different whole conversations with weight and smallest conversation.
    ``ends``: each conversation with the key of the node where it ends.
    """

    nodes: DataFrame
    turns: DataFrame
    sequences: DataFrame
    ends: DataFrame


def _head(conv: Column) -> Column:
    """How many turns a conversation takes from the head of its block."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def placed(rows: DataFrame) -> DataFrame:
    """Turns with ``at``, their number in the conversation from 0, and what its rebuilding needs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast(LONG).alias("conv"), F.col("turn").cast(LONG).alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.unhex(F.sha2(text, 256)).alias("said"), F.octet_length(text).cast(LONG).alias("bytes"),
    )
    runs = known.groupBy("conv", "turn", "role", "said", "bytes").agg(F.count("*").alias("n"))
    dealt = materialize(runs.repartitionByRange("conv", "turn", "role", "said").withColumn("part", F.spark_partition_id()), "turn-runs")
    sums = dealt.groupBy("conv", "part").agg(F.sum("n").alias("m"))
    ahead = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("m").over(ahead), F.lit(0)))
    sizes = sums.groupBy("conv").agg(F.sum("m").alias("size"))
    base = F.col("conv") - F.col("conv") % BLOCK
    heads = sizes.withColumns({"base": base, "head": _head(F.col("conv"))}).join(sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size")), "base", "left")
    known_by = heads.select("conv", "base", "head", F.least("head", F.coalesce("base_size", F.lit(0))).alias("lead"))
    inside = Window.partitionBy("conv", "part").orderBy("turn", "role", "said").rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts.join(known_by, "conv").drop("m"), ["conv", "part"])
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast(LONG), F.col("n") - 1, F.lit(REPEATS).cast(LONG))))
    each = blocks.withColumn("k", F.explode(F.sequence(F.col("block"), F.least(F.col("block") + REPEATS, F.col("n")) - 1)))
    return each.select("conv", (F.col("start") + F.col("first") + F.col("k")).alias("at"), "role", "said", "bytes", "base", "head", "lead")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations, from the output of ``placed``: conversation, place, role, SHA-256 of the text, bytes.

    A conversation that keeps no turn has one row with a null place.
    """
    convs = turns.where("at = 0").select("conv", "base", "head", "lead")
    own = turns.where("at >= head").select("conv", (F.col("lead") + F.col("at") - F.col("head")).alias("place"), "role", "said", "bytes")
    heads = turns.where((F.col("conv") % BLOCK == 0) & (F.col("at") < HEADS)).select(F.col("conv").alias("base"), "at", "role", "said", "bytes")
    lent = convs.select("conv", "base", "head").join(heads, "base").where("at < head").select("conv", F.col("at").alias("place"), "role", "said", "bytes")
    # A row without a place per conversation keeps those that have no turn.
    marks = convs.select("conv", F.lit(None).cast(LONG).alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("said"), F.lit(0).cast(LONG).alias("bytes"))
    return own.union(lent).union(marks)


def _hashed(turns: DataFrame) -> DataFrame:
    """Two hashes of each turn at its place; a conversation's mark has none."""
    h = lambda seed: F.when(F.col("place").isNull(), F.lit(0).cast(LONG)).otherwise(F.xxhash64(F.lit(seed), "place", "role", "said"))
    return turns.select("conv", "place", h(1).alias("a"), h(2).alias("b"), "bytes")


def _listed(parts: DataFrame) -> DataFrame:
    """One row per sequence: smallest conversation, weight and digest of the id list, whose parts stream by in order."""

    fields = pa.schema([(c, pa.int64()) for c in (*KEY, "total", "conv", "weight")] + [("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, key, own, sha = [], None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["depth"], r["x"], r["y"]) != key:
                    if key is not None:
                        made.append({**own, "ends_sha256": sha.hexdigest()})
                    key, sha = (r["depth"], r["x"], r["y"]), hashlib.sha256()
                    own = {**dict(zip(KEY, key)), "total": r["total"], "conv": r["least"], "weight": 0}
                sha.update((("," if own["weight"] else "") + r["ids"]).encode())
                own["weight"] += r["n"]
            yield pa.RecordBatch.from_pylist(made, schema=fields)
            made = []
        if key is not None:
            yield pa.RecordBatch.from_pylist([{**own, "ends_sha256": sha.hexdigest()}], schema=fields)

    ordered = parts.repartition(*KEY).sortWithinPartitions(*KEY, "list")
    return ordered.mapInArrow(digest, "depth long, x long, y long, total long, conv long, weight long, ends_sha256 string")


def _chunks(sequences: DataFrame, *columns: str) -> DataFrame:
    """The sequences once per chunk of their turns, by their smallest conversation."""
    every = F.sequence(F.lit(0).cast(LONG), F.floor((F.col("depth") - 1) / CHUNK))
    return sequences.where("depth > 0").select("conv", *columns, F.explode(every).alias("chunk"))


def _prefixes(turns: DataFrame, sequences: DataFrame) -> DataFrame:
    """All prefixes but the empty one of the sequences: their key, the one before and the bytes before the last turn."""
    cut = turns.where(F.col("place").isNotNull()).withColumn("chunk", F.floor(F.col("place") / CHUNK)).join(_chunks(sequences, F.col("depth").alias("whole")), ["conv", "chunk"])
    upto = Window.partitionBy("conv", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = cut.groupBy("conv", "chunk").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("bytes").alias("s"))
    ahead = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("conv", "chunk", *[F.coalesce(f(c).over(ahead), F.lit(0)).alias(f"{c}0") for f, c in ((F.bit_xor, "a"), (F.bit_xor, "b"), (F.sum, "s"))])
    run = cut.select("conv", "chunk", "whole", "place", "a", "b", "bytes", F.bit_xor("a").over(upto).alias("xa"), F.bit_xor("b").over(upto).alias("xb"), F.sum("bytes").over(upto).alias("sum"))
    met = run.join(starts, ["conv", "chunk"])
    x, y = F.col("xa").bitwiseXOR(F.col("a0")), F.col("xb").bitwiseXOR(F.col("b0"))
    return met.select(
        "conv", "chunk", "whole", (F.col("place") + 1).alias("depth"), x.alias("x"), y.alias("y"),
        x.bitwiseXOR(F.col("a")).alias("px"), y.bitwiseXOR(F.col("b")).alias("py"), (F.col("s0") + F.col("sum") - F.col("bytes")).alias("before"), "bytes",
    )


def trie(rows: DataFrame) -> Trie:
    """The trie of all conversations of a table with ``conv_id``, ``turn``, ``role`` and ``text``."""
    turns = materialize(rebuilt(materialize(placed(rows), "placed-turns")), "rebuilt")
    hashed = _hashed(turns)
    whole = hashed.groupBy("conv").agg(F.count("place").alias("depth"), F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"), F.sum("bytes").alias("total"))
    ends = materialize(whole, "ends")
    ids = F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",")
    parts = ends.groupBy(*KEY, F.floor(F.col("conv") / LIST).alias("list")).agg(ids.alias("ids"), F.count("*").alias("n"), F.min("conv").alias("least"), F.min("total").alias("total"))
    sequences = materialize(_listed(parts), "sequences")

    zero = F.lit(0).cast(LONG)
    roots = sequences.select("conv", F.col("depth").alias("whole"), zero.alias("depth"), zero.alias("x"), zero.alias("y"), F.lit(None).cast(LONG).alias("px"), F.lit(None).cast(LONG).alias("py"), zero.alias("before"), zero.alias("bytes"))
    prefixes = materialize(_prefixes(hashed, sequences), "prefixes")
    paths = prefixes.drop("chunk").unionByName(roots)
    nodes = materialize(paths.groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"), *[F.min(c).alias(c) for c in ("px", "py", "before", "bytes")], F.max(F.when(F.col("depth") < F.col("whole"), 1).otherwise(0)).alias("inner"),
    ), "nodes")

    # Leaves: sequences that are no proper prefix of another one.
    leaves = sequences.join(nodes.where("inner = 1").select(*KEY), KEY, "left_anti").select("conv", F.lit(1).cast(LONG).alias("leaf"))
    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.min("depth").alias("since"), F.min_by("before", "depth").alias("skip"))
    known = materialize(sequences.join(leaves, "conv", "left").join(owned, "conv", "left").select("conv", "depth", "weight", "total", F.coalesce("leaf", zero).alias("leaf"), "since", "skip"), "leaves")
    carried = ["weight", "total", "leaf", "since", "skip"]
    steps = prefixes.join(_chunks(known, *carried), ["conv", "chunk"]).select(*KEY, "before", *carried)
    every = steps.union(known.select(zero, zero, zero, zero, *carried))
    # Bytes of the own nodes of a sequence from this node on; a sequence may own none.
    once = F.when(F.col("since").isNull(), zero).otherwise(F.col("total") - F.when(F.col("depth") >= F.col("since"), F.col("before")).otherwise(F.col("skip")))
    sums = every.groupBy(*KEY).agg(F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(F.col("weight") * (F.col("total") - F.col("before")) - once).alias("saved_tokens"))

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    up = nodes.select("conv_id", "bytes", *KEY, (F.col("depth") - 1).alias("pdepth"), "px", "py")
    parents = nodes.select(F.col("depth").alias("pdepth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    # The root's key is null for its parent; it meets no one and stays. Nodes with many children are cut into parts.
    linked = salted_join(up, parents, ["pdepth", "px", "py"], ["x", "y"], task_rows=200_000)
    made = linked.join(sums, KEY).join(children, KEY, "left").join(sequences.select(*KEY, "ends_sha256"), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "x", "y", "px", "py",
    )
    return Trie(made, turns.where(F.col("place").isNotNull()), sequences, ends)


def with_last_turn(made: Trie, rows: DataFrame) -> DataFrame:
    """The nodes with the role and text of their last turn; both null at the root.

    A text is looked up by its SHA-256, once for all turns that repeat it.
    """
    last = made.turns.select(F.col("conv").alias("conv_id"), (F.col("place") + 1).alias("depth"), "role", "said")
    texts = rows.select(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("said"), F.coalesce("text", F.lit("")).alias("text")).groupBy("said").agg(F.first("text").alias("text"))
    return salted_join(made.nodes.join(last, ["conv_id", "depth"], "left"), texts, ["said"], ["conv_id", "depth"]).drop("said")

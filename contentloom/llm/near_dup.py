"""Near-duplicate documents: BagMinHash signatures, banding and exact verification.

A document is the multiset of its five-word runs. BagMinHash keeps, in each of
``SLOTS`` slots, the earliest point of Poisson processes that belong to the
elements and their weights: an element of weight w owns the weight levels below w,
cut into the dyadic levels [0,1), [1,2), [2,4), ... Each level of each element has
one process; its points carry a random place within the level, and those at or
above w are thinned out, so the work grows with log w. Equal element and level give
the same points everywhere, hence slots agree with the probability of the weighted
Jaccard similarity. Points are made in order of time and only as long as they are
earlier than some slot's best.

Candidates that share a band are verified by their exact multiset overlap. Texts with
equal words are one node, and nodes that are joined by bands, over any number of others, are a group; a
class lies within a group. A group of up to ``GROUP_NODES`` nodes and ``GROUP_RUNS`` runs is compared in one task:
from a node on, all nodes like it are taken out of the group and asked in turn, so a class
costs a comparison of each of its members with those not taken yet, and no pair is formed outside of the task.

Larger groups are dealt into blocks by a hash of the node, and any two blocks meet in one task, which compares
them like a small group; what is linked in some task hangs together. So all pairs of a group are compared in one
shuffle, however large it is. A group whose nodes hang together by many small buckets only is compared bucket by
bucket instead, each dealt into blocks if it is large, where that takes fewer comparisons.
All ways give the classes that all pairs within buckets give; in a task pairs that share no band
are compared too, so that more true links are found there, never fewer.

Defined cases: null and empty texts and texts without words are classes of their
own; texts of one to four words are one run; words are runs of letters, digits and
characters outside ASCII, A-Z in lower case; rows that repeat a doc_id and text are in the
same class; null ids form classes by text, and a class is named by its smallest id; texts of any length
are compared whole; an empty table gives no rows; other columns are not read by ``classes`` and stay in ``distinct_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from contentloom.llm.components import components
from contentloom.llm.sidelists import LAST, ROW, hash_of
from contentloom.llm.words import MUL, TEXT_ROWS, lists_of, mixed, owners, pieces, run_hashes, split_words, hashed
from contentloom.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
SLOTS = BANDS * ROWS
# Nodes and runs of a group that one task compares.
GROUP_NODES, GROUP_RUNS = 4096, 4_000_000
# Nodes that a block of a larger group may have at least.
SMALL = 32
# Bits of the filter that tells which texts are asked for: 8 MB.
MARK_BITS = 1 << 26
# Texts taken at a time; the arrays of their runs take some forty times as much.
PIECE_BYTES = 1 << 19


def shingles(offsets: np.ndarray, words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each run of ``size`` words; a shorter text is one run."""
    own, n = owners(offsets), np.diff(offsets)
    runs = run_hashes(words, size)
    inside = own[:len(runs)] == own[size - 1:] if len(runs) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < size))
    whole = np.array([xxhash.xxh3_64_intdigest(words[offsets[i]:offsets[i + 1]].tobytes()) for i in short], np.uint64)
    text, h = np.concatenate([own[:len(runs)][inside], short]), np.concatenate([runs[inside], whole])
    order = np.lexsort((h, text))
    return text[order], h[order]


def weighted(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different elements of each text, sorted, with their weights."""
    if not len(h):
        return text, h, np.zeros(0, np.int64)
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.concatenate([at, [len(h)]]))


def _unit(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from hashes."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53


def bag_minhash(n: int, text: np.ndarray, h: np.ndarray, weight: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures of ``n`` texts, one row each; texts without elements have infinite slots."""
    best = np.full(n * slots, np.inf)
    if not len(h):
        return best.reshape(n, slots)
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1  # dyadic levels that begin below the weight
    index = np.repeat(np.arange(len(h)), levels)
    level = np.arange(len(index)) - np.repeat(np.cumsum(levels) - levels, levels)
    base = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    length = np.where(level == 0, 1.0, 2.0 ** (level - 1))
    state = mixed(h[index] + MUL * (level.astype(np.uint64) + np.uint64(1)))
    own, top = text[index], weight[index].astype(np.float64)
    time, turn = np.zeros(len(index)), 0
    while len(index):
        turn += 1
        draw = mixed(state + np.uint64(turn * 0xD1342543DE82EF95 % 2**64))
        time = time - np.log(_unit(draw)) / length
        spot = mixed(draw + np.uint64(1))
        slot = own * slots + (spot % np.uint64(slots)).astype(np.int64)
        kept = base + length * (_unit(mixed(draw + np.uint64(2))) - 2.0**-53) < top
        np.minimum.at(best, slot[kept], time[kept])
        limit = best.reshape(n, slots).max(axis=1)
        live = time < limit[own]
        index, own, base, length, top, state, time = index[live], own[live], base[live], length[live], top[live], state[live], time[live]
    return best.reshape(n, slots)


def _content(offsets: np.ndarray, words: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each text's words; null without words."""
    return [xxhash.xxh3_128_digest(words[a:b].tobytes()) if b > a else None for a, b in zip(offsets[:-1], offsets[1:])]


def _signatures(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batch, "text", PIECE_BYTES):
        offsets, words = split_words(piece.column("text"), fold=True)
        h = hashed(words)
        signature = bag_minhash(piece.num_rows, *weighted(*shingles(offsets, h)))
        band = band_hashes(signature)
        n = np.diff(offsets)
        size = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
        yield pa.RecordBatch.from_arrays(
            [*(piece.column(c) for c in ("doc_id", *ROW)), pa.array(_content(offsets, h), pa.binary()), lists_of(pa.array(band.reshape(-1).view(np.int64)), np.full(len(band), BANDS)), pa.array(size)],
            names=["doc_id", *ROW, "node", "bands", "size"],
        )


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id``, what its row is known by, content name, band hashes and number of runs of each document; no shuffle."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _signatures(batch)

    return _named(docs).mapInArrow(sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, id long, t1 long, t2 long, node binary, bands array<long>, size long")


def _named(docs: DataFrame) -> DataFrame:
    """Texts with what their rows are known by: rows of one id, or without one, differ by the hash of their text."""
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "text").withColumns(hash_of())


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One hash per band of each signature; the band's number is part of it."""
    parts = signature.astype(np.float32).view(np.uint32).astype(np.uint64)  # the last bits of a logarithm may differ between machines
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signature), 1))
    for r in range(ROWS):
        out = out * MUL + mixed(parts[:, r::ROWS])
    return mixed(out)


def _marks(rows: DataFrame) -> np.ndarray:
    """A Bloom filter of the rows, two bits each, in at most ``MARK_BITS`` bits, eight of them in a byte.

    It only keeps texts from being moved that are not asked for; a full one lets more of them pass,
    which the join that follows leaves out.
    """
    n = rows.count()
    size = 1 << min(MARK_BITS.bit_length() - 1, max(10, (16 * n).bit_length()))
    at = rows.select(F.explode(F.array(*[F.pmod(F.xxhash64("id", c), F.lit(size)) for c in ("t1", "t2")])).alias("p"))
    words = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy()
    return bits.astype("<i8").view(np.uint8)


def _marked(marks: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which of the hashes have their bit in the filter; the filter stays packed."""
    at = np.mod(p, 8 * len(marks))
    return ((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _sets(texts: DataFrame, marks: np.ndarray) -> DataFrame:
    """What the row is known by, ``node`` and its runs for the texts in the filter; the n-th occurrence of a run is an element of its own."""
    held = texts.sparkSession.sparkContext.broadcast(marks)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            asked = np.logical_and(*(_marked(held.value, whole.column(c).to_numpy()) for c in ("p1", "p2")))
            for piece in pieces(whole.filter(pa.array(asked)), "text", PIECE_BYTES):
                offsets, words = split_words(piece.column("text"), fold=True)
                words = hashed(words)
                text, h = shingles(offsets, words)
                place = np.arange(len(h))
                new = np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
                nth = place - np.maximum.accumulate(np.where(new, place, 0)) if len(h) else place
                element = mixed(h + MUL * nth.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ROW), pa.array(_content(offsets, words), pa.binary()), lists_of(pa.array(element), np.bincount(text, minlength=piece.num_rows))], names=[*ROW, "node", "runs"])

    return texts.select(*ROW, "text", F.xxhash64("id", "t1").alias("p1"), F.xxhash64("id", "t2").alias("p2")).mapInArrow(make, "id long, t1 long, t2 long, node binary, runs array<long>")


def similar_sets(sizes: np.ndarray, elements: np.ndarray, threshold: float) -> np.ndarray:
    """A class number for each of some sets, given one after another: sets are linked if their overlap reaches the threshold."""
    _, code = np.unique(elements, return_inverse=True)
    ends = np.cumsum(sizes)
    starts, label = ends - sizes, np.full(len(sizes), -1)
    mark = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int32)
    rest, rest_code, rest_start = np.arange(len(sizes)), code, starts
    for seed in np.argsort(-sizes, kind="stable"):
        if label[seed] >= 0:
            continue
        label[seed], queue = seed, [seed]
        while queue:
            x = queue.pop()
            free = label[rest] < 0
            if not free.any():
                break
            if free.sum() * 2 < len(rest):  # leave out what has a class already
                rest = rest[free]
                n = sizes[rest]
                rest_start = np.cumsum(n) - n
                rest_code = code[np.repeat(starts[rest] - rest_start, n) + np.arange(n.sum())]
                free = np.ones(len(rest), bool)
            own = code[starts[x]:ends[x]]
            mark[own] = 1
            shared = np.add.reduceat(mark[rest_code], rest_start)
            mark[own] = 0
            like = rest[free & (shared >= threshold * (sizes[rest] + sizes[x] - shared))]
            label[like] = seed
            queue += like.tolist()
    return label


def _in_groups(sets: DataFrame, threshold: float) -> DataFrame:
    """``node``, ``root``, the smallest node of its class, and ``fits`` for sets that come together in a task by their ``key``."""

    def classes_of(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        names = table["node"].to_pylist()
        first = sorted({n: i for i, n in enumerate(names)}.values())  # a node may come in several rows
        table = table.take(pa.array(first))
        names = [names[i] for i in first]
        runs = table["runs"].combine_chunks()
        label = similar_sets(np.asarray(runs.value_lengths()).astype(np.int64), runs.flatten().to_numpy(), threshold)
        least: dict[int, bytes] = {}
        for n, c in zip(names, label.tolist()):
            least[c] = min(least.get(c, n), n)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([least[c] for c in label.tolist()], pa.binary()), table["fits"].combine_chunks()], names=["node", "root", "fits"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            key = batch.column("key").to_pylist()
            new = [i for i in range(len(key)) if i == 0 or key[i] != key[i - 1]]
            for a, b in zip(new, [*new[1:], len(key)]):
                if held and key[a] != group:
                    yield classes_of(held)
                    held = []
                group = key[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield classes_of(held)

    return sets.repartition("key").sortWithinPartitions("key").mapInArrow(make, "node binary, root binary, fits boolean")


def _meetings(nodes: DataFrame) -> DataFrame:
    """``node`` and the ``keys`` of the tasks in which it meets others, for ``node``, ``root``, ``bands`` and ``size`` of groups too large for one task.

    Blocks have half of what a task may compare, so any two of them fit. A set is sent to as many tasks as
    its group has other blocks.
    """
    rows = nodes.select("node", "root", "size", F.explode("bands").alias("band"))
    counts = [F.count("*").alias("n"), F.sum("size").alias("runs")]
    work = F.col("n").cast("double") * F.col("runs")
    buckets = rows.groupBy("root", "band").agg(*counts).where("n > 1")
    apart = buckets.groupBy("root").agg(F.sum(work).alias("apart"))
    # One row for each large group.
    groups = materialize(nodes.groupBy("root").agg(*counts).join(apart, "root").withColumn("whole", work <= F.col("apart")).drop("apart"), "large-groups")
    by_group = nodes.join(F.broadcast(groups.where("whole")), "root").select("node", F.hex("root").alias("unit"), "n", "runs")
    by_bucket = rows.join(F.broadcast(groups.where("NOT whole").select("root")), "root").join(buckets.hint("merge"), ["root", "band"]).select("node", F.hex("band").alias("unit"), "n", "runs")
    fits = (F.col("n") <= GROUP_NODES) & (F.col("runs") <= GROUP_RUNS)
    wanted = F.greatest(F.ceil(F.col("n") / max(GROUP_NODES // 2, SMALL)), F.ceil(F.col("runs") / (GROUP_RUNS // 2)))
    units = by_group.union(by_bucket).withColumn("blocks", F.when(fits, 1).otherwise(F.least("n", wanted)).cast("long"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    others = F.when(F.col("blocks") == 1, F.array(own)).otherwise(F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.col("own")))
    keys = F.transform("others", lambda x: F.concat_ws("-", "unit", F.least("own", x), F.greatest("own", x)))
    return units.withColumn("own", own).withColumn("others", others).groupBy("node").agg(F.flatten(F.collect_list(keys)).alias("keys"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``node`` (null without words) and ``class_id``, one row per input row."""
    sign = materialize(signed(docs), "signatures", batch_rows=TEXT_ROWS)
    nodes = sign.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct(*ROW)).alias("row"), F.first("bands").alias("bands"), F.max("size").alias("size"))
    nodes = materialize(nodes, "nodes")
    rows = nodes.select("node", F.explode("bands").alias("band"))
    # A bucket joins its nodes to the smallest of them; what hangs together is a group.
    buckets = rows.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Spark takes the bands of nodes for as few rows as the nodes and would broadcast them; the buckets are hashed instead.
    groups = components(rows.join(buckets.hint("shuffle_hash"), "band").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    sized = groups.join(nodes.select("node", "size"), "node").groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("runs"))
    fits = (F.col("n") <= GROUP_NODES) & (F.col("runs") <= GROUP_RUNS)
    needed = materialize(groups.join(sized.select("root", fits.alias("fits")), "root").join(nodes.select("node", "row.*"), "node"), "groups")

    tasks, asked, large = F.array(F.hex("root")), needed, needed.where("NOT fits")
    some_large = not large.isEmpty()
    if some_large:
        met = materialize(_meetings(large.select("node", "root").join(nodes.select("node", "bands", "size"), "node")), "meetings")
        tasks, asked = F.coalesce("keys", tasks), needed.join(met.hint("merge"), "node", "left")

    # A shuffle at every size: the runs of the asked texts move, by row and then by the tasks that compare them.
    wanted = asked.select(*ROW, tasks.alias("keys"), "fits").hint("shuffle_hash")
    sets = _sets(_named(docs), _marks(needed)).join(wanted, ROW).select("node", F.explode("keys").alias("key"), "fits", "runs")
    roots = materialize(_in_groups(sets, threshold), "classes", batch_rows=TEXT_ROWS)
    if some_large:  # a node is in several tasks
        linked = components(roots.where("NOT fits").select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = roots.where("fits").select("node", "root").union(linked)
    else:
        roots = roots.select("node", "root")
    named = sign.join(roots, "node", "left").withColumn("__root", F.coalesce("root", "node"))
    least = named.where(F.col("__root").isNotNull()).groupBy("__root").agg(F.min("doc_id").alias("class_id"))
    return named.join(least, "__root", "left").select("doc_id", "node", F.coalesce("class_id", "doc_id").alias("class_id"))


def distinct_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those of which a near copy with a smaller id stays.

    Rows are told apart by id: an id goes if each of its rows is in a class with a
    smaller id. Rows without an id stay together or go together.
    """
    found = materialize(classes(docs, threshold), "classes")
    gone = found.groupBy("doc_id").agg(F.every(~F.col("class_id").eqNullSafe(F.col("doc_id"))).alias("copy")).where("copy").select("doc_id")
    gone = materialize(gone, "copies")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti").select(*docs.columns)

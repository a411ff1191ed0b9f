"""Benchmark decontamination with suffix arrays of the training texts.

Each task sorts the suffixes of its texts (a shard) into a suffix array and looks
up every benchmark window by binary search. Words that no benchmark item contains
cannot be part of a match, so only runs of benchmark words long enough for a
window enter the array; nothing that could match is left out.

The benchmark is the query set and goes to all shards, in blocks of at most
``BLOCK_CHARS`` characters whose size is counted before anything is broadcast;
a larger benchmark takes more passes, each written before the next block is read, not larger broadcasts.

Defined cases: null and empty texts have no words and no hit; an item without words
has no window; items without an id count as hits but are not listed; repeated rows
are searched one by one; texts of any length are searched whole; an empty table gives no rows; other columns pass through,
those named like the operator's own (``columns.OWN``) are replaced, but stay in ``clean_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from contentloom.llm.columns import apart, free, together
from contentloom.llm.words import codes, lists_of, pieces, split_words
from contentloom.session import materialize

WINDOW = 10
BLOCK_CHARS = 16 << 20
SPAN = pa.struct([("first", pa.int64()), ("words", pa.int64())])
MATCH = pa.struct([("item", pa.string()), ("first", pa.int64()), ("words", pa.int64())])
ADDED = "__n_words long, __spans array<struct<first:long,words:long>>, __matches array<struct<item:string,first:long,words:long>>"


@dataclass
class Windows:
    """The different windows of a benchmark block: start and length of each, and where it stands in which items."""

    vocabulary: pa.Array
    words: np.ndarray
    start: np.ndarray
    length: np.ndarray
    names: list[str | None]
    # Places of window k: from first[k] up to first[k + 1].
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def items(self, k: int) -> Iterator[tuple[str | None, int]]:
        for j in range(self.first[k], self.first[k + 1]):
            yield self.names[self.item[j]], int(self.place[j])


def windows(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Windows:
    """Windows of ``window`` words, and items of fewer as one; arrays only, about a hundred bytes a word."""
    offsets, words = split_words(pa.array([t for _, t in rows], pa.string()), fold=True)
    number, vocabulary = codes(words)
    number = (number + 1).astype(np.int32)  # 0 ends a run
    sizes = np.diff(offsets)
    start, length, which, item, place, base = [], [], [], [], [], 0
    for n in np.unique(np.minimum(window, sizes[sizes > 0])):
        own = np.flatnonzero((sizes == n) | ((sizes > n) & (n == window)))
        count = sizes[own] - n + 1
        r = np.repeat(own, count)
        p = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = offsets[r] + p
        _, one, same = np.unique(number[at[:, None] + np.arange(n)], axis=0, return_index=True, return_inverse=True)
        start.append(at[one])
        length.append(np.full(len(one), n))
        which.append(same.reshape(-1) + base)
        item.append(r)
        place.append(p)
        base += len(one)
    join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
    order = np.argsort(join(which), kind="stable")
    first = np.searchsorted(join(which)[order], np.arange(base + 1))
    return Windows(vocabulary, np.concatenate([number, np.zeros(window, np.int32)]).astype(np.int64), join(start), join(length), [i for i, _ in rows], first, join(item)[order], join(place)[order])


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``t`` in the order of their suffixes, compared over ``depth`` words or more."""
    rank, have = np.unique(t, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while have < depth:
        second = np.concatenate([rank[have:] + 1, np.zeros(min(have, len(t)), np.int64)])[:len(t)]
        key = rank * (len(t) + 2) + second
        order = np.argsort(key, kind="stable")
        changes = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty_like(rank)
        rank[order] = changes
        have *= 2
    return order


def bounds(t: np.ndarray, order: np.ndarray, w: Windows, upper: bool) -> np.ndarray:
    """For each window the first place of the suffix array that is not before it, or with ``upper`` behind it."""
    low, high = np.zeros(len(w.start), np.int64), np.full(len(w.start), len(order), np.int64)
    while (open_ := low < high).any():
        which = np.flatnonzero(open_)
        middle = (low[which] + high[which]) // 2
        before = np.full(len(which), upper)
        live, at = np.arange(len(which)), 0
        while len(live):
            live = live[w.length[which[live]] > at]
            a, b = t[order[middle[live]] + at], w.words[w.start[which[live]] + at]
            before[live[a != b]] = (a < b)[a != b]
            live, at = live[a == b], at + 1
        low[which[before]] = middle[before] + 1
        high[which[~before]] = middle[~before]
    return low


def occurrences(offsets: np.ndarray, words: pa.Array, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and window of each place where a window stands."""
    none = np.zeros(0, np.int64)
    if not len(w.start) or not len(words):
        return none, none, none
    number, different = codes(words)
    known = pc.fill_null(pc.index_in(different, value_set=w.vocabulary.cast(different.type)), -1)
    t = np.asarray(known).astype(np.int64)[number] + 1
    # Runs of known words that do not cross texts; a 0 ends each.
    cut = np.zeros(len(t) + 1, bool)
    cut[offsets] = True
    inside = t > 0
    opens = inside & (cut[:-1] | np.concatenate([[True], ~inside[:-1]]))
    run = np.cumsum(opens) - 1
    long = np.bincount(run[inside], minlength=run[-1] + 1 if len(run) else 0) >= w.length.min()
    take = np.flatnonzero(inside)
    take = take[long[run[take]]]
    if not len(take):
        return none, none, none
    first = np.concatenate([[True], run[take[1:]] != run[take[:-1]]])
    spot = np.arange(len(take)) + np.cumsum(first) - 1
    shard = np.zeros(spot[-1] + 1 + int(w.length.max()) + 1, np.int64)
    shard[spot] = t[take]
    places = np.full(len(shard), -1, np.int64)
    places[spot] = take
    order = suffix_array(shard, int(w.length.max()))
    # Places at the very end would read past it; they are blank and match nothing.
    padded = np.concatenate([shard, np.zeros(int(w.length.max()) + 1, np.int64)])
    low, high = bounds(padded, order, w, False), bounds(padded, order, w, True)
    count = high - low
    window = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    place = places[order[at]]
    text = np.searchsorted(offsets, place, side="right") - 1
    return text, place - offsets[text], window


def _union(text: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each text without overlaps."""
    if not len(text):
        return text, first, length
    order = np.lexsort((first, text))
    text, first, length = text[order], first[order], length[order]
    reach = int((first + length).max()) + 1
    end = np.maximum.accumulate(text * reach + first + length)
    new = np.concatenate([[True], text[1:] * reach + first[1:] > end[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(new) - 1]])
    return text[new], first[new], end[last] - text[new] * reach - first[new]


def _longest(text: np.ndarray, first: np.ndarray, window: np.ndarray, w: Windows) -> list[tuple[int, str | None, int, int]]:
    """The longest verbatim matches: windows of an item that follow each other in a text as in the item."""
    rows = sorted((int(d), item or "", item is None, int(p) - q, int(p), int(w.length[k])) for d, p, k in zip(text, first, window) for item, q in w.items(int(k)))
    out: list[list] = []
    for d, item, blank, line, p, n in rows:
        if out and out[-1][:4] == [d, item, blank, line] and p <= out[-1][5]:
            out[-1][5] = max(out[-1][5], p + n)
        else:
            out.append([d, item, blank, line, p, p + n])
    return [(d, None if blank else item, p, end - p) for d, item, blank, _, p, end in out]


def _search(texts: pa.Array, w: Windows, spans: pa.Array, matches: pa.Array) -> list[pa.Array]:
    offsets, words = split_words(texts, fold=True)
    text, first, window = occurrences(offsets, words, w)
    old = np.repeat(np.arange(len(spans)), np.asarray(pc.list_value_length(spans)))
    earlier = pc.list_flatten(spans)
    d, p, n = _union(
        np.concatenate([old, text]), np.concatenate([np.asarray(earlier.field("first")), first]), np.concatenate([np.asarray(earlier.field("words")), w.length[window]]),
    )
    found = _longest(text, first, window, w)
    kept = np.repeat(np.arange(len(matches)), np.asarray(pc.list_value_length(matches)))
    rows = sorted([(int(i), x["item"], x["first"], x["words"]) for i, x in zip(kept, pc.list_flatten(matches).to_pylist())] + found, key=lambda r: r[0])
    return [
        pa.array(np.diff(offsets)),
        lists_of(pa.StructArray.from_arrays([pa.array(p, pa.int64()), pa.array(n, pa.int64())], fields=list(SPAN)), np.bincount(d, minlength=len(texts))),
        lists_of(pa.array([{"item": i, "first": a, "words": b} for _, i, a, b in rows], MATCH), np.bincount(np.array([r[0] for r in rows], np.int64), minlength=len(texts))),
    ]


def searched(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents with ``__n_words``, the hit ``__spans`` and the longest ``__matches``; no shuffle."""
    docs, spark = free(docs), docs.sparkSession
    total = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_chars))
    names = docs.columns
    out = docs.withColumns({"__n_words": F.lit(0).cast("long"), "__spans": F.array().cast("array<struct<first:long,words:long>>"), "__matches": F.array().cast("array<struct<item:string,first:long,words:long>>")})
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(ADDED).fields])
    for b in range(blocks):
        part = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
        part = part.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast(windows(sorted(((r["i"], r["t"]) for r in part.toLocalIterator()), key=repr), window))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch, text):
                    cells = dict(zip(piece.schema.names, piece.columns))
                    made = _search(cells[text], held.value, cells["__spans"], cells["__matches"])
                    yield pa.RecordBatch.from_arrays([*(cells[n] for n in names), *made], names=[*names, "__n_words", "__spans", "__matches"])

        out = out.mapInArrow(search, schema)
        if blocks > 1:  # one block at a time: its pass is over before the next one is sent
            out = materialize(out, "searched")
            held.destroy()
    return out


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words and the items with matches."""
    found = searched(docs.select("doc_id", "text"), benchmark).drop("text")
    items = F.array_sort(F.array_distinct(F.filter(F.transform("__matches", lambda m: m["item"]), lambda i: i.isNotNull())))
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a match, with their own columns."""
    found = searched(apart(docs, "text"), benchmark)
    return together(found.where(F.size("__spans") == 0), docs.columns, "text")

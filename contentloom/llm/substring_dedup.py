"""Removal of repeated passages by recompression.

Recompression rewrites a text in rounds: first each maximal run of one symbol gets
one name, then neighbouring symbols, the left one of the class "left" and the right
one of the class "right", become one. Names are 64-bit fingerprints of what they
stand for, and the class is a bit of the fingerprint, so all tasks give equal names
to equal content without a common table. Whether symbols join depends on them and
their neighbours alone; every symbol therefore has a context, the words that decide
it, and a passage that contains the context contains the same symbol.

A window is a run of ``WINDOW`` words. Each window elects as its anchor the
symbol of the highest round with the smallest name whose context lies within the window, or
itself if there is none: equal windows elect equal anchors. Neighbouring windows mostly
share an anchor, so there are about five windows to an anchor. Spark joins the anchors:

1. Anchors are grouped by the fingerprint of their context; only the smallest doc_id is
   kept, combined before the shuffle. Anchors that also occur under a smaller doc_id remain.
2. For an anchor whose whole neighbourhood (all windows that elected it) equals that of the
   smallest doc_id, all windows repeat. This settles the inside of long passages.
3. The others, mostly at the ends of passages, are compared window by window, by two hashes.

Defined cases: null and empty texts have no words; texts shorter than a window keep all
words; a null id is larger than any other and no id is smaller than itself, so rows that
repeat an id do not remove each other's words; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from contentloom.llm.columns import free
from contentloom.llm.words import MUL, Runs, hashed, mixed, owners, pieces, split_words
from contentloom.llm.sidelists import LAST, ROW, beside, hash_of, pairs_of
from contentloom.session import materialize

WINDOW = 13
ROUNDS = 2
# Texts taken at a time; a word takes about a hundred bytes on the way.
PIECE_BYTES = 2 << 20
# Makes a second hash of the words, so that windows are compared by 128 bits.
OTHER = np.uint64(0xA24BAED4963EE407)


def _hashes() -> dict:
    """What tells rows of one id apart: 96 bits of the text's hash, as every anchor carries them."""
    usual = hash_of()
    return usual | {"t2": F.shiftright(usual["t2"], 32).cast("int")}


def _runs(name: np.ndarray, text: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Name each maximal run of one symbol; its context takes in the symbols beside it."""
    first = np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(first)
    size = np.diff(np.concatenate([at, [len(name)]]))
    made = np.where(size > 1, mixed(name[at] * MUL + size.astype(np.uint64)), name[at])
    last = at + size - 1
    # Beyond the first or last symbol of a text lies nothing that a window could contain.
    left = np.where((at > 0) & (text[at - 1] == text[at]), low[at - 1], -n)
    after = np.minimum(last + 1, len(name) - 1)
    right = np.where((last + 1 < len(name)) & (text[after] == text[at]), high[after], 2 * n)
    return made, text[at], start[at], np.minimum(left, low[at]), np.maximum(right, high[last]), name[at]


def _pairs(name: np.ndarray, text: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, kind: np.ndarray, turn: int) -> tuple[np.ndarray, ...]:
    """Join a left symbol with a right one behind it; contexts already hold the neighbours.

    The class is taken from the symbol, not from the length of its run, which may reach out of a window.
    """
    right = (mixed(kind + np.uint64(turn)) >> np.uint64(63)).astype(bool)
    joins = np.zeros(len(name), bool)
    joins[:-1] = ~right[:-1] & right[1:] & (text[:-1] == text[1:])
    head = np.ones(len(name), bool)
    head[1:] = ~joins[:-1]
    at = np.flatnonzero(head)
    pair = joins[at]
    mate = np.minimum(at + 1, len(name) - 1)
    made = np.where(pair, mixed(mixed(name[at]) * MUL + name[mate]), name[at])
    return made, text[at], start[at], low[at], np.where(pair, high[mate], high[at])


def anchors(offsets: np.ndarray, words: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, ...]:
    """For each window of ``size`` words its text and start, and where the context of its anchor lies."""
    text = owners(offsets)
    n = len(words)
    inside = text[:n - size + 1] == text[size - 1:] if n >= size else np.zeros(0, bool)
    # The window itself is what is elected if it contains no symbol with its context.
    rank = np.full(len(inside), np.iinfo(np.uint64).max, np.uint64)
    low_of, high_of = np.arange(len(inside)), np.arange(len(inside)) + size
    if n and inside.any():
        place = np.arange(n)
        symbols = (words, text, place, place, place + 1)
        for turn in range(ROUNDS):
            *symbols, kind = _runs(*symbols, n)
            symbols = _pairs(*symbols, kind, turn)
            name, _, _, low, high = symbols
            fits = (low >= 0) & (high - low <= size)
            weight = (mixed(name[fits] + np.uint64(turn)) >> np.uint64(2)) | np.uint64((ROUNDS - 1 - turn) << 62)
            low, high = low[fits], high[fits]
            # Contexts of different symbols begin at different words, so no place comes twice.
            for shift in range(size):
                at = low - shift
                ok = (at >= 0) & (at + size >= high) & (at < len(inside))
                at, mine, l, r = at[ok], weight[ok], low[ok], high[ok]
                better = mine <= rank[at]
                at = at[better]
                rank[at], low_of[at], high_of[at] = mine[better], l[better], r[better]
    starts = np.flatnonzero(inside)
    return text[starts], starts, low_of[starts], high_of[starts]


def _grouped(offsets: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """One row per anchor: text, hashes of its context and of its neighbourhood, first window and number of windows.

    The neighbourhood are the words of all windows that elected the anchor.
    """
    text, start, low, high = anchors(offsets, words, size)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z.astype(np.uint64), z, z
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)])
    at = np.flatnonzero(new)
    count, first, runs = np.diff(np.concatenate([at, [len(start)]])), start[at], Runs(words)
    return text[at], runs.of(low[at], high[at]), runs.of(first, first + count + size - 1), first - offsets[text[at]], count


def _anchor_rows(docs: DataFrame, size: int) -> DataFrame:
    """What a row is known by, ``key``, ``around`` and ``spot``: first window and number of windows in one number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                texts = piece.column("text")
                offsets, words = split_words(texts, fold=False)
                text, key, around, first, count = _grouped(offsets, hashed(words), size)
                spot = (first << 8) | count
                own = pa.array(text)
                yield pa.RecordBatch.from_arrays([*(piece.column(c).take(own) for c in ROW), pa.array(key.view(np.int64)), pa.array(around.view(np.int64)), pa.array(spot)], names=[*ROW, "key", "around", "spot"])

    return docs.select("id", "text").withColumns(_hashes()).mapInArrow(make, "id long, t1 long, t2 int, key long, around long, spot long")


def _listed(spots: DataFrame, merge: bool, size: int) -> DataFrame:
    """What a row is known by and the windows of its text as pairs of numbers in ``places``.

    With ``merge`` the pairs are the word spans that the windows cover. A list is no longer than its text.
    """
    lists = spots.groupBy(*ROW).agg(F.collect_set("spot").alias("spots"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spot in batch.column("spots"):
                s = np.sort(spot.values.to_numpy())
                first, end = s >> 8, (s >> 8) + (s & 0xFF)
                if merge:
                    reach = np.maximum.accumulate(end + size - 1)
                    new = np.concatenate([[True], first[1:] > reach[:-1]])
                    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
                    first, end = first[new], reach[last]
                rows.append(np.stack([first, end], axis=1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ROW), pa.array(rows, pa.binary())], names=[*ROW, "places"])

    return lists.mapInArrow(make, "id long, t1 long, t2 int, places binary")


def _window_rows(texts: DataFrame, size: int) -> DataFrame:
    """Both hashes of each listed window with what its row is known by and ``spot``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                offsets, words = split_words(piece.column("text"), fold=False)
                h = hashed(words)
                runs, other, rows, starts = Runs(h), Runs(mixed(h ^ OTHER)), [], []
                for i, places in enumerate(piece.column("__places").to_pylist()):
                    own = [np.arange(a, b) for a, b in pairs_of(places)]
                    own = np.concatenate(own) if own else np.zeros(0, np.int64)
                    starts.append(own)
                    rows.append(np.full(len(own), i))
                row, start = np.concatenate(rows), np.concatenate(starts)
                at = offsets[row] + start
                spot, own = (start << 8) | 1, pa.array(row)
                yield pa.RecordBatch.from_arrays([*(pa.array(r.of(at, at + size).view(np.int64)) for r in (runs, other)), *(piece.column(c).take(own) for c in ROW), pa.array(spot)], names=["h", "h2", *ROW, "spot"])

    return texts.select("id", F.col("__t1").alias("t1"), F.col("__t2").alias("t2"), "text", "__places").mapInArrow(make, "h long, h2 long, id long, t1 long, t2 int, spot long")


def repeated_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Row and ``spot`` of windows that also start in a document with a smaller id.

    ``docs`` has ``id`` and ``text``.
    """
    rows = _anchor_rows(docs, size)
    shared = rows.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min_by("around", "id").alias("first_around")).where("least < most").drop("most")
    first, same = F.col("id") == F.col("least"), F.col("around") == F.col("first_around")
    # Only what the next steps ask is written: which anchors repeat as a whole, and which keys have others.
    met = materialize(rows.join(shared, "key").select("key", *ROW, "spot", (~first & same).alias("settled"), (~first & ~same).alias("open")), "anchors")
    settled = F.col("settled")
    undecided = met.where("open").select("key").distinct()
    lists = materialize(_listed(met.where(~settled).join(undecided, "key", "left_semi").select(*ROW, "spot"), False, size), "undecided")
    windows = materialize(_window_rows(beside(docs, lists, "id", "inner", _hashes()), size), "windows")
    least = windows.groupBy("h", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    later = windows.join(least, ["h", "h2"]).where(F.col("least") < F.col("id"))
    return met.where(settled).select(*ROW, "spot").union(later.select(*ROW, "spot"))


def deduplicated(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents with the words that stay, ``__n_words`` and ``__n_removed``.

    The words that stay are joined by single blanks; a text stays as it is, null
    included, if all its words stay. Columns named like the operator's own (``columns.OWN``) are replaced.
    """
    docs = free(docs)
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "text").where(F.col("text").isNotNull())
    spans = materialize(_listed(repeated_windows(plain, size), True, size), "spans")
    names = docs.columns
    texts = beside(docs, spans, "doc_id", "left", _hashes()).select(*names, "__places")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                text, places = piece.column("text").to_pylist(), piece.column("__places")
                n_words, n_removed = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
                for i, t in enumerate(text):
                    if not t:
                        continue
                    spans = pairs_of(places[i].as_py())
                    words = t.encode().split()
                    n_words[i] = len(words)
                    if len(spans):
                        stays = np.ones(len(words), bool)
                        for a, b in spans:
                            stays[a:b] = False
                        n_removed[i] = len(words) - stays.sum()
                        text[i] = b" ".join([words[k] for k in np.flatnonzero(stays)]).decode()
                cells = dict(zip(piece.schema.names, piece.columns)) | {"text": pa.array(text, pa.string())}
                yield pa.RecordBatch.from_arrays([*(cells[n] for n in names), pa.array(n_words), pa.array(n_removed)], names=[*names, "__n_words", "__n_removed"])

    return texts.mapInArrow(make, T.StructType([*docs.schema.fields, T.StructField("__n_words", T.LongType()), T.StructField("__n_removed", T.LongType())]))

"""How sources of one language differ in their words: exact integer divergences.

A group is a (lang, source) pair. Words are counted inside Arrow batches, so a text
gives one row per different word of a few megabytes; Spark adds them up by
(lang, term), which brings a term's sources together and cannot be skewed by a large source.

Terms: of each group the ``TOP`` terms that diverge most from their language. A term is dominated
by another one with at least its group count, at most its language count and an
earlier spelling; its value cannot be higher then. Partitions keep the terms that
fewer than ``TOP`` others dominate, a skyband; skybands are merged by dropping what is dominated in
their union, and what is left is ranked exactly.

Pairs: the summed divergence of each source from each other source of its language. Sources are
cut into blocks of ``BLOCK``; for each pair of blocks terms are dealt over tasks,
which turn a few thousand terms at a time into a matrix of counts and add up
the sources' values in integers. Terms that neither block has are counted in at the end.

All numbers are exact: quotients by long division in steps of three digits, sums in two halves.

Defined cases: null text, lang and source are ''; a group without terms has no term rows and pairs
like any other; a language without kept terms has pairs of value 0; one with a single source
has no pairs; every row is a document, also repeated ones; texts of any
length are read whole; equal values are ranked by the item's UTF-8 bytes; an empty table gives
no rows; other columns are not read, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from contentloom.llm.words import codes, owners, pieces, split_words
from contentloom.session import materialize

MIN_DOCS, TOP, SCALE = 3, 200, 10**9
# Sources of one language in a matrix; more are cut into blocks.
BLOCK = 256
# Rows of one shard of a pair of blocks, and terms of one matrix.
SHARD_ROWS, TERMS = 200_000, 1024
# Group lists of so many rows are sent to the tasks.
SEND_GROUPS = 10_000
# Texts counted at a time.
PIECE_BYTES = 4 << 20
# Letters in lower case, bytes of other scripts as they are, all else a blank.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, occurrences ``n`` and documents ``docs``, summed per few megabytes of text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                offsets, words = split_words(piece.column("text"), LETTERS)
                word, terms = codes(words)
                lang, langs = codes(piece.column("lang"))
                source, sources = codes(piece.column("source"))
                text = owners(offsets)
                # One number per (group, term), and per text of the group too.
                n_terms, group = max(len(terms), 1), lang * len(sources) + source
                in_text, times = np.unique(text * n_terms + word, return_counts=True)
                key = group[in_text // n_terms] * n_terms + in_text % n_terms
                order = np.argsort(key, kind="stable")
                key, times = key[order], times[order]
                at = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
                key = key[at]
                n = np.add.reduceat(times, at) if len(at) else at
                docs_of = np.diff(np.concatenate([at, [len(times)]])) if len(at) else at
                g = key // n_terms
                columns = [langs.take(pa.array(g // max(len(sources), 1))), sources.take(pa.array(g % max(len(sources), 1))), terms.take(pa.array(key % n_terms)), pa.array(n.astype(np.int64)), pa.array(docs_of.astype(np.int64))]
                columns = [c.cast(pa.string()) if i < 3 else c for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    return docs.mapInArrow(make, "lang string, source string, term string, n long, docs long")


def kept_terms(counted: DataFrame) -> DataFrame:
    """Counts ``g`` of each kept term in its groups and ``l`` in its language; ``head`` marks one row of each term.

    The counts are dealt by (lang, term) once, for the sums of the group and of the language.
    """
    of_term = Window.partitionBy("lang", "term")
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("g"), F.sum("docs").alias("docs"))
    both = summed.withColumns({"l": F.sum("g").over(of_term), "in_docs": F.sum("docs").over(of_term), "head": F.min("source").over(of_term) == F.col("source")})
    return both.where(F.col("in_docs") >= MIN_DOCS).drop("docs", "in_docs")


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """All groups with ``d``, N + V of the group, ``dl``, N + V of its language, ``v`` and ``idx``, the source's number in its language."""
    sums = kept.groupBy("lang", "source").agg(F.sum("g").alias("n"), F.count_if("head").alias("heads"))
    of_lang = sums.groupBy("lang").agg(F.sum("n").alias("nl"), F.sum("heads").alias("v"))
    zero = F.lit(0).cast("long")
    every = docs.select("lang", "source").distinct().join(sums.drop("heads"), ["lang", "source"], "left").join(of_lang, "lang", "left")
    v, number = F.coalesce("v", zero), F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return every.select("lang", "source", (F.coalesce("n", zero) + v).alias("d"), (F.coalesce("nl", zero) + v).alias("dl"), v.alias("v"), number.cast("long").alias("idx"))


def share(count: Column, d: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / d) by long division, three digits at a time."""
    value, rest = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        value, rest = value * 1000 + F.call_function("div", rest * 1000, d), (rest * 1000) % d
    return value + 1


def _shares(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    value, rest = np.zeros_like(count), count + 1
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, d)
        value = value * 1000 + more
    return value + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def skyband(g: np.ndarray, l: np.ndarray, spelling: np.ndarray, k: int = TOP, step: int = 512) -> np.ndarray:
    """Places of the rows that fewer than ``k`` others dominate by higher ``g``, lower ``l`` and earlier ``spelling``, all different.

    Rows are taken in an order in which all that dominate a row come before it. Only kept rows
    need to be counted: of a row's dominators the first ``k`` are kept themselves.
    """
    order = np.lexsort((spelling, l, -g))
    g, l, r = g[order], l[order], spelling[order]
    at = np.arange(len(g))
    first = np.maximum.accumulate(np.where(np.concatenate([np.ones(min(len(g), 1), bool), (g[1:] != g[:-1]) | (l[1:] != l[:-1])]), at, 0))
    order, l, r = (x[at - first < k] for x in (order, l, r))  # of equal counts the later spellings
    kept_l, kept_r, kept = np.zeros(0, l.dtype), np.zeros(0, r.dtype), []
    earlier = np.triu(np.ones((step, step), bool), 1)
    for s in range(0, len(order), step):
        x, y = l[s:s + step], r[s:s + step]
        above = ((kept_l[:, None] <= x) & (kept_r[:, None] <= y)).sum(axis=0)
        above += ((x[:, None] <= x) & (y[:, None] <= y) & earlier[:len(x), :len(x)]).sum(axis=0)
        ok = above < k
        kept.append(order[s:s + step][ok])
        kept_l, kept_r = np.concatenate([kept_l, x[ok]]), np.concatenate([kept_r, y[ok]])
    return np.concatenate(kept) if kept else order


def _skybands(rows: DataFrame, k: int, part: Column, buffer: int = 65_536) -> DataFrame:
    """The skyband of each group among the rows of a task, which come sorted by group; ``part`` says for what merge they go."""
    kind = rows.select("lang", "source", "term", "g", "l", "p", "q")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def reduced(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            spelling = np.empty(len(table), np.int64)
            spelling[pc.sort_indices(pc.cast(table["term"], pa.binary())).to_numpy()] = np.arange(len(table))
            return table.take(pa.array(skyband(table["g"].to_numpy(), table["l"].to_numpy(), spelling, k)))

        limit = buffer
        for batch in batches:
            lang, source = codes(batch.column("lang"))[0], codes(batch.column("source"))[0]
            new = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (source[1:] != source[:-1])])) if batch.num_rows else []
            for a, b in zip(new, [*new[1:], batch.num_rows]):
                run = pa.Table.from_batches([batch.slice(a, b - a)])
                if held and (held[0]["lang"][0], held[0]["source"][0]) != (run["lang"][0], run["source"][0]):
                    yield from reduced(pa.concat_tables(held)).to_batches()
                    held, n, limit = [], 0, buffer
                held.append(run)
                n += len(run)
                if n > limit:  # what a buffer keeps is a skyband too, and the next one starts with it
                    held = [reduced(pa.concat_tables(held))]
                    n = len(held[0])
                    limit = max(buffer, 2 * n)
        if held:
            yield from reduced(pa.concat_tables(held)).to_batches()

    return kind.mapInArrow(make, kind.schema).withColumn("part", part)


def terms(kept: DataFrame, groups: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` most divergent terms of each group: lang, source, item, value and rank."""
    few = groups.count() <= SEND_GROUPS
    d = groups.where("v > 0").select("lang", "source", "d", "dl")
    met = kept.join(F.broadcast(d) if few else d, ["lang", "source"]).select("lang", "source", "term", "g", "l", share(F.col("g"), F.col("d")).alias("p"), share(F.col("l"), F.col("dl")).alias("q"))
    parts = _skybands(met.where("p > q").sortWithinPartitions("lang", "source"), k, F.pmod(F.spark_partition_id(), F.lit(16)))
    for keys in (["lang", "source", "part"], ["lang", "source"]):
        parts = _skybands(parts.repartition(*keys).sortWithinPartitions(*keys), k, F.lit(0))
    valued = parts.select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


SUMS = pa.schema([("lang", pa.string()), *[(c, pa.int64()) for c in ("a", "b", "lo", "hi", "seen")]])


class _Sums:
    """One pair of blocks: its sources with their sizes, and the sums of all matrices so far."""

    def __init__(self, key: tuple, block: int, terms: int):
        self.key, self.block, self.terms, self.idx, self.d, self.seen = key, block, terms, np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.columns: list[np.ndarray] | None = None
        self.rest: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []

    def heads(self, idx: np.ndarray, d: np.ndarray) -> None:
        self.idx, self.d = np.concatenate([self.idx, idx]), np.concatenate([self.d, d])

    def start(self) -> None:
        """All sources are known, as they come before the terms."""
        if self.columns is not None:
            return
        order = np.argsort(self.idx)
        self.idx, self.d = self.idx[order], self.d[order]
        self.lo, self.hi = (np.zeros((len(order), len(order)), np.int64) for _ in range(2))
        i, j = self.key[1:3]
        side = self.idx // self.block
        self.columns = [np.flatnonzero(side == (j if s == i else i)) for s in side]

    def add(self, idx: np.ndarray, names: pa.Array, g: np.ndarray, last: bool = False) -> None:
        """Take rows of sorted terms; a term that may go on waits for the next rows."""
        self.start()
        if len(idx):
            self.rest.append((idx, names, g))
        n = sum(len(r[0]) for r in self.rest)
        if not n or (not last and n < 8 * self.terms):
            return
        idx, g = (np.concatenate([r[k] for r in self.rest]) for k in (0, 2))
        names = pa.concat_arrays([r[1] for r in self.rest])
        new = np.concatenate([[True], np.asarray(pc.not_equal(names[1:], names[:-1]))])
        end = n if last else int(np.flatnonzero(new)[-1])
        self.rest = [] if last else [(idx[end:], names[end:], g[end:])]
        row = np.cumsum(new)[:end] - 1
        at = np.searchsorted(self.idx, idx[:end])
        for first in range(0, int(row[-1]) + 1 if end else 0, self.terms):
            a, b = np.searchsorted(row, (first, first + self.terms))
            count = np.zeros((int(row[b - 1]) - first + 1, len(self.idx)), np.int64)
            count[row[a:b] - first, at[a:b]] = g[a:b]
            self.seen += len(count)
            q = _shares(count, self.d[None, :])
            for k, others in enumerate(self.columns):
                part = q[:, others]
                apart = q[:, k:k + 1] - part
                f = apart * apart // part
                self.lo[k, others] += (f & 0xFFFFFFFF).sum(axis=0)
                self.hi[k, others] += (f >> 32).sum(axis=0)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.add(np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), last=True)
        for k, others in enumerate(self.columns):
            others = others[others != k]
            n = len(others)
            yield pa.RecordBatch.from_arrays([pa.array([self.key[0]] * n, pa.string()), *(pa.array(c) for c in (np.full(n, self.idx[k]), self.idx[others], self.lo[k, others], self.hi[k, others], np.full(n, self.seen)))], schema=SUMS)


def _pair_sums(kept: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """Per language and ordered pair of sources ``a``, ``b``: the value's halves ``lo`` and ``hi`` over the terms that their blocks have, and the number ``seen`` of those."""
    n_rows = kept.count()
    blocks = groups.groupBy("lang").agg((F.floor(F.max("idx") / block) + 1).alias("nb"))
    known = groups.where("v > 0").join(blocks, "lang").select("lang", "source", "d", "idx", "nb", F.floor(F.col("idx") / block).alias("b"))
    few = groups.count() <= SEND_GROUPS
    shards, n_terms = max(1, -(-n_rows // SHARD_ROWS)), TERMS
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("o")
    low, high = F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j")
    cells = kept.join(F.broadcast(known) if few else known, ["lang", "source"]).select("lang", "term", "g", "idx", "b", other).select("lang", low, high, F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard"), "term", "idx", "g")
    heads = known.select("lang", "d", "idx", "b", other).select("lang", low, high, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(None).cast("string").alias("term"), "idx", F.col("d").alias("g"))
    keys = ["lang", "i", "j", "shard"]
    dealt = heads.union(cells).repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_first("term"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = {c: batch.column(c) for c in batch.schema.names}
            lang, (i, j, shard, idx, g) = codes(table["lang"])[0], (table[c].to_numpy() for c in ("i", "j", "shard", "idx", "g"))
            key = np.stack([lang, i, j, shard])
            new = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            names = table["term"].cast(pa.string())
            is_head = np.asarray(names.is_null())
            for a, b in zip(new, [*new[1:], batch.num_rows]):
                own = (table["lang"][int(a)].as_py(), int(i[a]), int(j[a]), int(shard[a]))
                if state is None or state.key != own:
                    if state is not None:
                        yield from state.rows()
                    state = _Sums(own, block, n_terms)
                m = a + int(is_head[a:b].sum())
                state.heads(idx[a:m], g[a:m])
                if m < b:
                    state.add(idx[m:b], names.slice(m, b - m), g[m:b])
        if state is not None:
            yield from state.rows()

    sums = dealt.mapInArrow(make, "lang string, a long, b long, lo long, hi long, seen long")
    # A pair of one block comes once per shard, one of two blocks as well.
    return sums.groupBy("lang", "a", "b").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.sum("seen").alias("seen"))


def source_pairs(kept: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every source with every other one of its language: lang, source, item, value and rank."""
    one = groups.select("lang", F.col("source"), F.col("idx").alias("a"), F.col("d").alias("da"), "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("idx").alias("b"), F.col("d").alias("db"))
    pairs = one.join(other, "lang").where("a <> b").join(_pair_sums(kept, groups, block), ["lang", "a", "b"], "left")
    zero = F.lit(0).cast("long")
    rest = (F.col("v") - F.coalesce("seen", zero)) * divergence(share(zero, F.col("da")), share(zero, F.col("db")))
    value = F.when(F.col("v") == 0, zero).otherwise(F.coalesce("hi", zero) * (1 << 32) + F.coalesce("lo", zero) + rest)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select("lang", "source", "item", value.alias("value")).withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, k: int = TOP, block: int = BLOCK) -> DataFrame:
    """Both parts: lang, source, part (``pair`` or ``term``), item, value and rank."""
    rows = _rows(docs)
    kept = materialize(kept_terms(counts(rows)), "terms")
    groups = materialize(groups_of(rows, kept), "groups")
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return named(source_pairs(kept, groups, block), "pair").union(named(terms(kept, groups, k), "term"))

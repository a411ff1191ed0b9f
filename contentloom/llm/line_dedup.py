"""Line deduplication by a deletion-neighbourhood join.

A line goes if an earlier line equals it or differs from it by at most ``edits`` edits (a
character added, lost or changed). Lines are ordered by document id and place. Two lines
within so many edits share a variant: the line without some of its characters, as many at most.
Each line emits its variants as hashed keys with the gaps where characters are lost; equal
keys meet in a grouping, not in pairs. Two lines of one variant are within as many edits as their gaps
have together, shared ones counted once, whatever the characters. So for each part of a line's gaps
the earliest line that shares this part is enough, one for each number of gaps in all.

Only lines that can have a partner emit variants: of ``edits`` + 1 parts of the longer line the edits
leave one as it is, so lines that share no part with a different line
are left out. This loses nothing. Every link is verified by the edit distance of the texts.

Defined cases: lines without a word, null and empty texts stay as they
are; a null id counts as the largest; rows that repeat an id with one text are one document and
get one result, other rows of an id are ordered by line and text; lines keep their characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from contentloom.llm.columns import apart, free, together
from contentloom.llm.sidelists import LAST, ROW, beside, hash_of
from contentloom.llm.words import MUL, TEXT_ROWS, mixed, pieces, powers
from contentloom.session import materialize

EDITS = 1
# Texts and variants taken at a time; a line's keys take more memory than the line.
PIECE_BYTES, VARIANTS = 1 << 20, 1 << 18
# Where a line stands, in the order of lines: n is its number in the text.
AT = ["id", "n", "t1", "t2"]


def _parts(n: int, edits: int) -> list[tuple[int, int, int]]:
    """Size of the longer line, number of the part and shift of each key of a line of ``n`` characters, as the longer or the shorter of two."""
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            fixed = 0 if i == 0 else -less if i == edits else None
            shifts = range(-edits, edits + 1) if fixed is None else (fixed,)
            out += [(n + less, i, d) for d in shifts if abs(d) + abs(less + d) <= edits]
    return out


def _halves(line: str, edits: int = EDITS) -> list[int]:
    """Keys of the parts of the line, taken as the longer and as the shorter of two."""
    cut = edits + 1
    return [xxhash.xxh3_64_intdigest(line[max(0, size * i // cut + d):max(0, size * (i + 1) // cut + d)], seed=cut * size + i) for size, i, d in _parts(len(line), edits)]


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _takes_part(line: str) -> bool:
    return line.strip(" \t\n\v\f\r") != ""


def _line_rows(texts: DataFrame, edits: int) -> DataFrame:
    """Each line that takes part: where it stands, its 128-bit hash and the keys of its parts."""
    names = [f"k{i}" for i in range(len(_parts(0, edits)))]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                row, number, h, k = [], [], [], []
                for i, text in enumerate(piece.column("text").to_pylist()):
                    for n, line in enumerate(text.split("\n")):
                        if _takes_part(line):
                            row.append(i)
                            number.append(n)
                            h.append(xxhash.xxh3_128_intdigest(line))
                            k.append(_halves(line, edits))
                keys = _signed([x for r in k for x in r]).reshape(-1, len(names))
                own = pa.array(row, pa.int64())
                cells = [*(piece.column(c).take(own) for c in ROW), pa.array(number, pa.int64()), pa.array(_signed([x >> 64 for x in h])), pa.array(_signed([x & (2**64 - 1) for x in h]))]
                yield pa.RecordBatch.from_arrays([*cells, *(pa.array(np.ascontiguousarray(keys[:, c])) for c in range(len(names)))], names=[*ROW, "n", "h1", "h2", *names])

    return texts.select("id", "text").withColumns(hash_of()).mapInArrow(make, "id long, t1 long, t2 long, n long, h1 long, h2 long, " + ", ".join(f"{n} long" for n in names))


def _lists(spots: DataFrame) -> DataFrame:
    """What a row is known by and the line numbers in ``places``; no list is longer than its text."""
    made = spots.groupBy(*ROW).agg(F.array_sort(F.collect_set("n")).alias("n"))
    return made.select(*ROW, F.array_join("n", ",").cast("binary").alias("places"))


def _lines_of(places: bytes | None) -> set[int]:
    return {int(n) for n in places.split(b",")} if places else set()


def _texts_of(texts: DataFrame) -> DataFrame:
    """Where the listed lines stand, and their text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                row, number, line = [], [], []
                for i, (text, places) in enumerate(zip(piece.column("text").to_pylist(), piece.column("__places").to_pylist())):
                    wanted = _lines_of(places)
                    for n, x in enumerate(text.split("\n")) if wanted else ():
                        if n in wanted:
                            row.append(i)
                            number.append(n)
                            line.append(x)
                own = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(piece.column(c).take(own) for c in ROW), pa.array(number, pa.int64()), pa.array(line, pa.string())], names=[*ROW, "n", "line"])

    return texts.select("id", F.col("__t1").alias("t1"), F.col("__t2").alias("t2"), "text", "__places").mapInArrow(make, "id long, t1 long, t2 long, n long, line string").dropDuplicates(AT)


def variants(line: str) -> np.ndarray:
    """Hashes of the line and, behind it, of the line without its first, second, ... character."""
    c = mixed(np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + MUL)
    power, inverse = powers(len(c) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * power[:len(c)], dtype=np.uint64)])
    without = sums[:-1] + (sums[-1] - sums[1:]) * inverse[1]
    return mixed(np.concatenate([sums[-1:], without]))


def _bits(edits: int) -> int:
    """Bits of one gap in the number that holds all gaps of a variant."""
    return 63 // edits


def deep_variants(line: str, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the line without up to ``edits`` characters, and the gaps of each: place + 1, the first gap lowest; 0 if none is lost."""
    own = variants(line)
    hashes, gaps, bits = [own], [np.arange(len(own))], _bits(edits)
    if len(line) >= (1 << bits) - 1:
        raise ValueError(f"a line of {len(line)} characters is too long for {edits} edits")
    # What is left of the line, the place from which on more may be lost, the gaps so far.
    left = [(line, 0, 0)]
    for depth in range(1, edits):
        left = [(x[:i] + x[i + 1:], i, g | ((i + 1) << (bits * (depth - 1)))) for x, start, g in left for i in range(start, len(x))]
        for x, start, g in left:
            hashes.append(variants(x)[1 + start:])
            gaps.append(g | ((np.arange(start, len(x)) + 1) << (bits * depth)))
    return np.concatenate(hashes), np.concatenate(gaps)


def _variant_rows(lines: DataFrame, edits: int) -> DataFrame:
    """``v`` and ``p`` (the gaps of the lost characters, 0: the line itself) with ``me``."""

    def made(lines: pa.Array, mes: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held, size = [], 0
        for line, me in zip(lines.to_pylist(), mes.to_pylist()):
            v, p = deep_variants(line, edits)
            held.append((v, p, np.full(len(v), me)))
            size += len(v)
            if size >= VARIANTS:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*held)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "line", PIECE_BYTES):
                for v, p, me in made(piece.column("line"), piece.column("me")):
                    for a in range(0, len(v), VARIANTS):
                        part = slice(a, a + VARIANTS)
                        yield pa.RecordBatch.from_arrays([pa.array(v[part].view(np.int64)), pa.array(p[part]), pa.array(me[part])], names=["v", "p", "me"])

    return lines.select("line", "me").mapInArrow(make, "v long, p long, me long")


def _late(lines: DataFrame, edits: int) -> DataFrame:
    """``me``: lines within ``edits`` edits of an earlier one. ``lines``: ``me``, in the order of the lines, and ``line``, all different."""
    bits = _bits(edits)
    gap = lambda p, i: F.shiftright(p, bits * i).bitwiseAND((1 << bits) - 1)
    n_gaps = lambda p: sum([(gap(F.col(p), i) > 0).cast("int") for i in range(edits)], F.lit(0))

    def part(of: tuple[int, ...]):
        return sum([F.shiftleft(gap(F.col("p"), i), bits * k) for k, i in enumerate(of)], F.lit(0).cast("long"))

    parts = F.array_distinct(F.array(*[part(c) for n in range(edits + 1) for c in combinations(range(edits), n)]))
    rows = _variant_rows(lines, edits)
    same = materialize(rows.groupBy("v", "p").agg(F.min("me").alias("m"), F.count("*").alias("n")), "variants")
    # A part that is all of the most gaps is shared by lines of the same gaps only, which are grouped already.
    whole = (F.col("q") == F.col("p")) & (n_gaps("p") == edits)
    shared = same.select("v", "p", "m", "n", F.explode(parts).alias("q")).where(~whole).groupBy("v", "q").agg(
        F.sum("n").alias("n"), *[F.min(F.when(n_gaps("p") == i, F.col("m"))).alias(f"m{i}") for i in range(edits + 1)])
    can_meet = F.coalesce(*[F.when(F.lit(2 * i) <= edits + n_gaps("q"), F.col(f"m{i}")) for i in range(edits + 1)])
    shared = shared.where((F.col("n") > 1) & can_meet.isNotNull()).drop("n")
    # Spark takes the variants of lines, or of parts, for as few rows as the lines and would broadcast them; one row a key is hashed instead.
    swapped = rows.where(n_gaps("p") == edits).join(same.where("n > 1").hint("shuffle_hash"), ["v", "p"]).select("me", F.col("m").alias("by"))
    room = edits - n_gaps("p") + n_gaps("q")
    earliest = F.least(*[F.when(F.lit(i) <= room, F.col(f"m{i}")) for i in range(edits + 1)])
    longer = rows.select("v", "p", "me", F.explode(parts).alias("q")).where(~whole).join(shared.hint("shuffle_hash"), ["v", "q"]).select("me", earliest.alias("by"))
    pairs = swapped.union(longer).where(F.col("by") < F.col("me")).distinct()
    one, two = lines.select("me", F.col("line").alias("a")), lines.select(F.col("me").alias("by"), F.col("line").alias("b"))
    checked = pairs.join(one.hint("merge"), "me").join(two.hint("merge"), "by").where(F.levenshtein("a", "b", edits).between(0, edits))
    return checked.select("me").distinct()


def removed_lines(texts: DataFrame, edits: int = EDITS) -> DataFrame:
    """Where the lines stand that go. ``texts`` has ``id`` and ``text`` without nulls."""
    names = [f"k{i}" for i in range(len(_parts(0, edits)))]
    lines = materialize(_line_rows(texts, edits), "lines", batch_rows=TEXT_ROWS)
    at = F.struct(*AT)
    first = lines.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("times"), *[F.first(k).alias(k) for k in names])
    first = materialize(first, "first-lines")
    again = lines.select(*AT, "h1", "h2").join(first.where("times > 1").select("h1", "h2", "first"), ["h1", "h2"]).where(at != F.col("first")).select(*AT)
    keys = first.select(F.explode(F.array(*names)).alias("k"), "h1", "first")
    shared = keys.groupBy("k").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("k")
    candidates = keys.join(shared.hint("shuffle_hash"), "k").select("first.*").distinct()
    lists = materialize(_lists(candidates), "candidates")
    # Numbers that grow with the lines' order stand for their places.
    found = _texts_of(beside(texts, lists, "id", "inner")).orderBy(*AT).withColumn("me", F.monotonically_increasing_id())
    found = materialize(found, "candidate-lines", batch_rows=TEXT_ROWS)
    return again.union(found.join(_late(found, edits).hint("merge"), "me").select(*AT))


def deduplicated(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The documents without those lines, with ``__n_lines`` and ``__n_removed``; columns named like the operator's own (``columns.OWN``) are replaced."""
    docs = free(docs)
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "text").where(F.col("text").isNotNull())
    gone = materialize(_lists(removed_lines(plain, edits)), "removed-lines")
    names = docs.columns
    texts = beside(docs, gone, "doc_id", "left").select(*names, "__places")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                text, places = piece.column("text").to_pylist(), piece.column("__places")
                n_lines, n_removed = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
                for i, t in enumerate(text):
                    if t is None:
                        continue
                    n_lines[i] = t.count("\n") + 1
                    drop = _lines_of(places[i].as_py())
                    if drop:
                        n_removed[i] = len(drop)
                        text[i] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop)
                cells = dict(zip(piece.schema.names, piece.columns)) | {"text": pa.array(text, pa.string())}
                yield pa.RecordBatch.from_arrays([*(cells[n] for n in names), pa.array(n_lines), pa.array(n_removed)], names=[*names, "__n_lines", "__n_removed"])

    return texts.mapInArrow(make, T.StructType([*docs.schema.fields, T.StructField("__n_lines", T.LongType()), T.StructField("__n_removed", T.LongType())]))


def with_text_left(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The deduplicated documents, without those that had words and lost them all."""
    found = deduplicated(apart(docs, "doc_id", "text"), edits)
    return together(found.where((F.col("__n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns, "doc_id", "text")

"""Quality scores by the nearest labelled neighbours in a latent-semantic space.

Terms of a text are its words and their shapes (length, capitals, signs), how often a
word recurs, and the size of the text. TF-IDF rows are projected on the leading singular
vectors of the labelled sample. The labelled vectors are sent to all tasks; each document is
compared with all of them in blocks, and its nearest ones vote with their similarity.

The sample has at most ``PER_CLASS`` documents per class, so everything sent is bounded;
document frequencies are counted over all documents. A class's votes weigh as many
labelled documents as each of its sample stands for.

Defined cases: null and empty texts have the size term only and are scored by it; null labels,
labels of unknown documents and documents with two different labels teach nothing; of several rows
of a labelled id the smallest text teaches; without any label all scores are 0.5; repeated rows and null ids are scored row by
row; texts of any length count whole; an empty table gives no rows; other columns pass through, one named ``__score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from contentloom.llm.features import counted, document_counts, inverse_frequency, product, weights
from contentloom.llm.words import codes, hashed, owners, pieces, split_words

FEATURES, RANK, NEIGHBOURS, PER_CLASS = 1 << 13, 64, 24, 1024
WORDS = FEATURES // 2
BLOCK = 2048
# What a byte counts as in a word's shape.
SIGN = np.array([b < 0x80 and not chr(b).isalnum() and b not in b".,;:'\"!?-()" for b in range(256)])
CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
MARK = np.array([b in b"!?" for b in range(256)])


def _shapes(words: pa.Array) -> np.ndarray:
    """A small number for each word's length, capitals, signs and exclamation marks."""
    words = pa.concat_arrays([words.cast(pa.large_string())])
    if not len(words):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
    data = np.frombuffer(words.buffers()[2], np.uint8)[:offsets[-1]]
    size = np.diff(offsets)
    total = lambda flag: np.add.reduceat(flag[data].astype(np.int64), offsets[:-1])
    capital = total(CAPITAL)
    parts = np.stack([np.minimum(size, 15), np.where(capital > 1, 2, capital), np.minimum(total(SIGN), 3), np.minimum(total(MARK), 2)])
    return ((parts[0] * 3 + parts[1]) * 4 + parts[2]) * 3 + parts[3]


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and hashed term of each occurrence."""
    offsets, words = split_words(texts, fold=False)
    own, n = owners(offsets), np.diff(offsets)
    index, different = codes(words)
    h = hashed(different)
    word = (h % np.uint64(WORDS)).astype(np.int64)[index]
    shape = WORDS + 64 + _shapes(different)[index]
    t, w, times = counted(own, index, max(1, len(different)))
    again = WORDS + np.minimum(np.log2(times), 15).astype(np.int64)
    share = np.bincount(t, minlength=len(texts)) / np.maximum(n, 1)
    sizes = WORDS + 16 + np.minimum(np.log2(n + 1), 20).astype(np.int64)
    variety = WORDS + 40 + np.minimum(share * 16, 15).astype(np.int64)
    rows = np.arange(len(texts))
    # Properties of the whole text weigh as several occurrences.
    return np.concatenate([own, own, t, np.repeat(rows, 16), np.repeat(rows, 16)]), np.concatenate([word, shape, again, np.repeat(sizes, 16), np.repeat(variety, 16)])


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    label: np.ndarray


def _rows(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, f, n = counted(*terms(texts), FEATURES)
    return t, f, weights(t, n, f, idf, len(texts))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def teaching_labels(labels: DataFrame, teaches: Column, key: str = "doc_id") -> DataFrame:
    """``key`` and ``quality`` of documents with one sure label that may be learned from."""
    one = labels.where(F.col(key).isNotNull() & F.col("quality").isin(0, 1) & teaches).groupBy(key).agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    return one.where("quality = most").select(key, "quality")


def fitted(docs: DataFrame, labels: DataFrame, teaches: Column, key: str = "doc_id", per_class: int = PER_CLASS) -> Model:
    found, rows = document_counts(docs, terms, FEATURES)
    idf = inverse_frequency(found, rows)
    sure = teaching_labels(labels, teaches, key)
    totals = {r["quality"]: r["n"] for r in sure.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(key)
    sample = sure.where("quality = 0").orderBy(order, key).limit(per_class).union(sure.where("quality = 1").orderBy(order, key).limit(per_class))
    # One text per document that teaches: of several rows of its id the smallest text.
    known = docs.select(key, "text").join(F.broadcast(sample), key).groupBy(key, "quality").agg(F.min("text").alias("text")).select("text", "quality").dropDuplicates()
    # Bounded by 2 * per_class labelled rows; only their terms reach the driver.

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                t, f, w = _rows(piece.column("text"), idf)
                ends = np.searchsorted(t, np.arange(piece.num_rows + 1))
                lists = [(f[a:b].astype(np.int32).tobytes(), w[a:b].astype(np.float32).tobytes()) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([piece.column("quality").cast(pa.int32()), pa.array([x for x, _ in lists], pa.binary()), pa.array([x for _, x in lists], pa.binary())], names=["quality", "f", "w"])

    got = sorted(known.mapInArrow(sparse, "quality int, f binary, w binary").collect(), key=lambda r: (r["quality"], bytes(r["f"]), bytes(r["w"])))
    x = np.zeros((len(got), FEATURES), np.float32)
    for row, r in zip(x, got):
        row[np.frombuffer(r["f"], np.int32)] = np.frombuffer(r["w"], np.float32)
    label = np.array([r["quality"] for r in got], np.int64)
    values, left = np.linalg.eigh((x @ x.T).astype(np.float64)) if len(got) else (np.zeros(0), np.zeros((0, 0)))
    keep = [i for i in range(len(values) - 1, -1, -1) if values[i] > 1e-6][:RANK]
    basis = (x.T @ (left[:, keep] / np.sqrt(values[keep]))) if keep else np.zeros((FEATURES, 1))
    each = np.bincount(label, minlength=2)
    votes = np.array([totals.get(c, 0) / max(1, each[c]) for c in (0, 1)])[label]
    return Model(idf, basis.astype(np.float32), _unit(x @ basis).astype(np.float32), votes, label)


def scores(texts: pa.Array, model: Model, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Score of each text: share of the similarity-weighted votes for label 1."""
    if not len(model.label):
        return np.full(len(texts), 0.5)
    t, f, w = _rows(texts, model.idf)
    vectors = _unit(product(t, f, w, model.basis, len(texts))).astype(np.float32)
    k, out = min(neighbours, len(model.label)), np.zeros(len(texts))
    for a in range(0, len(texts), BLOCK):
        near = vectors[a:a + BLOCK] @ model.vectors.T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(near, top, 1), 1e-6).astype(np.float64) ** 8 * model.votes[top]
        out[a:a + BLOCK] = (vote * model.label[top]).sum(1) / vote.sum(1)
    return out


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``__score``; no shuffle."""
    docs = docs.drop("__score")
    held, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                cells = dict(zip(piece.schema.names, piece.columns))
                yield pa.RecordBatch.from_arrays([*(cells[n] for n in names), pa.array(scores(piece.column(text), held.value))], names=[*names, "__score"])

    return docs.mapInArrow(make, T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())]))

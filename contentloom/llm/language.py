"""Language identification by sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams of one to three characters within words, weighted by TF-IDF with
document frequencies counted over all documents that may be learned from. The weights are trained with
follow-the-regularised-leader and an elastic net: the L1 part keeps most of them at zero,
the L2 part keeps the others small. A temperature fitted on a part of the sample that was
not trained on calibrates the scores.

The sample takes about ``PER_LANGUAGE`` documents of every language, all of a rare one;
this bounds what is trained on. The weights that are sent have one column per language. Rows are drawn by a hash, so
retries draw the same ones.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any
sample every text is ``und``; null languages teach nothing; texts of any length count whole; repeated rows
and null ids are predicted row by row, but equal texts of one language teach once; of equally likely languages the
first in the alphabet is taken; an empty table gives no rows; other columns pass through, those named ``__lang`` and ``__score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from contentloom.llm.features import document_counts, inverse_frequency, product, weights
from contentloom.llm.words import mixed, pieces, plain_text

FEATURES, GRAMS = 1 << 13, 3
PER_LANGUAGE = 400
# Training: step size, its offset, and the two penalties.
STEP, OFFSET, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 4
UNKNOWN = "und"
CHUNK = 1 << 19


def _letters(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    return np.asarray(pc.match_substring_regex(plain_text(texts), r"\pL"))


def _grams(c: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of the n-grams of characters ``c``; n-grams do not reach over a blank."""
    blank = c == 32
    texts, found, h = [], [], np.zeros(len(c), np.uint64)
    for n in range(1, GRAMS + 1):
        size = len(c) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint64(0x100000001B3) + c[n - 1:].astype(np.uint64)
        # A blank may begin or end an n-gram, which then marks an end of a word.
        ok = own[:size] == own[n - 1:]
        for k in range(1, n - 1):
            ok &= ~blank[k:size + k]
        ok &= ~(blank[:size] & blank[n - 1:])
        at = np.flatnonzero(ok)
        texts.append(own[at])
        found.append((mixed(h[at] + np.uint64(n)) % np.uint64(FEATURES)).astype(np.int64))
    return (np.concatenate(texts), np.concatenate(found)) if texts else (np.zeros(0, np.int64),) * 2


def _counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts of all n-grams; blocks of characters are counted one after another."""
    folded = pc.replace_substring_regex(pc.utf8_lower(plain_text(texts)), r"[^\pL]+", " ")
    sizes = np.asarray(pc.utf8_length(folded)).astype(np.int64)
    c = np.frombuffer("".join(folded.to_pylist()).encode("utf-32-le"), np.uint32)
    own = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    parts, start = [], 0
    while start < len(texts):
        # Whole texts up to a block; their rows are counted in one dense table.
        stop = start + 1
        while stop < len(texts) and stop - start < 64 and ends[stop] - (ends[start - 1] if start else 0) <= CHUNK:
            stop += 1
        a, b = (ends[start - 1] if start else 0), ends[stop - 1]
        t, f = _grams(c[a:b], own[a:b])
        table = np.bincount((t - start) * FEATURES + f, minlength=(stop - start) * FEATURES)
        key = np.flatnonzero(table)
        parts.append((key // FEATURES + start, key % FEATURES, table[key]))
        start = stop
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3


def _occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    t, f, _ = _counts(texts)
    return t, f


@dataclass
class Model:
    idf: np.ndarray
    names: list[str]
    w: np.ndarray
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def followed(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, classes: int, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Weights after ``EPOCHS`` passes over sparse rows (features, values); the last feature is the bias."""
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def weight(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        w = -(zf - np.sign(zf) * L1) / ((OFFSET + np.sqrt(n[f])) / STEP + L2)
        return np.where(np.abs(zf) <= L1, 0.0, w)

    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            f, x = np.append(rows[i][0], features), np.append(rows[i][1], 1.0)
            w = weight(f)
            p = _softmax(x @ w)
            p[label[i]] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / STEP
            z[f] += g - s * w
            n[f] += g * g
    w = weight(np.arange(features + 1))
    return w[:-1], w[-1]


def calibrated(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature with the least log loss; 1 without rows."""
    if not len(label):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(label)), label], 1e-12)).mean()
    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def fitted(docs: DataFrame, teaches: Column, key: str = "doc_id") -> Model:
    """Learn from the rows that ``teaches`` allows, and from no other: frequencies, weights and temperature."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & teaches)
    found, rows = document_counts(known, _occurrences, FEATURES)
    idf = inverse_frequency(found, rows)
    totals = known.groupBy("lang").agg(F.count("*").alias("of_lang"))
    draw = F.pmod(F.xxhash64(key, "text"), F.lit(1 << 30)) / float(1 << 30)
    # A row per language, far less than the model, which has a column of weights for each.
    drawn = known.select(key, "text", "lang").join(F.broadcast(totals), "lang").where(draw * F.col("of_lang") < PER_LANGUAGE)
    sample = drawn.select("text", "lang").dropDuplicates()

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                t, f, n = _counts(piece.column("text"))
                w = weights(t, n, f, idf, piece.num_rows)
                ends = np.searchsorted(t, np.arange(piece.num_rows + 1))
                cells = [pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()) for x in (f.astype(np.int32), w.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([piece.column("lang"), *cells], names=["lang", "f", "w"])

    got = sorted(((r["lang"], bytes(r["f"]), bytes(r["w"])) for r in sample.mapInArrow(sparse, "lang string, f binary, w binary").toLocalIterator() if r["f"]))
    names = sorted({r[0] for r in got})
    label = np.array([names.index(r[0]) for r in got], np.int64)
    x = [(np.frombuffer(f, np.int32), np.frombuffer(w, np.float32)) for _, f, w in got]
    held = np.arange(len(x)) % 5 == 0
    if not names:
        return Model(idf, [], np.zeros((FEATURES, 1)), np.zeros(1), 1.0)
    w, bias = followed([r for r, h in zip(x, held) if not h], label[~held], len(names))
    logits = np.array([v @ w[f] + bias for (f, v), h in zip(x, held) if h])
    return Model(idf, names, w, bias, calibrated(logits, label[held]))


def predictions(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    n, letters = len(texts), _letters(texts)
    if not model.names:
        return [UNKNOWN] * n, np.zeros(n)
    t, f, count = _counts(texts)
    p = _softmax((product(t, f, weights(t, count, f, model.idf, n), model.w, n) + model.bias) / model.temperature)
    best = p.argmax(axis=1)
    return [model.names[k] if ok else UNKNOWN for k, ok in zip(best, letters)], np.where(letters, p[np.arange(n), best], 0.0)


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``__lang`` and ``__score``; no shuffle."""
    docs = docs.drop("__lang", "__score")
    held, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                lang, score = predictions(piece.column(text), held.value)
                cells = dict(zip(piece.schema.names, piece.columns))
                yield pa.RecordBatch.from_arrays([*(cells[c] for c in names), pa.array(lang, pa.string()), pa.array(score)], names=[*names, "__lang", "__score"])

    return docs.mapInArrow(make, T.StructType([*docs.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())]))

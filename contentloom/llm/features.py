"""Hashed features of texts as sparse rows, and their counts over a corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contentloom.llm.words import pieces

# Texts to (number of texts, text and feature of each occurrence).
Maker = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def counted(text: np.ndarray, feature: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (text, feature) with their counts, sorted by text."""
    key, n = np.unique(text * size + feature, return_counts=True)
    return key // size, key % size, n


def document_counts(docs: DataFrame, make: Maker, size: int, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, over all rows, and the number of rows.

    A task sends one row per feature it met; there are ``size`` features, so the result is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for piece in pieces(batch, text):
                t, f, _ = counted(*make(piece.column(text)), size)
                found[:size] += np.bincount(f, minlength=size)
                rows += piece.num_rows
        found[size] = rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["feature", "n"])

    out = np.zeros(size + 1, np.int64)
    for r in docs.select(text).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r["feature"]] = r["n"]
    return out[:size], int(out[size])


def inverse_frequency(found: np.ndarray, rows: int) -> np.ndarray:
    return np.log((1 + rows) / (1 + found)) + 1


def weights(text: np.ndarray, n: np.ndarray, feature: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """Dampened TF-IDF of sparse rows, each of length 1."""
    w = (1 + np.log(n)) * idf[feature]
    norm = np.sqrt(np.bincount(text, w * w, minlength=rows))
    return w / norm[text]


def product(text: np.ndarray, feature: np.ndarray, w: np.ndarray, matrix: np.ndarray, rows: int) -> np.ndarray:
    """Sparse rows times a matrix with one row per feature; works in blocks of bounded size."""
    out = np.zeros((rows, matrix.shape[1]))
    block = 1 << 17
    for a in range(0, len(text), block):
        t = text[a:a + block]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        out[t[starts]] += np.add.reduceat(matrix[feature[a:a + block]] * w[a:a + block, None], starts, axis=0)
    return out

"""Words of Arrow batches as flat arrays, and hashes over runs of words.

Used inside ``mapInArrow`` tasks. All functions work on one batch; batches are cut
into pieces of a few megabytes first, so very long texts do not add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 8 << 20
# Rows of an Arrow batch of whole texts, where the plan is written at once.
TEXT_ROWS = 1000
MUL = np.uint64(0x9E3779B97F4A7C15)
# Letters and digits in lower case, bytes of other scripts as they are, all else a blank.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes or are one row."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def plain_text(texts: pa.Array) -> pa.Array:
    """The texts without nulls and without an offset into a larger buffer."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])


def split_words(texts: pa.Array, fold: bool | bytes) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words and the words of all texts, one after another.

    Words are runs without ASCII white space; with ``fold`` they are runs of
    letters, digits and characters outside ASCII, with A-Z in lower case. A table of 256 bytes in
    its place says what each byte becomes before the text is split; bytes of other scripts must stay.
    """
    texts = plain_text(texts)
    if fold:
        _, offsets, data = texts.buffers()
        folded = (data.to_pybytes() if data is not None else b"").translate(FOLD if fold is True else fold)
        texts = pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(folded))
    lists = pc.ascii_split_whitespace(texts)
    offsets, words = np.asarray(lists.offsets), lists.values
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    if full.all():
        return offsets.astype(np.int64), words
    before = np.concatenate([[0], np.cumsum(full)])
    return before[offsets].astype(np.int64), words.filter(pa.array(full))


def codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each word in the list of this batch's different words, and that list."""
    coded = pc.dictionary_encode(words)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


LONG_WORD = 64
BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=7) for b in range(256)], np.uint64)


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word, the same in every task."""
    index, different = codes(words)
    if not len(different):
        return np.zeros(0, np.uint64)
    different = pa.concat_arrays([different.cast(pa.large_string())])
    offsets = np.frombuffer(different.buffers()[1], np.int64, len(different) + 1)
    data = np.frombuffer(different.buffers()[2], np.uint8)
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    start, size = offsets[:-1][order], size[order]
    h = size.astype(np.uint64)
    n_long = int(np.searchsorted(-size, -LONG_WORD, side="left"))
    for k in range(int(size[n_long]) if n_long < len(size) else 0):
        end = int(np.searchsorted(-size, -k, side="left"))  # words longer than k
        h[n_long:end] = h[n_long:end] * MUL + BYTE[data[start[n_long:end] + k]]
    h = mixed(h)
    for i in range(n_long):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i]:start[i] + size[i]])
    out = np.empty_like(h)
    out[order] = h
    return out[index]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Runs:
    """Hashes of any runs of items, from sums over all items before them."""

    def __init__(self, h: np.ndarray):
        power, inverse = powers(len(h) + 1)
        self.inverse = inverse
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:len(h)], dtype=np.uint64)])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hash of the items from ``low`` up to ``high``, their number included."""
        return mixed((self.sums[high] - self.sums[low]) * self.inverse[low] + (high - low).astype(np.uint64))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (MUL, np.uint64(pow(int(MUL), -1, 2**64)))]
    return _POWERS[0], _POWERS[1]


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` items from each place on, as long as they all exist."""
    at = np.arange(max(0, len(h) - length + 1))
    return Runs(h).of(at, at + length)


def owners(offsets: np.ndarray) -> np.ndarray:
    """Text of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def lists_of(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column whose rows take so many of the values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)

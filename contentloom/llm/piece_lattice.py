"""Encoding and decoding with a sentencepiece vocabulary, n best segmentations each.

A text's segmentations are the paths of a lattice over its pieces, scored by the sum of
the vocabulary's scores. Viterbi scores from the left give, for each place, the best score
of all that lies before it; a search from the right that adds them to what it has
collected (A*) therefore meets whole paths in the order of their score.

No piece spans certain neighbours, as a letter and a digit or a letter and a blank. There
every path has a break, so the lattice falls into segments, mostly words; which classes may
stand together is read from the vocabulary. The best paths of a text are
those of its segments, and the next ones differ in the segments with the least loss, so
all segments get their best path and the second one's score, and only as many segments as paths are wanted are
searched for more. Their paths are combined to the n best of the text.

The different segments of some megabytes of text are worked on together, in arrays (``Lattices``): all lattices take a step
of the Viterbi pass at a time and then a step of the search. As the scores from the left are exact, the search for a best path always goes
on from the place it has just come to. Long segments and further paths are searched one by one.

Characters outside the vocabulary become their bytes. Blanks become the vocabulary's blank
mark and one stands before the text, as such vocabularies do; a literal mark is
written as bytes, so decoding gives the text back exactly.

Defined cases: a null text has no pieces and null results; an empty text has none and
score 0; repeated rows and null ids are encoded row by row; of equal scores the path found first is taken; texts of any length are
encoded whole; an empty table gives no rows; other columns pass through, those named like the operator's own (``columns.OWN``) are replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from contentloom.llm.columns import free
from contentloom.llm.words import MUL, pieces

# Fixed value: the vocabulary's mark for a blank.
BLANK = "▁"
N_BEST = 4
# Bytes of segments whose further paths are remembered per process; the store is emptied when full, which changes no result.
REMEMBER_BYTES = 24 << 20
# What an entry of the store takes besides its characters and pieces, about.
ENTRY_BYTES = 320
# Texts encoded at a time; their id lists stand side by side in memory.
PIECE_BYTES = 1 << 20
# Segments of more characters have a lattice of their own; results are the same.
TOGETHER = 64
# Lattices in arrays at a time.
LATTICES = 1 << 12
# Slots for the steps between beginnings of pieces, as a power of two.
HASH_BITS = 18
ADDED = "__n_best array<array<int>>, __scores array<double>, __decoded string"


class Vocabulary:
    """Pieces, scores and byte pieces of a sentencepiece model."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: set[int]):
        self.id = {p: i for i, p in enumerate(pieces) if i not in special and i not in set(byte_ids)}
        self.score = scores
        # Every beginning of a piece with the piece's id, -1 if it is none itself.
        self.begins = {p[:n]: -1 for p in self.id for n in range(1, len(p))} | self.id
        self.bytes = byte_ids
        used = [scores[i] for i in self.id.values() if scores[i] > -1e8]
        # A character in bytes costs more than any piece.
        self.byte_score = min(used) - 10
        self.text = [b"" if i in special else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        for b, i in enumerate(byte_ids):
            self.text[i] = bytes([b])
        self.bytes_of = pa.array(self.text, pa.binary())
        self.segments = self._breaks()
        self.tree = PieceTree(self)
        self.paths_known, self.held = {}, 0

    def remember(self, size: int) -> None:
        """Count what goes into the store; it is emptied when it is full."""
        self.held += ENTRY_BYTES + size
        if self.held > REMEMBER_BYTES:
            for paths in self.paths_known.values():
                paths.clear()
            self.held = 0

    def _breaks(self) -> re.Pattern:
        """The pattern of segments: blanks, then letters, one digit or other characters."""
        odd = "".join(sorted({c for p in self.id for c in p if c.isalnum() and not c.isalpha() and not re.match(r"\d", c)}))
        letter, other = rf"[^\W\d_{re.escape(odd)}]", rf"(?:[^\w{BLANK}\n]|[_{re.escape(odd)}])"
        pattern = re.compile(rf"{BLANK}*(?:{letter}+|\d|{other}+|\n)|{BLANK}+", re.S)
        if all(pattern.fullmatch(p) for p in self.id):
            return pattern
        return re.compile(rf"{BLANK}*[^{BLANK}]*|{BLANK}+", re.S)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.vocab_size())
        by_byte = {int(m.id_to_piece(i)[3:5], 16): i for i in n if m.is_byte(i)}
        special = {i for i in n if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
        return cls([m.id_to_piece(i) for i in n], [m.get_score(i) for i in n], [by_byte[b] for b in range(256)], special)

    def forward(self, segment: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float], float]:
        """For each place, the pieces that end there (start, score and ids) and Viterbi's best score; the score of the second whole path."""
        n, low = len(segment), float("-inf")
        arcs, best, second = [[] for _ in range(n + 1)], [0.0] + [low] * n, [low] * (n + 1)
        get, score, single = self.begins.get, self.score, self.id
        for i in range(n):
            b, c = best[i], second[i]
            found = []
            for j in range(i + 1, n + 1):
                k = get(segment[i:j])
                if k is None:
                    break
                if k >= 0:
                    found.append((j, score[k], (k,)))
            if segment[i] not in single:
                found.append((i + 1, self.byte_score, self._as_bytes(segment[i])))
            for j, s, ids in found:
                arcs[j].append((i, s, ids))
                x = b + s
                if x > best[j]:
                    second[j] = max(best[j], c + s)
                    best[j] = x
                elif x > second[j]:
                    second[j] = x
        return arcs, best, second[n]

    def arcs(self, segment: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each place, the pieces that end there: start, score and ids."""
        return self.forward(segment)[0]

    def _as_bytes(self, character: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in character.encode())

    def first(self, segment: str) -> tuple[tuple[int, ...], float, float]:
        """The best segmentation, its score and what the second one loses."""
        arcs, ahead, second = self.forward(segment)
        (score, ids), = self._search(arcs, ahead, 1)
        return ids, score, score - second

    def best(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations with their scores, best first."""
        arcs, ahead, _ = self.forward(segment)
        return self._search(arcs, ahead, n)

    @staticmethod
    def _search(arcs: list[list[tuple[int, float, tuple[int, ...]]]], ahead: list[float], n: int) -> list[tuple[float, tuple[int, ...]]]:
        """A* from the right; ``ahead`` is the exact score of all that is still to come."""
        found, turn = [], 0
        # Of equal promises the one nearer to the start goes first, so ties cost no search.
        queue = [(-ahead[-1], len(ahead) - 1, 0, 0.0, None)]
        while queue and len(found) < n:
            _, at, _, have, path = heapq.heappop(queue)
            if at == 0:
                ids = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                found.append((have, tuple(ids)))
                continue
            for i, s, ids in arcs[at]:
                turn += 1
                heapq.heappush(queue, (-(have + s + ahead[i]), i, turn, have + s, (ids, path)))
        return found


class PieceTree:
    """The beginnings of a vocabulary's pieces as numbers, in arrays: the empty one is 0."""

    def __init__(self, vocabulary: Vocabulary):
        number = {b: k for k, b in enumerate(vocabulary.begins, 1)} | {"": 0}
        characters = sorted({b[-1] for b in vocabulary.begins})
        # Number of each character; 0 is in no piece.
        self.character = np.zeros(0x110000, np.uint16 if len(characters) < 65535 else np.int32)
        self.character[list(map(ord, characters))] = np.arange(1, len(characters) + 1)
        self.width = len(characters) + 1
        after = np.array([number[b[:-1]] for b in vocabulary.begins], np.int64) * self.width + self.character[[ord(b[-1]) for b in vocabulary.begins]]
        to = np.arange(1, len(after) + 1, dtype=np.int32)
        # Where the beginning of a text may go, by its first character.
        self.first = np.full(self.width, -1, np.int32)
        self.first[after[after < self.width]] = to[after < self.width]
        # Steps by a hash; those that found their slot taken are sorted.
        self.slots, self.slot_to = np.full(1 << HASH_BITS, -1), np.full(1 << HASH_BITS, -1, np.int32)
        slot = self._slot(after)
        self.slots[slot], self.slot_to[slot] = after, to
        left = np.flatnonzero(self.slots[slot] != after)
        left = left[np.argsort(after[left])]
        # The last one is never looked for, so that a search always ends at one.
        self.left, self.left_to = np.append(after[left], np.iinfo(np.int64).max), np.append(to[left], np.int32(-1))
        self.piece = np.array([-1, *vocabulary.begins.values()], np.int32)
        self.score = np.array(vocabulary.score, np.float64)
        self.single = np.zeros(self.width, bool)
        self.single[self.character[[ord(p) for p in vocabulary.id if len(p) == 1]]] = True

    def step(self, at: np.ndarray, character: np.ndarray) -> np.ndarray:
        """The beginnings that are one character longer, -1 where there is none."""
        wanted = at.astype(np.int64) * self.width + character
        slot = self._slot(wanted)
        have, found = self.slots[slot], self.slot_to[slot]
        other = np.flatnonzero(have != wanted)
        found[other] = -1
        other = other[have[other] >= 0]
        k = np.searchsorted(self.left, wanted[other])
        found[other] = np.where(self.left[k] == wanted[other], self.left_to[k], -1)
        return found

    @staticmethod
    def _slot(steps: np.ndarray) -> np.ndarray:
        return ((steps.astype(np.uint64) * MUL) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many each, one after another."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


class Lattices:
    """Lattices of many segments, whose places are numbered through; an arc lies between two places."""

    def __init__(self, vocabulary: Vocabulary, segments: list[str]):
        self.v, tree = vocabulary, vocabulary.tree
        self.size = np.array([len(x) for x in segments], np.int64)
        # A segment has one place more than characters.
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.turn = _ranges(np.zeros(len(self.size), np.int64), self.size + 1)
        self.code = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        character = tree.character[self.code]
        place = _ranges(self.start, self.size)
        last = np.repeat(self.start + self.size, self.size)
        arcs, live = [], np.arange(len(place))
        at, long = tree.first[character], 1
        while True:
            keep = at >= 0
            live, at = live[keep], at[keep]
            if not len(live):
                break
            whole = tree.piece[at] >= 0
            arcs.append((place[live[whole]], np.full(whole.sum(), long), tree.piece[at[whole]]))
            keep = place[live] + long < last[live]
            live, at = live[keep], at[keep]
            at, long = tree.step(at, character[live + long]), long + 1
        # A character outside the vocabulary: its place among all characters, negative.
        odd = np.flatnonzero(~tree.single[character])
        arcs.append((place[odd], np.ones(len(odd), np.int64), -1 - odd))
        # Longer arcs first: of those that end at one place, the one nearer to the start.
        low, long, self.piece = (np.concatenate([a[k] for a in arcs[::-1]]) for k in range(3))
        self.low, self.high = low, low + long
        self.gain = np.where(self.piece >= 0, tree.score[np.maximum(self.piece, 0)], vocabulary.byte_score)

    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi's best score of each place, and that of the second path to it."""
        n = int((self.size + 1).sum())
        best, second = np.full(n, -np.inf), np.full(n, -np.inf)
        best[self.start] = 0.0
        # Arcs by how far from their segment's start they begin: those of one round end at different places.
        turn = self.turn.astype(np.uint16)[self.low]
        order = np.argsort(turn, kind="stable")
        bounds = np.cumsum([0, *np.bincount(turn)])
        low, high, gain = self.low[order], self.high[order], self.gain[order]
        for a, b in zip(bounds[:-1], bounds[1:]):
            i, j, s = low[a:b], high[a:b], gain[a:b]
            x, y, have, next_ = best[i] + s, second[i] + s, best[j], second[j]
            second[j] = np.where(x > have, np.maximum(have, y), np.maximum(next_, x))
            best[j] = np.maximum(x, have)
        return best, second

    def search(self, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A* from the right, a step of all segments at a time, up to the first path of each: its arcs from the left, and their number in each segment."""
        order = np.argsort(self.high, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(self.high, minlength=len(ahead)))])
        low, gain = self.low[order], self.gain[order]
        live = np.flatnonzero(self.size > 0)
        at, have, steps = (self.start + self.size)[live], np.zeros(len(live)), []
        while len(live):
            size = bounds[at + 1] - bounds[at]
            begin, arc = np.cumsum(size) - size, _ranges(bounds[at], size)
            promise = np.repeat(have, size) + gain[arc] + ahead[low[arc]]
            # Of equal promises the one nearer to the start goes first.
            top = np.flatnonzero(promise == np.repeat(np.maximum.reduceat(promise, begin), size))
            arc = arc[top[np.searchsorted(top, begin)]]
            steps.append((live, arc))
            at, have = low[arc], have + gain[arc]
            keep = at > self.start[live]
            live, at, have = live[keep], at[keep], have[keep]
        if not steps:
            return np.zeros(0, np.int64), np.zeros(len(self.size), np.int64)
        owner, arc = (np.concatenate([s[k] for s in steps[::-1]]) for k in range(2))
        return order[arc[np.argsort(owner, kind="stable")]], np.bincount(owner, minlength=len(self.size))

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the best segmentations, their number in each segment, the scores and what the second ones lose."""
        best, second = self.forward()
        arcs, n_arcs = self.search(best)
        ids, owner = self.piece[arcs], np.repeat(np.arange(len(n_arcs)), n_arcs)
        odd, width = np.flatnonzero(ids < 0), np.ones(len(ids), np.int64)
        if len(odd):
            different, which = np.unique(self.code[-1 - ids[odd]], return_inverse=True)
            spelt = [self.v._as_bytes(chr(c)) for c in different]
            size = np.array([len(x) for x in spelt])
            width[odd] = size[which]
            ids = np.repeat(ids, width)
            ids[ids < 0] = np.array([i for x in spelt for i in x])[_ranges((np.cumsum(size) - size)[which], size[which])]
        end = self.start + self.size
        return ids.astype(np.int32), np.bincount(owner, width, len(n_arcs)).astype(np.int64), best[end], best[end] - second[end]


class Encoder:
    """A vocabulary with the further paths of segments that its process has met."""

    def __init__(self, vocabulary: Vocabulary, n: int = N_BEST):
        self.v, self.n = vocabulary, n
        # One task leaves its paths to the next one of the process.
        self.paths_known = vocabulary.paths_known.setdefault(n, {})
        self.mark = np.array([vocabulary.bytes[b] for b in BLANK.encode()], np.int32)

    def _paths_of(self, segment: str) -> list[tuple[float, np.ndarray]]:
        """What each of the segment's ``n`` best paths loses, and its pieces."""
        made = self.paths_known.get(segment)
        if made is None:
            top = self.v.best(segment, self.n)
            made = [(top[0][0] - s, np.array(ids, np.int32)) for s, ids in top]
            self.v.remember(4 * len(segment) + sum(ENTRY_BYTES + ids.nbytes for _, ids in made))
            self.paths_known[segment] = made
        return made

    def _first(self, segments: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the best segmentations, their number in each segment, scores and losses; None is a literal mark."""
        score, loss = np.zeros(len(segments)), np.full(len(segments), np.inf)
        length = np.array([-1 if x is None else len(x) for x in segments], np.int64)
        parts, order = [], []
        for k in np.flatnonzero(length < 0).tolist():
            order.append([k])
            parts.append((self.mark, [len(self.mark)]))
            score[k] = self.v.byte_score
        for k in np.flatnonzero(length > TOGETHER).tolist():
            ids, score[k], loss[k] = self.v.first(segments[k])
            order.append([k])
            parts.append((np.array(ids, np.int32), [len(ids)]))
        together = np.flatnonzero((length > 0) & (length <= TOGETHER))
        for a in range(0, len(together), LATTICES):
            ks = together[a:a + LATTICES]
            ids, size, score[ks], loss[ks] = Lattices(self.v, [segments[k] for k in ks.tolist()]).first()
            order.append(ks)
            parts.append((ids, size))
        place, width = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
        if not parts:
            return np.zeros(0, np.int32), place, width, score, loss
        at = np.concatenate(order)
        width[at] = size = np.concatenate([p[1] for p in parts])
        place[at] = np.cumsum(size) - size
        return np.concatenate([p[0] for p in parts]), place, width, score, loss

    def n_best_of(self, texts: list[str | None]) -> tuple[list[list[np.ndarray] | None], list[list[float] | None]]:
        """The pieces and scores of the ``n`` best segmentations of each whole text, best first."""
        names, ends = [], []
        find = self.v.segments.findall
        for text in texts:
            for k, part in enumerate(text.split(BLANK) if text else ()):  # literal marks
                if k:
                    names.append(None)
                names += find((BLANK if k == 0 else "") + part.replace(" ", BLANK))
            ends.append(len(names))
        coded = pa.array(names, pa.large_string()).dictionary_encode(null_encoding="encode")
        which = np.asarray(coded.indices).astype(np.int64)
        at = np.zeros(len(coded.dictionary), np.int64)
        at[which[::-1]] = np.arange(len(which))[::-1]  # where each is met first
        ids, place, width, score, loss = self._first([names[k] for k in at.tolist()])
        width = width[which]
        ids = ids[_ranges(place[which], width)]
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(width)])
        losses, scores = loss[which], score[which].tolist()
        paths, totals = [], []
        for text, a, b in zip(texts, [0, *ends], ends):
            if not text:
                paths.append(None if text is None else [np.zeros(0, np.int32)])
                totals.append(None if text is None else [0.0])
                continue
            base, bounds, total = ids[at[a]:at[b]], at[a:b + 1] - at[a], sum(scores[a:b])
            changed = self._changes(names[a:b], losses[a:b])
            paths.append([_replaced(base, bounds, changes) if changes else base for _, changes in changed])
            totals.append([total - lost for lost, _ in changed])
        return paths, totals

    def n_best(self, text: str) -> tuple[list[np.ndarray], list[float]]:
        """The pieces and scores of the ``n`` best segmentations of the whole text, best first."""
        (paths,), (scores,) = self.n_best_of([text])
        return paths, scores

    def encode(self, text: str) -> tuple[np.ndarray, list[float]]:
        """The best pieces, and the scores of the ``n`` best segmentations of the whole text."""
        paths, scores = self.n_best(text)
        return paths[0], scores

    def _changes(self, segments: list[str | None], losses: np.ndarray) -> list[tuple[float, tuple[tuple[int, np.ndarray], ...]]]:
        """What each of the ``n`` best paths loses, and the segments in which it differs from the best one; they are among those of the smallest loss."""
        take = min(self.n - 1, len(losses))
        found = [(0.0, ())]
        for k in np.argpartition(losses, take - 1)[:take].tolist() if take else ():
            if np.isfinite(losses[k]):
                found += [(a + loss, (*c, (k, ids))) for a, c in found for loss, ids in self._paths_of(segments[k])[1:]]
                found = heapq.nsmallest(self.n, found, key=lambda x: x[0])
        return found

    def decode(self, ids: np.ndarray) -> str:
        return self.decoded([ids])[0]

    def decoded(self, lists: list[np.ndarray | None]) -> list[str | None]:
        """The text of each id list."""
        ends = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in lists])])
        texts = self.v.bytes_of.take(pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x in lists if x is not None)])))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), texts), b"").to_pylist()
        return [None if x is None else (t[1:] if t.startswith(b" ") else t).decode() for x, t in zip(lists, joined)]


def _replaced(base: np.ndarray, bounds: np.ndarray, changes: tuple[tuple[int, np.ndarray], ...]) -> np.ndarray:
    """The ids with those of some segments replaced."""
    parts, at = [], 0
    for k, other in sorted(changes, key=lambda x: x[0]):
        parts += [base[at:bounds[k]], other]
        at = bounds[k + 1]
    return np.concatenate([*parts, base[at:]])


def _nested(paths: list[list[np.ndarray] | None]) -> pa.Array:
    """The lists of each text's id lists."""
    flat = [x for p in paths for x in p or ()]
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    ids = pa.ListArray.from_arrays(ends([len(x) for x in flat]), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))
    return pa.ListArray.from_arrays(ends([len(p or ()) for p in paths]), ids, mask=pa.array([p is None for p in paths]))


def encoded(docs: DataFrame, model: str, text: str = "text", n: int = N_BEST) -> DataFrame:
    """The documents with ``__pieces``, the scores of the ``n`` best segmentations, the decoded text and, in ``__n_best``, the pieces of each of them, best first; no shuffle.

    The vocabulary is read on the driver from ``model`` and sent to the tasks; its size does not depend on the documents.
    """
    docs = free(docs)
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model))
    names = docs.columns

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(held.value, n)
        for batch in batches:
            for piece in pieces(batch, text, PIECE_BYTES):
                paths, scores = e.n_best_of(piece.column(text).to_pylist())
                back = e.decoded([p and p[0] for p in paths])
                cells = dict(zip(piece.schema.names, piece.columns))
                made = [_nested(paths), pa.array(scores, pa.list_(pa.float64())), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays([*(cells[c] for c in names), *made], names=[*names, "__n_best", "__scores", "__decoded"])

    found = docs.mapInArrow(make, T.StructType([*docs.schema.fields, *T.StructType.fromDDL(ADDED).fields]))
    return found.select(*names, F.get("__n_best", F.lit(0)).alias("__pieces"), "__scores", "__decoded", "__n_best")


def summary(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id``, number of pieces, their digest, the scores, whether decoding gave the text back, and a digest of the pieces of all n best segmentations."""
    made = encoded(docs.select("doc_id", "text"), model)
    # All lists as one text, "1,2;3,4"; JSON writes the numbers without a string for each, which array_join needs.
    made = made.withColumn("__joined", F.replace(F.trim(F.to_json("__n_best"), F.lit("[]")), F.lit("],["), F.lit(";")))
    return made.select(
        "doc_id", F.size("__pieces").cast("long").alias("n_pieces"), F.sha2(F.substring_index("__joined", ";", 1), 256).alias("pieces_sha256"),
        F.get("__scores", F.lit(0)).alias("score"), F.size("__scores").alias("n_best"), (F.get("__scores", F.lit(0)) - F.get("__scores", F.size("__scores") - 1)).alias("loss_of_last"),
        F.col("__decoded").eqNullSafe(F.col("text")).alias("round_trip"),
        F.sha2("__joined", 256).alias("n_best_sha256"),
    )

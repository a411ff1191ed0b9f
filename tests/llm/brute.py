"""Plain versions of the operators, for tests on small tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re

FOLDED = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
PLAIN = "[^\x20\x09-\x0d]+"


def folded(text):
    return re.findall(FOLDED, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text):
    return re.findall(PLAIN, text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def windows_hit(docs, items, size=10):
    """doc_id: words, hit words, item ids."""
    places = collections.defaultdict(set)
    for item, text in items:
        w = folded(text)
        n = min(size, len(w))
        for p in range(len(w) - n + 1) if n else ():
            places[tuple(w[p:p + n])].add(item)
    lengths = {len(k) for k in places}
    out = {}
    for doc, text in docs:
        w = folded(text)
        hit, found = set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (got := places.get(tuple(w[p:p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= got
        out[doc] = (len(w), len(hit), sorted(x for x in found if x is not None))
    return out


def near_classes(docs, size=5, threshold=0.8):
    """doc_id: smallest doc_id of its class; documents without words are their own class."""
    bags = {}
    for doc, text in docs:
        w = folded(text)
        bags[doc] = collections.Counter(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else collections.Counter([tuple(w)] if w else [])
    root = {d: d for d in bags}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    by_run = collections.defaultdict(list)
    for d, b in bags.items():
        for r in b:
            by_run[r].append(d)
    pairs = {p for ds in by_run.values() for p in itertools.combinations(sorted(ds), 2)}
    for a, b in pairs:
        shared = sum((bags[a] & bags[b]).values())
        if shared >= threshold * (bags[a].total() + bags[b].total() - shared):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {d: top(d) for d in bags}


def repeated_words(docs, size=13):
    """doc_id: words, removed words, digest of what stays."""
    first = {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        w = plain(text)
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p:p + size]), doc)
    out = {}
    for doc, text in docs:
        w = plain(text)
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p:p + size])] < doc:
                gone |= set(range(p, p + size))
        out[doc] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]


def removed_lines(docs, least_words=1):
    """doc_id: numbers of the lines that an earlier line equals or differs from by one edit."""
    lines = [(doc, n, x) for doc, text in sorted(docs, key=lambda d: d[0]) for n, x in enumerate((text or "").split("\n")) if len(plain(x)) >= least_words]
    first = {}
    for at, (_, _, x) in enumerate(lines):
        first.setdefault(x, at)
    near = {}
    texts = sorted(first, key=len)
    halves = collections.defaultdict(list)
    for x in texts:
        for n in (len(x), len(x) + 1):
            halves[n, 0, x[:n // 2]].append(x)
            halves[n, 1, x[len(x) - (n - n // 2):]].append(x)
    for group in halves.values():
        for a, b in itertools.combinations(set(group), 2):
            if one_edit(a, b):
                early, late = sorted((a, b), key=first.get)
                near[late] = True
    gone = collections.defaultdict(set)
    for at, (doc, n, x) in enumerate(lines):
        if first[x] < at or x in near:
            gone[doc].add(n)
    return gone

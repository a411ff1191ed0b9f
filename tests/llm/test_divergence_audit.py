"""The divergence audit against a plain one: odd rows, many sources, small blocks; the skyband alone."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentloom.llm import divergence_audit as audit


def plain(rows, top):
    words = [(l or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, l, s in rows]
    docs, counts = collections.Counter(), collections.Counter()
    for lang, source, ws in words:
        docs.update((lang, w) for w in set(ws))
        counts.update((lang, source, w) for w in ws)
    groups = sorted({w[:2] for w in words})
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= 3]
        own = [s for x, s in groups if x == lang]
        of = {s: [counts[lang, s, w] for w in kept] for s in own}
        share = lambda cs: [1 + 10**9 * (c + 1) // (sum(cs) + len(kept)) for c in cs]
        p, q = {s: share(of[s]) for s in own}, share([sum(x) for x in zip(*of.values())])
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(-sum(map(f, p[s], p[o])), o.encode(), o) for o in own if o != s]
            terms = [(-f(a, b), w.encode(), w) for w, c, a, b in zip(kept, of[s], p[s], q) if c and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


def odd_rows():
    rnd, rows = random.Random(5), []
    vocabulary = ["w" + "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 3))) for _ in range(60)] + ["日本"]
    for n in range(300):
        mine = rnd.sample(vocabulary, rnd.randint(1, 12))
        rows.append((" ".join(rnd.choice(mine).upper() if rnd.random() < 0.2 else rnd.choice(mine) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "de", None]), f"s{rnd.randrange(7)}"))
    rows += [(None, "en", "s1"), ("", "en", "empty"), ("12 34 !", "it", "digits"), ("once", "fr", "a"), ("", "fr", "b"), (None, None, None)]
    rows += [("same same text", "en", "s2")] * 4 + [("long text " * 30_000 + "tail", "en", "s3")] + [("x1y-z", "es", "only")] * 3
    return rows


@pytest.mark.parametrize("block,top,rows_of,terms", [(2, 3, 50, 4), (256, 200, 200_000, 1024)])
def test_equals_plain_audit(spark, monkeypatch, block, top, rows_of, terms):
    monkeypatch.setattr(audit, "SHARD_ROWS", rows_of)
    monkeypatch.setattr(audit, "TERMS", terms)
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    want = plain(rows, top)
    assert sorted(tuple(r) for r in audit.audit(docs, top, block).collect()) == want
    monkeypatch.setattr(audit, "SEND_GROUPS", 0)
    assert sorted(tuple(r) for r in audit.audit(docs, top, block).collect()) == want


def test_skyband_equals_plain():
    rnd = np.random.default_rng(1)
    for k, step in ((1, 4), (3, 16), (10, 512)):
        for size in (0, 1, 40, 300):
            g, l, r = rnd.integers(1, 6, size), rnd.integers(1, 9, size), rnd.permutation(size)
            want = [i for i in range(size) if sum((g >= g[i]) & (l <= l[i]) & (r <= r[i])) - 1 < k]
            assert sorted(audit.skyband(g, l, r, k, step).tolist()) == want


def test_shares_of_large_counts(spark):
    cases = [(0, 1), (10**12, 10**12 + 7), (8 * 10**14, 8 * 10**15), (3, 7 * 10**15)]
    want = [1 + 10**9 * (c + 1) // d for c, d in cases]
    rows = spark.createDataFrame(cases, "c long, d long").select(audit.share(F.col("c"), F.col("d")).alias("p")).collect()
    assert [r.p for r in rows] == want
    c, d = (np.array(x) for x in zip(*cases))
    assert audit._shares(c, d).tolist() == want


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert audit.audit(empty).count() == 0
    rows = [("aa bb", "en", "a"), ("aa bb", "en", "b"), ("aa cc", "en", "b")]
    docs = spark.createDataFrame([(*r, 1, 2, "t", 3.0) for r in rows], "text string, lang string, source string, g int, idx long, term string, value double")
    assert sorted(tuple(r) for r in audit.audit(docs).collect()) == plain(rows, 200)

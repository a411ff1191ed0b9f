"""The verdict of the quality rules against plain measures, exact binomial sums and plain selection."""

import collections
import math
import re

from brute import plain

from contentloom.llm import quality_rules as Q
from contentloom.llm.entry import op1_quality_rules

FOLDER = "/root/testdata/sf0.01"


def measures(text):
    words, lines = plain(text), [x for x in (text or "").split("\n") if plain(x)]
    chars = sum(map(len, words))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    windows = collections.defaultdict(list)
    for p in range(len(words) - Q.WINDOW + 1):
        windows[tuple(words[p:p + Q.WINDOW])].append(p)
    again = {q for places in windows.values() if len(places) > 1 for p in places for q in range(p, p + Q.WINDOW)}
    share = lambda a, b: a / b if b else 0.0
    dup = len(lines) - len(set(lines))
    return {
        "n": len(words), "base_failed": len(words) < 20 or 100 * len(again) > 30 * len(words), "symbol_share": share(symbols, chars), "dup_line_share": share(dup, len(lines)),
        "repeat_share": share(len(again), len(words)), "mean_word": share(chars, len(words)),
    }


def tail(k, n, rate):
    return math.fsum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))


def cutoffs(rows):
    """Per stratum and rule the best certified cutoff; ``rows`` are (stratum, good, measures)."""
    good = collections.defaultdict(list)
    bad = collections.defaultdict(list)
    for stratum, ok, m in rows:
        (good if ok else bad)[stratum].append(m)
    level, rate = Q.DELTA / len(Q.CUTOFFS) / max(1, len(good)), Q.ALPHA / len(Q.CUTOFFS)
    out = {}
    for stratum, mine in good.items():
        for rule, tried in Q.CUTOFFS.items():
            best = (0.0, None)
            for c in tried:
                lost, caught = sum(m[rule] > c for m in mine), sum(m[rule] > c for m in bad[stratum])
                if lost >= len(mine) * rate or tail(lost, len(mine), rate) > level:
                    break  # testing stops at the first cutoff that fails
                gain = caught / max(1, len(bad[stratum])) - 20 * lost / len(mine)
                if gain > best[0]:
                    best = (gain, c)
            out[stratum, rule] = best[1]
    return out


def test_verdict_equals_plain(spark):
    docs = {r.doc_id: (measures(r.text), r.lang) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    labels = collections.defaultdict(list)
    for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect():
        labels[r.doc_id].append(r.quality)
    rows = [(docs[d][1], min(q) >= 1, docs[d][0]) for d, q in labels.items() if d in docs and docs[d][1] is not None]
    chosen = cutoffs(rows)
    want = {d: not m["base_failed"] and not any(chosen.get((lang, r)) is not None and m[r] > chosen[lang, r] for r in Q.CUTOFFS) for d, (m, lang) in docs.items()}
    got = {r.doc_id: r for r in op1_quality_rules(spark, FOLDER).collect()}
    assert {d: r.kept for d, r in got.items()} == want
    assert {d: (r.n_words, r.base_failed) for d, r in got.items()} == {d: (m["n"], m["base_failed"]) for d, (m, _) in docs.items()}


def test_selection_equals_plain_on_many_strata(spark):
    import random

    rnd, rows = random.Random(3), []
    for s in range(6):
        for _ in range(rnd.choice([5, 400, 1500])):
            ok = rnd.random() < 0.7
            rows.append((f"s{s}", ok, {r: (rnd.random() * c[0] * (0.9 if ok else 2.2)) for r, c in Q.CUTOFFS.items()}))
    table = spark.createDataFrame([(s, ok, tuple(m[r] for r in Q.CUTOFFS)) for s, ok, m in rows], f"stratum string, good boolean, `__m` struct<{','.join(f'{r}:double' for r in Q.CUTOFFS)}>")
    got = {(r.stratum, rule): r[rule] for r in Q.certified_cutoffs(table).collect() for rule in Q.CUTOFFS}
    assert got == cutoffs(rows) and any(v is not None for v in got.values())

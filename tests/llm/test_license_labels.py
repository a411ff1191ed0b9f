"""Labels and scores of the licence scan against a plain diagonal vote, on all documents and on damaged notices."""

import collections
import random

from brute import folded

from contentloom.llm import license_scan as L
from contentloom.llm.entry import op2_license_scan

FOLDER = "/root/testdata/sf0.01"
TEMPLATES = [*((folded(t), x, True) for t, x in L.PHRASES.items()), *((folded(t), x, False) for x, t in L.NOTICES.items())]


def plain(text):
    words, labels, base, score, places = folded(text), set(), set(), 0.0, []
    for template, label, whole in TEMPLATES:
        k = min(L.K, len(template))
        of = len(template) - k + 1
        votes = collections.defaultdict(list)
        for q in range(of):
            for p in range(len(words) - k + 1):
                if words[p:p + k] == template[q:q + k]:
                    votes[p - q].append((p, q))
        spans = []
        for d in sorted(votes):
            own = votes[d]
            first, low, high = min(p for p, _ in own), min(q for _, q in own), max(q for _, q in own)
            if spans and not whole:
                before = spans[-1]
                later = (low > before["high"] and first > before["first"]) or (high < before["low"] and first < before["first"])
                if d - before["d"] <= L.SLACK and later:
                    spans[-1] = {"d": d, "n": before["n"] + len(own), "first": first, "low": low, "high": high}
                    continue
            spans.append({"d": d, "n": len(own), "first": first, "low": low, "high": high})
        for s in spans:
            share = min(1.0, s["n"] / of)
            if s["n"] == of if whole else share >= L.MIN_SHARE:
                labels.add(label)
                score = max(score, share)
                if whole:
                    base.add(label)
                    places.append(s["first"])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def rows_of(found):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in found.collect()}


def test_labels_of_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    want = {d: (*p[:6], round(p[6], 9)) for d, p in ((d, plain(t)) for d, t in docs.items())}
    got = rows_of(op2_license_scan(spark, FOLDER))
    assert got == want and any(w[5] for w in want.values())


def test_labels_of_damaged_notices(spark, table):
    rnd, rows = random.Random(11), []
    for n in range(80):
        words = []
        for _ in range(rnd.randint(1, 3)):
            notice = list(rnd.choice([*L.NOTICES.values(), *L.PHRASES]).split())
            for _ in range(rnd.randint(0, 4)):
                at = rnd.randrange(len(notice))
                notice[at:at + rnd.randint(0, 1)] = rnd.choice([[], ["odd"], ["two", "words"]])
                notice = notice or ["x"]
            words += [f"w{rnd.randrange(9)}" for _ in range(rnd.randint(0, 5))] + notice
        rows.append((n, " ".join(words)))
    want = {d: (*p[:6], round(p[6], 9)) for d, p in ((d, plain(t)) for d, t in rows)}
    assert rows_of(L.labelled(table(rows))) == want

"""Quality rules and the licence scan."""

import collections
import math
import re

import pytest
from brute import folded, plain
from pyspark.sql import functions as F

from contentloom.llm import license_scan, quality_rules
from contentloom.llm.entry import op1_quality_rules, op2_license_scan

FOLDER = "/root/testdata/sf0.01"
ODD = [
    (1, None), (2, ""), (3, "one two\n\none two\n one two"), (4, "a b c d e f g h " * 9), (5, "x " * 20000), (6, " ".join(f"w{i}" for i in range(30))),
    (6, " ".join(f"w{i}" for i in range(30))), (None, "MIT License, mit\nlicense & Apache-License #*$%&|<>"), (8, "General Public License mit license"), (9, "MIT-LİCENSE"),
    (10, " ".join(f"w{i}" for i in range(40)) + " " + " ".join(f"w{i}" for i in range(9, 40))),
]


def measures(text):
    w = plain(text)
    grams = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = {p for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if plain(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)


def test_measures_equal_brute_force(spark, table):
    for docs in (spark.read.parquet(f"{FOLDER}/documents.parquet"), table(ODD)):
        got = quality_rules.measured(docs).select("text", "__m.*").collect()
        for r in got:
            assert tuple(r)[1:7] == measures(r.text)


def test_binomial_tail(spark):
    cases = [(k, n, a) for n in (1, 5, 40, 700) for k in (0, 1, 3, 20) if k <= n for a in (0.01, 0.2)]
    for a in (0.01, 0.2):
        mine = [(k, n) for k, n, x in cases if x == a]
        got = spark.createDataFrame(mine, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), a).alias("p")).collect()
        for r in got:
            want = sum(math.comb(r.n, i) * a**i * (1 - a) ** (r.n - i) for i in range(r.k + 1)) if r.k < r.n * a else 1.0
            assert r.p == pytest.approx(want, rel=1e-9)
    far = spark.createDataFrame([(9_000_000, 1_000_000_000)], "k long, n long").select(quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).first().p
    assert far == 0.0


def test_cutoffs_keep_good_documents(spark):
    """Certified cutoffs stay within the share of good documents, which the rest of the labels confirm."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    m = quality_rules.measured(docs, keep=("doc_id", "lang")).cache()
    cutoffs = quality_rules.certified_cutoffs(quality_rules.holdout(m, labels)).cache()
    got = quality_rules.judged(m, cutoffs).join(labels, "doc_id").where("NOT __m.base_failed").groupBy("quality").agg(F.avg(F.col("__kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] > 1 - quality_rules.ALPHA and kept[0] < 0.5
    # a level nobody can reach certifies nothing
    none = quality_rules.certified_cutoffs(quality_rules.holdout(m, labels), delta=1e-300).collect()
    assert all(v is None for r in none for v in tuple(r)[1:])


def test_quality_of_odd_rows(spark, table):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (77, 1), (6, None)], "doc_id long, quality int")
    docs = table(ODD).withColumn("__x", F.lit(1)).withColumn("n_words", F.lit("mine"))
    kept = quality_rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [6, 6]
    assert quality_rules.kept_documents(docs.limit(0), labels.limit(0)).count() == 0


def base_places(text):
    w = folded(text)
    found = [(p, label) for phrase, label in license_scan.PHRASES.items() for k in [phrase.split()] for p in range(len(w) - len(k) + 1) if w[p:p + len(k)] == k]
    places = [p for p, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_licence_phrases_equal_brute_force(spark, table):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op2_license_scan(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_places(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    got = license_scan.labelled(table(ODD)).collect()
    want = sorted((repr(d), *base_places(t)) for d, t in ODD)
    assert sorted((repr(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == sorted(want)
    assert license_scan.labelled(table(ODD).limit(0)).count() == 0


def test_notices_with_added_and_lost_words(spark, table):
    grant = license_scan.NOTICES["mit-grant"]
    w = grant.split()
    texts = [(1, "x y " + grant + " z"), (2, " ".join([*w[:9], "really", *w[9:]])), (3, " ".join(w[:8] + w[9:])), (4, " ".join(w[:6])), (5, " ".join(reversed(w)))]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.labelled(table(texts)).collect()}
    assert got[1] == ("mit-grant", 1.0) and got[2][0] == got[3][0] == "mit-grant" and got[2][1] < 1
    assert got[4][0] == got[5][0] == ""
    spans = license_scan.scanned(table(texts[:1])).where("label IS NOT NULL").first()
    assert (spans["first"], spans["last"]) == (2, 2 + len(folded(grant)) - 1)


def test_no_python_in_native_plans(spark):
    for q in (op1_quality_rules, op2_license_scan):
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)

"""The learned operators: held-out accuracy, and rows of all kinds."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contentloom.llm import language, quality_knn, transcripts
from contentloom.llm.entry import _remainder, op3_quality_neighbours, op4_language, transcript_rows

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "12 345 |||"), (4, "word " * 20000), (4, "word " * 20000), (None, "É"), (7, "the of and")]


def test_quality_of_held_out_documents(spark):
    got = op3_quality_neighbours(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == 1000 and len(rows) > 80
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_neighbours_are_exact(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    m = quality_knn.fitted(docs, labels, F.lit(True))
    texts = pa.array([r.text for r in docs.limit(50).collect()])
    t, f, w = quality_knn._rows(texts, m.idf)
    dense = np.zeros((50, quality_knn.FEATURES))
    dense[t, f] = w
    v = dense @ m.basis
    near = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ m.vectors.T
    for row, score in zip(near, quality_knn.scores(texts, m)):
        top = np.sort(np.argsort(-row)[:quality_knn.NEIGHBOURS])
        vote = np.maximum(row[top], 1e-6) ** 8 * m.votes[top]
        assert score == pytest.approx((vote * m.label[top]).sum() / vote.sum(), abs=1e-3)


def test_quality_of_odd_rows(spark, table):
    labels = spark.createDataFrame([(7, 1, 0), (4, 0, 0), (2, 0, 0), (2, 1, 0), (99, 1, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    m = quality_knn.fitted(table(ODD), labels, F.lit(True))
    got = quality_knn.scored(table(ODD), m)
    assert got.count() == len(ODD) and got.columns == [*table(ODD).columns, "__score"]
    assert all(0 <= r["__score"] <= 1 for r in got.collect())
    nothing = quality_knn.fitted(table(ODD).limit(0), labels.limit(0), F.lit(True))
    assert {r["__score"] for r in quality_knn.scored(table(ODD), nothing).collect()} == {0.5}
    assert quality_knn.scored(table(ODD).limit(0), m).count() == 0


def test_language_of_held_out_documents(spark):
    rows = op4_language(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_language_grams_equal_a_plain_count():
    texts = ["Ab é", "", None, "x1y a"]
    t, f, n = language._counts(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        s = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        grams = [s[p:p + k] for k in (1, 2, 3) for p in range(len(s) - k + 1) if " " not in s[p + 1:p + k - 1] and not (s[p] == s[p + k - 1] == " ")]
        assert n[t == i].sum() == len(grams)


def test_language_penalty_and_temperature():
    rng = np.random.default_rng(0)
    label = rng.integers(0, 2, 200)
    rows = [(np.array([y, 5]), np.array([1.0, 0.01])) for y in label]
    w, _ = language.followed(rows, label, 2, features=8)
    assert (w[5] == 0).all() and w[0, 0] > 0 > w[0, 1] and (w[6] == 0).all()
    logits = rng.normal(size=(4000, 2)) * 2
    drawn = (rng.random(4000) > language._softmax(logits)[:, 0]).astype(int)
    assert language.calibrated(logits * 3, drawn) == pytest.approx(3, rel=0.2)


def test_language_of_odd_rows(spark, table):
    docs = table(ODD).withColumn("lang", F.when(F.col("doc_id") == 7, None).otherwise("xx"))
    got = {(r.doc_id, r["__lang"]) for r in language.identified(docs, language.fitted(docs, F.lit(True))).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "xx"), (None, "xx"), (7, "xx")}
    nothing = language.fitted(docs.limit(0), F.lit(True))
    assert {r["__lang"] for r in language.identified(docs, nothing).collect()} == {"und"}


def test_roles_of_held_out_transcripts(spark):
    rows = transcript_rows(spark, FOLDER)
    model = transcripts.fitted(rows.where(_remainder("conv_id", 5) > 0))
    got = {(r.conv_id, r.place): r for r in transcripts.parsed(rows.drop("role"), model).where("line = 0").collect()}
    truth = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").where(_remainder("conv_id", 5) == 0).collect()}
    right = [k in got and got[k].role == r.role for k, r in truth.items()]
    assert len(right) > 80 and np.mean(right) > 0.88
    assert np.mean([got[k].chat == f"<|im_start|>{r.role}\n{r.text}<|im_end|>" for k, r in truth.items() if k in got]) > 0.8

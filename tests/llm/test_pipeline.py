"""The pipeline against a plain version, stage by stage, and the SQL twins."""

import duckdb
import pytest
from brute import near_classes, plain, removed_lines, sha, windows_hit
from oracle import connect, differences

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from contentloom.llm.entry import op1_quality_rules, piece_model
from contentloom.llm.piece_lattice import Encoder, Vocabulary

FOLDER = "/root/testdata/sf0.01"


def test_run_equals_plain_stages(spark):
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    kept = {r.doc_id for r in op1_quality_rules(spark, FOLDER).collect() if r.kept}
    docs = [(d, table[d]) for d in sorted(kept)]
    gone = removed_lines(docs)
    cut = [(d, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d])) for d, t in docs]
    docs = [(d, t) for d, t in cut if not gone[d] or plain(t)]
    top = near_classes(docs)
    docs = [(d, t) for d, t in docs if top[d] == d]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hit = windows_hit(docs, items)
    e = Encoder(Vocabulary.read(piece_model()))
    want = {d: sha(",".join(map(str, e.encode(t)[0].tolist()))) for d, t in docs if not hit[d][1]}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id: r.pieces_sha256 for r in rows} == want and len(rows) == len(want)
    assert all(r.round_trip for r in rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, name


def test_stages_take_odd_tables(spark):
    """Nulls everywhere, repeated rows, empty and long texts, an empty table, and columns with the operators' own names."""
    own = ["__words", "__lang", "__n_words", "__places", "__n_best", "__n_lines", "__n_removed", "__spans", "__matches", "__m", "__kept", "row", "id", "node", "class_id", "stratum"]
    good = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", good, good, "long " * 30_000, good + "\nsecond line\nsecond line", "x", None]
    rows = [(None if k % 3 == 2 else k // 2, t, None if k == 3 else "en", None if k == 4 else "s", None if k == 5 else 1, *["own"] * len(own)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in own)).repartition(2)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert kept and all(r[c] == "own" for r in kept for c in own), name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == len(rows)


@pytest.mark.parametrize("name", ["op5_decontamination", "op9_substring_dedup", "op11_warc", "op12_divergence_audit", "op13_conversation_trie"])
def test_queries_equal_their_sql(spark, name):
    text, n = differences(spark, connect(FOLDER), FOLDER, queries()[name], oracle_sql()[name])
    assert text == "" and n > 200


def test_all_queries_are_registered():
    names = set(queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(oracle_sql()) <= names and duckdb.__version__

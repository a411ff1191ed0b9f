"""Inputs whose columns have the operators' own names, and empty tables, for every operator on documents."""

import pytest
from pyspark.sql import functions as F

from contentloom.llm import columns, decontaminate, divergence_audit, language, license_scan, line_dedup, near_dup, piece_lattice, quality_knn, quality_rules, substring_dedup
from contentloom.llm.entry import piece_model

NAMES = [*columns.OWN, "__words", "__lines", "__lang", "__score", "__n", "__m", "row", "id", "node", "root", "bands", "size"]
TEXTS = ["one two three four five six", None, "", "one two three four five six", "mit license and words " * 8, "fünf Wörter auf Deutsch hier"]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "de" if i == 5 else "en", "s", 1, *["mine"] * len(NAMES)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))


def operators(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "three four five")], "item_id long, text string")
    return {
        "rules": lambda: quality_rules.kept_documents(docs, labels), "licences": lambda: license_scan.labelled(docs),
        "neighbours": lambda: quality_knn.scored(docs, quality_knn.fitted(docs, labels, F.lit(True))), "language": lambda: language.identified(docs, language.fitted(docs, F.lit(True))),
        "searched": lambda: decontaminate.searched(docs, items), "clean": lambda: decontaminate.clean_documents(docs, items), "lines": lambda: line_dedup.deduplicated(docs),
        "lines left": lambda: line_dedup.with_text_left(docs), "pieces": lambda: piece_lattice.encoded(docs, piece_model()), "passages": lambda: substring_dedup.deduplicated(docs),
        "classes": lambda: near_dup.classes(docs), "distinct": lambda: near_dup.distinct_documents(docs), "audit": lambda: divergence_audit.audit(docs),
    }


KEPT_WHOLE = {"rules": 0, "clean": 4, "lines left": 5, "distinct": 5}


@pytest.mark.parametrize("name", ["audit", "classes", "clean", "distinct", "language", "licences", "lines", "lines left", "neighbours", "passages", "pieces", "rules", "searched"])
def test_columns_of_the_operators_names(spark, docs, name):
    out = operators(spark, docs)[name]()
    rows = out.collect()
    if name in KEPT_WHOLE:
        assert out.columns == docs.columns and len(rows) == KEPT_WHOLE[name] and all(r[n] == "mine" for r in rows for n in NAMES)
    elif name != "audit":
        assert len(rows) == len(TEXTS)
    assert operators(spark, docs.limit(0))[name]().count() == 0

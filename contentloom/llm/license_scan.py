"""Licence scan by diagonal voting, as DataFrame operations only.

All rolling word k-grams of a text are joined with the k-grams of the templates.
A match at word ``p`` of the text and place ``q`` of a template votes for the
diagonal ``p - q``; a template that stands in the text gathers its votes on one
diagonal, or on neighbouring ones if words were added or lost.

Defined cases: null and empty texts have no words, no label and score 0; repeated
rows and null ids are scanned row by row; a phrase that occurs again is counted
again; other input columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Phrases that must match whole.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices as their publishers word them; they may match in part.
NOTICES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-notice": "licensed under the GNU General Public License, version",
    "gpl-grant": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "all-rights-reserved": "All rights reserved",
}
K = 3
# Words by which neighbouring diagonals may differ.
SLACK = 3
# Share of a notice's k-grams that must be found.
MIN_SHARE = 0.75


def _words(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def template_grams(spark: SparkSession) -> tuple[DataFrame, list[int]]:
    """The k-grams of all templates with their hashes, and the k in use.

    Templates are fixed, about a hundred k-grams in all, so they may be broadcast.
    """
    rows = []
    for n, (text, label, whole) in enumerate([*((t, x, True) for t, x in PHRASES.items()), *((t, x, False) for x, t in NOTICES.items())]):
        words = _words(text)
        k = min(K, len(words))
        rows += [(n, label, whole, len(words) - k + 1, q, k, words[q:q + k]) for q in range(len(words) - k + 1)]
    made = spark.createDataFrame(rows, "template int, label string, whole boolean, of int, place int, k int, gram array<string>")
    sizes = sorted({r[5] for r in rows})
    h = F.coalesce(*[F.when(F.col("k") == k, F.xxhash64(*[F.get("gram", F.lit(i)) for i in range(k)])) for k in sizes])
    return made.withColumn("h", h), sizes


def _hash(k: int) -> Column:
    return F.xxhash64(*[F.get("__words", F.col("__at") + i) for i in range(k)])


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per template span: row, key, words, label, first and last word, share found.

    Each text also gives one row without a label, so none is lost. Only matches and
    that row leave the map stage, summed by diagonal before the shuffle.
    """
    spark = docs.sparkSession
    templates, sizes = template_grams(spark)
    own = spark.createDataFrame([(-1, None, False, 1, 0, 0, [], -1)], templates.schema)
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    words = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), F.array_remove(F.split(lowered, BETWEEN), "").alias("__words"))
    n = F.size("__words")
    # One place behind the last word stands for the text itself.
    at = words.select("*", F.explode(F.sequence(F.lit(0), n)).alias("__at"))
    grams = F.array(
        F.struct(F.lit(0).alias("k"), F.when(F.col("__at") == n, F.lit(-1).cast("long")).alias("h")),
        *[F.struct(F.lit(k).alias("k"), F.when(F.col("__at") + k <= n, _hash(k)).alias("h")) for k in sizes],
    )
    rolled = at.select("*", F.inline(grams).alias("__k", "__h")).where(F.col("__h").isNotNull())
    hit = rolled.join(F.broadcast(templates.unionByName(own)), (F.col("__k") == F.col("k")) & (F.col("__h") == F.col("h")))
    # The words themselves decide, not their hash.
    same = hit.where((F.col("k") == 0) | (F.slice("__words", F.col("__at") + 1, F.col("k")) == F.col("gram")))
    votes = same.groupBy("__row", "__key", n.cast("long").alias("n_words"), "template", "label", "whole", "of", (F.col("__at") - F.col("place")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("__at").alias("first"), F.max(F.col("__at") + F.col("k") - 1).alias("last"), F.min("place").alias("from"), F.max("place").alias("to"),
    )
    return _merged(votes)


def _merged(votes: DataFrame) -> DataFrame:
    """Join neighbouring diagonals of a template into one span.

    Diagonals go together if they differ by at most ``SLACK`` and the later part of
    the template follows in the text as well. Phrases must match whole and stay apart.
    A window never holds more than one text's matches of one template.
    """
    order = Window.partitionBy("__row", "template").orderBy("diagonal", "first")
    before = lambda c: F.lag(c).over(order)
    # Added words move the rest of the template to a later diagonal, lost ones to an earlier one.
    added = (F.col("from") > before("to")) & (F.col("first") > before("first"))
    lost = (F.col("to") < before("from")) & (F.col("first") < before("first"))
    joins = ~F.col("whole") & (F.col("diagonal") - before("diagonal") <= SLACK) & (added | lost)
    marked = votes.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    spans = marked.withColumn("__span", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = spans.groupBy("__row", "__key", "n_words", "template", "label", "whole", "of", "__span").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    share = F.least(F.lit(1.0), F.col("votes") / F.col("of"))
    found = (F.col("label").isNull()) | F.when(F.col("whole"), F.col("votes") == F.col("of")).otherwise(share >= MIN_SHARE)
    return merged.select("__row", "__key", "n_words", "label", "whole", "first", "last", share.alias("share")).where(found)


def labelled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its places, labels and score."""
    base = F.col("whole")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return scanned(docs, key, text).groupBy("__row", F.col("__key").alias(key)).agg(
        F.max("n_words").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("share"))), F.lit(0.0)).alias("score"),
    ).drop("__row")

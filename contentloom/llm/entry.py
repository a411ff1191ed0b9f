"""Queries of the operators in this folder and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contentloom.session import materialize
from contentloom.llm import conversation_trie, decontaminate, divergence_audit, language, license_scan, line_dedup, near_dup, oracles, piece_lattice, quality_knn, quality_rules, substring_dedup, transcripts, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of every document, the base rule and the verdict of the certified rules.

    The measures are written once, since cutoffs and verdicts both read them.
    """
    measures = materialize(quality_rules.measured(_table(spark, folder, "documents"), keep=("doc_id", "lang")), "quality-measures")
    cutoffs = quality_rules.certified_cutoffs(quality_rules.holdout(measures, _table(spark, folder, "labels")))
    judged = quality_rules.judged(measures, cutoffs)
    return judged.select("doc_id", *[F.col(f"__m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], F.col("__kept").alias("kept"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return license_scan.labelled(_table(spark, folder, "documents"))


def _remainder(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % n, F.lit(-1))


def op3_quality_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learned from two thirds of the labels."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = quality_knn.fitted(docs, labels, _remainder("doc_id", 3) != 1)
    found = quality_knn.scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_remainder("doc_id", 3) == 1).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from four fifths of the languages given."""
    docs = _table(spark, folder, "documents")
    model = language.fitted(docs, _remainder("doc_id", 5) > 0)
    found = language.identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.hits(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def transcript_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations as transcripts: each turn behind a marker in one of several styles, an eighth without."""
    rows = _table(spark, folder, "conversations")
    style = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8))
    name = F.initcap("role")
    mark = (
        F.when(style == 0, F.lit("")).when(style == 2, F.concat(F.lit("### "), name, F.lit(":\n"))).when(style == 3, F.concat(F.lit("["), F.upper("role"), F.lit("] ")))
        .when(style == 4, F.concat(F.when(F.col("role") == "user", "Human").otherwise(name), F.lit(": "))).when(style == 5, F.concat(F.lit("<|"), "role", F.lit("|>")))
        .otherwise(F.concat(name, F.lit(": ")))
    )
    return rows.withColumn("text", F.concat(F.coalesce(mark, F.lit("")), F.coalesce("text", F.lit(""))))


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Turns recovered from the transcripts of all conversations; roles are learned from four fifths of them."""
    rows = transcript_rows(spark, folder)
    model = transcripts.fitted(rows.where(_remainder("conv_id", 5) > 0))
    found = transcripts.parsed(rows.drop("role"), model)
    return found.select("conv_id", F.col("place").alias("turn"), "line", "role", "n_lines", "chat", (_remainder("conv_id", 5) == 0).alias("held_out"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document that an earlier line equals within one edit."""
    found = line_dedup.deduplicated(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def piece_model() -> str:
    """The sentencepiece model of the queries; operators take any path."""
    from public_tokenizers import path

    return path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces, best scores and round trip of every document."""
    return piece_lattice.summary(_table(spark, folder, "documents"), piece_model())


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that repeat a passage of an earlier one."""
    found = substring_dedup.deduplicated(_table(spark, folder, "documents").select("doc_id", "text"))
    # A text that keeps all its words keeps its white space too; the digest is over single blanks.
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near copies of every document; a class is named by its smallest id."""
    found = near_dup.classes(_table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", (F.col("class_id") == F.col("doc_id")).alias("kept"))


def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as WARC records and read back from the archives."""
    found = warc.round_trip(_table(spark, folder, "pages"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("first").alias("refers_to"))


def op12_divergence_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of the sources of each language, by pair and by term."""
    return divergence_audit.audit(_table(spark, folder, "documents"))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    made = conversation_trie.trie(_table(spark, folder, "conversations"))
    return made.nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_license_scan, op3_quality_neighbours, op4_language, op5_decontamination, op6_chat_format, op7_line_dedup, op8_sentencepiece, op9_substring_dedup, op10_near_duplicates, op11_warc, op12_divergence_audit, op13_conversation_trie)}
SQL: dict[str, str] = {"op5_decontamination": oracles.OP5, "op9_substring_dedup": oracles.OP9, "op11_warc": oracles.OP11, "op12_divergence_audit": oracles.OP12, "op13_conversation_trie": oracles.OP13}

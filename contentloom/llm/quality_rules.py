"""Risk-controlled quality rules, as DataFrame expressions only.

Every rule compares one measure of a text with a cutoff. Cutoffs are not set by
hand: labelled documents are a holdout on which each cutoff of a fixed list is
tested. A cutoff may be used in a stratum only if an exact binomial bound shows,
at a confidence corrected for all strata and rules, that it rejects at most the
allowed share of the stratum's good documents.

Defined cases: a null or empty text has no words, fails the base rule and is not
kept; a null language or one without certified cutoffs is judged by the base rule
alone; a document labelled more than once is good only if all its labels say so;
labels of unknown documents and null labels count for nothing; repeated rows are
judged one by one; input columns of the same names never mix with the measures.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from contentloom.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEATED = 20, 8, 30
# Share of a stratum's good documents that all its rules together may reject.
ALPHA = 0.05
# Chance that any certified cutoff of any stratum exceeds its share.
DELTA = 0.05
# Cutoffs of so many strata are sent to the documents.
SEND_STRATA = 10_000
# Rules: measure, and its cutoffs from lenient to strict. A document above the cutoff is rejected.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.5, 0.3, 0.2, 0.1, 0.05, 0.02),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4),
    "repeat_share": (0.28, 0.24, 0.2, 0.16),
    "mean_word": (14.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0, 6.5),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a computed value so that the lambdas inside ``body`` do not compute it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(grams: Column) -> Column:
    """Words under windows whose hash occurs at least twice in ``grams``."""

    def positions(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"), p.alias("last"))
    covered = let(ordered, lambda s: F.aggregate(positions(s), start, step, lambda a: a["n"]))
    return F.when(F.size(grams) == F.size(F.array_distinct(grams)), F.lit(0).cast("long")).otherwise(covered)


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Measures of each text in a struct column ``__m`` beside the kept columns; no shuffle.

    Equal windows are found by 64-bit hashes within one document.
    """
    names = [c for c in docs.columns if keep is None or c in keep]
    body = F.coalesce(F.col(text), F.lit(""))
    chars = F.length(F.translate(body, BLANKS, ""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(*names, F.array_remove(F.split(body, SPACE), "").alias("__words"), lines.alias("__lines"), chars.alias("__chars"), (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).alias("__symbols"))
    counted = split.select(
        *names, F.size("__words").cast("long").alias("__n"), F.col("__chars").cast("long").alias("__chars"), F.col("__symbols").cast("long").alias("__symbols"),
        F.size("__lines").alias("__n_lines"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__dup"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__grams"),
    )
    for reach in (1, 2, 4):  # hashes of 2, 4 and 8 words
        pairs = F.zip_with(F.slice("__grams", 1, F.greatest(F.size("__grams") - reach, F.lit(0))), F.slice("__grams", reach + 1, F.size("__grams")), lambda a, b: F.xxhash64(a, b))
        counted = counted.withColumn("__grams", pairs)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    done = counted.select(*names, "__n", "__chars", "__symbols", "__n_lines", "__dup", _covered(F.col("__grams")).alias("__rep"))
    m = F.struct(
        F.col("__n").alias("n_words"), F.col("__chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"), F.col("__dup").alias("n_dup_lines"),
        F.col("__rep").alias("n_repeat_words"), ((F.col("__n") < MIN_WORDS) | (100 * F.col("__rep") > MAX_REPEATED * F.col("__n"))).alias("base_failed"),
        share("__symbols", "__chars").alias("symbol_share"), share("__dup", "__n_lines").alias("dup_line_share"),
        share("__rep", "__n").alias("repeat_share"), share("__chars", "__n").alias("mean_word"),
    )
    return done.select(*names, m.alias("__m"))


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted by ten so that it is exact to 1e-13."""
    x = n.cast("double") + 11.0
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    shift = F.lit(0.0)
    for i in range(1, 11):
        shift = shift + F.ln(n.cast("double") + i)
    return series - shift


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Bin(n, rate) where k lies below the mean; 1 where it does not.

    Terms are summed from k downwards; they shrink faster than geometrically, and
    those more than 12 standard deviations away are below double precision.
    """
    log_term = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    count = F.least(k.cast("long"), (12 * F.sqrt(n * F.lit(rate)) + 50).cast("long"))
    steps = F.when(count >= 1, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] * (k - j) / (n - k + j + 1) * ((1 - rate) / rate)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    return F.when(k >= n * F.lit(rate), 1.0).otherwise(F.least(F.lit(1.0), F.exp(log_term) * F.aggregate(steps, start, step, lambda a: a["sum"])))


def certified_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: the cutoff of each rule, null where none is certified.

    ``labelled`` has ``stratum``, ``good`` and the measures ``__m``. Within a rule the cutoffs are
    tested from lenient to strict and testing stops at the first failure, which needs no
    correction; strata and rules share ``delta`` evenly, and the rules of a stratum share
    ``alpha``. Of the certified cutoffs the one with the best balance on the holdout is taken
    (a false rejection weighs 20 times a missed bad document; ties go to the lenient side).
    Counts are partial sums before the only shuffle, one row per task and stratum.
    """
    counted = labelled.where(F.col("stratum").isNotNull()).groupBy("stratum").agg(
        F.count_if(F.col("good")).alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"),
        *[F.count_if(F.col("good") & (F.col(f"__m.{r}") > c)).alias(f"{r}_{i}_good") for r, cs in CUTOFFS.items() for i, c in enumerate(cs)],
        *[F.count_if(~F.col("good") & (F.col(f"__m.{r}") > c)).alias(f"{r}_{i}_bad") for r, cs in CUTOFFS.items() for i, c in enumerate(cs)],
    )
    strata = counted.where("n_good > 0")
    share, level = alpha / len(CUTOFFS), F.lit(delta / len(CUTOFFS)) / strata.agg(F.count("*").alias("n")).scalar()
    listed = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(f"{r}_{i}_good").alias("good"), F.col(f"{r}_{i}_bad").alias("bad"))
        for r, cs in CUTOFFS.items() for i, c in enumerate(cs)
    ])
    tried = strata.select("stratum", "n_good", "n_bad", F.inline(listed)).withColumn("ok", binomial_tail(F.col("good"), F.col("n_good"), share) <= level)
    gain = F.col("bad") / F.greatest(F.col("n_bad"), F.lit(1)) - 20 * F.col("good") / F.col("n_good")
    failed = tried.groupBy("stratum", "rule").agg(
        F.min(F.when(~F.col("ok"), F.col("step"))).alias("stop"), F.collect_list(F.struct(gain.alias("gain"), (-F.col("step")).alias("lenient"), "cutoff", "step")).alias("tried"),
    )
    usable = F.filter("tried", lambda x: (x["gain"] > 0) & (x["step"] < F.coalesce(F.col("stop"), F.lit(1000))))
    best = failed.select("stratum", "rule", F.array_max(usable)["cutoff"].alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in CUTOFFS])


def holdout(measures: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """The labelled documents with their measures, stratum and whether they are good."""
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__key")).agg((F.min("quality") >= 1).alias("good"))
    return measures.select(F.col(key).alias("__key"), F.col(stratum).alias("stratum"), "__m").join(good, "__key")


def judged(measures: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add ``__kept``: the base rule holds and no certified cutoff of the stratum is exceeded.

    Up to ``SEND_STRATA`` cutoffs are sent to the documents; more meet them in a join that Spark plans. The rows are the same.
    """
    cutoffs = materialize(cutoffs, "cutoffs")
    few = cutoffs.count() <= SEND_STRATA
    named = cutoffs.select(F.col("stratum").alias("__stratum"), F.struct(*CUTOFFS).alias("__cut"))
    over = F.lit(False)
    for rule in CUTOFFS:
        over = over | F.coalesce(F.col(f"__m.{rule}") > F.col(f"__cut.{rule}"), F.lit(False))
    joined = measures.join(F.broadcast(named) if few else named, F.col(stratum) == F.col("__stratum"), "left")
    return joined.withColumn("__kept", ~F.col("__m.base_failed") & ~over).drop("__stratum", "__cut")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns, whatever those are called.

    Documents and measures are written once: cutoffs and verdicts read the written
    measures, so that no filter repeats the expressions behind them.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "lang", "text")
    measures = materialize(measured(rows, keep=("row", "doc_id", "lang")), "quality-measures")
    cutoffs = certified_cutoffs(holdout(measures, labels))
    return judged(measures, cutoffs).where("__kept").select("row.*")

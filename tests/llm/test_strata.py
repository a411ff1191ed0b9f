"""More strata than a few hundred."""

from pyspark.sql import functions as F

from contentloom.llm import quality_rules as Q


def test_every_stratum_is_tested(spark, monkeypatch):
    zero = F.struct(F.lit(False).alias("base_failed"), *[F.lit(0.0).alias(r) for r in Q.CUTOFFS])
    high = F.struct(F.lit(False).alias("base_failed"), *[F.lit(1e9).alias(r) for r in Q.CUTOFFS])
    good = spark.range(300 * 2000).select((F.col("id") % 300).cast("string").alias("stratum"), F.lit(True).alias("good"), zero.alias("__m"))
    bad = spark.range(300 * 10).select((F.col("id") % 300).cast("string").alias("stratum"), F.lit(False).alias("good"), high.alias("__m"))
    cutoffs = Q.certified_cutoffs(good.union(bad)).cache()
    assert cutoffs.count() == 300
    docs = spark.range(300).select(F.col("id").cast("string").alias("lang"), high.alias("__m"))
    for most in (0, 10_000):
        monkeypatch.setattr(Q, "SEND_STRATA", most)
        assert Q.judged(docs, cutoffs).groupBy("__kept").count().collect() == [(False, 300)]

"""Time the headline queries; prints one JSON line.

Derived tables are written once beforehand, so the operators are timed, not the
fixtures. Each query runs three times and the median counts, which leaves out the
first run, as that loads and compiles. Results go to
Spark's noop sink: every row is computed, none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.errors import AnalysisException  # noqa: E402

import contentloom.plans  # noqa: E402,F401  (registers the queries)
from contentloom.plans import registry  # noqa: E402
from contentloom.session import local_session  # noqa: E402

HEADLINE = (
    "a03_error_histogram", "v01_validate", "v22_mixed_definitions", "v26_combined_object", "f02_by_type", "f05_referencing",
    "f07_search", "r01_embedded_references", "r02_metadata_edges", "j02_back_references", "j03_drop_references",
    "h01_levels", "w01_latest_context", "w06_insert", "w07_update", "w08_upsert", "j05_adapt", "j06_find_adaptation",
    "j12_one_sided_links", "p04_assemble", "c01_from_json_schema", "k01_verify_definitions", "e01_similar_content", "t01_slug",
)


def written(spark, folder: str, cores: int) -> dict:
    """The derived tables, written over all cores and read back."""
    root, made = tempfile.mkdtemp(prefix="bench-"), {}
    for name in registry.DERIVED:
        try:
            df = getattr(registry.Tables(spark, folder, made), name)
        except AnalysisException:  # some derived tables exist for the SQL twins only
            continue
        df.repartition(cores).write.parquet(f"{root}/{name}")
        made[name] = spark.read.schema(df.schema).parquet(f"{root}/{name}")
    return made


def main() -> None:
    folder, cores = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    made, took = written(spark, folder, int(cores)), {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            at = time.perf_counter()
            registry.QUERIES[name].plan(registry.Tables(spark, folder, made)).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - at)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "headline query time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Session helpers: local test sessions and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Temporary folders of local sessions that name no shared one.
_LOCAL: dict[str, str] = {}


def local_session(cpus: int | str = "*", app: str = "contentloom") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a local session that names none gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="contentloom-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one run of a multi-job operator."""
    return f"{shared_folder(spark).rstrip('/')}/contentloom/{label}-{uuid.uuid4().hex}"


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Meanwhile Arrow batches have at most so many rows; a smaller limit of the session holds, and its own comes back."""
    if rows is None:
        yield
        return
    own, now = spark.conf.get(BATCH_ROWS, None), int(spark.conf.get(BATCH_ROWS))
    spark.conf.set(BATCH_ROWS, str(min(rows, now) if now > 0 else rows))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(BATCH_ROWS)
        else:
            spark.conf.set(BATCH_ROWS, own)


def materialize(df: DataFrame, label: str, compression: str = "snappy", batch_rows: int | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back, which cuts its lineage.

    Unlike a checkpoint, which runs the plan once more to store its rows, this
    computes them once; executors may come and go afterwards. With ``batch_rows`` whole
    texts go to Python that many at a time, which bounds what JVM and Python hold of them.
    """
    path = scratch_path(df.sparkSession, label)
    with arrow_batches(df.sparkSession, batch_rows):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Session helpers: a local session for tests, lineage cuts and scratch paths."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "obsframe") -> SparkSession:
    """A session for tests and the bench; on a cluster the submitted session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder; a cluster without the setting
    is an error, since a machine-local path would be lost with its machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="obsframe-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table or file set written by a job."""
    return f"{shared_dir(spark).rstrip('/')}/obsframe-{name}-{uuid.uuid4().hex}"


def tasks_for(rows: int, each: int = 1 << 15) -> int:
    """In how many tasks a step on so many narrow rows is worth its start: for ``coalesce``, which never makes more than there are."""
    return max(8, -(-rows // each))


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Steps that are written inside give Python batches of about ``size`` bytes at most. An executor holds several copies of a batch for every task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut_observed(df: DataFrame, *aggs: Column) -> tuple[DataFrame, dict]:
    """``cut_lineage`` plus aggregates that are observed while the rows are written."""
    seen = Observation()
    path = scratch_path(df.sparkSession, "step")
    df.observe(seen, *aggs).write.parquet(path)
    return _read_step(df, path), seen.get


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    out, seen = cut_observed(df, F.count(F.lit(1)).alias("n"))
    return out, int(seen["n"])


def cut_lineage(df: DataFrame, **options: str | int) -> DataFrame:
    """Write the table once below the shared folder and go on from the files; ``options`` are the writer's.

    Nothing is recomputed when an executor is lost, and the planner knows the written size.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.options(**options).parquet(path)
    return _read_step(df, path)


def _read_step(df: DataFrame, path: str) -> DataFrame:
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._step = path
    return out


def drop_steps(*steps: DataFrame) -> None:
    """Delete tables that ``cut_*`` has written, once nothing that is still to run reads them: a step whose successor is written, say.

    Only the very DataFrames that ``cut_*`` returned are known as steps; others are left alone.
    """
    for df in steps:
        path = getattr(df, "_step", None) if "_step" in df.__dict__ else None
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

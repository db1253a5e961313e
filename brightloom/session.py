"""Session construction, the shared work folder and size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}
ROWS_PER_FILE = 20_000  # of checkpoints whose length is known; a longer one has more files, not longer ones


def local_session(app: str = "brightloom", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        # hash instead of sort joins where the measured build partitions are small
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "32m")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BRIGHTLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="brightloom-")
    return _LOCAL_DIRS[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is ever overwritten in place."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Reliable checkpoint in the shared folder, so lost executors can be replaced.

    A checkpoint has a file per partition, empty ones too, and for each file Hadoop's local file system starts
    processes of its own. ``rows`` says about how many rows there are at most: a short table is then
    written by few tasks, however many shuffle partitions there are.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    return df.checkpoint(eager=True)


@contextmanager
def dealt_once(spark: SparkSession) -> Iterator[None]:
    """For eager steps: sides that are dealt by some of a join's keys are not dealt again by all of them, and
    the files a step shuffled go when it ends. Only the plans of this block differ, no result does."""
    ours = {
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder by columns and read again: far smaller than a checkpoint of whole rows, and
    a later read takes the columns it needs only."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with dealt_once(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast only after counting that the side has at most ``max_rows`` rows.

    The count stops at ``max_rows + 1`` rows. A larger side comes back without a hint and
    is joined by shuffle.
    """
    seen = df.limit(max_rows + 1).count()
    return F.broadcast(df) if seen <= max_rows else df


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """A side that is much smaller than its input: computed once, stored, counted, and then
    broadcast if the count allows it, so that the large side is not shuffled for it."""
    return broadcast_if_small(cut_lineage(df), max_rows)

"""Session helpers: local test sessions, lineage cuts, input width."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def local_session(app: str = "rankloom", cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on one machine, for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's own folder under spark.checkpoint.dir; one is made only in a one-process session that names none.

    On a cluster the folder must be shared by all executors, so an unset one is an error there, as in a cluster of several
    processes on one machine. What is written there goes when the driver ends.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if re.fullmatch(r"local(\[[^\]]*\])?", sc.master) is None:
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = os.path.join(tempfile.gettempdir(), f"rankloom-{os.getuid()}")
        sc.setCheckpointDir(named)
    own = sc._jsc.sc().getCheckpointDir().get()
    path = sc._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there.

    Used where a plan is read more than once or is too deep; the files survive a lost executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a compressed table of which later steps read the columns they need: for wide rows and texts."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str, factor: int = 2) -> DataFrame:
    """Rows spread by columns over a fixed number of partitions that the planner doesn't put together again: for much work a row."""
    spark = df.sparkSession
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), factor * spark.sparkContext.defaultParallelism)
    return df.repartition(wide, *by)


def per_worker(key: str, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once a Python worker: functions that travel by value have globals of their own in each task."""
    kept = sys.__dict__.setdefault("_rankloom_kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def widen(df: DataFrame, factor: int = 1) -> DataFrame:
    """Spread a narrow input (few files) over all cores before a stage with much work a row.

    Inputs with at least ``factor`` partitions a core, as any large table has, aren't shuffled.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * factor
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= want else df.repartition(want)


def if_small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df``, marked for a broadcast if it has at most ``most`` rows, as it is otherwise; counted here, so it should be written or cheap."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

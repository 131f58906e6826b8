"""Session factory and the settings that operators read from a session."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "canonry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer.

    On a cluster the master, memory and checkpoint folder come from the
    submit command; only unset values get a default here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, for tables between two steps.

    It is what `spark.checkpoint.dir` names, or the context's checkpoint
    folder. Where both are unset, local mode gets a folder of its own that
    ends with the process; a cluster gets an error.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_local_folder()}"


@lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="canonry-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def written(df: DataFrame, flag: str | None = None) -> tuple:
    """`df` as a Parquet table of the shared folder, which cuts its lineage and outlives executors; its number of rows; with `flag`, how many have that column true."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/canonry-steps/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag) if flag else F.lit(False)).alias("k")).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return (table, seen.get["n"], seen.get["k"]) if flag else (table, seen.get["n"])


def scans(spark: SparkSession, blocks: Iterable, scan: Callable[[Broadcast], DataFrame]) -> list[DataFrame]:
    """What `scan` gives for each block, which is sent to the executors.

    One block stays lazy. Of several each is scanned and written before the
    next is built, so the driver and the executors hold one at a time.
    """
    parts, held = [], None
    for block in blocks:
        if held is not None:
            parts.append(written(scan(held))[0])
            held.destroy()
        held = spark.sparkContext.broadcast(block)
    if held is not None:
        last = scan(held)
        if parts:
            last, _ = written(last)
            held.destroy()
        parts.append(last)
    return parts


def stored(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame], bucket: str | None = None) -> DataFrame:
    """A table derived from the files `sources`, built once and kept in the shared folder; rows of one `bucket` value share a folder.

    The sources' paths, sizes and times are part of its name, so changed files
    get a new table. A table is complete once it has its success mark; a
    builder that was lost leaves none and the next one builds again.
    """
    mark = hashlib.sha256(repr((name, file_state(spark, sources))).encode()).hexdigest()[:24]
    target = f"{shared_folder(spark)}/canonry-stored/{name}-{mark}"
    held = _OPEN.get((spark.sparkContext.applicationId, target))
    if held is not None:
        return held
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        writer = build().write.mode("overwrite")
        (writer.partitionBy(bucket) if bucket else writer).parquet(target)
    # its files don't change, so they are listed once
    _OPEN[spark.sparkContext.applicationId, target] = spark.read.parquet(target)
    return _OPEN[spark.sparkContext.applicationId, target]


#: Stored tables that this process has opened.
_OPEN: dict[tuple[str, str], DataFrame] = {}


def file_state(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int, int]]:
    """Path, bytes, files and time of change of each of `paths`; a few calls each, however many files it has."""
    conf, state = spark.sparkContext._jsc.hadoopConfiguration(), []
    for source in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(source)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            state.append((source, 0, 0, 0))
            continue
        summary = fs.getContentSummary(path)
        state.append((source, summary.getLength(), summary.getFileCount(), fs.getFileStatus(path).getModificationTime()))
    return state


def ship(spark: SparkSession, root: str) -> None:
    """Makes the package below `root` importable in Python workers that don't find it by themselves.

    Workers find it when they start in `root` or have it in PYTHONPATH; else
    the package is sent to them by Spark, once per session.
    """
    # Spark 4.1 may zip the parts of a union by their partitioning, which fails when adaptive execution has given them different numbers of partitions
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    paths = [os.path.abspath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p]
    if os.path.abspath(root) in paths or getattr(spark.sparkContext, "_canonry_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "canonry-package"), "zip", root, "canonry")
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._canonry_shipped = True

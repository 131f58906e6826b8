"""Named Parquet tables of one data folder, and tables derived from them once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from canonry.session import stored


def place(folder: str, name: str) -> str:
    """Where the table `name` is."""
    return f"{folder.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` below `folder`; one file or a directory of files. The schema of a single file that hasn't changed is read once."""
    path = place(folder, name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or fs.getFileStatus(where).isDirectory():
        return spark.read.parquet(path)
    status = fs.getFileStatus(where)
    state = (status.getLen(), status.getModificationTime())
    if _SCHEMAS.get(path, (None,))[0] != state:
        _SCHEMAS[path] = (state, spark.read.parquet(path).schema)
    return spark.read.schema(_SCHEMAS[path][1]).parquet(path)


_SCHEMAS: dict[str, tuple[tuple[int, int], StructType]] = {}


def derived(spark: SparkSession, folder: str, name: str, sources: list[str], build: Callable[[], DataFrame], bucket: str | None = None) -> DataFrame:
    """A table made from the tables `sources` of `folder`, built at its first use and again when one of them changes."""
    return stored(spark, name, [place(folder, s) for s in sources], build, bucket)

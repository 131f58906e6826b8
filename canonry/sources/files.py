"""Documents from files, id lists, and table sinks."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.operators.graph import latest

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file, one a line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))


def doc_text(data: bytes) -> str:
    """Readable runs of a legacy DOC file: UTF-16 first, then UTF-8."""
    for encoding in ("utf-16-le", "utf-8"):
        text = data.decode(encoding, "ignore")
        runs = re.findall(r"[\w\s.,;:()/%\-–“”\"']{20,}", text)
        kept = [r.strip() for r in runs if sum(c.isalpha() and ord(c) < 0x1F00 for c in r) > len(r) // 2]
        if kept:
            return "\n".join(kept)
    return ""


def pdf_text(data: bytes) -> str:
    """Text shown by the content streams of a simple PDF; fonts with their own encoding need a decoder plug-in."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        for line in re.split(rb"\bT\*|\bTd\b|\bTD\b|\bET\b", body):
            shown = b"".join(re.sub(rb"\\([()\\])", rb"\1", s) for s in re.findall(rb"\(((?:\\.|[^\\()])*)\)", line))
            if shown.strip():
                out.append(shown.decode("latin-1"))
    return "\n".join(out)


READERS = {"docx": docx_text, "doc": doc_text, "pdf": pdf_text, "txt": lambda data: data.decode("utf-8", "replace")}


def read_documents(spark: SparkSession, path: str, readers: dict = READERS) -> DataFrame:
    """`path`, `kind`, `text`, `error` of all files under `path`; formats go by extension, unreadable files keep their error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("kind"), "content").where(F.col("kind").isin(list(readers)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for kind, data in zip(batch["kind"], batch["content"]):
                try:
                    texts.append(readers[kind](bytes(data)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": batch["path"], "kind": batch["kind"], "text": texts, "error": errors})

    return rows.mapInPandas(run, "path string, kind string, text string, error string")


def read_ids(spark: SparkSession, path: str, column: str = "id") -> DataFrame:
    """Distinct ids of a CSV list; a missing file is an empty list, so nothing is selected."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"{column} string")
    return spark.read.csv(path, header=True).select(F.trim(column).alias(column)).where(F.col(column).isNotNull()).distinct()


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows of both, the latest of each key."""
    return latest(current.unionByName(changes), key, order)


def deactivate(rows: DataFrame, flag: str, which: Column) -> DataFrame:
    """Rows with `flag` turned off where `which` holds; null counts as not holding."""
    return rows.withColumn(flag, F.when(F.coalesce(which, F.lit(False)), False).otherwise(F.col(flag)))


def pending(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't among those done: resuming a job."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def write_partitioned_csv(df: DataFrame, path: str, by: list[str]) -> None:
    """CSV files in a folder per value."""
    df.write.mode("overwrite").partitionBy(*by).option("header", "true").csv(path)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once: the check behind a uniqueness rule."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def create_table(spark: SparkSession, path: str, schema: str, by: list[str] | None = None) -> bool:
    """An empty Parquet table with `schema`, in folders by `by`; false, and nothing done, where something is already there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return False
    writer = spark.createDataFrame([], schema).write
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return True


def flush_table(spark: SparkSession, path: str) -> None:
    """Replaces a Parquet table by an empty one with the same columns."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def merged(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key; a change's null keeps the old value, its other values replace it. Each side has a key once."""
    rest = [c for c in current.columns if c not in key]
    both = current.alias("old").join(changes.alias("new"), key, "full_outer")
    new = set(changes.columns)
    return both.select(*key, *[(F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")) if c in new else F.col(f"old.{c}")).alias(c) for c in rest])


def write_report(lines: DataFrame, path: str) -> None:
    """One text file per part of the sorted lines of column `value`."""
    lines.select("value").write.mode("overwrite").text(path)


def split_by_sector_and_year(rows: DataFrame, sectors: str, year: str, path: str) -> None:
    """CSV files in a folder for each sector and year; a row with several sectors is in each of them."""
    each = rows.withColumn("sector", F.explode(F.array_distinct(F.filter(F.transform(F.split(sectors, ","), lambda s: F.trim(s)), lambda s: s != ""))))
    write_partitioned_csv(each.withColumnRenamed(year, "year") if year != "year" else each, path, ["sector", "year"])


#: Fixed value: extensions of files that may be uploaded.
UPLOADS = (".pdf", ".docx", ".doc")


def upload_problem(name: Column | str, read_only: bool = False) -> Column:
    """Why a file may not be uploaded: `read-only`, `format`; null if it may."""
    lower = F.lower(F.col(name) if isinstance(name, str) else name)
    good = F.lit(False)
    for end in UPLOADS:
        good = good | lower.endswith(end)
    return F.lit("read-only") if read_only else F.when(~F.coalesce(good, F.lit(False)), "format")

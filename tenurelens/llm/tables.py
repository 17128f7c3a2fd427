"""Reading the tables the operators work on, and sizing their partitions."""
from __future__ import annotations

import ctypes
import math
import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenurelens.sources.shared import new_path

_SHIPPED: dict = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, where they can't import it from their path."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in (os.environ.get("PYTHONPATH") or "").split(os.pathsep) or Path.cwd() == root:
        return
    folder = tempfile.TemporaryDirectory(prefix="package-")  # the driver serves the file until it ends
    target = Path(folder.name, "tenurelens_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "tenurelens").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED[app] = folder


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id`` (long) and ``text`` (null becomes empty); all others are left out.

    Rows without an id keep a null ``doc_id``.
    """
    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def give_back() -> None:
    """Returns what a Python worker has freed to the system: workers live on for other stages and operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def write(df: DataFrame, path: str, by: str | None = None) -> None:
    """Writes an intermediate table; the shuffle files it took are given up as soon as it is there."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        conf.set(key, before)


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder, in one folder per value of ``by``, and read again."""
    path = new_path(df.sparkSession, name)
    write(df, path, by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts, from one pass over the column."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def partitions_for(spark: SparkSession, parts: int) -> int:
    """At least ``parts``, and no fewer than the session's own shuffle setting."""
    return max(int(parts), int(spark.conf.get("spark.sql.shuffle.partitions")))


def cuts(total: int, each: int) -> int:
    """Pieces of about ``each`` that ``total`` makes, 1 at least."""
    return max(1, math.ceil(total / each))

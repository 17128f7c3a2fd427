"""Sources and sinks: parquet and catalog tables, CSV dimensions, result tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tenurelens.schema import ENTITY


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table of a directory of tables."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def catalog_table(spark: SparkSession, name: str, fallback: T.StructType | None = None) -> DataFrame:
    """Catalog table; an empty frame of the given schema where it does not exist."""
    if fallback is not None and not spark.catalog.tableExists(name):
        return spark.createDataFrame([], fallback)
    return spark.table(name)


def read_csv(spark: SparkSession, path: str, schema=None, encoding: str = "ISO-8859-1") -> DataFrame | None:
    """CSV dimension with header; None where the file is missing or holds no row."""
    reader = spark.read.option("header", True).option("encoding", encoding)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    try:
        df = reader.csv(path)
    except AnalysisException:
        return None
    return None if df.isEmpty() else df


def has_columns(df: DataFrame | None, required) -> bool:
    """Gate used before a join: are all required columns there?  Reads only the schema."""
    return df is not None and set(required) <= set(df.columns)


def or_constant(df: DataFrame, gates, column: str, fallback, build) -> DataFrame:
    """``build(df)`` where every (frame, required columns) gate holds, else a constant column."""
    if all(has_columns(g, req) for g, req in gates):
        return build(df)
    return df.withColumn(column, F.lit(fallback))


def save_features(df: DataFrame, columns=None, table: str | None = None, path: str | None = None,
                  partition_by: str | None = "vantage_date", mode: str = "overwrite") -> DataFrame:
    """Write the wanted columns that exist to a table, a parquet folder, or both."""
    out = df if not columns else df.select(*[c for c in dict.fromkeys(columns) if c in df.columns])
    parts = [partition_by] if partition_by and partition_by in out.columns else []
    if path:
        out.write.mode(mode).partitionBy(*parts).parquet(path)
        # the table is filled from the files just written, so the features are computed once
        out = out.sparkSession.read.parquet(path) if table else out
    if table:
        out.write.mode(mode).partitionBy(*parts).saveAsTable(table)
    return out


def save_bucketed(df: DataFrame, table: str, by=ENTITY, buckets: int | None = None, mode: str = "overwrite") -> DataFrame:
    """A managed catalog table bucketed and sorted by ``by``, and its rows: tables bucketed alike are joined or grouped on the key without a shuffle.

    The number of buckets is the session's number of shuffle partitions unless given.
    """
    spark, by = df.sparkSession, list(by)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, *by).write.mode(mode).bucketBy(buckets, *by).sortBy(*by).saveAsTable(table)
    return spark.table(table)


def save_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a report table as JSON lines."""
    df.write.mode(mode).json(path)

"""Sample, training and model tables on storage."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metriloom.functions.names import series_id
from metriloom.schemas import SAMPLE


def write_samples(df: DataFrame, path: str, *, mode: str = "append") -> None:
    """Sample table by date, sorted by (name, time) inside its files so row groups can be skipped.

    The rebalance lets AQE size the files from the shuffled volume: a busy date is split over many
    tasks and files, quiet dates share one.
    """
    (
        df.withColumn("date", F.to_date("timestamp"))
        .hint("rebalance", "date")
        .sortWithinPartitions("date", "name", "timestamp")
        .write.mode(mode)
        .partitionBy("date")
        .parquet(path)
    )


def write_by_date(df: DataFrame, path: str, *, ts: str = "timestamp", order: Sequence[str] = (), mode: str = "append", unit: str = "day") -> None:
    """Any table with a time column in folders by date (of the day, or of the first day of its ``unit``, as month),
    sorted inside its files; rows without a time get a folder that no time interval reads."""
    (
        df.withColumn("date", F.date_trunc(unit, ts).cast("date"))
        .hint("rebalance", "date")
        .sortWithinPartitions("date", *order, ts)
        .write.mode(mode)
        .partitionBy("date")
        .parquet(path)
    )


def stored_dates(spark: SparkSession, path: str) -> list[str]:
    """Dates of the folders below ``path``, newest first: a listing of names, no file is opened."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted((n.removeprefix("date=") for n in names if re.fullmatch(r"date=\d{4}-\d{2}-\d{2}", n)), reverse=True)


def _by_date(spark: SparkSession, path: str) -> DataFrame:
    """The table with its folders' date; its columns are those of the newest folder."""
    days = stored_dates(spark, path)
    if not days:
        return spark.read.parquet(path)
    columns = spark.read.parquet(f"{path.rstrip('/')}/date={days[0]}").schema
    return spark.read.schema(T.StructType([*columns.fields, T.StructField("date", T.DateType())])).parquet(path)


def newest_time(spark: SparkSession, path: str, *, ts: str = "timestamp"):
    """The newest time of a table in date folders, read from the newest folder that has rows; None if it has none."""
    df = _by_date(spark, path)
    for day in stored_dates(spark, path):
        found = df.where(F.col("date") == F.lit(day).cast("date")).agg(F.max(ts)).first()[0]
        if found is not None:
            return found
    return None


def read_recent(spark: SparkSession, path: str, seconds: int, *, ts: str = "timestamp", as_of=None, unit: str = "day") -> tuple[DataFrame, object]:
    """Rows of the last ``seconds`` up to any later time, and the evaluation time (the newest row's unless given).

    Only the date folders of the interval are read: the cut-off is a literal, on the folder and on the time. What
    comes after decides whether the first moment belongs to the interval.
    """
    at = as_of if as_of is not None else newest_time(spark, path, ts=ts)
    df = _by_date(spark, path)
    if at is None:
        return df.drop("date").limit(0), None
    since = at - timedelta(seconds=seconds)
    kept = df.where((F.col("date") >= F.date_trunc(unit, F.lit(since)).cast("date")) & (F.col(ts) >= F.lit(since).cast(df.schema[ts].dataType)))
    return kept.drop("date"), at


def read_samples(spark: SparkSession, path: str, *, start=None, end=None, names: list[str] | None = None) -> DataFrame:
    """Canonical samples with ``series_id``. The time interval prunes date folders and, with the names,
    is pushed into the scan."""
    df = spark.read.schema(T.StructType([*SAMPLE.fields, T.StructField("date", T.DateType())])).parquet(path)
    if start is not None:
        df = df.where((F.col("date") >= F.to_date(F.lit(start))) & (F.col("timestamp") >= F.lit(start)))
    if end is not None:
        df = df.where((F.col("date") <= F.to_date(F.lit(end))) & (F.col("timestamp") <= F.lit(end)))
    if names:
        df = df.where(F.col("name").isin(names))
    return df.drop("date").withColumn("series_id", series_id("name", "labels"))


def read_training_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Training frame: a timestamp and numeric columns, with the schema given."""
    fields = [T.StructField("timestamp", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in columns]]
    return spark.read.schema(T.StructType(fields)).csv(path, header=True)


def write_training_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def write_parameters(params: DataFrame, path: str, *, model: str, version: int) -> None:
    """Store one version of a parameter table; writing a version again replaces it alone."""
    (
        params.withColumn("model", F.lit(model))
        .withColumn("version", F.lit(version).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model", "version")
        .parquet(path)
    )


def read_parameters(spark: SparkSession, path: str, *, model: str, version: int) -> DataFrame:
    return spark.read.parquet(path).where((F.col("model") == model) & (F.col("version") == version))


def data_summary(df: DataFrame, *, ts: str = "timestamp") -> DataFrame:
    """One row: records, columns and the time range (NULL without a time column)."""
    has_time = ts in df.columns
    return df.agg(
        F.count("*").alias("n_records"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"),
        (F.min(ts) if has_time else F.lit(None)).alias("start"),
        (F.max(ts) if has_time else F.lit(None)).alias("end"),
    )

"""Streaming jobs built from the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from metriloom.operators import store
from metriloom.session import ROCKSDB, new_path
from metriloom.sources.payloads import ingest_payload


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the files of a table, a single file or a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a glob is used so that a path that is one file is accepted as well
    head, _, last = path.rstrip("/").rpartition("/")
    return reader.parquet(f"{head}/[{last[0]}]{last[1:]}")


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarked event time; watermarks need a timestamp with zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def start(df: DataFrame, path: str, checkpoint: str, *, available_now: bool = False, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append a stream to a parquet table, exactly once by its checkpoint."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_split(df: DataFrame, path: str, late_path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """Append the rows of an ordered stream to one table and its late rows to another.

    A batch writes its own folder of either table, so a repeated batch replaces what it wrote.
    """

    def write(frame: DataFrame, batch: int) -> None:
        frame.persist()
        for rows, at in (("NOT late", path), ("late", late_path)):
            frame.where(rows).drop("late").write.mode("overwrite").parquet(f"{at}/batch={batch}")
        frame.unpersist()

    writer = df.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def closed_by(stream: DataFrame, ts: str, path: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream with an end: calling the second value moves the watermark beyond all times of the stream.

    The end is one row without key and value at the last day that timestamps know, in a file below ``path``, a
    shared folder that the returned stream reads as well. It is never applied itself.
    """
    spark, schema = stream.sparkSession, stream.schema
    columns = [(F.lit("9999-12-30") if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    end = spark.range(1).select(*columns)
    end.limit(0).write.parquet(path)
    rows = spark.readStream.schema(schema).parquet(path)
    return stream.unionByName(rows), lambda: end.write.mode("append").parquet(path)


def replay(df: DataFrame, label: str, partition_by: Sequence[str] = (), close: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over everything available and read the table it wrote.

    With ``close`` (see ``closed_by``) the stream goes on after its end is set, so that rows waiting for the
    watermark are released.
    """
    spark = df.sparkSession
    out = new_path(spark, label)
    for finish in (None, close) if close else (None,):
        if finish:
            finish()
        start(df, f"{out}/table", f"{out}/checkpoint", available_now=True, partition_by=partition_by).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/table")


def stream_ingest(payloads: DataFrame, *, keep: Sequence[str] = (), **columns) -> tuple[DataFrame, DataFrame]:
    """Accepted samples and rejects of a payload stream; both are append streams."""
    return ingest_payload(payloads, keep=keep, **columns)


def stream_align(
    samples: DataFrame, *, keys: Sequence[str], ts: str = "timestamp", value: str = "value", period: str = "5 minutes", slide: str | None = None,
    delay: str = "10 minutes",
) -> DataFrame:
    """Mean, sum and count per series and (tumbling or sliding) window; rows behind the watermark are dropped."""
    window = F.window(ts, period, slide) if slide else F.window(ts, period)
    grouped = with_event_time(samples, ts, delay).groupBy(*keys, window.alias("w"))
    return grouped.agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), F.count(value).alias("samples")).select(
        *keys, F.col("w.start").alias(ts), F.col("w.end").alias("window_end"), "mean", "total", "samples"
    )


def registry_batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function folding registry events into versioned state tables under ``path``.

    Batch n reads the state of the last batch before n and writes ``batch=n``, so a repeated batch gives
    the same table. A state holds one row per agent.
    """

    def write(events: DataFrame, batch: int) -> None:
        parts = [store.registry_partials(events)]
        previous = state_version(events.sparkSession, path, before=batch)
        if previous is not None:
            parts.append(previous)
        store.merge_partials(*parts).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def state_version(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest state table under ``path`` (older than ``before`` where given)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = [n for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    batches = sorted(int(n.split("=")[1]) for n in done)
    batches = [b for b in batches if before is None or b < before]
    return spark.read.parquet(f"{path}/batch={batches[-1]}") if batches else None


def stream_registry(events: DataFrame, path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    writer = events.writeStream.foreachBatch(registry_batch_writer(path)).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()

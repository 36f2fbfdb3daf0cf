"""Runs streaming plans to the end of their input, for queries and tests."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from wharfline.session import shared_dir
from wharfline.sources.tables import table


def stream_table(spark: SparkSession, sf_dir: str, name: str, files: int = 4, order: str | None = None) -> DataFrame:
    """A table as a stream of files, one in each micro-batch.

    A folder of several files is read as it lies there. A table in fewer files is
    written to the shared folder once more, as so many of them, so that state
    goes from batch to batch as it would for an endless source. With ``order``
    the files are stretches of that column, and the batches come in its order.
    """
    batch, at = table(spark, sf_dir, name), f"{sf_dir.rstrip('/')}/{name}.parquet"
    if order:
        number = F.col(order).cast("timestamp").cast("long") if batch.schema[order].dataType.simpleString().startswith("timestamp") else F.col(order).cast("long")
        cuts = batch.agg(F.percentile_approx(number, F.array(*[F.lit(k / files) for k in range(1, files)]))).first()[0] or []
        return in_stretches(batch, sum((F.when(number > c, 1).otherwise(0) for c in cuts), F.lit(0)), files)
    if len(batch.inputFiles()) < files:
        at = f"{shared_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
        batch.repartition(files).write.parquet(at)
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(at)


def in_stretches(df: DataFrame, number: Column, files: int) -> DataFrame:
    """A stream of ``df`` with a micro-batch for each ``number`` from 0 on, in this order.

    Files are read by the time of writing, so they are written one after the other.
    """
    at = f"{shared_dir(df.sparkSession).rstrip('/')}/stretches-{uuid.uuid4().hex}"
    for k in range(files):
        df.where(number == k).coalesce(1).write.mode("append").parquet(at)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)


def drain(df: DataFrame, mode: str = "append", numbered: bool = False) -> DataFrame:
    """Runs the stream on what there is, and gives its result as a batch.

    Each batch is written under its number in the shared folder, so one that is
    run again after a failure replaces itself. In complete mode the last batch
    is the result, else all of them together, with their numbers as ``batch`` if
    that is asked for.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    seen: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/{number}")
        seen.append(number)

    query = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    numbers = sorted(set(seen))
    if mode == "complete":
        numbers = numbers[-1:]
    if numbered:
        kept = [spark.read.schema(df.schema).parquet(f"{at}/out/{n}").withColumn("batch", F.lit(n).cast("bigint")) for n in numbers]
        return reduce(DataFrame.union, kept) if kept else spark.createDataFrame([], df.schema.add("batch", "long"))
    if not numbers:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*[f"{at}/out/{n}" for n in numbers])


def every(df: DataFrame, seconds: float, told: Callable[[int, DataFrame], None], checkpoint: str | None = None) -> StreamingQuery:
    """Starts a stream in micro-batches of a fixed interval and calls ``told`` with each.

    The checkpoint keeps offsets and state: a query that is started again with
    it goes on where the last finished batch ended, and a batch that failed is
    run again under its number.
    """
    at = checkpoint or f"{shared_dir(df.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}/checkpoint"
    writer = df.writeStream.foreachBatch(lambda batch, number: told(number, batch))
    return writer.option("checkpointLocation", at).trigger(processingTime=f"{seconds} seconds").start()

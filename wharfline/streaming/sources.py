"""Stream sources and sinks: rate, sentences, sockets with 8-byte frames, Kafka."""

from __future__ import annotations

import socket
import struct
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.query import StreamingQuery

from wharfline.functions.scalar import decode_event, encode_event
from wharfline.session import has_format

#: Own sentences for the random source.
SENTENCES = ("a ship left the quiet harbour", "the tide turns twice a day", "old ropes creak in the wind", "gulls follow the evening boats", "the lamp burns until morning")
PORT = 51762


def rate(spark: SparkSession, rows_per_second: int, partitions: int = 4) -> DataFrame:
    """An endless generator: (timestamp, value)."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).option("numPartitions", partitions).load()


def micro_batches(spark: SparkSession, batch_size: int, partitions: int = 4) -> DataFrame:
    """A generator whose ids go on by ``batch_size`` with every batch."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", batch_size).option("numPartitions", partitions).load()


def sentences(ids: DataFrame, value: str = "value") -> DataFrame:
    """A sentence for every row, drawn by the hash of its id."""
    every = F.array(*[F.lit(s) for s in SENTENCES])
    return ids.withColumn("sentence", F.get(every, F.pmod(F.xxhash64(value), F.lit(len(SENTENCES))).cast("int")))


class _FrameReader(SimpleDataSourceStreamReader):
    """Reads whole frames from a port; the offset counts them."""

    def __init__(self, options: dict) -> None:
        self.address = (options.get("host", "127.0.0.1"), int(options.get("port", PORT)))
        self.wait = float(options.get("waitSeconds", 0.2))
        self.kept: list[tuple[int, int]] = []
        self.base = 0
        self.buffer = b""
        self.link: socket.socket | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frames": 0}

    def _pull(self) -> None:
        try:
            if self.link is None:
                self.link = socket.create_connection(self.address, timeout=self.wait)
            self.link.settimeout(self.wait)
            until = time.monotonic() + self.wait
            while time.monotonic() < until:
                got = self.link.recv(1 << 16)
                if not got:
                    break
                self.buffer += got
        except OSError:
            pass
        whole = len(self.buffer) // 8 * 8
        self.kept += list(struct.iter_unpack("<ii", self.buffer[:whole]))
        self.buffer = self.buffer[whole:]

    def read(self, start: dict):
        self._pull()
        rows = self.kept[start["frames"] - self.base :]
        return iter(rows), {"frames": start["frames"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        return iter(self.kept[start["frames"] - self.base : end["frames"] - self.base])

    def commit(self, end: dict) -> None:
        del self.kept[: end["frames"] - self.base]
        self.base = end["frames"]


class FrameSocket(DataSource):
    """Events as little-endian int pairs from a TCP port."""

    @classmethod
    def name(cls) -> str:
        return "frame_socket"

    def schema(self) -> str:
        return "source int, event int"

    def simpleStreamReader(self, schema) -> _FrameReader:  # noqa: N802
        return _FrameReader(self.options)


def frame_socket(spark: SparkSession, host: str = "127.0.0.1", port: int = PORT) -> DataFrame:
    spark.dataSource.register(FrameSocket)
    return spark.readStream.format("frame_socket").option("host", host).option("port", port).load()


def _send_frames(host: str, port: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link = None
        for b in batches:
            if b.num_rows:
                link = link or socket.create_connection((host, port))
                link.sendall(np.stack((b.column(0).to_numpy(), b.column(1).to_numpy()), axis=1).astype("<i4").tobytes())
        if link:
            link.close()
        yield from ()

    return send


def to_frame_socket(df: DataFrame, checkpoint: str, host: str = "127.0.0.1", port: int = PORT) -> StreamingQuery:
    """Starts a stream that sends (source, event) rows as 8-byte frames to a port.

    Every task with rows has a connection of its own. As a socket can't take
    frames back, a batch that is run again sends its frames again.
    """

    def told(batch: DataFrame, number: int) -> None:
        pairs = batch.select(F.col("source").cast("int"), F.col("event").cast("int"))
        pairs.mapInArrow(_send_frames(host, port), "source int, event int").write.format("noop").mode("overwrite").save()

    return df.writeStream.foreachBatch(told).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def has_kafka(spark: SparkSession) -> bool:
    return has_format(spark, "kafka")


def kafka_events(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Decoded events of a topic. Offsets and partitions are kept by the checkpoint."""
    if not has_kafka(spark):
        raise RuntimeError("the Kafka connector isn't on the class path")
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return raw.select(decode_event(F.col("value")).alias("d")).select("d.source", "d.event")


def kafka_strings(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    if not has_kafka(spark):
        raise RuntimeError("the Kafka connector isn't on the class path")
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return raw.select(F.col("value").cast("string").alias("value"))


def event_values(events: DataFrame) -> DataFrame:
    """(source, event) rows as the 8-byte ``value`` that a topic of events holds."""
    return events.select(encode_event(F.col("source"), F.col("event")).alias("value"))


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Writes a ``value`` column (and ``partition``, if there) to a topic; see ``event_values``."""
    if not has_kafka(df.sparkSession):
        raise RuntimeError("the Kafka connector isn't on the class path")
    return df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()

"""Session factory and the shared-folder helpers every iterative plan uses."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wharfline", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the queries are written for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset on a
    local master, as in tests, a temporary folder is made and set; on a cluster
    no machine's own folder would do, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="wharfline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike ``localCheckpoint`` the copy outlives any executor, and unlike
    ``persist`` it is never computed again when a block is lost.

    It also parts a summary by key from the rows that are joined with it: next
    to an aggregate by the same key Spark joins in the aggregate's partitions,
    which it can't split, while beside a table a hot key's rows are split.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_scratch: dict[str, list[str]] = {}


def scratch_mark(spark: SparkSession) -> int:
    """How many tables ``materialise`` has written for this application so far."""
    return len(_scratch.setdefault(spark.sparkContext.applicationId, []))


def drop_scratch(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that ``materialise`` has written after a mark.

    Frames that still read these tables fail afterwards, so a job calls it when
    its results are written, with the mark it took at its start.
    """
    written = _scratch.setdefault(spark.sparkContext.applicationId, [])
    gone, written[since:] = written[since:], []
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcasts an object of this package's classes, as pickled bytes.

    A plain broadcast names classes, which an executor without this package
    couldn't import; ``pickle.loads(shipped.value)`` works on any.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def give_back() -> None:
    """Returns to the system what this process holds and no longer uses."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, for ``mapInArrow``, in a worker that gives back its unused memory before and after.

    A worker is used again by later tasks, of other operators too, and without
    this it keeps beside the JVM most of what any of them ever took.
    """

    def whole(batches: Iterator) -> Iterator:
        give_back()
        yield from run(batches)
        give_back()

    return whole


def has_format(spark: SparkSession, name: str) -> bool:
    """Whether a source that ships apart from Spark is on the class path."""
    source = spark._jvm.org.apache.spark.sql.execution.datasources.DataSource
    try:
        source.lookupDataSource(name, spark._jsparkSession.sessionState().conf())
    except Exception:  # the JVM's exception for an unknown source arrives wrapped
        return False
    return True

"""Throughput and latency instruments of streams, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE_TOP = 1000


def latency_tag(i: Column, every: int) -> Column:
    """Whether an element carries its time.

    The remainder that is looked for starts at 1000 and falls by one with each
    tag, back to 1000 after 1; so tag j of a round lies in block j of ``every``
    elements at remainder 1000 - j, and rounds are 999 blocks long.
    """
    block, rest = F.floor(i / every), i % every
    j = F.lit(SAMPLE_TOP) - rest
    return rest.between(1, SAMPLE_TOP) & (block >= j) & ((block - j) % (SAMPLE_TOP - 1) == 0)


def simple_tag(i: Column, every: int) -> Column:
    return i % every == 0


def edge_tag(batch: str, order: list[str]) -> tuple[Column, Column]:
    """First and last element of each micro-batch."""
    up, down = Window.partitionBy(batch).orderBy(*order), Window.partitionBy(batch).orderBy(*[F.desc(c) for c in order])
    return F.row_number().over(up) == 1, F.row_number().over(down) == 1


def throughput(df: DataFrame, key: str, ms: Column, order: list[str], every: int) -> DataFrame:
    """Elements per second over each ``every`` elements; the first only starts the clock."""
    w = Window.partitionBy(key).orderBy(*order)
    marks = df.withColumn("n", F.row_number().over(w).cast("bigint")).withColumn("ms", ms).where(F.col("n") % every == 0)
    since = F.col("ms") - F.lag("ms").over(Window.partitionBy(key).orderBy("n"))
    return marks.withColumn("since", since).where("since > 0").select(key, "n", F.round(F.lit(every * 1000.0) / F.col("since"), 6).alias("per_second"))


def hops(df: DataFrame, i: str, n: int, partitions: int, by_key: bool = True) -> DataFrame:
    """n exchanges, each adding one to the id and the hop's name to the trace."""
    out = df.withColumn("trace", F.array().cast("array<string>"))
    for k in range(n):
        out = out.repartition(partitions, i) if by_key else out.repartition(partitions)
        out = out.withColumn(i, F.col(i) + 1).withColumn("trace", F.array_append("trace", F.lit(f"hop-{k}")))
    return out

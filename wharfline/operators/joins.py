"""Join operators: size-checked broadcast, cross-and-filter, full-outer checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is only broadcast if the optimizer's estimate of it is no larger.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint, or as it is if it may be larger than ``limit``."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def cross_filter(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """A product that is filtered; an equality in the filter is planned as an equi join."""
    return left.crossJoin(right).where(condition)


def identity_check(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Key groups which don't have exactly one row on each side.

    (keys, n_left, n_right); empty when the sides agree one to one. Counted
    before the join, so a repeated key multiplies nothing.
    """
    a = left.groupBy(*keys).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    b = b.select(*[F.col(k).alias(f"__{k}") for k in keys], "n_right")
    met = a.join(b, [a[k].eqNullSafe(b[f"__{k}"]) for k in keys], "full_outer")
    out = met.select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return out.where("n_left <> 1 OR n_right <> 1")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, as multisets."""
    only = lambda a, b, side: a.exceptAll(b).withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def must_be_empty(df: DataFrame, message: str = "a row where none may be") -> DataFrame:
    """``df``, which fails on its first row when it is run.

    The check hangs on a row number, so it can't be pushed below ``df``.
    """
    numbered = df.withColumn("__n", F.monotonically_increasing_id())
    return numbered.where(F.when(F.col("__n") >= 0, F.raise_error(F.lit(message)).cast("boolean"))).drop("__n")

"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.session import cut, materialise


#: Edges that a task takes at once, and holds of those before.
AT_ONCE = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node connected with it): all nodes but the least ones, and of those the ones with nothing but loops."""
    names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: u.size], at[u.size :]
    least = np.arange(names.size)
    while (apart := least[a] != least[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(least, np.maximum(least[a], least[b]), np.minimum(least[a], least[b]))
        while ((further := least[least]) != least).any():
            least = further
    told = (least != np.arange(names.size)) | (np.bincount(least, minlength=names.size) == 1)
    return names[told], names[least[told]]


def _forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what the given ones do, fewer where those of a partition close rings; loops stay only alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new, n = (np.empty(0, np.int64),) * 2, [], 0
        for b in batches:
            new.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n >= AT_ONCE:
                held = stars(*(np.concatenate(x) for x in zip(held, *new, strict=True)))
                new, n = [], 0
                if held[0].size >= AT_ONCE:
                    yield made(held)
                    held = (np.empty(0, np.int64),) * 2
        if held[0].size or n:
            yield made(stars(*(np.concatenate(x) for x in zip(held, *new, strict=True))))

    kinds = [edges.schema[c].dataType for c in ("u", "v")]

    def made(rows: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["u", "v"])

    if not all(isinstance(k, T.LongType) for k in kinds):
        return edges.distinct()
    return edges.mapInArrow(run, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u is linked to the least node around u."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them."""
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an undirected edge list.

    The component is its least node. Rings are cut inside the partitions
    first, so edges of nearby nodes should lie in one. The number of edges never grows, no
    neighbour list is gathered in one place, and each round ends in a reliable
    checkpoint; if ``max_rounds`` don't settle them, that is an error. Loops and repeated edges are allowed; edges with a null end are
    ignored; a node whose only edge is a loop is its own component.
    """
    given = cut(_forest(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()))
    loops = given.where("u = v").select("u").distinct()
    state = given.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seen = None
    for _ in range(max_rounds):
        row = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == seen or row[0] == 0:
            break
        seen = tuple(row)
        state = cut(_small_star(materialise(_large_star(state).distinct(), "large-star")).distinct())
    else:
        raise RuntimeError(f"components haven't settled after {max_rounds} rounds")
    out = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = state.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.join(out.select("node").union(roots.select("node")), loops.u == F.col("node"), "left_anti")
    return out.union(roots).union(alone.select(F.col("u").alias("node"), F.col("u").alias("component")))

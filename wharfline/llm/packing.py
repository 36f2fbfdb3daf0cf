"""Variable-capacity best-fit packing.

Every text is cut into pieces of the largest permitted length and a rest. The
pieces go into bins longest first, each into the open bin that it leaves least
room in; if it fits none, the permitted size is opened which costs least for a
token of it. Which sizes may be opened at all is optimised jointly: every set
of sizes that holds the largest is tried, each bin is then downsized to the
smallest permitted size that holds its contents, and the cheapest plan is kept.

Best fit looks at lengths only, so it runs on the histogram of the lengths,
which has as many rows as the largest size at most, however many documents
there are: bins filled alike are one record with a multiplicity. Placing all
pieces of one length ends in a few records more, and equals placing them one
by one. The documents of a length are then dealt to its places by rank. A rank
is a place within (length, shard) plus the counts of the shards before it, so a
length that a third of all rows have is ranked by many tasks.

Length is the number of UTF-8 bytes (the tokens of a byte-level model) unless a
``length`` column is named; :func:`with_token_counts` makes one from a vocabulary.

Defined results: a null or empty text has one row, piece 0 with no tokens and
no bin; null ids are ranked first; which of several rows that agree in id and
length gets which place is left open, each gets its own; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import itertools
import pickle
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wharfline.llm.names import map_carrying, quoted
from wharfline.session import materialise, ship

CAPACITIES = (2048, 4096, 8192)
#: Cost of a sequence: a fixed part, its length, and attention's square of it.
FIXED_COST = 64.0
SQUARE_COST = 1 / 16384
#: Rows that one task ranks, about.
SHARD_ROWS = 200_000


def cost(size: int) -> float:
    return FIXED_COST + size + size * size * SQUARE_COST


@dataclass
class Bins:
    """``many`` bins alike: opened size, and contents as (length, times)."""

    size: int
    many: int
    contents: tuple[tuple[int, int], ...]

    @property
    def used(self) -> int:
        return sum(n * k for n, k in self.contents)


def best_fit(histogram: dict[int, int], sizes: tuple[int, ...]) -> list[Bins]:
    """Best fit of all pieces, longest first, opening only ``sizes``."""
    room: dict[int, list[Bins]] = {}
    order: list[int] = []

    def put(left: int, bins: Bins) -> None:
        if left not in room:
            room[left] = []
            insort(order, left)
        room[left].append(bins)

    def fill(bins: Bins, left: int, length: int, count: int) -> int:
        """Stacks pieces in these bins, one bin after the other; what remains."""
        each = left // length
        whole = min(bins.many, count // each)
        if whole:
            put(left - each * length, Bins(bins.size, whole, (*bins.contents, (length, each))))
        count -= whole * each
        rest = bins.many - whole
        if rest and count:
            put(left - count * length, Bins(bins.size, 1, (*bins.contents, (length, count))))
            rest, count = rest - 1, 0
        if rest:
            put(left, Bins(bins.size, rest, bins.contents))
        return count

    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            at = bisect_left(order, length)
            if at < len(order):
                left = order[at]
                bins = room[left].pop(0)
                if not room[left]:
                    del room[left], order[at]
            else:
                left = min((s for s in sizes if s >= length), key=lambda s: (cost(s) / s, s))
                bins = Bins(left, -(-count // (left // length)), ())
            count = fill(bins, left, length, count)
    return [b for k in order for b in room[k]]


def downsized(bins: Bins, capacities: tuple[int, ...]) -> int:
    return min(c for c in capacities if c >= bins.used)


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[float, list[tuple[int, Bins]]]:
    """The cheapest plan's cost, and its records with their final sizes."""
    top, rest = max(capacities), sorted(capacities)[:-1]
    found = None
    for n in range(len(rest) + 1):
        for some in itertools.combinations(rest, n):
            bins = [(downsized(b, capacities), b) for b in best_fit(histogram, (*some, top))]
            total = sum(cost(c) * b.many for c, b in bins)
            if found is None or total < found[0]:
                found = (total, bins)
    return found


def _places(bins: list[tuple[int, Bins]]) -> np.ndarray:
    """Rows (key, rank, first bin, times a bin, offset, size), sorted by key.

    The key is length << 40 | first rank; the records are few, see above.
    """
    rows, ranks, first = [], {}, 0
    for size, b in bins:
        at = 0
        for length, each in b.contents:
            start = ranks.get(length, 0)
            rows.append((length << 40 | start, start, first, each, at, size))
            ranks[length] = start + b.many * each
            at += length * each
        first += b.many
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = None, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, bin_id, bin_size, bin_offset."""
    top = max(capacities)
    tokens = F.col(length) if length else F.octet_length(F.col(text).cast("string"))
    sized = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("n")), "packing")
    cut = F.expr(f"sequence(0, greatest(cast(ceil(n / {top}) as int) - 1, 0))")
    pieces = sized.select("doc_id", "n", F.explode(cut).alias("piece")).select("doc_id", F.col("piece").cast("long").alias("piece"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).alias("n_tokens"))
    filled = pieces.where("n_tokens > 0")
    histogram = {r[0]: r[1] for r in filled.groupBy("n_tokens").count().collect()}  # no more rows than the largest size
    places = docs.sparkSession.sparkContext.broadcast(_places(plan(histogram, capacities)[1]))
    shards = max(16, sum(histogram.values()) // SHARD_ROWS)
    dealt = filled.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    counts = dealt.groupBy("n_tokens", "shard").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("n_tokens").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("n_tokens", "shard", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("n_tokens", "shard").orderBy("doc_id", "piece"))
    ranked = dealt.withColumn("own", own).join(counts, ["n_tokens", "shard"]).select("doc_id", "piece", "n_tokens", (F.col("before") + F.col("own") - 1).alias("rank"))
    kind = sized.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for b in batches:
            n, rank = b.column("n_tokens").to_numpy(), b.column("rank").to_numpy()
            _, start, first, each, at, size = table[np.searchsorted(table[:, 0], n << 40 | rank, "right") - 1].T
            nth = rank - start
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("piece"), b.column("n_tokens"), pa.array(first + nth // each), pa.array(size.copy()), pa.array(at + nth % each * n)],
                names=["doc_id", "piece", "n_tokens", "bin_id", "bin_size", "bin_offset"],
            )

    packed = ranked.mapInArrow(run, f"doc_id {kind}, piece long, n_tokens long, bin_id long, bin_size long, bin_offset long")
    none = F.lit(None).cast("long")
    empty = pieces.where("n_tokens <= 0").select("doc_id", "piece", F.lit(0).cast("long"), none, none, none)
    return packed.union(empty)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a byte-level vocabulary file: a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def with_token_counts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` and the number of tokens of each whole text, for ``pack(..., length=name)``.

    ``ranks`` and ``pattern`` are a vocabulary's, read by the caller; they are of
    fixed size and go out with the tasks. A null text has none. The caller names
    the column, and one of that name is replaced.
    """
    shared = ship(docs.sparkSession, (pattern, ranks))
    kept = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        split, table = pickle.loads(shared.value)
        coder = tiktoken.Encoding("given", pat_str=split, mergeable_ranks=table, special_tokens={})
        for b in batches:
            counts = [len(coder.encode_ordinary(t)) if t else 0 for t in b.column("i0").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64())], names=[*b.schema.names[:-1], "a0"])

    return map_carrying(docs, kept, [F.col(quoted(text)).cast("string")], run, [T.StructField(name, T.LongType())])

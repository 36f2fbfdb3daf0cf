"""SimHash near-duplicate groups through multi-index hashing.

A document's 64-bit fingerprint is the majority vote over the XXH64 values of
its word shingles. Fingerprints at most ``max_distance`` bits apart are linked.
The bits are cut into as few segments as leave each a radius of 2 at most: by
the general pigeonhole rule, two linked fingerprints differ in at most that
many bits in one of them. Each fingerprint enumerates the small Hamming ball
around its value in every segment and is filed under each value of it; whatever
meets under one value is verified over all 64 bits.

* radius 2: both sides file under their radius-1 ball and meet half way;
* radius 1: each files under its own value and under those with one set bit
  cleared, so of two neighbours the larger reaches the smaller;
* radius 0: the value alone.

What shares a value is searched as a spanning forest, so a dense group of k
fingerprints gives k - 1 links rather than all pairs. A value that many
fingerprints share is split into blocks, and each pair of blocks is a unit of
its own, so no task holds an unbounded group.

Defined results: a null text has no words; no words give the fingerprint zero,
linked like any other; fewer words than a shingle give one shingle; repeated
rows and equal ids each get their own row; a null id never names a component
unless all of the component's ids are null; an empty table gives no rows; other
columns are carried by :func:`deduplicate` and ignored by the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.llm.names import map_carrying, quoted, unused
from wharfline.plans.components import connected_components
from wharfline.session import materialise

SEED = 42
SHINGLE = 4
MAX_DISTANCE = 4
#: A segment value that more fingerprints than this have is split into blocks.
HOT_VALUE = 2048
#: Fingerprints in a block of a split value.
BLOCK = 32768
#: Shingles whose bits are unpacked at once.
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned.

    ``bytes.split`` cuts at exactly the six ASCII white-space characters and
    ``bytes.lower`` changes exactly A-Z.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))[: len(words) - shingle + 1].tolist()
    ends = np.concatenate((gaps, [len(joined)]))[shingle - 1 :].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), _CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK], strict=True)], dtype=">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(votes * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, name: str = "fingerprint") -> DataFrame:
    """``docs`` without its text, and with the fingerprint as a signed long."""
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(x, shingle) for x in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found.view(np.int64))], names=[*b.schema.names[:-1], "a0"])

    if unused(kept, name)[0] != name:
        raise ValueError(f"a column is called {name} already")
    return map_carrying(docs, kept, [F.col(quoted(text)).cast("string")], run, [T.StructField(name, T.LongType())])


def segments(max_distance: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment."""
    n = max(1, -(-(max_distance + 1) // 3))
    each, extra = divmod(max_distance, n)
    edges = [64 * i // n for i in range(n + 1)]
    return [(edges[i], edges[i + 1] - edges[i], each if i <= extra else each - 1) for i in range(n)]


def _filed(max_distance: int) -> F.col:
    """An array of the (segment, value) under which ``fp`` is filed."""
    parts = []
    for i, (low, bits, radius) in enumerate(segments(max_distance)):
        mask = (1 << bits) - 1 if bits < 64 else -1
        own = f"(shiftrightunsigned(fp, {low}) & {mask}L)"
        near = f"transform(sequence(0, {bits - 1}), i -> {own} ^ shiftleft(1L, i))"
        if radius < 0:
            continue
        if radius == 1:
            near = f"filter({near}, x -> ({own} & x) = x)"
        every = f"array({own})" if radius == 0 else f"concat(array({own}), {near})"
        parts.append(f"transform({every}, x -> named_struct('seg', {i}, 'val', x))")
    return F.expr(f"concat({', '.join(parts)})")


def _forest(fps: np.ndarray, max_distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what ``max_distance`` connects, one less than its members."""
    out, rest = [], fps
    while rest.size > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and rest.size:
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= max_distance
            if near.any():
                hits, rest = rest[near], rest[~near]
                out.append((np.full(hits.size, x), hits))
                todo.extend(hits)
    return out


def _linked(units: np.ndarray, fps: np.ndarray, max_distance: int, small: int = 12) -> np.ndarray:
    """Verified links (n, 2) inside runs of equal ``units``, which are sorted."""
    cuts = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1], [True])))
    sizes = np.diff(cuts)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size_of = np.repeat(sizes, sizes)
    keep = (size_of > 1) & (size_of <= small)
    u, f = units[keep], fps[keep]
    for step in range(1, small):
        same = np.flatnonzero(u[step:] == u[:-step]) if step < u.size else np.empty(0, np.int64)
        if not same.size:
            break
        a, b = f[same], f[same + step]
        near = np.bitwise_count(a ^ b) <= max_distance
        found.append((a[near], b[near]))
    for i in np.flatnonzero(sizes > small):
        found += _forest(fps[cuts[i] : cuts[i + 1]], max_distance)
    if not found:
        return np.empty((0, 2), np.uint64)
    pairs = np.stack([np.concatenate(x) for x in zip(*found, strict=True)], axis=1)
    pairs.sort(axis=1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def links(nodes: DataFrame, max_distance: int = MAX_DISTANCE, hot: int = HOT_VALUE, block: int = BLOCK) -> DataFrame:
    """Links (src, dst) that connect the distinct longs ``fp`` of ``nodes``.

    Every pair within ``max_distance`` is connected by them, directly or by
    other such pairs; each link is itself within that distance.
    """
    filed = nodes.select("fp", F.explode(_filed(max_distance)).alias("k")).select("fp", "k.seg", "k.val")
    exact = F.array(*[F.expr(f"named_struct('seg', {i}, 'val', shiftrightunsigned(fp, {low}) & {(1 << bits) - 1 if bits < 64 else -1}L)") for i, (low, bits, _) in enumerate(segments(max_distance))])
    crowded = nodes.select(F.explode(exact).alias("k")).groupBy("k.seg", "k.val").count().where(F.col("count") > hot)
    around = F.concat(*[F.array(F.col("val")), F.expr("transform(sequence(0, 63), i -> val ^ shiftleft(1L, i))")])
    crowded = materialise(crowded.select("seg", F.explode(around).alias("val")).distinct(), "simhash-crowded")
    if crowded.isEmpty():
        units = filed.select(F.xxhash64("seg", "val").alias("unit"), "fp")
    else:
        full = filed.join(crowded, ["seg", "val"]).groupBy("seg", "val").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        full = materialise(full, "simhash-blocks")
        filed = filed.join(full, ["seg", "val"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        filed = filed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        units = filed.select(F.xxhash64("seg", "val", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64)]

        def flush(units: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            pairs = _linked(units, fps.view(np.uint64), max_distance).view(np.int64)
            for i in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[i : i + (1 << 16), k])) for k in (0, 1)], names=["src", "dst"])

        for b in batches:
            held = [np.concatenate((x, b.column(i).to_numpy())) for i, x in enumerate(held)]
            last = int(np.searchsorted(held[0], held[0][-1])) if held[0].size else 0
            if last > 1 << 16:  # whole units only
                yield from flush(held[0][:last], held[1][:last])
                held = [x[last:] for x in held]
        if held[0].size:
            yield from flush(*held)

    return units.repartition("unit").sortWithinPartitions("unit", "fp").mapInArrow(run, "src long, dst long")


def components(prints: DataFrame, doc_id: str = "doc_id", name: str = "fingerprint", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``prints`` and ``component_id``, the least id that its links reach."""
    nodes = materialise(prints.groupBy(F.col(name).alias("fp")).agg(F.min(doc_id).alias("least_id")), "simhash-nodes")
    roots = connected_components(materialise(links(nodes, max_distance), "simhash-links"))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root"))
    least = materialise(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-least")
    named = rooted.join(least, "root").select(F.col("fp").alias("__fp"), F.col("root").alias("component_root"), "component_id")
    return prints.join(named, F.col(name) == F.col("__fp")).drop("__fp")


def hexadecimal(c: str) -> F.col:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per document: its id, fingerprint in hex, and component."""
    prints = materialise(fingerprints(docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text")), "text", shingle), "simhash-prints")
    return components(prints, "doc_id", "fingerprint", max_distance).select("doc_id", hexadecimal("fingerprint").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one document of each component, that with the least id.

    Of rows that agree in id and text one stays; of unlike texts with that same
    id the one whose text hashes lowest stays. All columns are kept.
    """
    i, t = F.col(quoted(doc_id)), F.col(quoted(text))
    keyed = docs.select(i.alias("__id"), F.xxhash64(t).alias("__hash"), t.alias("__text"))
    prints = materialise(fingerprints(keyed, "__text", shingle), "simhash-prints")
    return keep_least(docs, prints, components(prints, "__id", "fingerprint", max_distance), doc_id, text)


def keep_least(docs: DataFrame, prints: DataFrame, grouped: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The row of ``docs`` with the least (__id, __hash) of each ``component_root``."""
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__hash").alias("hash"))
    best = grouped.groupBy("component_root").agg(F.min(order).alias("best")).select("best.id", "best.hash")
    rows = prints.groupBy("__id", "__hash").count()
    kept = best.join(rows, best.id.eqNullSafe(rows["__id"]) & (best.hash == rows["__hash"])).select("id", "hash", (F.col("count") > 1).alias("again"))
    kept = materialise(kept, "simhash-kept")
    own, kept_id, kept_hash = unused(docs.columns, "__hash", "__kept_id", "__kept_hash")
    tagged = docs.withColumn(own, F.xxhash64(F.col(quoted(text))))
    met = lambda k: F.col(quoted(doc_id)).eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_hash))
    single, many = (kept.where(c).select(F.col("id").alias(kept_id), F.col("hash").alias(kept_hash)) for c in ("not again", "again"))
    once = tagged.join(single, met(single), "left_semi")
    if many.isEmpty():
        return once.drop(own)
    return once.union(tagged.join(many, met(many), "left_semi").dropDuplicates([doc_id, own])).drop(own)

"""Near-duplicate groups by SimHash over five-word shingles and multi-index hashing, made whole by rare shingles.

Two texts are linked if their sets of five-word shingles have a Jaccard
similarity of ``LEAST`` at least. At that similarity some 15 of 100 fingerprint
bits differ, so 64 bits and four of them, as in :mod:`wharfline.llm.simhash`,
would find little but copies. Here a fingerprint has 512 bits, cut into
``SEGMENTS`` segments of ``WIDTH`` bits. In each segment the Hamming ball of radius
``TURNED`` is enumerated over its ``WEAK`` least certain bits, those whose votes are
nearest to even: they are the ones that a few other shingles turn. Texts that
are filed under one value of a segment meet in a unit, where complete distances
are verified. Two texts at just 0.8 to 0.84 meet with a probability of 0.98 (on
random sets), at 0.9 nearly always.

Of a unit's texts that are ``NEAR`` bits apart at most, each is paired with its
``STEPS`` nearest, and the minimum spanning forest of the distances is added, so
a dense group of k texts gives a few times k pairs rather than all. Over all
units the nearest pairs of each text are checked on the shingle sets themselves;
what these connect needs no further pair, and all other pairs between unlike
components are checked as well. So no link is below ``LEAST``.

What that leaves apart (pairs that met nowhere, that are more than ``NEAR`` bits
apart or that a unit's forest passed over) is found exactly. All shingles have
one order, rare ones first; of two sets as similar as ``LEAST`` the first
n - ceil(LEAST * n) + 1 shingles in that order, n being a set's own size, have one
in common. So each set is filed under these, and what meets there in unlike
components is checked, unless the sizes, or the parities of the sets over
``BITS`` buckets, already tell that too many shingles differ; both are bounds that no
similar pair exceeds; for large sets, whose parities over so few buckets tell
nothing, they are taken again over two buckets an element. Which shingles are common is counted on about ``SAMPLED``
sets; the order decides how much meets, never what is found. So the groups are
those of all pairs, and a dense group, being one component by then, makes no
pairs here.

Texts with equal sets are one node, so copies make no pairs. A value that many
nodes share is split into blocks, and each pair of blocks is a unit of its own.

Defined results: a null or empty text has the empty set, equal to itself only;
fewer words than a shingle give one shingle; long texts are taken whole; texts
of equal distance are paired in the order of their hashes; the rest is as in
:func:`wharfline.llm.simhash.deduplicate`.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.llm.names import quoted
from wharfline.llm.simhash import keep_least
from wharfline.plans.components import connected_components
from wharfline.session import lean, materialise

SEED = 43
SHINGLE = 5
LEAST = 0.8
SEGMENTS, WIDTH, WEAK, TURNED = 17, 30, 4, 2
#: Bits of a complete distance that are checked further, and the nearest nodes each is paired with.
NEAR, STEPS = 104, 2
#: Nodes of a unit all of whose pairs are looked at, at once; a unit with more than BLOCK is split.
SMALL, BLOCK = 12, 8192
#: Bytes of a list of nodes that goes out to all tasks.
SENT_BYTES = 32 << 20
#: Buckets whose parities bound the difference of two sets.
BITS = 1024
#: Sets, about, on which common shingles are counted, and how many of these go out to all tasks.
SAMPLED, COMMON = 20_000, 1 << 18
#: Texts of a batch whose sets are held at once.
_TEXTS = 512
#: Shingles whose bits are unpacked at once.
_CHUNK = 1 << 13
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: All ways to turn up to TURNED of the weak bits.
_TURNS = np.array([x for x in itertools.product((0, 1), repeat=WEAK) if sum(x) <= TURNED], np.int64)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))], np.uint64))


def fingerprint(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64 bytes of a set that isn't empty, and the ``WEAK`` weakest bits of each segment."""
    votes = np.zeros((len(_FACTORS), 64), np.int64)
    for i in range(0, hashes.size, _CHUNK):
        mixed = hashes[i : i + _CHUNK] * _FACTORS[:, None]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(mixed.view(np.uint8).reshape(len(_FACTORS), -1, 8), axis=2)
        votes += bits.sum(axis=1, dtype=np.int32)
    votes = (2 * votes - hashes.size).ravel()
    margin = np.abs(votes[: SEGMENTS * WIDTH]).reshape(SEGMENTS, WIDTH)
    return np.packbits(votes > 0), np.argsort(margin, axis=1, kind="stable")[:, :WEAK].astype(np.uint8)


def filed(prints: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """(texts, filings): the values, with their segments' numbers above, that fingerprints are filed under."""
    bits = np.unpackbits(prints, axis=1)[:, : SEGMENTS * WIDTH].reshape(-1, SEGMENTS, WIDTH).astype(np.int64)
    own = (bits << np.arange(WIDTH)).sum(axis=2)
    turned = ((1 << weak.astype(np.int64)) @ _TURNS.T) ^ own[:, :, None]  # weak bits are unlike, so they add up
    return (np.arange(SEGMENTS)[:, None] << WIDTH | turned).reshape(len(prints), -1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets that aren't both empty."""
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (both.size - shared)


def sketch(found: np.ndarray) -> bytes:
    """Parities of a set over a power of two of buckets, two at least for each element."""
    buckets = 1 << max(10, (2 * found.size - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(buckets - 1)).view(np.int64), minlength=buckets) & 1).tobytes()


def may_be_similar(a: bytes, b: bytes, elements: int, least: float = LEAST) -> bool:
    """False only if two sets with so many elements in all, told by their sketches, are less similar than ``least``."""
    x, y = (np.frombuffer(k, np.uint8) for k in (a, b))
    while x.size != y.size:  # of the longer one, buckets that are one in the shorter
        x, y = sorted((x, y), key=len)
        y = y[: y.size // 2] ^ y[y.size // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= elements * (1 - least) / (1 + least) + 1e-6


def _prints(keyed: DataFrame, shingle: int) -> DataFrame:
    """(__id, __hash, node, print, weak) from (__id, __hash, __text); node is a hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _TEXTS):
                b = whole.slice(at, _TEXTS)
                sets = [shingle_set(x, shingle) for x in b.column(2).cast(pa.binary()).to_pylist()]
                node = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets)).view(np.int64)
                made = [fingerprint(s) if s.size else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(node), pa.array([m and m[0].tobytes() for m in made], pa.binary()), pa.array([m and m[1].tobytes() for m in made], pa.binary())],
                    names=["__id", "__hash", "node", "print", "weak"],
                )

    kind = keyed.schema["__id"].dataType.simpleString()
    return keyed.mapInArrow(lean(run), f"__id {kind}, __hash long, node long, print binary, weak binary")


def _mixed(nodes: np.ndarray, k: int) -> np.ndarray:
    x = nodes.view(np.uint64) * _FACTORS[k]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _meeting(units: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    """(unit, node, n, x1, x2) of the sorted units with several nodes; x1 and x2 are sums without carry of two hashes of these."""
    first = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1])))
    n = np.diff(np.append(first, units.size))
    on = np.repeat(n > 1, n)
    units, nodes, n = units[on], nodes[on], n[n > 1]
    first = np.cumsum(n) - n
    told = [np.bitwise_xor.reduceat(_mixed(nodes, k), first).view(np.int64) if n.size else n for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(units), pa.array(nodes), *(pa.array(np.repeat(x, n)) for x in (n, *told))], names=["unit", "node", "n", "x1", "x2"])


def _shared(filings: DataFrame) -> DataFrame:
    """(unit, node, n): those of (unit, node) whose unit n > 1 nodes have.

    Texts much alike meet in most of their units; of units with the same nodes one is left, as its pairs are those of all.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # of one unit, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            if held[0][0][0] == held[-1][0][-1]:
                continue
            units, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(units, units[-1]))
            held = [(units[last:], nodes[last:])]
            yield _meeting(units[:last], nodes[:last])
        if held:
            yield _meeting(*(np.concatenate(x) for x in zip(*held, strict=True)))

    met = filings.repartition("unit").sortWithinPartitions("unit").mapInArrow(lean(meet), "unit long, node long, n long, x1 long, x2 long")
    return materialise(met.groupBy("n", "x1", "x2", "node").agg(F.min("unit").alias("unit")).select("unit", "node", "n"), "similar-met")


def _met(nodes: DataFrame) -> DataFrame:
    """(unit, node, n): the filings of the nodes (node, print, weak) under values that n > 1 of them have."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                prints, weak = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8) for k in (1, 2))
                units = filed(prints.reshape(-1, 64), weak.reshape(-1, SEGMENTS, WEAK))
                yield pa.RecordBatch.from_arrays([pa.array(units.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), units.shape[1]))], names=["unit", "node"])

    spread_out = nodes.where("print is not null").select("node", "print", "weak").mapInArrow(lean(spread), "unit long, node long")
    return _shared(spread_out)


def _near(units: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, node, distance) of the candidates inside runs of equal ``units``, which are sorted."""
    cuts = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1], [True])))
    sizes = np.diff(cuts)
    found = []

    def add(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        ok = (d <= NEAR) & (nodes[a] != nodes[b])
        found.append((nodes[a[ok]], nodes[b[ok]], d[ok]))

    few = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    for step in range(1, SMALL):
        a = few[:-step] if step else few
        a = a[(a + step < units.size)]
        a = a[units[np.minimum(a + step, units.size - 1)] == units[a]]
        if not a.size:
            break
        for i in range(0, a.size, 1 << 16):
            k = a[i : i + (1 << 16)]
            add(k, k + step, np.bitwise_count(prints[k] ^ prints[k + step]).sum(axis=1, dtype=np.int64))
    for c in np.flatnonzero(sizes > SMALL):
        low, size = int(cuts[c]), int(sizes[c])
        own = prints[low : low + size]
        open_, near, best = np.ones(size, bool), np.full(size, 10_000), np.zeros(size, np.int64)
        x, some = 0, min(STEPS + 1, size - 1)
        for _ in range(size):  # a spanning tree from node to nearest node
            open_[x] = False
            d = np.bitwise_count(own ^ own[x]).sum(axis=1, dtype=np.int64)
            close = np.argpartition(d, some)[: some + 1]
            close = close[close != x]
            add(np.full(close.size, low + x), low + close, d[close])
            better = open_ & (d < near)
            near[better], best[better] = d[better], x
            left = np.where(open_, near, 20_000)
            x = int(left.argmin())
            if not open_[x]:
                break
            add(np.array([low + best[x]]), np.array([low + x]), near[x : x + 1])
    return found


def _unlike(units: np.ndarray, nodes: np.ndarray, prints: np.ndarray, sizes: np.ndarray, roots: np.ndarray, least: float = LEAST) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, node, parities that differ) of all pairs inside runs of equal ``units`` that may be as similar as ``least``.

    The rows are sorted by unit and size; pairs of equal ``roots`` are left out.
    """
    cuts = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1], [True])))
    lengths = np.diff(cuts)
    found = []

    def add(a: np.ndarray, b: np.ndarray) -> None:
        ok = (roots[a] != roots[b]) & (sizes[a] >= least * sizes[b] - 1e-6)
        a, b = a[ok], b[ok]
        d = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64)
        ok = d <= (sizes[a] + sizes[b]) * (1 - least) / (1 + least) + 1e-6
        if ok.any():
            found.append((nodes[a[ok]], nodes[b[ok]], d[ok]))

    few = np.flatnonzero(np.repeat(lengths <= SMALL, lengths))
    for step in range(1, SMALL):
        few = few[few + step < units.size]
        few = few[units[few + step] == units[few]]
        for i in range(0, few.size, 1 << 16):
            add(few[i : i + (1 << 16)], few[i : i + (1 << 16)] + step)
    for c in np.flatnonzero(lengths > SMALL):
        low, high = int(cuts[c]), int(cuts[c + 1])
        if (roots[low:high] == roots[low]).all():
            continue
        ends = low + np.searchsorted(sizes[low:high], sizes[low:high] / least + 1e-6, "right")
        for x, end in zip(range(low, high), ends.tolist(), strict=True):
            add(np.full(end - x - 1, x), np.arange(x + 1, end))
    return found


def _candidates(met: DataFrame, nodes: DataFrame, block: int = BLOCK, search: Callable = _near, more: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, d): pairs that are near in some unit, src < dst.

    ``search`` gets units, nodes, prints and the columns ``more`` of ``nodes``, sorted by unit and by these.
    """
    split = met.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    split = split.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    units = split.select(F.xxhash64("unit", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "node")
    full = units.join(nodes.select("node", "print", *more), "node").select("unit", "node", "print", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush(*rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = search(*rows)
            if found:
                a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
                rows = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b), d), axis=1), axis=0)
                for i in range(0, len(rows), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[i : i + (1 << 16), k])) for k in range(3)], names=["src", "dst", "d"])

        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(0).to_numpy(), b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(b.num_rows, -1)]
            new += [b.column(3 + k).to_numpy() for k in range(len(more))]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last > 1 << 15:  # whole units only
                yield from flush(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held:
            yield from flush(*held)

    return full.repartition("unit").sortWithinPartitions("unit", *more, "node").mapInArrow(lean(run), "src long, dst long, d long").distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of ``pairs`` (src, dst) whose sets are as similar as ``least``."""
    pairs = materialise(pairs.select("src", "dst"), "similar-pairs")
    met = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    named = materialise(nodes.join(met, "node").select("node", "rep"), "similar-named")
    sent = named.hint("broadcast") if 32 * named.count() <= SENT_BYTES else named

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _TEXTS):
                b = whole.slice(at, _TEXTS)
                found = [shingle_set(x, shingle).tobytes() for x in b.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["node", "set"])

    # copies are let go before their texts are shuffled
    one = texts.join(sent, F.col("__hash") == F.col("rep")).groupBy("node").agg(F.first("__text").alias("__text"))
    held = materialise(one.mapInArrow(lean(sets), "node long, set binary"), "similar-sets")
    a = held.select(F.col("node").alias("src"), F.col("set").alias("a"))
    b = held.select(F.col("node").alias("dst"), F.col("set").alias("b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                r = whole.slice(at, 1024)
                near = [similarity(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= least for x, y in zip(r.column(2), r.column(3), strict=True)]
                yield r.select(["src", "dst"]).filter(pa.array(near, pa.bool_()))

    return materialise(pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b").mapInArrow(lean(check), "src long, dst long"), "similar-links")


def _common(nodes: DataFrame, texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the commonest shingles of a sample, and how many of its sets have each."""
    some = nodes.where(F.pmod(F.xxhash64("rep"), F.lit(max(1, nodes.count() // SAMPLED))) == 0).select("rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).cast(pa.binary()):
                s = shingle_set(x.as_py(), shingle).view(np.int64)
                for i in range(0, s.size, 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(s[i : i + (1 << 16)])], names=["shingle"])

    one = texts.join(F.broadcast(some), F.col("__hash") == F.col("rep")).groupBy("rep").agg(F.first("__text").alias("__text"))
    counts = one.select("__text").mapInArrow(lean(run), "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    top = counts.where("n > 1").orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    keys = top.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top.column("n").to_numpy()[order]


def rare_first(found: np.ndarray, keys: np.ndarray, counts: np.ndarray, least: float = LEAST) -> np.ndarray:
    """Those shingles of a sorted set, the rare ones, of which every set as similar as ``least`` has one among its own."""
    rank = np.zeros(found.size, np.int64)
    if keys.size:
        at = np.minimum(np.searchsorted(keys, found), keys.size - 1)
        rank = np.where(keys[at] == found, counts[at], 0)
    return found[np.argsort(rank, kind="stable")[: found.size - math.ceil(least * found.size - 1e-6) + 1]]


def _rest(nodes: DataFrame, texts: DataFrame, roots: DataFrame, shingle: int, least: float, block: int = BLOCK) -> DataFrame:
    """(src, dst, d): all pairs of unlike ``roots`` that may be as similar as ``least``."""
    shared = nodes.sparkSession.sparkContext.broadcast(_common(nodes, texts, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, _TEXTS):
                sets = [shingle_set(x, shingle) for x in whole.slice(at, _TEXTS).column(0).cast(pa.binary()).to_pylist()]
                sets = [s for s in sets if s.size]
                node = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets)).view(np.int64)
                parity = [np.packbits(np.bincount((s % np.uint64(BITS)).view(np.int64), minlength=BITS) & 1).tobytes() for s in sets]
                rare = [rare_first(s, keys, counts, least).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array([s.size for s in sets], pa.int64()), pa.array(parity, pa.binary()), pa.array(rare, pa.list_(pa.int64())), pa.array([sketch(s) for s in sets], pa.binary())],
                    names=["node", "size", "print", "rare", "sketch"],
                )

    made = texts.select("__text").mapInArrow(lean(run), "node long, size long, print binary, rare array<long>, sketch binary")
    made = materialise(made.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "print", "rare", "sketch")]), "similar-rare")
    met = _shared(made.select(F.explode("rare").alias("unit"), "node"))
    rooted = met.join(roots.withColumnRenamed("component", "root"), "node", "left").select("unit", F.coalesce("root", "node").alias("root"))
    units = rooted.groupBy("unit").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a != z").select("unit")
    met = materialise(met.join(materialise(units, "similar-units"), "unit"), "similar-unlike")
    named = met.select("node").distinct().join(made.select("node", "size", "print"), "node").join(roots, "node", "left")
    named = materialise(named.select("node", "size", "print", F.coalesce("component", "node").alias("root")), "similar-rooted")
    search = functools.partial(_unlike, least=least)
    pairs = materialise(_candidates(met, named, block, search, ("size", "root")), "similar-near")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [may_be_similar(x.as_py(), y.as_py(), n.as_py(), least) for x, y, n in zip(b.column(3), b.column(4), b.column(5), strict=True)]
            yield b.select(["src", "dst", "d"]).filter(pa.array(ok, pa.bool_()))

    ends = [made.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), F.col("sketch").alias(f"{k}_sketch")) for k in ("src", "dst")]
    both = pairs.join(ends[0], "src").join(ends[1], "dst").select("src", "dst", "d", "src_sketch", "dst_sketch", (F.col("src_size") + F.col("dst_size")).alias("elements"))
    return both.mapInArrow(lean(bound), "src long, dst long, d long")


def _connecting(pairs: DataFrame, known: DataFrame | None, nodes: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Verified links among ``pairs`` (src, dst, d) that connect, with the links ``known``, what all of them connect."""
    ends = pairs.select("*", F.explode(F.array("src", "dst")).alias("end"))
    nearest = F.min(F.struct("d", "src", "dst")).alias("p")
    first = materialise(ends.groupBy("end").agg(nearest).select("p.src", "p.dst").distinct(), "similar-nearest")
    found = _verified(first, nodes, texts, shingle, least)
    roots = materialise(connected_components(found if known is None else found.union(known)), "similar-roots")
    named = lambda k: roots.select(F.col("node").alias(k), F.col("component").alias(f"{k}_root"))
    left = pairs.join(first, ["src", "dst"], "left_anti").join(named("src"), "src", "left").join(named("dst"), "dst", "left")
    left = left.where(F.coalesce("src_root", "src") != F.coalesce("dst_root", "dst"))
    return found.union(_verified(left, nodes, texts, shingle, least))


def links(prints: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Verified links (src, dst) that connect just what all pairs as similar as ``least`` connect."""
    nodes = materialise(prints.groupBy("node").agg(F.min("__hash").alias("rep"), F.first("print").alias("print"), F.first("weak").alias("weak")), "similar-nodes")
    pairs = materialise(_candidates(_met(nodes), nodes), "similar-candidates")
    found = materialise(_connecting(pairs, None, nodes, texts, shingle, least), "similar-found")
    roots = materialise(connected_components(found), "similar-found-roots")
    rest = materialise(_rest(nodes, texts, roots, shingle, least), "similar-rest")
    return found if rest.isEmpty() else found.union(_connecting(rest, found, nodes, texts, shingle, least))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``docs`` with one document of each group of similar texts, that with the least id."""
    i, t = F.col(quoted(doc_id)), F.col(quoted(text))
    keyed = docs.select(i.alias("__id"), F.xxhash64(t).alias("__hash"), t.cast("string").alias("__text"))
    prints = materialise(_prints(keyed, shingle), "similar-prints")
    roots = connected_components(materialise(links(prints, keyed.select("__hash", "__text"), shingle, least), "similar-all"))
    grouped = prints.select("__id", "__hash", "node").join(roots, "node", "left").select("__id", "__hash", F.coalesce("component", "node").alias("component_root"))
    return keep_least(docs, prints, grouped, doc_id, text)

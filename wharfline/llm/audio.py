"""Chroma audio fingerprints for media columns.

A recording becomes frames of spectral energy by pitch class, smoothed and
scaled. Over an integral image of these, 16 rectangle filters are slid along
time; each filter's response is quantised to two bits by thresholds trained
here, and the 32 bits of a place are packed into one integer.

Recordings with equal fingerprints are one node. Every integer files its node
and place, a run of one integer by its two ends; under integers that several
nodes share, the ``REACH`` places to either side are fetched and laid side by
side, which is all of a recording shorter than that. Two nodes are linked if the
bit error there is ``MAX_ERROR`` at most, over ``MIN_OVERLAP`` places at least and
over ``SHARE`` of the places that the one with fewer has there: a jingle that
unlike recordings have in common links none of them. Links form a spanning
forest of each group rather than all its pairs; an integer that many nodes share
is split into blocks, each pair of which is a unit of its own. Linked nodes are a
class, and every recording is aligned with its class's least: a histogram of the
offsets at which equal integers lie gives the offset, and the bit error over the
whole overlap there is told.

Silent places have no integer, so silence links nothing.

Defined results: null, empty or unreadable media have an empty fingerprint and
are a class of their own; null ids are in no class unless a recording with an
id has the same fingerprint; long recordings are taken whole, and aligned in
memory that grows with their length; of offsets with as many equal integers the
least shift is told, the later on ties; repeated rows each get their own result;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import struct
import wave
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.plans.components import connected_components
from wharfline.session import materialise

RATE, FRAME, HOP = 4000, 2048, 256
LOW, HIGH = 100.0, 1900.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
WIDTH = 24
MAX_ERROR, MIN_OVERLAP, SHARE, REACH = 0.15, 10, 0.5, 256
#: A frame is silent below this share of the recording's loudest.
SILENT = 1e-4
#: Nodes under one integer that one task compares.
BLOCK = 4096
#: Recordings whose responses set the thresholds.
TRAIN_TUNES = 64


def filters() -> list[tuple[int, int, int, int]]:
    """16 filters as (shape, lowest pitch class, pitch classes, frames)."""
    out = []
    for k in range(16):
        height = 2 + 2 * (k % 6 % 5)
        out.append((k % 5, k * 5 % (13 - height), height, (8, 12, 16, WIDTH)[k // 4]))
    return out


def read_wav(data: bytes | None) -> tuple[np.ndarray, int] | None:
    """Mono samples in -1 to 1 and the rate; None if it can't be read."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            raw, size, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError, struct.error, RuntimeError):
        return None
    if size not in (1, 2, 3, 4) or not rate:
        return None
    raw = raw[: len(raw) // (size * channels) * size * channels]
    if size == 3:  # the upper bytes of four
        four = np.zeros((len(raw) // 3, 4), np.uint8)
        four[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        raw, size = four.tobytes(), 4
    x = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[size]).astype(np.float64)
    x = (x - 128) / 128 if size == 1 else x / float(1 << (8 * size - 1))
    return x.reshape(-1, channels).mean(axis=1), rate


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def resample(x: np.ndarray, rate: int) -> np.ndarray:
    """Linear resampling, after a moving average where the rate falls."""
    if rate == RATE or not x.size:
        return x
    wide = rate // RATE
    if wide > 1:
        x = np.convolve(x, np.full(wide, 1 / wide), "same")
    return np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)


@lru_cache(maxsize=1)
def _bins() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = np.flatnonzero((hz >= LOW) & (hz <= HIGH))
    return np.hanning(FRAME), used, np.eye(12)[np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % 12]


def chroma(x: np.ndarray) -> np.ndarray:
    """(frames, 12) unit energies by pitch class; silent frames are zero."""
    if len(x) < FRAME:
        return np.zeros((0, 12))
    window, used, classes = _bins()
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    energy = (np.abs(np.fft.rfft(frames * window, axis=1)[:, used]) ** 2) @ classes
    if len(energy) < len(SMOOTH):
        return np.zeros((0, 12))
    smooth = sum(w * energy[i : len(energy) - len(SMOOTH) + 1 + i] for i, w in enumerate(SMOOTH))
    size = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(size > max(1e-9, SILENT * float(size.max())), smooth / np.maximum(size, 1e-12), 0.0)


def responses(image: np.ndarray) -> np.ndarray:
    """(places, 16) filter responses by an integral image."""
    places = len(image) - WIDTH + 1
    if places < 1:
        return np.zeros((0, 16))
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(places)
    area = lambda a, z, y0, y1: total[t + z, y1] - total[t + a, y1] - total[t + z, y0] + total[t + a, y0]
    out = np.empty((places, 16))
    for k, (shape, y, h, w) in enumerate(filters()):
        whole, mid_y, mid_w = area(0, w, y, y + h), y + h // 2, w // 2
        if shape == 0:  # upper against lower
            a = area(0, w, mid_y, y + h)
        elif shape == 1:  # late against early
            a = area(mid_w, w, y, y + h)
        elif shape == 2:  # one diagonal against the other
            a = area(0, mid_w, y, mid_y) + area(mid_w, w, mid_y, y + h)
        elif shape == 3:  # the middle third of time against the rest
            a = area(w // 3, w - w // 3, y, y + h)
        else:  # the middle pitch classes against the rest
            a = area(0, w, y + h // 4, y + h - h // 4)
        out[:, k] = np.log((1 + a) / (1 + whole - a))
    return out


def tune(values: np.ndarray, seed: int) -> np.ndarray:
    """A recording of a vector: a note per value, played from a seeded start, with hiss."""
    rng = np.random.default_rng(seed)
    semitone = np.floor(np.nan_to_num(np.asarray(values, float)) * 60).astype(int) % 24
    n = RATE // 10
    t = np.arange(n) / RATE
    hz = 220 * 2 ** (semitone[:, None] / 12)
    notes = (0.4 * np.sin(2 * np.pi * hz * t) + 0.2 * np.sin(4 * np.pi * hz * t)) * np.hanning(n) ** 0.25
    start = np.zeros(int(rng.integers(0, RATE // 2)))
    x = np.concatenate((start, notes.ravel()))
    return x + rng.normal(0, 0.002, len(x)) * (x != 0)


@lru_cache(maxsize=1)
def thresholds(seed: int = 3) -> np.ndarray:
    """(16, 3) quartiles of the responses over generated recordings."""
    rng = np.random.default_rng(seed)
    every = [responses(chroma(tune(rng.normal(0, 0.13, 64), int(s)))) for s in range(TRAIN_TUNES)]
    return np.quantile(np.concatenate(every), [0.25, 0.5, 0.75], axis=0).T


def fingerprint(x: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each place; 0 where it is silent."""
    image = chroma(x)
    r = responses(image)
    level = (r[:, :, None] > limits).sum(axis=2)
    gray = np.array([0, 1, 3, 2], np.uint64)[level]
    packed = (gray << (2 * np.arange(16, dtype=np.uint64))).sum(axis=1).astype(np.uint32)
    heard = np.concatenate(([0], np.cumsum(image.any(axis=1))))
    loud = heard[WIDTH:] - heard[: len(heard) - WIDTH] if len(r) else np.zeros(0)
    return np.where(loud >= WIDTH, packed, 0).astype(np.uint32)


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of unlike bits of a[i + offset] and b[i], and the places compared."""
    lo, hi = max(0, -offset), min(len(b), len(a) - offset)
    if hi <= lo:
        return 1.0, 0
    x, y = a[lo + offset : hi + offset], b[lo:hi]
    both = (x != 0) & (y != 0)
    n = int(both.sum())
    return (float(np.bitwise_count(x ^ y)[both].sum()) / (32 * n) if n else 1.0), n


def offset_votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many i have a[i + offset] == b[i] != 0, for offsets 1 - len(b) to len(a) - 1.

    The pairs of a rare integer are listed, a few at once; those of one that both
    have often are counted by a convolution. Memory grows with the lengths.
    """
    votes, size = np.zeros(len(a) + len(b) - 1, np.int64), len(a) + len(b) - 1
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = np.where(a != 0, hi - lo, 0)
    pairs = np.zeros(len(a), np.int64)  # of each place's integer, over all places
    _, of = np.unique(a, return_inverse=True)
    pairs[:] = np.bincount(of, n)[of]
    often = pairs > size * 32
    for code in np.unique(a[often]):
        width = 1 << (size - 1).bit_length()
        both = np.fft.rfft(a == code, width) * np.fft.rfft((b == code)[::-1], width)
        votes += np.rint(np.fft.irfft(both, width)[:size]).astype(np.int64)
    at = np.flatnonzero((n > 0) & ~often)
    ends = np.cumsum(n[at])
    first = 0
    while first < at.size:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + (1 << 20), "right")))
        k = at[first:last]
        step = np.arange(n[k].sum()) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
        votes += np.bincount(np.repeat(k, n[k]) - order[np.repeat(lo[k], n[k]) + step] + len(b) - 1, minlength=size)
        first = last
    return votes


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """(offset, equal integers there, bit error) by the histogram of offsets."""
    votes = offset_votes(a, b) if len(a) and len(b) else np.zeros(0, np.int64)
    if not votes.any():
        return 0, 0, 1.0
    top = np.flatnonzero(votes == votes.max()) - (len(b) - 1)
    best = int(max(top, key=lambda o: (-abs(o), o)))
    return best, int(votes.max()), bit_error(a, b, best)[0]


def fingerprints(media: DataFrame, media_id: str, column: str, decode: Callable = read_wav) -> DataFrame:
    """(id, codes): the fingerprint of each row's media as little-endian bytes.

    ``decode(value, id)`` or ``decode(value)`` gives samples and rate, or None.
    """
    limits, pair = thresholds(), decode is not read_wav
    schema = T.StructType([T.StructField("id", media.schema[media_id].dataType), T.StructField("codes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b, out = whole.slice(at, 64), []
                for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True):
                    got = None if v is None else decode(v, i) if pair else decode(v)
                    out.append(fingerprint(resample(*got), limits).astype("<u4").tobytes() if got else b"")
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], names=["id", "codes"])

    return media.select(F.col(media_id).alias("id"), F.col(column).alias("v")).mapInArrow(run, schema)


def filed_places(codes: np.ndarray) -> np.ndarray:
    """The places of all integers, those of a run of one integer only at its ends."""
    if not codes.size:
        return np.empty(0, np.int64)
    turn = codes[1:] != codes[:-1]
    return np.flatnonzero((codes != 0) & (np.concatenate(([True], turn)) | np.concatenate((turn, [True]))))


def _group_links(nodes: list, places: np.ndarray, codes: list[np.ndarray]) -> Iterator[tuple]:
    """A spanning forest of the links of nodes that meet at ``places``."""
    left = int(places.max())
    wide = left + max(len(c) - int(p) for c, p in zip(codes, places, strict=True))
    grid = np.zeros((len(nodes), wide), np.uint32)
    for i, (c, p) in enumerate(zip(codes, places, strict=True)):
        grid[i, left - p : left - p + len(c)] = c
    rest, heard = np.arange(len(nodes)), (grid != 0).sum(axis=1)
    while rest.size > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and rest.size:
            x = todo.pop()
            both = (grid[rest] != 0) & (grid[x] != 0)
            n = both.sum(axis=1)
            wrong = (np.bitwise_count(grid[rest] ^ grid[x]) * both).sum(axis=1)
            near = (n >= MIN_OVERLAP) & (n >= SHARE * np.minimum(heard[x], heard[rest])) & (wrong <= MAX_ERROR * 32 * n)
            for y in rest[near]:
                if nodes[x] != nodes[y]:
                    yield nodes[x], nodes[y]
            todo += rest[near].tolist()
            rest = rest[~near]


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (src, dst) between the nodes (node, codes), which connect all that are near."""
    kind = nodes.schema["node"].dataType

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                codes = [np.frombuffer(c, "<u4") for c in b.column("codes").to_pylist()]
                places = [filed_places(c) for c in codes]
                row = np.repeat(np.arange(len(codes)), [len(p) for p in places])
                place = np.concatenate(places) if codes else np.empty(0, np.int64)
                code = np.concatenate([c[p] for c, p in zip(codes, places, strict=True)]) if codes else np.empty(0, np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), b.column("node").take(pa.array(row)), pa.array(place.astype(np.int32))], names=["code", "node", "place"])

    filed = nodes.where(F.length("codes") > 0).mapInArrow(spread, T.StructType([T.StructField("code", T.LongType()), T.StructField("node", kind), T.StructField("place", T.IntegerType())]))
    filed = materialise(filed, "audio-codes")
    counts = filed.groupBy("code").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("code", "n")
    counts = materialise(counts, "audio-shared")
    around = F.expr(f"substring(codes, greatest(place - {REACH}, 0) * 4 + 1, (least(place, {REACH}) + {REACH} + 1) * 4)")
    shared = filed.join(counts, "code").join(nodes, "node").withColumn("codes", around).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    shared = shared.withColumn("own", F.pmod(F.xxhash64("node", "place"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    shared = shared.withColumn("place", F.least("place", F.lit(REACH)))
    units = shared.select(F.xxhash64("code", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "node", "place", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        unit, found = None, set()

        def flush() -> Iterator[pa.RecordBatch]:
            src, dst = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(src, links_kind), pa.array(dst, links_kind)], names=["src", "dst"])
            found.clear()

        links_kind = None
        for b in batches:
            links_kind = b.schema.field("node").type
            for u, n, p, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if u != unit:
                    if len(held[0]) > 1:
                        found.update(_group_links(held[0], np.array(held[1]), held[2]))
                    held, unit = ([], [], []), u
                    if len(found) > 50_000:
                        yield from flush()
                held[0].append(n)
                held[1].append(p)
                held[2].append(np.frombuffer(c, "<u4"))
        if len(held[0]) > 1:
            found.update(_group_links(held[0], np.array(held[1]), held[2]))
        if found:
            yield from flush()

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, T.StructType([T.StructField("src", kind), T.StructField("dst", kind)]))


def recordings(media: DataFrame, media_id: str, column: str, decode: Callable = read_wav) -> DataFrame:
    """One row per recording: id, n_codes, codes, class_id, place_offset, n_equal, bit_error."""
    prints = materialise(fingerprints(media, media_id, column, decode), "audio-prints")
    nodes = materialise(prints.where(F.length("codes") > 0).groupBy("codes").agg(F.min("id").alias("node")).where("node is not null"), "audio-nodes")
    found = connected_components(materialise(links(nodes), "audio-links"))
    classes = nodes.join(found, "node", "left").select("node", "codes", F.coalesce("component", "node").alias("class_id"))
    least = nodes.select(F.col("node").alias("class_id"), F.col("codes").alias("first"))
    aligned = classes.join(least, "class_id")
    kind = prints.schema["id"].dataType
    schema = T.StructType([T.StructField("codes", T.BinaryType()), T.StructField("class_id", kind), T.StructField("place_offset", T.LongType()), T.StructField("n_equal", T.LongType()), T.StructField("bit_error", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [align(np.frombuffer(c, "<u4"), np.frombuffer(f, "<u4")) for c, f in zip(b.column("codes").to_pylist(), b.column("first").to_pylist(), strict=True)]
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("codes"), b.column("class_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=[f.name for f in schema])

    placed = aligned.select("codes", "class_id", "first").mapInArrow(run, schema)
    joined = prints.join(placed, "codes", "left")
    return joined.select(
        F.col("id").alias(media_id),
        (F.length("codes") / 4).cast("long").alias("n_codes"),
        F.lower(F.hex("codes")).alias("fingerprint"),
        F.when(F.length("codes") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        "place_offset",
        "n_equal",
        "bit_error",
    )


def vector_recording(values: list[float], vec_id: object) -> tuple[np.ndarray, int] | None:
    """The WAV file of a vector, read back as any media would be."""
    return read_wav(write_wav(tune(np.array([np.nan if v is None else v for v in values]), zlib.crc32(str(vec_id).encode())))) if values else None

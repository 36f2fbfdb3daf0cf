"""Scalar functions and codecs that the plans share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_ipv4(address: Column) -> Column:
    """A 32-bit integer as dotted text."""
    part = lambda shift: F.shiftrightunsigned(address.cast("int"), shift).bitwiseAND(255).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8), part(0))


def event_letter(code: Column) -> Column:
    """1 to 7 as a to g."""
    return F.chr(code + 96)


def host_number(name: Column, master: str = "master") -> Column:
    """-1 for the master, N for a worker ``…-w-N…``; anything else fails."""
    found = F.regexp_extract(name, r"-w-([0-9]+)", 1)
    return F.when(name.contains(f"-{master}") | (name == master), F.lit(-1)).when(found != "", found.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no host number in "), name)).cast("int"))


def fixed_partition(instance: Column | int, partitions: Sequence[int]) -> Column:
    """Sink instance i writes to partition i modulo their number."""
    known = F.array(*[F.lit(p) for p in partitions])
    at = F.pmod(instance if isinstance(instance, Column) else F.lit(instance), F.lit(len(partitions)))
    return F.get(known, at.cast("int"))


def encode_event(source: Column, event: Column) -> Column:
    """Two little-endian ints as an 8-byte frame."""

    def word(c: Column) -> Column:
        text = F.lpad(F.hex(F.pmod(c.cast("bigint"), F.lit(1 << 32))), 8, "0")
        return F.concat(*[F.substring(text, i, 2) for i in (7, 5, 3, 1)])

    return F.unhex(F.concat(word(source), word(event)))


def decode_event(frame: Column) -> Column:
    """The two ints of an 8-byte frame, in column operations; null for other sizes."""
    at = lambda i: F.conv(F.hex(F.substring(frame, i, 1)), 16, 10).cast("bigint")
    word = lambda o: (at(o) + at(o + 1) * 256 + at(o + 2) * 65536 + at(o + 3) * 16777216)
    signed = lambda v: F.when(v >= 2147483648, v - 4294967296).otherwise(v).cast("int")
    return F.when(F.length(frame) == 8, F.struct(signed(word(1)).alias("source"), signed(word(5)).alias("event")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def milliseconds_of_day(clock: Column) -> Column:
    """``HH:mm:ss,SSS`` in milliseconds since midnight."""
    p = F.split(clock, "[:,]")
    return (F.get(p, 0).cast("bigint") * 3600 + F.get(p, 1).cast("bigint") * 60 + F.get(p, 2).cast("bigint")) * 1000 + F.get(p, 3).cast("bigint")

"""WARC archives, and their capture index by external merge.

Every page becomes one gzipped WARC record. Of records with equal payloads the
one with the least page id is the response and the others are revisits of it,
which carry the HTTP head and the payload's digest but no payload. An archive
holds the records of a stretch of a partition, up to ``ARCHIVE_BYTES`` of
payload, and is by itself a valid ``.warc.gz`` file; as executors share only
what Spark writes, archives are rows of a table in the shared folder.

Reading an archive back gives its captures, which are sorted locally by URL key
and time: a run. Runs are dealt out by ranges of the same key, split by id also,
so that a URL with a third of all captures spans many ranges. The exchange keeps
the order of what it moves from one task to another, so a range gets sorted parts
of all runs; nothing is sorted again, the parts are merged k ways by a loser tree.
A capture's place in the history of its URL follows from the merged order: places
are counted within a range, and the few URLs that go on from one range into the
next have the counts of the ranges before added.

Defined results: null html is an empty payload, and empty payloads are equal;
null ids come after all others, and a null id is referred to as null; of equal
ids with unlike URLs the least URL is the response, and captures of one URL and
time are in the order of their ids, then of their archives; long payloads are
taken whole; rows that agree in id, URL
and html are the same capture and get the same record type; a null URL has the
empty key; without a time column a capture's time is ``EPOCH`` plus its id in
seconds, ``EPOCH`` if that isn't a number of a fitting size; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wharfline.session import materialise

ARCHIVE_BYTES = 8 << 20
GZIP_LEVEL = 4
EPOCH = 1_700_000_000
#: Captures of one merged range, about.
RANGE_ROWS = 100_000
#: Payloads below this are always responses.
LEAST_REVISIT = 0

_BREAKS = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then path and query."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)", url or "")
    if not m:
        return (url or "").lower()
    host = re.sub(r"^www[0-9]*\.", "", m[1].lower())
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


def _uuid(page_id: str | None, url: str | None) -> str:
    h = hashlib.sha1(f"{page_id}\0{url}".encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def record(page_id: str | None, url: str | None, seconds: int, payload: bytes, refers: tuple[str | None, str | None] | None) -> bytes:
    """One WARC/1.1 record; ``refers`` is the response's (page id, URL) for a revisit."""
    own = digest(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers else head + payload
    fields = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", _uuid(page_id, url)),
        ("WARC-Date", datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Payload-Digest", f"sha1:{own}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _BREAKS.sub(lambda c: f"%{ord(c[0]):02X}", url)))
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if refers:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _uuid(*refers))]
        if refers[0] is not None:
            fields.append(("X-Refers-To-Page-ID", refers[0]))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def read_archive(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, block) of every record of an archive."""
    at, step = 0, 1 << 14
    while at < len(data):
        z, parts, fed = zlib.decompressobj(31), [], at
        while not z.eof and fed < len(data):
            parts.append(z.decompress(data[fed : fed + step]))
            fed += step
        used = min(fed, len(data)) - len(z.unused_data) - at
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        if not lines[0].startswith("WARC/") or len(rest) != int(fields["Content-Length"]) + 4:
            raise ValueError(f"no whole WARC record at {at}")
        yield at, used, fields, rest[:-4]
        at += used


class LoserTree:
    """Merges k sorted runs; every inner node keeps the loser of its match."""

    def __init__(self, runs: Iterable[Iterator], key) -> None:
        self.runs, self.key = list(runs), key
        self.k = len(self.runs)
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k
        for i in range(self.k):
            self._advance(i)
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _advance(self, i: int) -> None:
        row = next(self.runs[i], None)
        self.heads[i], self.keys[i] = row, None if row is None else self.key(row)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None or (self.keys[b] is None and a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.tree[node] < 0:  # still being built: wait for the opponent
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while self.k:
            i = self.tree[0]
            if self.keys[i] is None:
                return
            yield self.heads[i]
            self._advance(i)
            self._replay(i)


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", time: str | None = None, archive_bytes: int = ARCHIVE_BYTES, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """A table (archive, data), each row a ``.warc.gz`` file."""
    seconds = F.unix_timestamp(F.col(time).cast("timestamp")) if time else F.col(page_id).cast("string").try_cast("long") + EPOCH
    named = pages.select(
        F.col(page_id).alias("id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(page).cast("string").cast("binary"), F.lit(b"")).alias("payload"),
        F.when(seconds.between(0, 253_402_300_799), seconds).otherwise(EPOCH).alias("seconds"),
    ).withColumn("sha", F.sha1("payload"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "url")
    first = named.where(F.length("payload") >= least_revisit).groupBy("sha").agg(F.min(place).alias("a"), F.max(place).alias("z"))
    copied = materialise(first.where("not (a <=> z)").select("sha", "a"), "copied")
    ready = named.join(copied, "sha", "left").select(
        F.col("id").cast("string").alias("id"),
        "url",
        "payload",
        "seconds",
        (F.col("a").isNotNull() & (F.length("payload") >= least_revisit) & ~place.eqNullSafe(F.col("a"))).alias("revisit"),
        F.col("a.id").cast("string").alias("first_id"),
        F.col("a.url").alias("first_url"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, name = [], 0, hashlib.sha1()

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{name.hexdigest()}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "data"])

        for b in batches:
            for i, u, p, s, again, fi, fu in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = record(i, u, s, p, (fi, fu) if again else None)
                held.append(member(raw))
                name.update(held[-1])
                size += len(p)
                if size >= archive_bytes:
                    yield archive()
                    held, size, name = [], 0, hashlib.sha1()
        if held:
            yield archive()

    return materialise(ready.mapInArrow(run, "archive string, data binary"), "warc")


_CAPTURE = "url_key string, seconds long, page_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, archive string, offset long, length long"


def _key(r: tuple) -> tuple:
    return r[0], r[1], r[2] is None, len(r[2] or ""), r[2] or "", r[7], r[8]


def capture_runs(archives: DataFrame) -> DataFrame:
    """The captures of every archive, read back and sorted locally."""
    names = [f.split()[0] for f in _CAPTURE.split(", ")]
    kinds = [pa.int64() if f.endswith(" long") else pa.string() for f in _CAPTURE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("archive").to_pylist(), b.column("data").to_pylist(), strict=True):
                rows = []
                for at, length, f, block in read_archive(data):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size, sha = int(re.search(rb"Content-Length: ([0-9]+)", head)[1]), f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != sha):
                        raise ValueError(f"{name} at {at}: the payload doesn't match its digest")
                    when = int(datetime.strptime(f["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
                    rows.append((url_key(f.get("WARC-Target-URI")), when, f.get("X-Page-ID"), f["WARC-Type"], size, sha, f.get("X-Refers-To-Page-ID"), name, at, length))
                rows.sort(key=_key)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return materialise(archives.mapInArrow(run, _CAPTURE), "captures")


def natural_runs(rows: Iterable[tuple], key=_key) -> list[list[tuple]]:
    """The rows as sorted runs: one goes on for as long as an archive's keys rise."""
    done: list[list[tuple]] = []
    open_: dict[str, list[tuple]] = {}
    for row in rows:
        run = open_.get(row[7])
        if run is None or key(row) < key(run[-1]):
            open_[row[7]] = run = []
            done.append(run)
        run.append(row)
    return done


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in global order of URL key, time and id, by loser trees.

    Adds ``part``, the number of the range, and ``place``, the capture's place in
    its URL's history within the range. Rows of partition i come before those of
    partition i + 1, and are in order in it.
    """
    n = max(1, -(-runs.count() // range_rows))
    order = ["url_key", "seconds", F.col("page_id").isNull(), F.length("page_id"), "page_id"]
    ranged = runs.repartitionByRange(n, *order) if n > 1 else runs.coalesce(1)
    names, kinds = [*runs.columns, "part", "place"], [*(pa.int64() if f.dataType == T.LongType() else pa.string() for f in runs.schema), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        parts = natural_runs(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held: list[tuple] = []
        url, place = None, 0
        for row in LoserTree([iter(p) for p in parts], _key):
            url, place = row[0], place + 1 if row[0] == url else 1
            held.append((*row, part, place))
            if len(held) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return ranged.mapInArrow(run, T.StructType([*runs.schema, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())]))


def in_history(merged: DataFrame) -> DataFrame:
    """``merged``, written once, with ``place`` counted over all ranges."""
    merged = materialise(merged, "merged")
    # a range's first and last URL may go on beyond it: two rows for each range at most
    ends = merged.groupBy("part").agg(F.min("url_key").alias("first"), F.max("url_key").alias("last"))
    ends = ends.select("part", F.explode(F.array_distinct(F.array("first", "last"))).alias("url_key"))
    counts = merged.join(F.broadcast(ends), ["part", "url_key"]).groupBy("part", "url_key").agg(F.max("place").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = F.broadcast(counts.select("part", "url_key", before.alias("before")).where("before > 0"))
    joined = merged.join(moved, ["part", "url_key"], "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0)))
    return joined.select(*[c for c in merged.columns if c != "part"])


def histories(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", time: str | None = None) -> DataFrame:
    """Writes archives of all pages, reads them back, and merges their index."""
    kind = pages.schema[page_id].dataType
    merged = in_history(merge_runs(capture_runs(write_archives(pages, page_id, url, page, time))))
    return merged.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})

"""Avro container files.

Where Spark's own ``avro`` format is on the class path it is used. Otherwise
files are decoded from the ``binaryFile`` source, which reads any store Spark
reads, and encoded by the executors into a folder that they share. Records of
long, int, double, float, string, boolean and bytes fields, each nullable.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wharfline.session import has_format

MAGIC = b"Obj\x01"
BLOCK_ROWS = 4096
#: Avro's primitive names of Spark's types.
_NAMES = {T.LongType: "long", T.IntegerType: "int", T.ShortType: "int", T.DoubleType: "double", T.FloatType: "float", T.StringType: "string", T.BooleanType: "boolean", T.BinaryType: "bytes"}
_BACK = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType(), "boolean": T.BooleanType(), "bytes": T.BinaryType()}


def has_native(spark: SparkSession) -> bool:
    return has_format(spark, "avro")


def put_long(out: io.BytesIO, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.write(bytes(((n & 0x7F) | 0x80,)))
        n >>= 7
    out.write(bytes((n,)))


def get_long(src: io.BytesIO) -> int:
    shift = value = 0
    while True:
        got = src.read(1)
        if not got:
            raise ValueError("the Avro file ends inside a number")
        value |= (got[0] & 0x7F) << shift
        if got[0] < 0x80:
            return (value >> 1) ^ -(value & 1)
        shift += 7


def _put(out: io.BytesIO, kind: str, v: object) -> None:
    if v is None:
        put_long(out, 0)
        return
    put_long(out, 1)
    if kind in ("long", "int"):
        put_long(out, v)
    elif kind == "double":
        out.write(struct.pack("<d", v))
    elif kind == "float":
        out.write(struct.pack("<f", v))
    elif kind == "boolean":
        out.write(b"\x01" if v else b"\x00")
    else:
        data = v.encode() if kind == "string" else bytes(v)
        put_long(out, len(data))
        out.write(data)


def _get(src: io.BytesIO, kind: str | list) -> object:
    if isinstance(kind, list):
        return _get(src, kind[get_long(src)])
    if kind == "null":
        return None
    if kind in ("long", "int"):
        return get_long(src)
    if kind == "double":
        return struct.unpack("<d", src.read(8))[0]
    if kind == "float":
        return struct.unpack("<f", src.read(4))[0]
    if kind == "boolean":
        return src.read(1) == b"\x01"
    if kind in ("string", "bytes"):
        data = src.read(get_long(src))
        return data.decode() if kind == "string" else data
    raise ValueError(f"Avro type {kind} isn't supported")


def schema_json(schema: T.StructType, name: str = "row") -> str:
    fields = [{"name": f.name, "type": ["null", _NAMES[type(f.dataType)]]} for f in schema]
    return json.dumps({"type": "record", "name": name, "fields": fields})


def encode(rows: Iterator[tuple], schema: str) -> Iterator[bytes]:
    """A container file in pieces: the head, then a block of rows each."""
    kinds = [f["type"][1] for f in json.loads(schema)["fields"]]
    sync = struct.pack("<QQ", zlib.crc32(schema.encode()), 0x9E3779B97F4A7C15)
    head = io.BytesIO()
    head.write(MAGIC)
    put_long(head, 2)
    for k, v in (("avro.schema", schema), ("avro.codec", "deflate")):
        for s in (k, v):
            put_long(head, len(s.encode()))
            head.write(s.encode())
    put_long(head, 0)
    head.write(sync)
    yield head.getvalue()
    body, n = io.BytesIO(), 0

    def block() -> bytes:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        data, out = z.compress(body.getvalue()) + z.flush(), io.BytesIO()
        put_long(out, n)
        put_long(out, len(data))
        return out.getvalue() + data + sync

    for row in rows:
        for kind, v in zip(kinds, row, strict=True):
            _put(body, kind, v)
        n += 1
        if n == BLOCK_ROWS:
            yield block()
            body, n = io.BytesIO(), 0
    if n:
        yield block()


def _head(src: io.BytesIO) -> tuple[dict, str, bytes]:
    if src.read(4) != MAGIC:
        raise ValueError("not an Avro container file")
    meta: dict[str, bytes] = {}
    while n := get_long(src):
        if n < 0:
            n = -n
            get_long(src)
        for _ in range(n):
            k = src.read(get_long(src)).decode()
            meta[k] = src.read(get_long(src))
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), src.read(16)


def decode(data: bytes) -> Iterator[list[tuple]]:
    """The rows of a container file, a block at a time."""
    src = io.BytesIO(data)
    schema, codec, sync = _head(src)
    kinds = [f["type"] for f in schema["fields"]]
    while src.tell() < len(data):
        n, size = get_long(src), get_long(src)
        raw = src.read(size)
        if src.read(16) != sync:
            raise ValueError("an Avro block doesn't end in its mark")
        body = io.BytesIO(zlib.decompress(raw, -15) if codec == "deflate" else raw)
        yield [tuple(_get(body, k) for k in kinds) for _ in range(n)]


def spark_schema(avro: dict) -> T.StructType:
    pick = lambda t: next(x for x in t if x != "null") if isinstance(t, list) else t
    return T.StructType([T.StructField(f["name"], _BACK[pick(f["type"])]) for f in avro["fields"]])


def _qualified(spark, path: str) -> str:
    """The path in the default store, where Spark would read it, if it names none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def write_avro(df: DataFrame, path: str) -> None:
    """A file per partition under ``path``, a URI that all executors can write."""
    if has_native(df.sparkSession):
        df.write.format("avro").mode("overwrite").save(path)
        return
    schema = schema_json(df.schema)
    uri = _qualified(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held = f"{folder}/_{task.partitionId()}-{task.taskAttemptId()}"
        with store.open_output_stream(held) as out:
            for piece in encode(rows, schema):
                out.write(piece)
        store.move(held, f"{folder}/part-{task.partitionId():05d}.avro")  # an attempt run again replaces it
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64())], names=["part"])

    df.mapInArrow(run, "part long").count()


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    if has_native(spark):
        return spark.read.format("avro").load(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.avro").load(path)
    first = files.select("content").limit(1).collect()
    if not first:
        raise FileNotFoundError(f"no Avro files under {path}")
    schema = spark_schema(_head(io.BytesIO(bytes(first[0][0])))[0])
    arrow = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}
    kinds, names = [arrow[type(f.dataType)] for f in schema], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                for rows in decode(data):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("content").mapInArrow(run, schema)

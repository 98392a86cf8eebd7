"""Column logs: several streams of fixed-width columns in one file, in row groups.

Layout, little-endian: 8 bytes of magic; number of streams (u32); per stream its name (u8 length, bytes),
number of fields (u32) and per field a type code (u8) and name (u8 length, bytes); then row groups: stream
(u32), rows (u32), and the columns one after another. The magic is a parameter."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MAGIC = b"TAPELOG\x01"
#: Type codes.
CODES = ("u8", "u32", "u64", "i64", "f64")
NUMPY = {"u8": "u1", "u32": "<u4", "u64": "<u8", "i64": "<i8", "f64": "<f8"}
SPARK = {"u8": T.ShortType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0), "i64": T.LongType(), "f64": T.DoubleType()}
Streams = list[tuple[str, list[tuple[str, str]]]]


def fingerprint(fields: list[tuple[str, str]]) -> str:
    return "".join(f"{n}:{t}," for n, t in fields)


def header(data: bytes) -> tuple[Streams, int]:
    (count,), at, out = struct.unpack_from("<I", data, 8), 12, []

    def name(at: int) -> tuple[str, int]:
        return data[at + 1 : at + 1 + data[at]].decode(), at + 1 + data[at]

    for _ in range(count):
        stream, at = name(at)
        (n,), at, fields = struct.unpack_from("<I", data, at), at + 4, []
        for _ in range(n):
            kind, (field, at) = CODES[data[at]], name(at + 1)
            fields.append((field, kind))
        out.append((stream, fields))
    return out, at


def groups(data: bytes, magic: bytes | None, want: str) -> Iterator[tuple[list[tuple[str, str]], dict[str, np.ndarray]]]:
    if magic is not None and data[:8] != magic:
        raise ValueError("the file's magic differs")
    streams, at = header(data)
    while at < len(data):
        stream, rows = struct.unpack_from("<II", data, at)
        at += 8
        name, fields = streams[stream]
        sizes = [np.dtype(NUMPY[k]).itemsize * rows for _, k in fields]
        if at + sum(sizes) > len(data):
            raise ValueError(f"row group at {at} is truncated")
        if name == want:
            cols, a = {}, at
            for (field, kind), size in zip(fields, sizes, strict=True):
                cols[field] = np.frombuffer(data, NUMPY[kind], rows, a)
                a += size
            yield fields, cols
        at += sum(sizes)


def read(spark: SparkSession, path: str, stream: str, fields: list[tuple[str, str]], magic: bytes | None = MAGIC, columns: list[str] | None = None) -> DataFrame:
    """One stream of the logs at ``path``; files whose fields differ are refused. Only ``columns`` are built."""
    keep = [f for f in fields if columns is None or f[0] in columns]
    schema = T.StructType([T.StructField(n, SPARK[k]) for n, k in keep])

    def run(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                for own, cols in groups(data, magic, stream):
                    if fingerprint(own) != fingerprint(fields):
                        raise ValueError(f"fields are {fingerprint(own)}")
                    arrays = [pa.array(cols[n].astype("i2") if k == "u8" else cols[n].astype("i8") if k == "u32" else cols[n]) for n, k in keep]
                    arrays = [a.cast(pa.decimal128(20, 0)) if k == "u64" else a for a, (_, k) in zip(arrays, keep, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in keep])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def dump(streams: dict[str, tuple[list[tuple[str, str]], list[dict]]], group: int = 65536, magic: bytes = MAGIC) -> bytes:
    """A log of small tables (driver-side rows); large tables belong in Parquet."""
    out = bytearray(magic + struct.pack("<I", len(streams)))
    for name, (fields, _) in streams.items():
        out += bytes([len(name)]) + name.encode() + struct.pack("<I", len(fields))
        for n, k in fields:
            out += bytes([CODES.index(k), len(n)]) + n.encode()
    for i, (fields, rows) in enumerate(streams.values()):
        for a in range(0, len(rows), group):
            some = rows[a : a + group]
            out += struct.pack("<II", i, len(some))
            for n, k in fields:
                out += np.array([r[n] for r in some], NUMPY[k]).tobytes()
    return bytes(out)


def write(path: str, streams: dict[str, tuple[list[tuple[str, str]], list[dict]]], **kw) -> None:
    Path(path).write_bytes(dump(streams, **kw))

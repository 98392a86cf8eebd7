"""Messages as bytes and as columns: framing lengths, decoding in arrays, encoding, hashing.

Numbers are big-endian. Types that nobody asks for cost nothing; references of 2^63 and more don't fit a long and
are told by decode_error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.digest import FNV_BASIS, FNV_PRIME, MASK

#: Bytes of a message of each type; those that change the book, and the others of a session.
CORE = {"A": 36, "F": 40, "E": 31, "C": 36, "X": 23, "D": 19, "U": 35}
SESSION = {"S": 12, "R": 39, "H": 25, "Y": 20, "L": 26, "V": 35, "W": 12, "K": 28, "I": 50, "N": 20, "Q": 40, "P": 44, "B": 19, "J": 35, "O": 48, "h": 21}
HEADER = 11
#: Name, offset, bytes, kind of the fields behind the header (u number, c text, f flag).
FIELDS = {
    "A": (("order_ref", 11, 8, "u"), ("side", 19, 1, "c"), ("shares", 20, 4, "u"), ("stock", 24, 8, "c"), ("price", 32, 4, "u")),
    "F": (("order_ref", 11, 8, "u"), ("side", 19, 1, "c"), ("shares", 20, 4, "u"), ("stock", 24, 8, "c"), ("price", 32, 4, "u"), ("attribution", 36, 4, "c")),
    "E": (("order_ref", 11, 8, "u"), ("shares", 19, 4, "u"), ("match_number", 23, 8, "u")),
    "C": (("order_ref", 11, 8, "u"), ("shares", 19, 4, "u"), ("match_number", 23, 8, "u"), ("printable", 31, 1, "f"), ("price", 32, 4, "u")),
    "X": (("order_ref", 11, 8, "u"), ("shares", 19, 4, "u")),
    "D": (("order_ref", 11, 8, "u"),),
    "U": (("order_ref", 11, 8, "u"), ("new_ref", 19, 8, "u"), ("shares", 27, 4, "u"), ("price", 31, 4, "u")),
    "S": (("code", 11, 1, "c"),),
    "H": (("stock", 11, 8, "c"), ("state", 19, 1, "c"), ("reason", 21, 4, "c")),
    "I": (("paired", 11, 8, "u"), ("imbalance", 19, 8, "u"), ("direction", 27, 1, "c"), ("near", 40, 4, "u"), ("reference", 44, 4, "u")),
    "Y": (("action", 19, 1, "c"),),
}


def number(frame: Column, offset: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(frame, offset + 1, size)), 16, 10).cast("decimal(20,0)")


def text(frame: Column, offset: int, size: int) -> Column:
    return F.rtrim(F.decode(F.substring(frame, offset + 1, size), "ISO-8859-1"), F.lit(" \0"))


ERRORS = ("truncated", "unknown_type", "invalid_side", "wide_number")


class _Column:
    """One field of a batch, filled type by type; null where no type fills it."""

    def __init__(self, n: int, kind: str):
        self.kind, self.there = kind, np.zeros(n, bool)
        self.values, self.words = np.zeros(n, np.int64), []

    def put(self, rows: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Fills ``rows`` from the field's bytes (a row each); says which don't fit."""
        self.there[rows] = True
        size = raw.shape[1]
        if self.kind == "u":
            wide = np.zeros((len(rows), 8), np.uint8)
            wide[:, 8 - size :] = raw
            self.values[rows] = wide.view(">i8")[:, 0]
            return wide[:, 0] >= 128
        if self.kind == "f":
            self.values[rows] = raw[:, 0] == ord("Y")
        else:
            each, which = np.unique(np.ascontiguousarray(raw).view(f"S{size}")[:, 0], return_inverse=True)
            self.values[rows] = which + len(self.words)
            self.words += [w.decode("latin-1").rstrip(" \0") for w in each.tolist()]
        return np.zeros(len(rows), bool)

    def array(self, ok: np.ndarray) -> pa.Array:
        there = self.there & ok
        if self.kind == "c":
            return pa.array(self.words, pa.string()).take(pa.array(self.values, mask=~there))
        return pa.array(self.values != 0 if self.kind == "f" else self.values, mask=~there)


def decode(frames: DataFrame, types: tuple[str, ...] = tuple(FIELDS), strict: bool = False) -> DataFrame:
    """frames(type, frame, ...) -> the same columns, locate, tracking, ts_ns, every field of ``types`` (null where a
    type lacks it) and decode_error. ``strict`` raises on the first error instead. Frames are read as arrays of bytes,
    all of a type in a batch at once."""
    kinds = {"locate": "u", "tracking": "u", "ts_ns": "u"} | {name: kind for t in types for name, _, _, kind in FIELDS[t]}
    kept = [c for c in frames.columns if c not in kinds]
    codes = list((CORE | SESSION).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            frame = pc.fill_null(batch.column("frame"), b"").cast(pa.large_binary())
            offs = np.frombuffer(frame.buffers()[1], np.int64)[frame.offset : frame.offset + n + 1] if n else np.zeros(1, np.int64)
            data = np.frombuffer(frame.buffers()[2], np.uint8) if frame.buffers()[2] is not None else np.zeros(0, np.uint8)
            size = np.diff(offs)
            code = pc.fill_null(pc.index_in(batch.column("type"), pa.array([t for t, _ in codes])), -1).to_numpy(zero_copy_only=False)
            need = np.where(code >= 0, np.array([k for _, k in codes])[code], 0)
            error = np.where(size < HEADER, 0, np.where(code < 0, 1, np.where(size < need, 0, -1)))
            columns = {name: _Column(n, kind) for name, kind in kinds.items()}
            some = np.flatnonzero(error < 0)
            for name, at, width in (("locate", 1, 2), ("tracking", 3, 2), ("ts_ns", 5, 6)):
                columns[name].put(some, data[offs[some][:, None] + np.arange(at, at + width)])
            for k, (t, length) in enumerate(codes):
                rows = some[code[some] == k]
                if not len(rows) or (t not in types and t not in "AF"):
                    continue
                raw = data[offs[rows][:, None] + np.arange(length)]
                if t in "AF":
                    error[rows[(raw[:, 19] != ord("B")) & (raw[:, 19] != ord("S"))]] = 2
                for name, at, width, _ in FIELDS[t] if t in types else ():
                    wide = columns[name].put(rows, raw[:, at : at + width])
                    error[rows[wide & (error[rows] < 0)]] = 3
            if strict and (error >= 0).any():
                raise ValueError(f"decode: {ERRORS[error[error >= 0][0]]}")
            ok = error < 0
            fields = [c.array(ok).cast(pa.int32()) if name in ("locate", "tracking") else c.array(ok) for name, c in columns.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *fields, pa.array(ERRORS).take(pa.array(error, mask=ok))], [*kept, *columns, "decode_error"])

    ddl = {"u": "long", "c": "string", "f": "boolean"}
    new = [f"{name} {'int' if name in ('locate', 'tracking') else ddl[kind]}" for name, kind in kinds.items()]
    schema = T.StructType([*(frames.schema[c] for c in kept), *T.StructType.fromDDL(", ".join([*new, "decode_error string"])).fields])
    need_cols = frames.select(*dict.fromkeys([*kept, "type", "frame"]))
    return need_cols.mapInArrow(run, schema)


def _hex(value: Column, size: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), 2 * size, "0")


def encode(messages: DataFrame) -> DataFrame:
    """frame of each message (type and the fields of its type; missing ones are 0 or blank)."""
    have = set(messages.columns)

    def part(name: str, size: int, kind: str) -> Column:
        if kind == "u":
            return _hex(F.coalesce(F.col(name), F.lit(0)) if name in have else F.lit(0), size)
        value = F.col(name) if name in have else F.lit("")
        value = F.when(value.cast("boolean"), "Y").otherwise("N") if kind == "f" and name in have else value
        return F.hex(F.encode(F.rpad(F.coalesce(value.cast("string"), F.lit("")), size, " "), "ISO-8859-1"))

    out = F.when(F.lit(False), "")
    for t, fields in FIELDS.items():
        parts, at = [F.hex(F.encode(F.col("type"), "ISO-8859-1")), part("locate", 2, "u"), part("tracking", 2, "u"), part("ts_ns", 6, "u")], HEADER
        for name, offset, size, kind in fields:
            parts.append(F.lit("20" * (offset - at)))
            parts.append(part(name, size, kind))
            at = offset + size
        parts.append(F.lit("20" * ((CORE | SESSION)[t] - at)))
        out = out.when(F.col("type") == t, F.concat(*parts))
    return messages.withColumn("frame", F.unhex(out))


def trace_hash(rows: list[dict], state: int = FNV_BASIS) -> int:
    """FNV-1a over decoded messages in order: whole numbers fold at once, texts byte by byte, padded."""

    def fold(value: int) -> None:
        nonlocal state
        state = ((state ^ (value & MASK)) * FNV_PRIME) & MASK

    for m in rows:
        fold(ord(m["type"]))
        for name in ("locate", "tracking", "ts_ns"):
            fold(m[name])
        for name, _, size, kind in FIELDS[m["type"]]:
            if kind == "u":
                fold(int(m[name]))
            elif kind == "f":
                fold(int(m[name]))
            elif size == 1:
                fold(ord(m[name]))
            else:
                for b in m[name].ljust(size).encode("latin-1"):
                    fold(b)
    return state

"""Captures as frames: raw, session-tolerant, length-prefixed, sequenced packets, and packet captures.

Files are read with Spark's binaryFile source, so any store it reaches will do; one file is one chain of
lengths and so one task, and a day is many files. Frames leave in Arrow batches with their position."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.schemas import CAPTURED, FRAMES
from tapeloom.sources.wire import CORE, HEADER, SESSION

FRAMINGS = ("raw", "session", "lenprefix", "mold", "pcap")
BATCH = 8192
#: Messages of a file are fewer than 2 to this power.
FILE_BITS = 40
#: Packet header, counts of heartbeat and end.
PACKET, HEARTBEAT, END = 20, 0xFFFF, 0
#: First bytes of a packet capture -> byte order, nanoseconds in a unit.
PCAP = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}


class FramingError(ValueError):
    """What is wrong with a stream, and where."""

    def __init__(self, kind: str, offset: int, detail: str = ""):
        super().__init__(f"{kind} at {offset}{': ' + detail if detail else ''}")
        self.kind, self.offset = kind, offset


def raw(data: bytes, tolerant: bool = False) -> Iterator[tuple[int, bytes]]:
    sizes, at = (CORE | SESSION if tolerant else CORE), 0
    while at < len(data):
        kind = chr(data[at])
        if len(data) - at < HEADER:
            raise FramingError("truncated", at)
        if kind not in sizes:
            raise FramingError("unknown_type", at, repr(kind))
        if len(data) - at < sizes[kind]:
            raise FramingError("truncated", at)
        frame = data[at : at + sizes[kind]]
        if kind in "AF" and frame[19:20] not in (b"B", b"S"):
            raise FramingError("invalid_side", at)
        yield at, frame
        at += sizes[kind]


def length_prefixed(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        if len(data) - at < 2:
            raise FramingError("truncated", at)
        n = int.from_bytes(data[at : at + 2], "big")
        if n == 0 or len(data) - at - 2 < n:
            raise FramingError("truncated", at)
        yield at + 2, data[at + 2 : at + 2 + n]
        at += 2 + n


def sequenced(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, sequence number, message). A session's numbers run on without a gap; another session starts anew."""
    at, expected, session = 0, None, None
    while at < len(data):
        start = at
        if len(data) - at < PACKET:
            raise FramingError("truncated_header", at)
        name, number, count = data[at : at + 10], *struct.unpack_from(">QH", data, at + 10)
        at += PACKET
        if count == END:
            if at != len(data):
                raise FramingError("trailing_bytes", at)
            return
        if name != session:
            session, expected = name, number
        if number != expected:
            raise FramingError("sequence_gap" if number > expected else "sequence_regression", start, f"expected {expected}, got {number}")
        for _ in range(0 if count == HEARTBEAT else count):
            if len(data) - at < 2:
                raise FramingError("truncated_message", at)
            n = int.from_bytes(data[at : at + 2], "big")
            at += 2
            if n == 0:
                raise FramingError("bad_message_length", at)
            if len(data) - at < n:
                raise FramingError("truncated_message", at)
            yield at, expected, data[at : at + n]
            expected += 1
            at += n


def captured(data: bytes) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(offset, ts_ns, source port, destination port, protocol, payload); what isn't UDP over IPv4 comes whole."""
    if data[:4] not in PCAP or len(data) < 24:
        return
    order, unit = PCAP[data[:4]]
    at = 24
    while at + 16 <= len(data):
        sec, sub, size, _ = struct.unpack_from(order + "IIII", data, at)
        at += 16
        if at + size > len(data):
            return
        yield (at, sec * 10**9 + sub * unit, *_datagram(data[at : at + size]))
        at += size


def _datagram(packet: bytes) -> tuple[int, int, int, bytes]:
    at = 12
    if len(packet) >= 18 and packet[at : at + 2] == b"\x81\x00":
        at += 4
    if len(packet) < at + 2 + 20 or packet[at : at + 2] != b"\x08\x00":
        return 0, 0, 0, packet
    at += 2
    head, protocol = (packet[at] & 15) * 4, packet[at + 9]
    if protocol != 17 or len(packet) < at + head + 8:
        return 0, 0, protocol, packet
    source, target, size = struct.unpack_from(">HHH", packet, at + head)
    return source, target, protocol, packet[at + head + 8 : at + head + max(8, size)]


def _walk(data: bytes, framing: str) -> Iterator[tuple[int, int | None, int | None, bytes]]:
    if framing in ("raw", "session"):
        yield from ((at, None, None, f) for at, f in raw(data, framing == "session"))
    elif framing == "lenprefix":
        yield from ((at, None, None, f) for at, f in length_prefixed(data))
    elif framing == "mold":
        yield from ((at, n, None, f) for at, n, f in sequenced(data))
    else:
        yield from ((at, None, ts, f) for at, ts, _, _, protocol, f in captured(data) if protocol == 17)


def frames(files: DataFrame, framing: str = "session", types: tuple[str, ...] | None = None) -> DataFrame:
    """files(path, ordinal, content) -> file, offset, seq (place in the whole stream: files in order of ``ordinal``, then
    places in a file), number (of a sequenced message), ts_ns (of a packet capture), type, frame. ``types`` are framed but
    only those are kept; an empty file is an error."""
    if framing not in FRAMINGS:
        raise ValueError(f"framing is one of {FRAMINGS}")
    wanted = None if types is None else frozenset(types)
    names = [c.split()[0] for c in FRAMES.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def run(batches):
        for batch in batches:
            for file, ordinal, content in zip(*(batch.column(c).to_pylist() for c in ("path", "ordinal", "content")), strict=True):
                if not content:
                    raise FramingError("empty", 0, file)
                rows: list[tuple] = []
                for i, (at, n, ts, frame) in enumerate(_walk(content, framing)):
                    kind = chr(frame[0]) if frame else ""
                    if wanted is None or kind in wanted:
                        rows.append((file, at, (ordinal << FILE_BITS) + i, n, ts, kind, frame))
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path", F.col("ordinal").cast("long").alias("ordinal"), "content").mapInArrow(run, FRAMES)


def read_frames(spark: SparkSession, path: str, framing: str = "session", types: tuple[str, ...] | None = None) -> DataFrame:
    """``frames`` of the files at a path, in order of their names."""
    if framing not in FRAMINGS:
        raise ValueError(f"framing is one of {FRAMINGS}")
    whole = spark.read.format("binaryFile").load(path)
    names = sorted(r.path for r in whole.select("path").collect())  # names alone, no contents
    place = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("path")) - 1 if names else F.lit(0)
    return frames(whole.select("path", place.alias("ordinal"), "content"), framing, types)


def skipped(frame: DataFrame, core: tuple[str, ...] = tuple(CORE)) -> DataFrame:
    """How many frames of each type a replay passes over."""
    return frame.filter(~F.col("type").isin(*core)).groupBy("type").agg(F.count("*").alias("n"))


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets of captures with ports and protocol."""
    return packets_of(spark.read.format("binaryFile").load(path))


def packets_of(files: DataFrame) -> DataFrame:
    """files(content) -> packets with time, ports, protocol and payload."""
    names = [c.split()[0] for c in CAPTURED.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = [r[1:] for r in captured(content)]
                for a in range(0, len(rows), BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + BATCH], strict=True), kinds, strict=True)], names)

    return files.select("content").mapInArrow(run, CAPTURED)


def continuity(packets: DataFrame) -> DataFrame:
    """Breaks in packets(file, pkt_off, session, seq, count): each packet of a session starts where the last ended."""
    from pyspark.sql import Window as W

    w = W.partitionBy("file", "session").orderBy("pkt_off")
    told = packets.filter(F.col("count") != END).withColumn("expected", F.lag(F.col("seq") + F.when(F.col("count") == HEARTBEAT, 0).otherwise(F.col("count"))).over(w))
    return told.filter("expected <> seq").select("file", "pkt_off", "session", "expected", "seq", F.when(F.col("seq") > F.col("expected"), "sequence_gap").otherwise("sequence_regression").alias("error"))

"""Row types of the engine, and a fingerprint to compare them by."""

from __future__ import annotations

from pyspark.sql import types as T

FRAMES = "file string, offset long, seq long, number long, ts_ns long, type string, frame binary"
PRINTS = "match_number long, locate int, ts_ns long, price_ticks long, shares long, printable string, with_price string"
SCRIPT = "kind string, ts_ns long, side string, price_ticks long, qty long, ref long, flags string"
EVENTS = "type string, ts_ns long, ref long, side string, price_ticks long, qty long, fee_cash long, mid_ticks long, ledger string, submit_ns long"
CAPTURED = "ts_ns long, src_port int, dst_port int, protocol int, payload binary"


def fingerprint(schema: T.StructType) -> str:
    return "".join(f"{f.name}:{f.dataType.simpleString()}," for f in schema.fields)

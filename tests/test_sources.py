"""Framing, decoding, logs and text inputs."""

import struct

import pytest

from tapeloom.sources import capture, columnlog, ouch, tables, wire

CORE = tuple("AFECXDU")


def frames_of(spark, rows):
    schema = "seq long, type string, locate int, tracking int, ts_ns long, order_ref long, new_ref long, side string, shares long, stock string, price long, attribution string, match_number long, printable boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    return wire.encode(spark.createDataFrame([tuple(m.get(n) for n in names) for m in rows], schema))


@pytest.fixture(scope="module")
def messages():
    return [m | {"order_ref": m["order_ref"] % 2**62} for m in tables.corpus(7, 70)]


def test_round_trip_and_framings(spark, tmp_path, messages):
    frames = [bytes(r.frame) for r in frames_of(spark, messages).orderBy("seq").collect()]
    assert [len(f) for f in frames[:7]] == [wire.CORE[t] for t in "AFECXDU"]
    raw = b"".join(frames)
    session = b"S" + bytes(10) + b"O" + raw
    lenp = b"".join(struct.pack(">H", len(f)) + f for f in frames)
    packet = lambda n, some: b"SESSION001" + struct.pack(">QH", n, len(some)) + b"".join(struct.pack(">H", len(f)) + f for f in some)
    mold = packet(1, frames[:30]) + b"SESSION001" + struct.pack(">QH", 31, 0xFFFF) + packet(31, frames[30:]) + b"SESSION001" + struct.pack(">QH", 71, 0)
    udp = lambda f: bytes(12) + b"\x08\x00" + b"\x45" + bytes(8) + b"\x11" + bytes(10) + struct.pack(">HHHH", 1, 2, 8 + len(f), 0) + f
    pcap = b"\xd4\xc3\xb2\xa1" + bytes(20) + b"".join(struct.pack("<IIII", 1, i, len(udp(f)), len(udp(f))) + udp(f) for i, f in enumerate(frames))
    got = {}
    for kind, data in (("raw", raw), ("session", session), ("lenprefix", lenp), ("mold", mold), ("pcap", pcap)):
        (tmp_path / kind).write_bytes(data)
        df = capture.read_frames(spark, str(tmp_path / kind), kind, CORE)
        got[kind] = [bytes(r.frame) for r in df.orderBy("seq").collect()]
        if kind == "raw":
            back = [r.asDict() for r in wire.decode(df, CORE, strict=True).orderBy("seq").collect()]
    assert all(g == frames for g in got.values())
    assert wire.trace_hash(back) == wire.trace_hash(messages)
    assert capture.read_packets(spark, str(tmp_path / "pcap")).filter("dst_port = 2 and protocol = 17").count() == 70


@pytest.mark.parametrize(
    "data, framing, kind",
    [(b"Z" + bytes(20), "session", "unknown_type"), (b"D" + bytes(15), "raw", "truncated"), (b"S" + bytes(11), "raw", "unknown_type"), (b"\0\0", "lenprefix", "truncated"), (b"A" + bytes(35), "raw", "invalid_side"), (bytes(12), "mold", "truncated_header"), (b"0" * 10 + struct.pack(">QH", 1, 1) + b"\0\0", "mold", "bad_message_length")],
)
def test_bad_streams(data, framing, kind):
    with pytest.raises(capture.FramingError) as e:
        list(capture._walk(data, framing))
    assert e.value.kind == kind


def test_gaps():
    one = lambda n, s=b"A" * 10: s + struct.pack(">QH", n, 1) + struct.pack(">H", 1) + b"x"
    assert [n for _, n, _ in capture.sequenced(one(5) + one(6) + one(1, b"B" * 10))] == [5, 6, 1]
    for data, kind in ((one(5) + one(7), "sequence_gap"), (one(5) + one(5), "sequence_regression"), (b"A" * 10 + struct.pack(">QH", 1, 0) + b"x", "trailing_bytes")):
        with pytest.raises(capture.FramingError) as e:
            list(capture.sequenced(data))
        assert e.value.kind == kind


def test_decode_errors(spark):
    f = spark.createDataFrame([("A", bytearray(b"A" + bytes(35))), ("D", bytearray(b"D" + bytes(11))), ("?", bytearray(b"?" + bytes(20))), ("D", bytearray(b"D" + bytes(10) + b"\xff" * 8)), ("D", bytearray(b"D" + bytes(17) + b"\x07"))], "type string, frame binary")
    out = wire.decode(f).select("order_ref", "decode_error").collect()
    assert [tuple(r) for r in out] == [(None, "invalid_side"), (None, "truncated"), (None, "unknown_type"), (None, "wide_number"), (7, None)]


def test_column_log(spark, tmp_path):
    fields = [("ts", "u64"), ("px", "i64"), ("qty", "u32"), ("side", "u8"), ("x", "f64")]
    rows = [{"ts": 2**64 - 1 - i, "px": -i, "qty": i, "side": i % 2, "x": i / 2} for i in range(10)]
    columnlog.write(str(tmp_path / "log"), {"other": ([("a", "u8")], [{"a": 1}]), "fills": (fields, rows)}, group=4)
    df = columnlog.read(spark, str(tmp_path / "log"), "fills", fields)
    assert [(int(r.ts), r.px, r.qty, r.side, r.x) for r in df.collect()] == [tuple(r.values()) for r in rows]
    assert columnlog.read(spark, str(tmp_path / "log"), "fills", fields, columns=["px"]).columns == ["px"]
    with pytest.raises(Exception, match="fields are"):
        columnlog.read(spark, str(tmp_path / "log"), "fills", fields[:2]).collect()


def test_text_inputs(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("kind,ts_ns,side,price_ticks,qty,ref,flags\next_add,1,B,10,5,1,\nhalt,2,,,,,\nstrat_limit,3,S,0,5,2,mid:-3\n")
    assert [(r.kind, r.peg, r.offset, r.hidden) for r in tables.read_script(spark, str(p)).orderBy("line_no").collect()] == [("ext_add", "none", 0, False), ("halt", "none", 0, False), ("strat_limit", "mid", -3, True)]
    p.write_text("kind,ts_ns,side,price_ticks,qty,ref\nnope,1,B,10,5,1\n")
    with pytest.raises(Exception, match="not a script row"):
        tables.read_script(spark, str(p)).collect()
    with pytest.raises(ValueError):
        tables.read_prints(spark, str(p))
    p.write_text("match_number,locate,ts_ns,price_ticks,shares,printable,with_price\n7,1,2,100,5,Y,N\n7,1,2,101,5,Y,N\n")
    assert tables.read_prints(spark, str(p)).count() == 2
    p.write_text("type,ts_ns,ref,side,price_ticks,qty,fee_cash,mid_ticks,ledger,submit_ns\nF,1,2,B,100,5,-1,0,M,0\n")
    assert tables.read_events(spark, str(p)).first().fee_cash == -1


def test_order_entry_codec(spark):
    rows = [(1, bytearray(ouch.pack("O", {"token": "00000000000007", "side": "B", "shares": 5, "stock": "SPY", "price": 100, "tif": 99999}))), (2, bytearray(ouch.pack("X", {"token": "t", "shares": 3}))), (3, bytearray(b"O123"))]
    got = ouch.decode(spark.createDataFrame(rows, "seq long, frame binary")).collect()
    assert [len(r[1]) for r in rows[:2]] == [49, 19] and (got[0].token, got[0].stock, got[0].tif, got[1].shares, got[2].decode_error) == ("00000000000007", "SPY", 99999, 3, "truncated")
    assert len(ouch.executed(1, "t", 2, 3, 4)) == ouch.OUTBOUND_SIZE["E"]

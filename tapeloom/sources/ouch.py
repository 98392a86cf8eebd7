"""Order-entry messages: inbound enter, replace, cancel and modify; outbound answers; and a gateway to the simulator.

Codecs are tables of places; decoding is a projection, and the gateway is one fold per session."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.simulator import STRATEGY, Config, Order, Simulator
from tapeloom.sources.wire import number, text

#: Name, offset, bytes, kind (u number, c text) of inbound fields, and whole sizes.
INBOUND_SIZE = {"O": 49, "U": 47, "X": 19, "M": 20}
OUTBOUND_SIZE = {"S": 10, "A": 66, "E": 40, "D": 37}
INBOUND = {
    "O": (("token", 1, 14, "c"), ("side", 15, 1, "c"), ("shares", 16, 4, "u"), ("stock", 20, 8, "c"), ("price", 28, 4, "u"), ("tif", 32, 4, "u"), ("firm", 36, 4, "c"), ("display", 40, 1, "c"), ("capacity", 41, 1, "c"), ("sweep", 42, 1, "c"), ("minimum", 43, 4, "u"), ("cross", 47, 1, "c"), ("customer", 48, 1, "c")),
    "U": (("token", 1, 14, "c"), ("new_token", 15, 14, "c"), ("shares", 29, 4, "u"), ("price", 33, 4, "u"), ("tif", 37, 4, "u"), ("display", 41, 1, "c"), ("sweep", 42, 1, "c"), ("minimum", 43, 4, "u")),
    "X": (("token", 1, 14, "c"), ("shares", 15, 4, "u")),
    "M": (("token", 1, 14, "c"), ("side", 15, 1, "c"), ("shares", 16, 4, "u")),
}
IMMEDIATE = 99_999  # a time in force of this means immediate or cancel


def decode(frames: DataFrame) -> DataFrame:
    """frames(seq, frame) of inbound messages -> type and every field, with decode_error."""
    kind = F.decode(F.substring("frame", 1, 1), "ISO-8859-1")
    need = F.element_at(F.create_map(*(F.lit(x) for t, n in INBOUND_SIZE.items() for x in (t, n))), kind)
    cols = {}
    for t, fields in INBOUND.items():
        for name, at, size, k in fields:
            value = number(F.col("frame"), at, size).cast("long") if k == "u" else text(F.col("frame"), at, size)
            cols[name] = (cols[name] if name in cols else F).when(kind == t, value)
    error = F.when(need.isNull(), "unknown_type").when(F.octet_length("frame") < need, "truncated")
    return frames.select("seq", kind.alias("type"), *(F.when(error.isNull(), c).alias(n) for n, c in cols.items()), error.alias("decode_error"))


def pack(kind: str, values: dict) -> bytes:
    """An inbound message."""
    out = bytearray(b" " * INBOUND_SIZE[kind])
    out[:1] = kind.encode()
    for name, at, size, k in INBOUND[kind]:
        v = values.get(name, 0 if k == "u" else "")
        out[at : at + size] = int(v).to_bytes(size, "big") if k == "u" else str(v).ljust(size).encode("latin-1")[:size]
    return bytes(out)


def executed(ts: int, token: str, shares: int, price: int, match: int) -> bytes:
    return b"E" + struct.pack(">Q", ts) + token.ljust(14).encode() + struct.pack(">II", shares, price) + b"R" + struct.pack(">Q", match)


class Gateway:
    """Inbound messages to orders; answers as (type, token, shares, price) rows in order."""

    def __init__(self, config: Config):
        self.sim, self.refs, self.tokens, self.out, self._seen = Simulator(config), {}, {}, [], [0, 0]
        self._next = STRATEGY

    def handle(self, m: dict, ts: int) -> None:
        kind, token = m["type"], m["token"]
        if kind == "O":
            if token in self.refs:
                return self._say("J", token, m["shares"], m["price"])
            self._next += 1
            self._know(token, self._next)
            self._say("A", token, m["shares"], m["price"])
            hidden = m.get("display") == "N"
            self.sim.submit(Order(self._next, m["side"], m["shares"], m["price"], "ioc" if m["tif"] == IMMEDIATE else "day_limit", hidden=hidden), ts)
            self.sim.drain()
        elif kind == "U":
            ref = self.refs.get(token)
            self._next += 1
            error = "unknown_order" if ref is None else self.sim.replace(ref, self._next, m["shares"], m["price"])
            if error == "none":
                del self.refs[token]
                self._know(m["new_token"], self._next)
            self._say("U" if error == "none" else "J", m["new_token"], m["shares"], m["price"])
        elif kind == "X":
            ref = self.refs.get(token)
            left = self.sim.book.remaining(ref) if ref is not None else 0
            if ref is not None and self.sim.cancel(ref):
                self._say("C", token, left, 0)
        self._flush()

    def _know(self, token: str, ref: int) -> None:
        self.refs[token], self.tokens[ref] = ref, token

    def _say(self, kind: str, token: str, shares: int, price: int) -> None:
        self.out.append((kind, token, shares, price))

    def _flush(self) -> None:
        news = [(f["seq"], "E", f["ref"], f["qty"], f["price_ticks"]) for f in self.sim.fills[self._seen[0] :]]
        for d in self.sim.decisions[self._seen[1] :]:
            if d["filled"]:
                news.append((d["seq"], "E", d["ref"], d["filled"], d["notional"] // d["filled"]))
            if d["cancelled"]:
                news.append((d["seq"], "D" if d["kind"] == "rejected_stp" else "C", d["ref"], d["cancelled"], 0))
        self._seen = [len(self.sim.fills), len(self.sim.decisions)]
        for _, kind, ref, shares, price in sorted(news, key=lambda x: x[0]):
            self._say(kind, self.tokens.get(ref, ""), shares, price)


def sessions(messages: DataFrame, config: Config) -> DataFrame:
    """messages(session, seq, ts_ns, type, fields...): every answer of each session's gateway."""
    import pandas as pd

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        gate, rows = Gateway(config), []
        for m in pdf.sort_values("seq").to_dict("records"):
            done = len(gate.out)
            gate.handle(m, int(m["ts_ns"]))
            rows += [(m["session"], m["seq"], i, *o) for i, o in enumerate(gate.out[done:])]
        return pd.DataFrame(rows, columns=["session", "seq", "nth", "type", "token", "shares", "price"])

    return messages.groupBy("session").applyInPandas(go, "session long, seq long, nth int, type string, token string, shares long, price long")

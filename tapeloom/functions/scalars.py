"""Scalar functions over integer ticks, quantities, days and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

I64_MIN, I64_MAX = -(2**63), 2**63 - 1
OPEN_NS, CLOSE_NS, EARLY_CLOSE_NS = 34_200 * 10**9, 57_600 * 10**9, 46_800 * 10**9


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _clamp(c: Column) -> Column:
    lo, hi = F.lit(I64_MIN).cast("decimal(38,0)"), F.lit(I64_MAX).cast("decimal(38,0)")
    return F.least(F.greatest(c.cast("decimal(38,0)"), lo), hi).cast("long")


def sat_add(a: Column, b: Column) -> Column:
    return _clamp(_wide(a) + _wide(b))


def sat_sub(a: Column, b: Column) -> Column:
    return _clamp(_wide(a) - _wide(b))


def sat_mul(a: Column, b: Column) -> Column:
    return _clamp(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"))


def fee(notional: Column, bps: Column) -> Column:
    """Signed basis points of notional, truncated toward zero."""
    return F.signum(bps.cast("double")).cast("long") * F.floor(notional.cast("decimal(28,0)") * F.abs(bps).cast("decimal(9,0)") / F.lit(10000)).cast("long")


def mid(bid: Column, ask: Column) -> Column:
    """Integer mid; 0 where a side is empty or not positive."""
    both = (bid > 0) & (ask > 0)
    return F.when(both, F.floor((bid + ask) / 2).cast("long")).otherwise(F.lit(0).cast("long"))


def doubled_mid(bid: Column, ask: Column) -> Column:
    return F.when(bid.isNotNull() & ask.isNotNull(), bid + ask).when(ask.isNotNull(), 2 * ask).when(bid.isNotNull(), 2 * bid).otherwise(F.lit(0).cast("long"))


def portfolio_mid(bid: Column, ask: Column) -> Column:
    return F.when(bid.isNotNull() & ask.isNotNull(), (bid + ask) / 2.0).otherwise(F.lit(0.0))


def taker_price(notional: Column, qty: Column) -> Column:
    """Average price, halves rounded up."""
    return F.floor((notional + F.floor(qty / 2)) / qty).cast("long")


def peg(kind: str, offset: Column, bid: Column, ask: Column) -> Column:
    """Reference price of a peg; null where its side is empty."""
    base = {"bid": bid, "ask": ask, "mid": F.when(bid.isNotNull() & ask.isNotNull(), F.floor((bid + ask) / 2).cast("long"))}[kind]
    return base + offset


def epoch_day(y: Column, m: Column, d: Column) -> Column:
    return F.unix_date(F.make_date(y, m, d))


def weekday(day: Column) -> Column:
    """0 is Sunday."""
    return F.pmod(day + 4, F.lit(7))


def trading_day(day: Column) -> Column:
    """Not Saturday or Sunday; there are no holidays."""
    return ~weekday(day).isin(0, 6)


def close_ns(early: Column) -> Column:
    return F.when(F.coalesce(early, F.lit(False)), EARLY_CLOSE_NS).otherwise(CLOSE_NS).cast("long")


def classify(day: Column, ns: Column, close: Column) -> Column:
    """Open and close themselves are in session."""
    return F.when(~trading_day(day), "non_trading_day").when(ns < OPEN_NS, "before_open").when(ns > close, "after_close").otherwise("in_session")


def symbol(raw: Column) -> Column:
    return F.rtrim(raw, F.lit(" \0"))


def padded_symbol(name: Column) -> Column:
    return F.rpad(name, 8, " ")


def token(order_id: Column) -> Column:
    return F.lpad(order_id.cast("string"), 14, "0")


def token_id(text: Column) -> Column:
    """The number of a token of digits, else null."""
    return F.when(text.rlike("^[0-9]+$"), text.cast("decimal(20,0)"))


def flag(text: Column) -> Column:
    """struct(peg, offset, hidden, ok) of a script flag: '', 'nd', or mid/bid/ask with an optional :offset."""
    side = F.regexp_extract(text, "^(mid|bid|ask)(?::([+-]?[0-9]+))?$", 1)
    off = F.regexp_extract(text, "^(mid|bid|ask)(?::([+-]?[0-9]+))?$", 2)
    pegged = side != ""
    return F.struct(
        F.when(pegged, side).otherwise("none").alias("peg"),
        F.when(off != "", off.cast("long")).otherwise(F.lit(0).cast("long")).alias("offset"),
        (pegged | (text == "nd")).alias("hidden"),
        (pegged | text.isin("", "nd")).alias("ok"),
    )


def prints_csv() -> Column:
    return F.concat_ws(",", *(F.col(c).cast("string") for c in ("match_number", "locate", "ts_ns", "price_ticks", "shares", "printable", "with_price")))


def events_csv() -> Column:
    return F.concat_ws(",", *(F.col(c).cast("string") for c in ("type", "ts_ns", "ref", "side", "price_ticks", "qty", "fee_cash", "mid_ticks", "ledger", "submit_ns")))

"""Orders and the book: what each message did to its order, and the resting book that remains.

A message's effect on an order depends only on the earlier messages of that order's replace chain: messages are
dealt and sorted by chain, and one pass over each partition folds them in Arrow batches, the k-th messages of all
chains of a batch in one step. What is kept between batches is the state of one chain, so a history never has to
fit into memory. A rejected message changes nothing, which a running sum couldn't say. Messages without an order
are no part of the pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators import chains

ADDS, REDUCES = ("A", "F"), ("E", "C", "X")
CORE = (*ADDS, *REDUCES, "D", "U")
_ADD, _REDUCE, _DELETE, _REPLACE = range(4)
_KINDS = np.array([_ADD] * 2 + [_REDUCE] * 3 + [_DELETE, _REPLACE])
STATUS = ("ok", "zero_ref", "bad_qty", "out_of_band", "duplicate_ref", "unknown_order", "over_execute")
_OK, _ZERO, _QTY, _BAND, _TWICE, _UNKNOWN, _OVER = range(7)
#: What had last happened to the reference that a message names.
FATES = ("never_added", "resting", "deleted", "drained", "replaced")
_NEVER, _RESTING, _DELETED, _DRAINED, _REPLACED = range(5)
EFFECT = "status string, remaining long, taken long, add_price long, order_side string, fate string"
#: Steps over fewer chains than this go message by message.
MANY = 16


class _Fold:
    """One batch of messages in order of chain and position."""

    def __init__(self, batch: pa.RecordBatch, lo: int | None, hi: int | None, carry: tuple[int | None, dict[int, tuple]]):
        def numbers(name: str) -> np.ndarray:
            return pc.fill_null(batch.column(name), 0).to_numpy(zero_copy_only=False).astype(np.int64)

        self.n = batch.num_rows
        self.chain, self.own, self.qty, self.price = (numbers(c) for c in ("_chain", "order_ref", "shares", "price"))
        self.kind = _KINDS[pc.index_in(batch.column("type"), pa.array(CORE)).to_numpy(zero_copy_only=False).astype(np.int64)]
        self.outside = pc.is_null(batch.column("price")).to_numpy(zero_copy_only=False)
        if lo is not None:
            self.outside = self.outside | (self.price < lo) | (self.price >= hi)
        self.side = pc.fill_null(pc.index_in(batch.column("side"), pa.array(["B", "S"])), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        other = np.where(self.kind == _REPLACE, numbers("new_ref"), self.own) if "new_ref" in batch.schema.names else self.own
        self.refs, place = np.unique(np.concatenate([self.own, other]), return_inverse=True)
        self.ref, self.new, self.new_own = place[: self.n], place[self.n :], other
        k = len(self.refs)
        self.left, self.entry, self.entry_side, self.last = np.zeros(k, np.int64), np.zeros(k, np.int64), np.full(k, -1), np.full(k, _NEVER)
        self.before = carry
        if self.n and carry[0] == self.chain[0]:
            at = np.searchsorted(self.refs, list(carry[1]))
            for i, (ref, state) in zip(at.tolist(), carry[1].items(), strict=True):
                if i < k and self.refs[i] == ref:
                    self.left[i], self.entry[i], self.entry_side[i], self.last[i] = state
        self.status, self.fate = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        self.remaining, self.taken, self.level, self.level_side = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64), np.zeros(self.n, np.int64), np.full(self.n, -1)

    def run(self) -> None:
        first = np.flatnonzero(np.diff(self.chain, prepend=self.chain[0] - 1))
        size = np.diff(np.append(first, self.n))
        place = np.arange(self.n) - np.repeat(first, size)
        order = np.argsort(place, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(place))]).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < MANY:
                self._singly(np.sort(order[a:]))
                break
            self._together(order[a:b])

    def _together(self, rows: np.ndarray) -> None:
        r, new, kind, qty, price = self.ref[rows], self.new[rows], self.kind[rows], self.qty[rows], self.price[rows]
        was = self.left[r]
        add, reduce, delete, replace = (kind == k for k in range(4))
        dead, outside = was == 0, self.outside[rows]
        status = np.where(dead, _UNKNOWN, _OK)
        status[reduce & ~dead & (qty > was)] = _OVER
        status[add] = np.where(dead, _OK, _TWICE)[add]
        status[replace & ~dead & (new != r) & (self.left[new] > 0)] = _TWICE
        status[replace & ~dead & (self.new_own[rows] == 0)] = _ZERO
        status[(add | replace) & outside] = _BAND
        status[~delete & (qty <= 0)] = _QTY
        status[add & (self.own[rows] == 0)] = _ZERO
        ok = status == _OK
        self.status[rows], self.fate[rows] = status, self.last[r]
        add, reduce, delete, replace = add & ok, reduce & ok, delete & ok, replace & ok
        self.taken[rows] = taken = np.where(reduce, qty, np.where(delete | replace, was, 0))
        self.entry[r[add]], self.entry_side[r[add]] = price[add], self.side[rows[add]]
        self.level[rows], self.level_side[rows] = self.entry[r], self.entry_side[r]
        self.left[r] = np.where(add, qty, was - taken)
        self.last[r[ok]] = np.where(replace, _REPLACED, np.where(delete, _DELETED, np.where(reduce & (was == taken), _DRAINED, _RESTING)))[ok]
        to = new[replace]
        self.left[to], self.entry[to], self.entry_side[to], self.last[to] = qty[replace], price[replace], self.entry_side[r[replace]], _RESTING
        self.remaining[rows] = self.left[np.where(replace, new, r)]

    def _singly(self, rows: np.ndarray) -> None:
        left, entry, entry_side, last = (x.tolist() for x in (self.left, self.entry, self.entry_side, self.last))
        out = []
        for r, own, new, new_own, kind, qty, price, outside, side in zip(*(x[rows].tolist() for x in (self.ref, self.own, self.new, self.new_own, self.kind, self.qty, self.price, self.outside, self.side)), strict=True):
            was, taken, fate, at = left[r], 0, last[r], r
            if kind == _ADD:
                status = _ZERO if own == 0 else _QTY if qty <= 0 else _BAND if outside else _TWICE if was else _OK
                if status == _OK:
                    left[r], entry[r], entry_side[r], last[r] = qty, price, side, _RESTING
                level, level_side = entry[r], entry_side[r]
            else:
                level, level_side = entry[r], entry_side[r]
                if kind == _REDUCE:
                    status = _QTY if qty <= 0 else _UNKNOWN if not was else _OVER if qty > was else _OK
                    taken = qty if status == _OK else 0
                elif kind == _DELETE:
                    status, taken = (_OK, was) if was else (_UNKNOWN, 0)
                else:
                    status = _QTY if qty <= 0 else _BAND if outside else _UNKNOWN if not was else _ZERO if new_own == 0 else _TWICE if new != r and left[new] else _OK
                    taken = was if status == _OK else 0
                if status == _OK:
                    left[r] = was - taken
                    last[r] = _REPLACED if kind == _REPLACE else _DELETED if kind == _DELETE else _DRAINED if was == taken else _RESTING
                    if kind == _REPLACE:
                        left[new], entry[new], entry_side[new], last[new], at = qty, price, entry_side[r], _RESTING, new
            out.append((status, fate, left[at], taken, level, level_side))
        for column, values in zip((self.status, self.fate, self.remaining, self.taken, self.level, self.level_side), zip(*out, strict=True), strict=True):
            column[rows] = values
        self.left, self.entry, self.entry_side, self.last = (np.array(x, np.int64) for x in (left, entry, entry_side, last))

    def carry(self) -> tuple[int | None, dict[int, tuple]]:
        """The last chain, and the state of its references."""
        chain = int(self.chain[-1])
        own = self.chain == chain
        known = dict(self.before[1]) if self.before[0] == chain else {}
        for i in np.unique(np.concatenate([self.ref[own], self.new[own]])).tolist():
            known[int(self.refs[i])] = int(self.left[i]), int(self.entry[i]), int(self.entry_side[i]), int(self.last[i])
        return chain, known

    def columns(self) -> list[pa.Array]:
        side = pa.array(["B", "S"]).take(pa.array(self.level_side, mask=self.level_side < 0))
        level = pa.array(self.level, mask=(self.fate == _NEVER) & ~((self.status == _OK) & (self.kind == _ADD)))
        return [pa.array(STATUS).take(pa.array(self.status)), pa.array(self.remaining), pa.array(self.taken), level, side, pa.array(FATES).take(pa.array(self.fate))]


def effects(messages: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Every message with status, remaining (of its order, after it; of a replacement, the new order), taken (quantity
    it removed), add_price and order_side (where its order rested), and fate (what had last happened to its reference).
    messages(seq, order_ref, locate, side, type, shares, price[, new_ref], ...). Checks, in this order: an add needs a
    reference, a quantity, a price inside [lo, hi) and no live order of its reference; a reduction needs a quantity, a
    live order and no more than what remains; a replacement needs a quantity, a price inside, a live order, and a new
    reference that isn't 0 and has no live order. A null price is outside, a null quantity is 0. Messages of other
    types or without a reference have the status none."""
    core = F.coalesce(F.col("type").isin(*CORE) & F.col("order_ref").isNotNull(), F.lit(False))
    names = messages.columns
    orders = messages.filter(core)
    chain = None
    if "new_ref" in names:
        chain = chains.roots(messages.filter((F.col("type") == "U") & core).select("order_ref", "new_ref"))
    if chain is None:
        keyed = orders.withColumn("_chain", F.col("order_ref").cast("long"))
    else:
        keyed = orders.join(chain, orders["order_ref"].cast("long") == F.col("ref"), "left").withColumn("_chain", F.coalesce("root", F.col("order_ref").cast("long"))).drop("ref", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: tuple[int | None, dict[int, tuple]] = (None, {})
        for batch in batches:
            if not batch.num_rows:
                continue
            fold = _Fold(batch, lo, hi, carry)
            fold.run()
            carry = fold.carry()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *fold.columns()], [*names, *_EFFECT])

    schema = T.StructType([*messages.schema.fields, *T.StructType.fromDDL(EFFECT).fields])
    done = keyed.repartition("_chain").sortWithinPartitions("_chain", "seq").mapInArrow(run, schema)
    zero, none = F.lit(0).cast("long"), F.lit(None)
    aside = messages.filter(~core).select(*names, F.lit("none").alias("status"), zero.alias("remaining"), zero.alias("taken"), none.cast("long").alias("add_price"), none.cast("string").alias("order_side"), F.lit(FATES[0]).alias("fate"))
    return done.union(aside)


_EFFECT = [c.split()[0] for c in EFFECT.split(", ")]


def prints(effect: DataFrame) -> DataFrame:
    """Executions that found their order: E at the order's price, C at its own; printable is carried, not filtered.
    The match number is the message's; null if the messages carry none."""
    done = effect.filter(F.col("type").isin("E", "C") & (F.col("status") == "ok"))
    own = F.col("type") == "C"
    match = F.col("match_number") if "match_number" in effect.columns else F.lit(None).cast("long")
    printed = ~own | F.coalesce(F.col("printable"), F.lit(True)) if "printable" in effect.columns else F.lit(True)
    return done.select(
        match.alias("match_number"), "locate", "ts_ns", F.when(own, F.col("price")).otherwise(F.col("add_price")).alias("price_ticks"), "shares", F.when(printed, "Y").otherwise("N").alias("printable"), F.when(own, "Y").otherwise("N").alias("with_price"), "order_ref", "seq",
    )


def print_counters(effect: DataFrame) -> DataFrame:
    execution = F.col("type").isin("E", "C")
    return effect.agg(
        F.count_if(execution & (F.col("status") == "ok")).alias("prints"),
        F.count_if(execution & (F.col("status") != "ok")).alias("unpriced"),
        F.count_if(~F.col("status").isin("ok", "none")).alias("failed"),
    )


def resting(effect: DataFrame) -> DataFrame:
    """Live orders with their place of entry: order_ref, locate, side, price, qty, entered."""
    done = effect.filter(F.col("status") == "ok")
    enters = F.struct(F.col("seq").alias("entered"), "locate", F.coalesce("order_side", "side").alias("side"), "price")
    none = F.lit(None).cast(done.select(enters.alias("e")).schema["e"].dataType)
    state = lambda ref, part, qty, entry: F.struct(F.col(ref).cast("long").alias("order_ref"), F.struct("seq", F.lit(part).alias("part")).alias("at"), qty.cast("long").alias("qty"), entry.alias("entry"))
    added = F.col("type").isin(*ADDS)
    if "new_ref" in effect.columns:
        replaced = F.array(state("order_ref", 0, F.lit(0), none), state("new_ref", 1, F.col("remaining"), enters))
        states = F.when(F.col("type") == "U", replaced).otherwise(F.array(state("order_ref", 0, F.col("remaining"), F.when(added, enters))))
    else:
        states = F.array(state("order_ref", 0, F.col("remaining"), F.when(added, enters)))
    last = done.select(F.explode(states).alias("s")).select("s.*").groupBy("order_ref").agg(F.max_by("qty", "at").alias("qty"), F.max(F.when(F.col("entry").isNotNull(), F.struct("at", "entry"))).alias("a"))
    return last.filter("qty > 0").select("order_ref", F.col("a.entry.locate").alias("locate"), F.col("a.entry.side").alias("side"), F.col("a.entry.price").alias("price"), "qty", F.col("a.entry.entered").alias("entered"))


def levels(rest: DataFrame) -> DataFrame:
    return rest.groupBy("locate", "side", "price").agg(F.sum("qty").alias("qty"), F.count("*").alias("orders"))


def best(rest: DataFrame) -> DataFrame:
    bid, ask = F.max(F.when(F.col("side") == "B", F.col("price"))), F.min(F.when(F.col("side") == "S", F.col("price")))
    return rest.groupBy("locate").agg(bid.alias("best_bid"), ask.alias("best_ask"))


def queue(rest: DataFrame) -> DataFrame:
    """Each order with its position in its level and the quantity ahead of it."""
    w = W.partitionBy("locate", "side", "price").orderBy("entered")
    ahead = F.coalesce(F.sum("qty").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rest.select("locate", "side", "price", "order_ref", "qty", F.row_number().over(w).cast("long").alias("place"), ahead.alias("ahead"))


def fronts(rest: DataFrame) -> DataFrame:
    return rest.groupBy("locate", "side", "price").agg(F.min_by("order_ref", "entered").alias("front_ref"))


def neighbours(level: DataFrame) -> DataFrame:
    """Each level with the next levels below and above on its side."""
    w = W.partitionBy("locate", "side").orderBy("price")
    return level.select("locate", "side", "price", F.lag("price").over(w).alias("below"), F.lead("price").over(w).alias("above"))


def depth(level: DataFrame, n: int, alpha: float = 1.0) -> DataFrame:
    """The first n levels from the touch, with weight (1 + level) ** -alpha."""
    from_touch = F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))
    place = F.row_number().over(W.partitionBy("locate", "side").orderBy(from_touch))
    ranked = level.withColumn("level", (place - 1).cast("long")).filter(F.col("level") < n)
    return ranked.select("locate", "side", "level", "price", "qty", F.round(F.pow(F.lit(1.0) + F.col("level"), F.lit(-alpha)), 6).alias("weight"))


def deltas(effect: DataFrame) -> DataFrame:
    """Signed quantity changes of levels; their sum is the book. A replacement is two, the removal first."""
    change = lambda part, price, qty: F.struct(F.lit(part).alias("part"), F.col(price).cast("long").alias("price"), qty.cast("long").alias("delta"))
    gone, new = change(0, "add_price", -F.col("taken")), change(1, "price", F.col("shares"))
    parts = F.when(F.col("type") == "U", F.array(gone, new)).when(F.col("type").isin(*ADDS), F.array(new)).otherwise(F.array(gone))
    rows = effect.filter(F.col("status") == "ok").select("seq", "locate", F.col("order_side").alias("side"), F.explode(parts).alias("p"))
    return rows.select("seq", "locate", "side", "p.price", "p.delta", "p.part").filter("delta != 0")


def last_deltas(delta: DataFrame, k: int) -> DataFrame:
    """The last k changes, and how many before them are gone."""
    kept = delta.orderBy(F.desc("seq"), F.desc("part")).limit(k)
    return kept.crossJoin(F.broadcast(delta.agg(F.greatest(F.count("*") - k, F.lit(0)).alias("dropped"))))


def audit(effect: DataFrame, rest: DataFrame, delta: DataFrame) -> DataFrame:
    """Violations of the book's invariants; all zero on a sound book."""
    folded = delta.groupBy("locate", "side", "price").agg(F.sum("delta").alias("d"))
    both = levels(rest).join(folded, ["locate", "side", "price"], "full_outer")
    one = both.agg(F.count_if(F.coalesce("qty", F.lit(0)) != F.coalesce("d", F.lit(0))).alias("level_mismatch"), F.count_if(F.col("d") < 0).alias("negative_level"))
    return one.crossJoin(effect.agg(F.count_if(F.col("remaining") < 0).alias("negative_order")))


def summary(effect: DataFrame, rest: DataFrame) -> DataFrame:
    """What a replay reports, over one book of all instruments."""
    m = effect.agg(
        F.count("*").alias("messages"), F.count_if(F.col("status") == "none").alias("skipped"), F.count_if(~F.col("status").isin("ok", "none")).alias("failed"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts")
    )
    b = rest.agg(F.count("*").alias("live_orders"), F.max(F.when(F.col("side") == "B", F.col("price"))).alias("best_bid"), F.min(F.when(F.col("side") == "S", F.col("price"))).alias("best_ask"))
    return m.crossJoin(b)


def locate_stats(effect: DataFrame) -> DataFrame:
    """Per locate: prints, unpriced, price range, shares, and the volume-weighted price in millionths of a tick (integer division)."""
    ok = F.col("status") == "ok"
    p = effect.filter(F.col("type").isin("E", "C")).withColumn("px", F.when(ok, F.when(F.col("type") == "C", F.col("price")).otherwise(F.col("add_price"))))
    notional = F.sum(F.when(ok, F.col("px").cast("decimal(38,0)") * F.col("shares")))
    shares = F.sum(F.when(ok, F.col("shares")))
    agg = p.groupBy("locate").agg(F.count_if(ok).alias("prints"), F.count_if(~ok).alias("unpriced"), F.min("px").alias("min_tick"), F.max("px").alias("max_tick"), F.coalesce(shares, F.lit(0)).alias("shares"), notional.alias("_n"))
    return agg.withColumn("vwap_micro", F.when(F.col("shares") > 0, F.expr("cast((_n * 1000000) div shares as bigint)"))).drop("_n")


def error_histogram(effect: DataFrame) -> DataFrame:
    """Failures by error and whether the reference had been added before."""
    rows = effect.filter(~F.col("status").isin("ok", "none"))
    return rows.groupBy(F.col("status").alias("error"), (F.col("fate") != FATES[0]).alias("seen")).agg(F.count("*").alias("n"))


def fates(effect: DataFrame) -> DataFrame:
    """What had happened to the orders of executions that failed: resting, deleted, drained, replaced or never added."""
    return effect.filter(F.col("type").isin("E", "C") & (F.col("status") != "ok")).groupBy("fate").agg(F.count("*").alias("n"))


def symbols(messages: DataFrame) -> DataFrame:
    """The stock of each locate, as its first add says."""
    return messages.filter(F.col("type").isin(*ADDS)).groupBy("locate").agg(F.min_by("stock", "seq").alias("symbol"), F.min_by("order_ref", "seq").alias("first_ref"))


def with_symbol(rows: DataFrame, symbol: DataFrame) -> DataFrame:
    """Rows with their locate's symbol. A locate has 16 bits, so there are 65,536 symbols at most to broadcast."""
    return rows.join(F.broadcast(symbol.select("locate", "symbol")), "locate", "left")

"""Execution quality from an event log: rows of fills (F) and prints (P), ordered by seq.

log(run, seq, type, ts_ns, ref, side, price_ticks, qty, fee_cash, mid_ticks, ledger, submit_ns); every
measure is per run. Cash and equity leave fees out; the account that includes them is ``account``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.operators import asof, ranks

HORIZONS_NS = (1_000_000, 10_000_000, 100_000_000)
TELEMETRY_NS = (1_000, 10_000, 100_000)


def _fill() -> Column:
    return F.col("type") == "F"


def signed_qty() -> Column:
    return F.when(F.col("side") == "B", F.col("qty")).otherwise(-F.col("qty"))


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def scalars(log: DataFrame) -> DataFrame:
    """Counts, quantities, volume, fees by ledger, inventory, cash, hit rate, final mid and equity, in one pass.
    A sell whose mid is unknown (0) counts as a hit though it isn't measurable, so the rate can exceed 1."""
    buy = F.col("side") == "B"
    hit = _fill() & F.when(buy, F.col("mid_ticks") > F.col("price_ticks")).otherwise(F.col("mid_ticks") < F.col("price_ticks"))
    measurable = _fill() & (F.col("mid_ticks") > 0) & (F.col("mid_ticks") != F.col("price_ticks"))
    fee = lambda ledger: _sum(F.when(_fill() & (F.col("ledger") == ledger), F.col("fee_cash")))
    out = log.groupBy("run").agg(
        F.count_if(_fill()).alias("fills"),
        F.count_if(F.col("type") == "P").alias("prints"),
        _sum(F.when(_fill() & buy, F.col("qty"))).alias("buy_qty"),
        _sum(F.when(_fill() & (F.col("side") == "S"), F.col("qty"))).alias("sell_qty"),
        _sum(F.when(_fill(), F.col("price_ticks") * F.col("qty"))).alias("volume_ticks"),
        _sum(F.when(_fill(), F.col("fee_cash"))).alias("fees_cash"),
        fee("M").alias("fees_maker_cash"),
        fee("T").alias("fees_taker_cash"),
        _sum(F.when(_fill(), signed_qty())).alias("final_inventory"),
        _sum(F.when(_fill(), -signed_qty() * F.col("price_ticks"))).alias("cash_pnl_ticks"),
        F.coalesce(F.max_by("mid_ticks", F.when(F.col("mid_ticks") > 0, F.col("seq"))), F.lit(0)).alias("final_mid_ticks"),
        F.count_if(hit).alias("hits"),
        F.count_if(measurable).alias("measurable"),
    )
    rate = F.when(F.col("measurable") > 0, F.round(F.col("hits") / F.col("measurable"), 6)).otherwise(F.lit(0.0))
    return out.withColumn("hit_rate", rate).withColumn("equity_pnl_ticks", F.col("cash_pnl_ticks") + F.col("final_inventory") * F.col("final_mid_ticks")).drop("hits", "measurable")


def equity(log: DataFrame, length: int | None = None) -> DataFrame:
    """Cash, inventory, equity and its running peak (from 0) after every row; rows without a mid are marked at
    the run's last one. A run is summed in parts of ``length`` rows, so a long one isn't one task."""
    flow = F.when(_fill(), -signed_qty() * F.col("price_ticks")).otherwise(F.lit(0))
    rows = ranks.carried(log, ["run"], "seq", {"cash": flow, "inventory": F.when(_fill(), signed_qty()).otherwise(F.lit(0))}, length)
    last = log.groupBy("run").agg(F.coalesce(F.max_by("mid_ticks", F.when(F.col("mid_ticks") > 0, F.col("seq"))), F.lit(0)).alias("_last"))
    rows = rows.join(last, "run").withColumn("equity", F.col("cash") + F.col("inventory") * F.when(F.col("mid_ticks") > 0, F.col("mid_ticks")).otherwise(F.col("_last")))
    return ranks.peaks(rows.select("run", "seq", "_block", "cash", "inventory", "equity"), ["run"], "seq", "equity", "peak", 0).select("run", "seq", "cash", "inventory", "equity", "peak")


def drawdown(curve: DataFrame) -> DataFrame:
    """Largest fall from the peak, in ticks, and in basis points of it while it is positive."""
    fall = F.col("peak") - F.col("equity")
    return curve.groupBy("run").agg(F.max(fall).alias("max_drawdown_ticks"), F.round(F.coalesce(F.max(F.when(F.col("peak") > 0, fall / F.col("peak"))), F.lit(0.0)) * 10000, 4).alias("max_drawdown_bps"))


def _targets(log: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    fills = log.filter(_fill() & (F.col("price_ticks") > 0)).select("run", "seq", "side", F.col("price_ticks").alias("px"), "mid_ticks", F.explode(F.array(*(F.lit(h).cast("long") for h in horizons))).alias("horizon_ns"), "ts_ns")
    fills = fills.withColumn("target_ns", F.col("ts_ns") + F.col("horizon_ns"))
    return fills


def markouts(log: DataFrame, horizons: tuple[int, ...] = HORIZONS_NS, bucket: int | None = asof.AUTO) -> DataFrame:
    """Mean move in basis points from a fill to the first print at or past each horizon."""
    prints = log.filter((F.col("type") == "P") & (F.col("price_ticks") > 0)).select("run", "ts_ns", "seq", F.col("price_ticks").alias("next_px"))
    firsts = prints.groupBy("run", "ts_ns").agg(F.min_by("next_px", "seq").alias("next_px"))
    hit = asof.forward(_targets(log, horizons), firsts, ["run"], "target_ns", "ts_ns", ["next_px"], bucket)
    move = F.when(F.col("side") == "B", 1).otherwise(-1) * (F.col("next_px") - F.col("px")) / F.col("px") * 10000
    return hit.groupBy("run", "horizon_ns").agg(F.count("next_px").alias("measured"), F.round(F.coalesce(F.avg(move), F.lit(0.0)), 6).alias("mean_bps"))


def tick_markouts(log: DataFrame, horizons: tuple[int, ...] = TELEMETRY_NS, bucket: int | None = asof.AUTO) -> DataFrame:
    """Mean move in ticks from a fill to the first mid at or past each horizon; fills that none follows are left out."""
    mids = log.filter("mid_ticks > 0").groupBy("run", "ts_ns").agg(F.min_by("mid_ticks", "seq").alias("next_mid"))
    hit = asof.forward(_targets(log, horizons), mids, ["run"], "target_ns", "ts_ns", ["next_mid"], bucket)
    move = F.when(F.col("side") == "B", 1).otherwise(-1) * (F.col("next_mid") - F.col("px"))
    return hit.groupBy("run", "horizon_ns").agg(F.count("next_mid").alias("measured"), F.round(F.coalesce(F.avg(move), F.lit(0.0)), 6).alias("mean_ticks"))


def account(log: DataFrame, length: int | None = None) -> DataFrame:
    """Running cash net of fees, inventory and fees after every fill."""
    sums = {"net_cash": -signed_qty() * F.col("price_ticks") - F.col("fee_cash"), "inventory": signed_qty(), "fees": F.col("fee_cash")}
    return ranks.carried(log.filter(_fill()), ["run"], "seq", sums, length).select("run", "seq", *sums)


def latency_histogram(log: DataFrame) -> DataFrame:
    """Taker latencies (ts - submit) in buckets of powers of two: 0 below 16 ns, then floor(log2) - 4, 31 at most."""
    lag = F.col("ts_ns") - F.col("submit_ns")
    rows = log.filter(_fill() & (F.col("submit_ns") > 0) & (lag >= 0)).select("run", lag.alias("latency"))
    bits = F.length(F.bin("latency")) - 1  # exact at powers of two, unlike a logarithm
    bucket = F.when(F.col("latency") < 16, 0).otherwise(F.least(bits - 4, F.lit(31))).cast("long")
    return rows.groupBy("run", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max("latency").alias("largest"))


def latency_fit(log: DataFrame, least: int = 8) -> DataFrame:
    """Mean, population deviation and the shape that their ratio suggests, with at least ``least`` samples."""
    lag = F.col("ts_ns") - F.col("submit_ns")
    rows = log.filter(_fill() & (F.col("ledger") == "T") & (F.col("submit_ns") > 0) & (lag >= 0))
    out = rows.groupBy("run").agg(F.count("*").alias("n"), F.avg(lag).alias("mean"), F.stddev_pop(lag).alias("sd")).filter(F.col("n") >= least)
    ratio = F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(F.lit(0.0))
    shape = F.when(F.abs(ratio - 1) < 0.25, "exponential").when(F.abs(ratio - 0.577) < 0.15, "uniform").otherwise("normal")
    return out.select("run", "n", F.round("mean", 4).alias("mean_ns"), F.round("sd", 4).alias("sd_ns"), shape.alias("shape"))


def merged(streams: list[tuple[str, DataFrame]]) -> DataFrame:
    """Streams that share one seq counter as one, in causal order: seq, then the order given here: the rows
    are sorted by both, over range partitions."""
    out = None
    for rank, (name, df) in enumerate(streams):
        one = df.withColumn("stream", F.lit(name)).withColumn("stream_rank", F.lit(rank))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.orderBy("seq", "stream_rank")


def quote_changes(quotes: DataFrame) -> DataFrame:
    """Rows at which the top of book differs from the row before. quotes(run, seq, bid_px, bid_qty, ask_px, ask_qty)."""
    top = F.struct("bid_px", "bid_qty", "ask_px", "ask_qty")
    w = W.partitionBy("run").orderBy("seq")
    return quotes.withColumn("_was", F.lag(top).over(w)).filter(~top.eqNullSafe(F.col("_was"))).drop("_was")

"""Price discovery, market impact and sweeps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.operators import ranks


def lead_lag(series: DataFrame, max_lag: int) -> DataFrame:
    """Correlation of x(i) and y(i + lag) for each lag, from centred sums; 0 where either side doesn't vary.
    series(i, x, y) is dense from 0; empty where it is not longer than max_lag."""
    size = series.agg(F.count("*").alias("n"))
    lags = series.sparkSession.range(-max_lag, max_lag + 1).select(F.col("id").alias("lag"))
    a = series.select("i", F.col("x").cast("double").alias("x")).crossJoin(F.broadcast(lags)).withColumn("j", F.col("i") + F.col("lag"))
    pairs = a.join(series.select(F.col("i").alias("j"), F.col("y").cast("double").alias("y")), "j")
    means = pairs.groupBy("lag").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    c = pairs.join(F.broadcast(means), "lag").withColumn("dx", F.col("x") - F.col("mx")).withColumn("dy", F.col("y") - F.col("my"))
    sums = c.groupBy("lag").agg(F.sum(F.col("dx") * F.col("dy")).alias("sxy"), F.sum(F.col("dx") ** 2).alias("sxx"), F.sum(F.col("dy") ** 2).alias("syy"))
    rho = F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))).otherwise(F.lit(0.0))
    return sums.crossJoin(F.broadcast(size)).filter((F.col("n") > max_lag) & F.lit(max_lag > 0)).select("lag", F.round(rho, 9).alias("rho"))


def best_lag(correlations: DataFrame) -> DataFrame:
    """The lag of the largest absolute correlation; of equal ones the most negative."""
    return correlations.agg(F.max(F.struct(F.abs("rho").alias("strength"), (-F.col("lag")).alias("l"), "rho")).alias("b")).filter("b is not null").select((-F.col("b.l")).alias("lag"), F.col("b.rho").alias("rho"))


def information_share(spread: DataFrame) -> DataFrame:
    """Hasbrouck's bounds of the first series' share from (v1, v2, c): the square of what it alone explains under
    either order of the factors. Zero where the covariance matrix isn't positive."""
    good = (F.col("v1") > 0) & (F.col("v2") > 0) & (F.col("v1") * F.col("v2") - F.col("c") ** 2 > 0)
    own = {1: ("v1", "v2"), 2: ("v2", "v1")}
    lead, rest = {}, {}
    for k, (mine, other) in own.items():
        lead[k] = (F.sqrt(mine) - F.col("c") / F.sqrt(mine)) ** 2
        rest[k] = F.greatest(F.col(other) - F.col("c") ** 2 / F.col(mine), F.lit(0.0))
    share = lambda part, other: F.when(part + other > 0, part / (part + other)).otherwise(F.lit(0.5))
    first, second = share(lead[1], rest[1]), share(rest[2], lead[2])
    low, high = F.least(first, second), F.greatest(first, second)
    or_zero = lambda x: F.round(F.when(good, F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))).otherwise(F.lit(0.0)), 6)
    return spread.select(or_zero(low).alias("lower_1"), or_zero(high).alias("upper_1"), or_zero(1 - high).alias("lower_2"), or_zero(1 - low).alias("upper_2"), or_zero((low + high) / 2).alias("mid_1"))


def permanent_impact(qty: Column, volume: float, sigma: float, gamma: float, alpha: float) -> Column:
    """Basis points: sign gamma sigma (|q| / V) ** alpha 10000."""
    return F.signum(qty.cast("double")) * gamma * sigma * F.pow(F.abs(qty) / F.lit(volume), F.lit(alpha)) * 10000


def temporary_impact(qty: Column, seconds: Column, volume: float, sigma: float, eta: float, beta: float, day: float = 23400.0) -> Column:
    """Basis points of the rate at which it trades: sign eta sigma (rate / V) ** beta 10000."""
    rate = F.abs(qty) / seconds * day
    return F.signum(qty.cast("double")) * eta * sigma * F.pow(rate / F.lit(volume), F.lit(beta)) * 10000


def _scan(factor: np.ndarray, x: np.ndarray) -> np.ndarray:
    """y[k] = factor[k] y[k - 1] + x[k] from y[-1] = 0, in doubling steps over whole arrays."""
    factor, x, step = factor.copy(), x.copy(), 1
    while step < x.shape[-1]:
        x[..., step:] += factor[..., step:] * x[..., :-step].copy()
        factor[..., step:] *= factor[..., :-step].copy()
        step *= 2
    return x


def _inside(rate: float, names: list[str]):
    """Within each block, in batches in order of key, block and seq: sums, decayed sums, and what is left of a unit that
    stood at the block's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was = None  # key, block, ts, and the three figures of the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            key, block, ts, perm, temp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "_block", "ts_ns", "permanent", "temporary"))
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            gone = np.zeros(len(key))
            gone[1:] = np.maximum(ts[1:] - ts[:-1], 0)  # a clock that doesn't advance leaves it
            sums, x = perm.astype(np.float64), np.stack([temp.astype(np.float64), first.astype(np.float64)])
            if was is not None and was[0] == key[0] and was[1] == block[0]:
                held = math.exp(-rate * max(int(ts[0]) - was[2], 0))
                sums[0] += was[3]
                x[:, 0] = x[:, 0] * [1, 0] + was[4] * held
            begins = np.flatnonzero(first).tolist()
            for a, b in zip(begins, [*begins[1:], len(key)], strict=True):
                np.cumsum(sums[a:b], out=sums[a:b])
            y = _scan(np.where(first, 0.0, np.stack([np.exp(-rate * gone)] * 2)), x)
            was = (key[-1], block[-1], int(ts[-1]), sums[-1], y[:, -1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "seq", "ts_ns", "_block")), pa.array(sums), *(pa.array(r) for r in y)], names)

    return run


def _across(rate: float, names: list[str]):
    """What each block starts with, from blocks in order: a row per block, so a loop does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, perm, temp = None, 0, 0.0, 0.0
        for batch in batches:
            out = []
            for key, block, begin, end, p, t, left in zip(*(batch.column(c).to_pylist() for c in ("key", "_block", "begin", "end", "p", "t", "left")), strict=True):
                if key != own:
                    own, last, perm, temp = key, begin, 0.0, 0.0
                temp *= math.exp(-rate * max(begin - last, 0))
                out.append((block, perm, temp))
                perm, temp, last = perm + p, temp * left + t, end
            blocks, perms, temps = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(blocks, pa.int64()), pa.array(perms, pa.float64()), pa.array(temps, pa.float64())], names)

    return run


def impact_state(shocks: DataFrame, half_life_ns: float, length: int | None = None) -> DataFrame:
    """Permanent sum and decayed temporary impact after each shock: shocks(key, seq, ts_ns, permanent, temporary).
    The recurrence is linear, so blocks of ``length`` positions are folded for themselves, in one pass over sorted
    partitions, and each adds what is left of the blocks before it."""
    rate, kind = math.log(2) / half_life_ns, shocks.schema["key"].dataType.simpleString()
    rows = shocks.select("key", F.col("seq").cast("long").alias("seq"), F.col("ts_ns").cast("long").alias("ts_ns"), "permanent", "temporary", F.floor(F.col("seq") / F.lit(length or ranks.LENGTH)).cast("long").alias("_block"))
    inside = rows.repartition("key", "_block").sortWithinPartitions("key", "_block", "seq").mapInArrow(_inside(rate, ["key", "seq", "ts_ns", "_block", "p", "t", "left"]), f"key {kind}, seq long, ts_ns long, _block long, p double, t double, left double")
    ends = inside.groupBy("key", "_block").agg(F.min_by("ts_ns", "seq").alias("begin"), F.max_by("ts_ns", "seq").alias("end"), *(F.max_by(c, "seq").alias(c) for c in ("p", "t", "left")))
    starts = ends.repartition("key").sortWithinPartitions("key", "_block").mapInArrow(_across(rate, ["key", "_block", "from_p", "from_t"]), f"key {kind}, _block long, from_p double, from_t double")
    out = inside.join(starts, ["key", "_block"])
    return out.select("key", "seq", F.round(F.col("p") + F.col("from_p"), 6).alias("permanent"), F.round(F.col("t") + F.col("from_t") * F.col("left"), 6).alias("temporary"))


def trajectory(spark, quantity: float, slices: int, horizon: float, sigma: float, risk: float, eta: float) -> DataFrame:
    """Holdings along the optimal schedule, X sinh(k (T - t)) / sinh(k T) with cosh(k dt) = 1 + (risk sigma^2 / eta) dt^2 / 2;
    linear where risk or eta is not positive."""
    dt = horizon / slices
    step = spark.range(slices + 1).select(F.col("id").alias("step"))
    kappa = math.acosh(1 + risk * sigma**2 / eta * dt * dt / 2) / dt if risk > 0 and eta > 0 else 0.0
    if abs(math.sinh(kappa * horizon)) < 1e-12:
        left = F.lit(quantity) * (1 - F.col("step") / F.lit(slices))
    else:
        left = F.lit(quantity) * F.sinh(F.lit(kappa) * (F.lit(horizon) - F.col("step") * F.lit(dt))) / F.lit(math.sinh(kappa * horizon))
    w = W.orderBy("step")  # as many rows as the schedule has slices
    return step.withColumn("left", left).select("step", F.round("left", 6).alias("remaining"), F.round(F.coalesce(F.lag("left").over(w) - F.col("left"), F.lit(0.0)), 6).alias("trade"))


def shortfall(schedule: DataFrame, seconds: float, volume: float, sigma: float, gamma: float, eta: float, day: float = 23400.0) -> DataFrame:
    """Expected cost of a schedule (step, trade) with slices of ``seconds``: a slice pays the permanent impact of all
    traded up to and with it, and the temporary impact of its own rate."""
    so_far = F.sum("trade").over(W.orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    cost = F.col("trade") * sigma / volume * (gamma * so_far + eta * F.col("trade") / seconds * day)
    return schedule.withColumn("cost", cost).agg(F.round(F.sum("cost"), 6).alias("shortfall"), F.round(F.sum("trade"), 6).alias("traded"))


def sweep_bands(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Min, mean, max and the interpolated 5, 50 and 95 percent quantiles of each numeric column."""
    pairs = ", ".join(f"'{k}', cast({k} as double)" for k in keys)
    long = runs.select(F.expr(f"stack({len(keys)}, {pairs}) as (key, value)"))
    out = long.groupBy("key").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.avg("value").alias("mean"), F.max("value").alias("hi"))
    out = out.join(ranks.quantiles(long, ["key"], F.col("value"), {"p5": 0.05, "p50": 0.5, "p95": 0.95}), "key", "left")
    return out.select("key", "n", *(F.round(c, 6).alias(c) for c in ("lo", "mean", "hi", "p5", "p50", "p95")))


def distinct_values(runs: DataFrame, keys: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{k}', cast({k} as string)" for k in keys)
    return runs.select(F.expr(f"stack({len(keys)}, {pairs}) as (key, value)")).groupBy("key").agg(F.count_distinct("value").alias("distinct_values"))


def grid(spark, axes: dict[str, str]) -> DataFrame:
    """One row per combination of axes given as 'a,b,c' or 'lo..hi[:step]'."""
    out = None
    for name, text in axes.items():
        if ".." in text:
            lo, _, rest = text.partition("..")
            hi, _, step = rest.partition(":")
            values = [float(lo) + i * float(step or 1) for i in range(int((float(hi) - float(lo)) / float(step or 1) + 1e-9) + 1)]
        else:
            values = [float(v) for v in text.split(",")]
        one = spark.createDataFrame([(v,) for v in values], f"`{name}` double")
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def medians(samples: DataFrame, base: DataFrame, limit: float) -> DataFrame:
    """Median of each repetition's median per name, against a base, flagged beyond ``limit`` times it."""
    inner = ranks.quantiles(samples, ["name", "repetition"], F.col("value"), {"m": 0.5})
    outer = ranks.quantiles(inner, ["name"], F.col("m"), {"median": 0.5})
    j = outer.join(ranks.quantiles(base, ["name"], F.col("value"), {"base": 0.5}), "name")
    ratio = F.col("median") / F.col("base")
    return j.select("name", F.round("median", 6).alias("median"), F.round(ratio, 6).alias("ratio"), (ratio > limit).alias("slower"))

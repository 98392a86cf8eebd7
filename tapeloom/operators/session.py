"""The trading session: phase, halt windows, auction imbalance and crosses.

Events carry seq (stream position) because what a print sees is what the stream said before it."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from heapq import heappop, heappush
from math import inf

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.operators import asof, folds

PHASES = ("O", "S", "Q", "M", "E", "C")


def phase(events: DataFrame) -> DataFrame:
    """The last recognised system event, and how many there were of either sort. events(seq, code)."""
    known = F.col("code").isin(*PHASES)
    return events.agg(F.max_by("code", F.when(known, F.col("seq"))).alias("phase"), F.count("*").alias("events"), F.count_if(~known).alias("ignored"))


def halt_windows(actions: DataFrame) -> DataFrame:
    """actions(seq, ts_ns, locate, state): H or P opens a window unless one is open, T closes it."""
    acts = actions.filter(F.col("state").isin("H", "P", "T")).withColumn("open", F.col("state") != "T")
    w = W.partitionBy("locate").orderBy("seq")
    turns = acts.withColumn("was", F.coalesce(F.lag("open").over(w), F.lit(False))).filter("open != was")
    ends = turns.withColumn("close_seq", F.lead("seq").over(w)).withColumn("end_ns", F.lead("ts_ns").over(w))
    return ends.filter("open").select("locate", F.col("seq").alias("open_seq"), F.col("ts_ns").alias("start_ns"), "close_seq", "end_ns")


def halted(points: DataFrame, windows: DataFrame, few: int = 1 << 10) -> DataFrame:
    """Points (seq, ts_ns, locate) that fall into a window as the stream had told it by then: an open that came
    later is unknown, a close that came later hasn't closed it. Up to ``few`` windows are broadcast. Of more, each point
    looks up two lowest values: the start among the windows that are open at its seq, against its time, and the open
    among the windows that hold its time, against its seq; no point meets a window."""
    w = windows.select(F.col("locate").alias("_l"), "open_seq", "start_ns", "close_seq", "end_ns")
    if windows.limit(few + 1).count() <= few:  # prints stay where they are
        told = (F.col("open_seq") < F.col("seq")) & (F.col("start_ns") <= F.col("ts_ns"))
        still = F.col("close_seq").isNull() | (F.col("close_seq") > F.col("seq")) | (F.col("ts_ns") < F.col("end_ns"))
        return points.join(F.broadcast(w), (F.col("locate") == F.col("_l")) & told & still, "left_semi")
    w = w.filter("_l IS NOT NULL AND open_seq IS NOT NULL AND start_ns IS NOT NULL")
    got = points.filter("locate IS NOT NULL AND seq IS NOT NULL AND ts_ns IS NOT NULL")
    got = _lowest(got, "seq", w.select("_l", (F.col("open_seq") + 1).alias("_from"), F.col("close_seq").alias("_to"), F.col("start_ns").alias("_value")), "_start")
    got = _lowest(got, "ts_ns", w.filter("end_ns IS NOT NULL").select("_l", F.col("start_ns").alias("_from"), F.col("end_ns").alias("_to"), F.col("open_seq").alias("_value")), "_open")
    return got.filter((F.col("_start") <= F.col("ts_ns")) | (F.col("_open") < F.col("seq"))).select(*points.columns)


def _lowest(points: DataFrame, at: str, spans: DataFrame, name: str) -> DataFrame:
    """Points with the lowest _value among the spans (_l, _from, _to, _value) of their locate that hold their ``at``; a span
    without _to has no end. The lowest value is a step function of ``at``: its steps are made by one pass over the spans."""
    cast = spans.select(F.col("_l").cast("long"), *(F.col(c).cast("long") for c in ("_from", "_to", "_value")))
    steps = folds.ordered(cast.filter("_to IS NULL OR _from < _to"), ["_l"], "_from", _steps, "locate long, _back long, _value long")
    back = points.select("*", (-F.col(at).cast("long")).alias("_at_back"))  # the last step at or before is the first one backwards
    out = asof.forward(back, steps, ["locate"], "_at_back", "_back", ["_value"])
    return out.select(*points.columns, F.col("_value").alias(name))


def _steps(spans: Iterator[dict]) -> Iterator[tuple]:
    """Where the lowest value changes, as (locate, -at, value or null). Kept are open spans; not those that end no later
    than one with a lower value."""
    open_: list[tuple[int, float]] = []
    at = value = None

    def ends(until: float) -> Iterator[tuple[float, int | None]]:
        while open_ and open_[0][1] <= until:
            end = open_[0][1]
            while open_ and open_[0][1] <= end:
                heappop(open_)
            yield end, open_[0][0] if open_ else None

    def turns() -> Iterator[tuple]:
        for s in spans:
            start, end, low = s["_from"], inf if s["_to"] is None else s["_to"], s["_value"]
            yield from ((s["_l"], *e) for e in ends(start))
            if not open_ or low < open_[0][0] or end > open_[0][1]:
                heappush(open_, (low, end))
                yield s["_l"], start, open_[0][0]
        if open_:
            yield from ((s["_l"], *e) for e in ends(sys.maxsize))

    for locate, place, low in turns():
        if at is not None and place != at:
            yield locate, -at, value
        at, value = place, low
    if at is not None:
        yield locate, -at, value


def latest_imbalance(noii: DataFrame) -> DataFrame:
    """noii(seq, locate, paired, imbalance, direction, near): the last one of each locate and the last that says something."""
    fields = F.struct("seq", "paired", "imbalance", "direction", "near")
    tells = (F.col("paired") > 0) | (F.col("imbalance") > 0)
    return noii.groupBy("locate").agg(F.max(fields).alias("a"), F.max(F.when(tells, fields)).alias("i"), F.count("*").alias("n")).select(
        "locate", F.col("a.seq").alias("last_seq"), F.col("i.seq").alias("told_seq"), F.col("i.paired").alias("paired"), F.col("i.imbalance").alias("imbalance"), F.col("i.direction").alias("direction"), F.col("i.near").alias("near"), "n"
    )


def market_crosses(noii: DataFrame, at_seq: DataFrame, kind: str) -> DataFrame:
    """Crosses of all locates at the last event in ``at_seq`` (seq): price near, quantity paired + imbalance
    whatever its direction."""
    last = at_seq.agg(F.max("seq").alias("_at"))
    seen = noii.join(F.broadcast(last), F.col("seq") < F.col("_at"))
    told = latest_imbalance(seen).filter("told_seq is not null")
    return told.select("locate", F.lit(kind).alias("kind"), F.col("near").alias("price"), (F.col("paired") + F.col("imbalance")).alias("qty"))


def resume_crosses(actions: DataFrame, noii: DataFrame) -> DataFrame:
    """A cross at every T of a locate that ever had a window before, with the last telling imbalance by then."""
    acts = actions.select("locate", "seq", F.lit(1).alias("act"), "state", *(F.lit(None).cast("long").alias(c) for c in ("paired", "imbalance", "near")))
    tells = noii.filter("paired > 0 OR imbalance > 0").select("locate", "seq", F.lit(0).alias("act"), F.lit(None).cast("string").alias("state"), "paired", "imbalance", "near")
    w = W.partitionBy("locate").orderBy("seq", "act").rowsBetween(W.unboundedPreceding, 0)
    rows = acts.unionByName(tells).withColumn("had", F.max(F.when(F.col("state").isin("H", "P"), 1).otherwise(0)).over(w)).withColumn("i", F.last(F.when(F.col("act") == 0, F.struct("paired", "imbalance", "near")), True).over(w))
    return rows.filter("state = 'T' AND had = 1 AND i IS NOT NULL").select("locate", "seq", F.col("i.near").alias("price"), (F.col("i.paired") + F.col("i.imbalance")).alias("qty"))


def short_sale(rows: DataFrame) -> DataFrame:
    """The last restriction of each locate. rows(seq, locate, action)."""
    return rows.groupBy("locate").agg(F.max_by("action", "seq").alias("action"), F.count("*").alias("n"))

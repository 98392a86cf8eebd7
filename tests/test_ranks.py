"""Order statistics, running sums and decayed sums in parts, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import asof, discovery, ranks, session, tearsheet


def test_quantiles(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.choice([None, 0.0, 5.5, rnd.gauss(0, 1), rnd.random() * 1e6])) for k in "aaaabc" for _ in range(300)] + [("d", 1.0), ("e", None)]
    got = {r.k: r for r in ranks.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], F.col("v"), {"lo": 0.0, "q": 0.3, "hi": 1.0}).collect()}
    for k in "abcd":
        own = [v for x, v in rows if x == k and v is not None]
        assert (got[k].lo, got[k].hi) == (min(own), max(own)) and got[k].q == pytest.approx(np.quantile(own, 0.3))
    assert "e" not in got


LOG = "run long, seq long, type string, ts_ns long, ref long, side string, price_ticks long, qty long, fee_cash long, mid_ticks long, ledger string, submit_ns long"


@pytest.mark.parametrize("length", [1, 7, None])
def test_running_sums_in_parts(spark, length):
    rnd = random.Random(2)
    rows = [(i % 3, i * 2, rnd.choice("FFP"), i, i, rnd.choice("BS"), rnd.randint(1, 50), rnd.randint(1, 9), rnd.randint(-3, 3), rnd.choice([0, rnd.randint(1, 50)]), "M", 0) for i in range(200)]
    log = spark.createDataFrame(rows, LOG).repartition(4)
    want, net = {}, {}
    for run in range(3):
        own = [r for r in rows if r[0] == run]
        last = next((r[9] for r in reversed(own) if r[9] > 0), 0)
        cash = inventory = peak = fees = 0
        for _, seq, kind, _, _, side, price, qty, fee, mid, *_ in own:
            signed = qty if side == "B" else -qty
            if kind == "F":
                cash, inventory, fees = cash - signed * price, inventory + signed, fees + fee
                net[run, seq] = (cash - fees, inventory, fees)
            value = cash + inventory * (mid or last)
            peak = max(peak, value)
            want[run, seq] = (cash, inventory, value, peak)
    assert {(r.run, r.seq): tuple(r)[2:] for r in tearsheet.equity(log, length).collect()} == want
    assert {(r.run, r.seq): tuple(r)[2:] for r in tearsheet.account(log, length).collect()} == net


@pytest.mark.parametrize("length", [1, 16, None])
def test_impact_in_parts(spark, length):
    """Clocks that stand or go back, and gaps beyond what an exponential holds."""
    rnd = random.Random(3)
    rows, ts = [], 0
    for i in range(300):
        ts += rnd.choice([0, -5, 10, 1000, 10**7, 10**13 if i % 90 == 0 else 3])
        rows.append((i % 2, i // 2, ts, rnd.uniform(-1, 1), rnd.uniform(-9, 9)))
    got = {(r.key, r.seq): (r.permanent, r.temporary) for r in discovery.impact_state(spark.createDataFrame(rows, "key long, seq long, ts_ns long, permanent double, temporary double").repartition(3), 5e3, length).collect()}
    for key in (0, 1):
        perm = temp = 0.0
        was = None
        for _, seq, ts, p, t in (r for r in rows if r[0] == key):
            temp = temp * math.exp(-math.log(2) / 5e3 * max(0, ts - (ts if was is None else was))) + t
            perm, was = perm + p, ts
            assert got[key, seq] == (pytest.approx(perm, abs=2e-6), pytest.approx(temp, abs=2e-6))


def test_halts_broadcast_and_salted(spark):
    rnd = random.Random(4)
    acts = spark.createDataFrame([(i * 10, i * 10 + rnd.randint(-15, 15), rnd.randrange(4), rnd.choice("HPT")) for i in range(60)], "seq long, ts_ns long, locate long, state string")
    points = spark.createDataFrame([(i, i + rnd.randint(-20, 20), rnd.randrange(5)) for i in range(1, 600, 7)], "seq long, ts_ns long, locate long")
    windows = session.halt_windows(acts)
    few, many = session.halted(points, windows), session.halted(points, windows, few=1)
    assert few.columns == many.columns and sorted(few.collect()) == sorted(many.collect()) and few.count()


def test_asof_chooses_its_pieces(spark, monkeypatch):
    left = spark.createDataFrame([(1, t) for t in range(0, 400, 3)], "k long, at long")
    right = spark.createDataFrame([(1, t, t) for t in range(0, 300, 7)], "k long, rt long, v long")
    whole = sorted(asof.forward(left, right, ["k"], "at", "rt", ["v"], None).collect(), key=repr)
    assert sorted(asof.forward(left, right, ["k"], "at", "rt", ["v"]).collect(), key=repr) == whole
    monkeypatch.setattr(asof, "PIECE", 5)
    assert asof._bucket(right, "rt") == 294 * 5 // 43
    assert sorted(asof.forward(left, right, ["k"], "at", "rt", ["v"]).collect(), key=repr) == whole


def test_many_halts_without_pairs(spark):  # F2
    rnd = random.Random(5)
    spans = [(rnd.randrange(3), i * 3, rnd.choice([None, i * 3 + rnd.randint(-40, 40)]) if i % 50 == 0 else i * 3 + rnd.randint(-40, 40)) for i in range(2500)]
    rows = [(k, o, s, *rnd.choice([(None, None), (o + rnd.randint(1, 90), None), (o + rnd.randint(1, 90), (s or 0) + rnd.randint(-9, 90))])) for k, o, s in spans]
    held = [w for w in rows if w[3] is not None or rnd.random() < 0.01]
    points = [(i, rnd.choice([i, i, None]) if i % 40 == 0 else i + rnd.randint(-60, 60), rnd.choice([0, 1, 2, 3, None])) for i in range(0, 7600, 5)]
    windows = spark.createDataFrame(held, "locate long, open_seq long, start_ns long, close_seq long, end_ns long")
    assert len(held) > 1 << 10
    got = session.halted(spark.createDataFrame(points + points[:50], "seq long, ts_ns long, locate long"), windows)

    def inside(p):
        return p[1] is not None and any(w[0] == p[2] and w[1] < p[0] and w[2] is not None and w[2] <= p[1] and (w[3] is None or w[3] > p[0] or w[4] is not None and p[1] < w[4]) for w in held)

    want = [p for p in points + points[:50] if inside(p)]
    assert 0 < len(want) < len(points) and sorted(map(tuple, got.collect())) == sorted(want)
    assert "LeftSemi" not in got._jdf.queryExecution().toString()

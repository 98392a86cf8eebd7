"""Hand-computed trades, sessions, diffs, tearsheets and analytics."""

import random

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import scalars as S
from tapeloom.operators import asof, chains, discovery, orders, session, tape, tearsheet
from tapeloom.operators.book import Book
from tapeloom.schemas import fingerprint

MESSAGE = "seq long, type string, order_ref long, shares long, price long, side string, locate long, ts_ns long, new_ref long, match_number long, printable boolean"


def messages(spark, rows):
    """(type, ref, shares, price, side, match, printable[, new_ref])"""
    return spark.createDataFrame([(i, t, ref, q, px, side, 1, i, *(more or (None,)), match, flag) for i, (t, ref, q, px, side, match, flag, *more) in enumerate(rows)], MESSAGE)


def test_trades(spark):
    rows = [
        ("A", 10, 1000, 100000, "B", None, None), ("E", 10, 400, 0, "", 77, None), ("C", 10, 300, 100005, "", 78, True), ("D", 10, 0, 0, "", None, None), ("A", 11, 500, 101000, "S", None, None),
        ("E", 11, 200, 0, "", 79, None), ("E", 99, 123, 0, "", 80, None), ("C", 11, 100, 99900, "", 81, False),
    ]
    e = orders.effects(messages(spark, rows))
    p = orders.prints(e).orderBy("seq").collect()
    assert [(r.match_number, r.price_ticks, r.shares, r.printable, r.with_price) for r in p] == [(77, 100000, 400, "Y", "N"), (78, 100005, 300, "Y", "Y"), (79, 101000, 200, "Y", "N"), (81, 99900, 100, "N", "Y")]
    assert tuple(orders.print_counters(e).first()) == (4, 1, 1)


def test_trades_after_a_replacement(spark):
    rows = [("A", 10, 1000, 100000, "B", None, None), ("E", 10, 400, 0, "", 77, None), ("C", 10, 100, 100005, "", 78, False), ("U", 10, 300, 99000, "", None, None, 11), ("E", 11, 50, 0, "", 79, None), ("E", 10, 1, 0, "", 80, None)]
    e = orders.effects(messages(spark, rows))
    p = orders.prints(e).orderBy("seq").collect()
    assert [(r.match_number, r.price_ticks, r.shares, r.printable) for r in p] == [(77, 100000, 400, "Y"), (78, 100005, 100, "N"), (79, 99000, 50, "Y")]
    assert [tuple(r) for r in orders.resting(e).collect()] == [(11, 1, "B", 99000, 250, 3)]
    assert [(r.seq, r.side, r.price, r.delta) for r in orders.deltas(e).orderBy("seq", "part").collect()] == [(0, "B", 100000, 1000), (1, "B", 100000, -400), (2, "B", 100000, -100), (3, "B", 100000, -500), (3, "B", 99000, 300), (4, "B", 99000, -50)]
    assert [tuple(r) for r in orders.fates(e).collect()] == [("replaced", 1)]


@pytest.mark.parametrize(("seed", "band", "refs"), [(1, None, 4), (2, (95, 106), 12), (3, None, 400)])
def test_effects_are_the_book(spark, seed, band, refs):
    """Dirty streams, against the ordered book: reused and missing references, chains, replacements onto live and onto
    their own references, reference 0, no quantity, prices outside, types that aren't orders."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(3000):
        t = rnd.choice("AAFECXXDUUS")
        ref = None if t == "S" else rnd.choice([0, *range(1, refs), 1, 2])
        rows.append((t, ref, rnd.choice([0, 1, 5, 9, 30]), rnd.randint(94, 107), rnd.choice("BS") if t in "AF" else None, None, None, rnd.choice([0, ref, *range(1, refs)]) if t == "U" else None))
    lo, hi = band or (None, None)
    got = orders.effects(messages(spark, rows).repartition(3), lo, hi).orderBy("seq").collect()
    book = Book(lo, hi)
    for r, (t, ref, qty, price, side, *_, new) in zip(got, rows, strict=True):
        was = book.orders.get(ref)
        level, left = (was[1], was[2]) if was else (None, 0)
        error = book.apply({"type": t, "order_ref": ref, "shares": qty, "price": price, "side": side, "new_ref": new})
        assert r.status == ("none" if t == "S" else "ok" if error == "none" else error)
        if t == "S":
            continue
        assert r.remaining == book.remaining(new if t == "U" and error == "none" else ref)
        if error == "none" and t not in "AF":
            assert (r.add_price, r.taken) == (level, left - book.remaining(ref) if t != "U" else left)
            assert r.order_side is not None
    e = orders.effects(messages(spark, rows), lo, hi)
    assert {(r.order_ref, r.side, r.price, r.qty) for r in orders.resting(e).collect()} == {(k, *v) for k, v in book.orders.items()}
    assert tuple(orders.audit(e, orders.resting(e), orders.deltas(e)).first()) == (0, 0, 0)
    by_level = {(s, p): [r for r, _ in book.queue(s, p)] for s in "BS" for p in book.prices[s]}
    assert {(r.side, r.price): r.front_ref for r in orders.fronts(orders.resting(e)).collect()} == {k: v[0] for k, v in by_level.items()}


def test_null_prices_quantities_and_references(spark):
    rows = [("A", 1, 5, None, "B", None, None), ("A", 2, None, 100, "B", None, None), ("A", None, 5, 100, "B", None, None), ("A", 3, 5, 100, None, None, None), ("U", 3, 5, None, None, None, None, 4), ("U", 3, 5, 100, None, None, None, None), ("E", 3, None, 0, None, None, None), (None, 3, 1, 1, None, None, None)]
    for band in ((), (0, 200)):
        got = orders.effects(messages(spark, rows), *band).orderBy("seq").collect()
        assert [r.status for r in got] == ["out_of_band", "bad_qty", "none", "ok", "out_of_band", "zero_ref", "bad_qty", "none"]
    assert orders.effects(messages(spark, rows).limit(0)).count() == 0


def test_messages_without_an_order_are_not_dealt(spark):
    """30 % session messages: no partition holds three times the mean."""
    own = spark.range(20000).select(F.col("id").alias("seq"), F.when(F.col("id") % 10 < 3, "S").when(F.col("id") % 10 < 6, "A").otherwise("E").alias("type"), F.when(F.col("id") % 10 >= 3, F.col("id") % 1000).alias("order_ref"), F.lit(5).cast("long").alias("shares"), F.lit(100).cast("long").alias("price"), F.lit("B").alias("side"), F.lit(1).cast("long").alias("locate"), F.col("id").alias("ts_ns"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # partitions as they are dealt, however small
    try:
        sizes = [r["count"] for r in orders.effects(own).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset(key)
    assert sum(sizes) == 20000 and max(sizes) < 3 * sum(sizes) / len(sizes)


def test_chains_by_rounds_and_in_one_task(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(25)] + [(None, 1), (2, None)]
    df = spark.createDataFrame(edges, "order_ref long, new_ref long")
    want = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in want:
        for a, b in edges:
            if a in want and b in want and a != b:
                want[a] = want[b] = min(want[a], want[b])
    for few in (None, 3):
        assert {r.ref: r.root for r in chains.roots(df, few).collect()} == want
    assert chains.roots(df.limit(0)) is None


def test_diff(spark):
    ours = spark.createDataFrame([(77, 100000, 400), (78, 100005, 300)], "match_number long, price_ticks long, shares long")
    theirs = spark.createDataFrame([(77, 100000, 401, 1), (79, 1, 1, 2), (80, 1, 1, 3)], "match_number long, price_ticks long, shares long, line_no int")
    assert tuple(tape.diff_report(ours, theirs).first()) == (1, 1, 2, 0, 1, 77)


def test_crosses(spark):
    noii = spark.createDataFrame([(1, 1, 5000, 0, "N", 1), (2, 1, 5000, 700, "B", 1000000), (3, 2, 12000, 0, "N", 555000), (4, 2, 0, 0, "N", 7), (9, 1, 1, 1, "B", 1)], "seq long, locate long, paired long, imbalance long, direction string, near long")
    got = session.market_crosses(noii, spark.createDataFrame([(5,)], "seq long"), "closing").orderBy("locate").collect()
    assert [(r.price, r.qty) for r in got] == [(1000000, 5700), (555000, 12000)]
    acts = spark.createDataFrame([(0, 1, "T"), (3, 1, "H"), (5, 1, "T"), (6, 1, "T")], "seq long, locate long, state string")
    assert [(r.seq, r.qty) for r in session.resume_crosses(acts, noii).orderBy("seq").collect()] == [(5, 5700), (6, 5700)]


def test_halts_by_stream_position(spark):
    acts = spark.createDataFrame([(1, 100, 1, "H"), (2, 110, 1, "P"), (5, 200, 1, "T"), (8, 300, 1, "H")], "seq long, ts_ns long, locate long, state string")
    w = session.halt_windows(acts)
    assert [(r.start_ns, r.end_ns) for r in w.orderBy("open_seq").collect()] == [(100, 200), (300, None)]
    points = spark.createDataFrame([(0, 100, 1), (3, 150, 1), (4, 250, 1), (6, 150, 1), (7, 200, 1), (9, 299, 1), (10, 300, 1), (10, 300, 2)], "seq long, ts_ns long, locate long")
    assert sorted(r.seq for r in session.halted(points, w).collect()) == [3, 4, 6, 10]


def test_calendar(spark):
    day = spark.range(1).select(S.epoch_day(F.lit(2000), F.lit(3), F.lit(1)).alias("d"), S.epoch_day(F.lit(2026), F.lit(7), F.lit(3)).alias("e")).first()
    assert day.d == 11017
    at = lambda ns, early: spark.range(1).select(S.classify(F.lit(day.e), F.lit(ns), S.close_ns(F.lit(early)))).first()[0]
    assert [at(S.OPEN_NS - 1, True), at(S.OPEN_NS, True), at(S.EARLY_CLOSE_NS, True), at(S.EARLY_CLOSE_NS + 1, True), at(S.EARLY_CLOSE_NS + 1, False)] == ["before_open", "in_session", "in_session", "after_close", "in_session"]


LOG = "run long, seq long, type string, ts_ns long, ref long, side string, price_ticks long, qty long, fee_cash long, mid_ticks long, ledger string, submit_ns long"


def test_tearsheet(spark):
    log = spark.createDataFrame(
        [(0, 0, "F", 0, 1, "B", 100000, 100, -40, 100050, "M", 0), (0, 1, "P", 1_000_000, 0, "B", 100050, 10, 0, 100060, "", 0), (0, 2, "F", 2_000_000, 2, "S", 100100, 100, 30, 100090, "T", 1_999_000), (0, 3, "P", 3_000_000, 0, "B", 100050, 10, 0, 100120, "", 0)],
        LOG,
    )
    r = tearsheet.scalars(log).first()
    assert (r.fills, r.prints, r.volume_ticks, r.fees_cash, r.fees_maker_cash, r.fees_taker_cash, r.cash_pnl_ticks, r.final_mid_ticks, r.hit_rate) == (2, 2, 20_010_000, -10, -40, 30, 10_000, 100_120, 1.0)
    m = {x.horizon_ns: x for x in tearsheet.markouts(log).collect()}
    assert m[1_000_000].measured == 2 and m[1_000_000].mean_bps == pytest.approx((5 + 50 / 100100 * 10000) / 2, abs=1e-5)
    assert (m[10_000_000].measured, m[10_000_000].mean_bps) == (0, 0.0)
    assert tearsheet.drawdown(tearsheet.equity(log)).first().max_drawdown_ticks == 0
    assert [(x.bucket, x.n) for x in tearsheet.latency_histogram(log).collect()] == [(5, 1)]


@pytest.mark.parametrize("bucket", [None, 7])
def test_asof(spark, bucket):
    left = spark.createDataFrame([(1, t) for t in range(0, 40, 3)] + [(2, 5)], "k long, at long")
    right = spark.createDataFrame([(1, 3, "a"), (1, 10, "b"), (1, 36, "c")], "k long, rt long, v string")
    got = {(r.k, r.at): r.v for r in asof.forward(left, right, ["k"], "at", "rt", ["v"], bucket).collect()}
    assert got == {(1, t): "a" if t <= 3 else "b" if t <= 10 else "c" if t <= 36 else None for t in range(0, 40, 3)} | {(2, 5): None}


def test_lead_lag(spark):
    wave = [(i * 7919) % 101 for i in range(60)]
    s = spark.createDataFrame([(i, wave[i], wave[i - 2] if i >= 2 else 0) for i in range(60)], "i long, x long, y long")
    best = discovery.best_lag(discovery.lead_lag(s, 5)).first()
    assert best.lag == 2 and best.rho == pytest.approx(1.0)
    assert discovery.lead_lag(s, 60).count() == 0
    flat = discovery.lead_lag(s.withColumn("y", F.lit(1)), 3)
    assert {r.rho for r in flat.collect()} == {0.0} and discovery.best_lag(flat).first().lag == -3


def test_information_shares_sum_to_one(spark):
    r = discovery.information_share(spark.createDataFrame([(4.0, 9.0, 2.0)], "v1 double, v2 double, c double")).first()
    assert r.lower_1 + r.upper_2 == pytest.approx(1) and r.upper_1 + r.lower_2 == pytest.approx(1)


def test_schedules(spark):
    twap = discovery.trajectory(spark, 100.0, 4, 60.0, 0.1, 0.0, 1.0).orderBy("step").collect()
    assert [r.remaining for r in twap] == [100, 75, 50, 25, 0]
    ac = discovery.trajectory(spark, 100.0, 4, 60.0, 0.1, 1.0, 0.01).orderBy("step").collect()
    assert ac[-1].remaining == 0 and ac[1].trade > 25


def test_bands_and_grid(spark):
    r = discovery.sweep_bands(spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "x double"), ["x"]).first()
    assert (r.p5, r.p50, r.p95, r.lo, r.hi) == (1.15, 2.5, 3.85, 1.0, 4.0)
    assert discovery.grid(spark, {"a": "1,2", "b": "0..10:5"}).count() == 6


def test_scalars(spark):
    r = spark.range(1).select(S.sat_add(F.lit(2**62), F.lit(2**62)).alias("a"), S.sat_mul(F.lit(-(2**62)), F.lit(4)).alias("m"), S.fee(F.lit(999), F.lit(-15)).alias("f"), S.taker_price(F.lit(7), F.lit(2)).alias("p")).first()
    assert (r.a, r.m, r.f, r.p) == (2**63 - 1, -(2**63), -1, 4)
    assert fingerprint(spark.range(1).schema) == "id:bigint,"

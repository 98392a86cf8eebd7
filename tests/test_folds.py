"""Folds stream: no group of rows is held whole, and whole numbers stay whole beside nulls."""

import tracemalloc

import pytest

from tapeloom.operators import folds, runs
from tapeloom.operators.simulator import Config, Simulator
from tapeloom.plans.registry import QUERIES

D = "/root/testdata/sf0.001"
BIG = (1 << 53) + 1
SCRIPT = "run long, line_no long, kind string, ts_ns long, side string, price_ticks long, qty long, ref long"


def streams(spark, name):
    plan = QUERIES[name](spark, D)._jdf.queryExecution().toString()
    return "MapInArrow" in plan and "FlatMapGroups" not in plan


def script(n):
    """A strategy's bid that flow takes, again and again."""
    for i in range(n):
        yield {"kind": "trade" if i % 2 else "strat_limit", "ts_ns": i, "side": "S" if i % 2 else "B", "price_ticks": 1000, "qty": 5, "ref": i}


def test_a_group_is_never_held(spark):
    def peak(rows):
        tracemalloc.start()
        n = sum(1 for _ in rows)
        yield n, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()

    (n, most), = folds.ordered(spark.range(200_000).selectExpr("0L AS k", "id", "uuid() AS text"), ["k"], "id", peak, "n long, peak long").collect()
    assert n == 200_000 and most < 16 << 20


def test_groups_and_order(spark):
    rows = [(k, i) for i in (3, 1, None, 2) for k in (1, None, 2)]
    got = folds.ordered(spark.createDataFrame(rows, "k long, i long").repartition(3), ["k"], "i", lambda rs: [tuple(map(str, zip(*((r["k"], r["i"]) for r in rs), strict=True)))], "k string, i string").collect()
    assert sorted(map(tuple, got)) == sorted((str((k,) * 4), "(1, 2, 3, None)") for k in (1, 2, None))


def test_a_script_keeps_no_history():
    sim, total = Simulator(Config()), {}
    read = []
    steps = runs._script_steps((read.append(1) or r for r in script(10_000)), sim, total)
    next(steps)
    assert len(read) == 2 and sum(1 for _ in steps) == 9_999
    assert total["maker_fills"] == 5_000 and not sim.decisions and not sim.trades and not sim.fills
    events, whole, kept = runs.run_script(script(10_000), Config())
    assert whole == total and len(events) == 10_000 and len(kept.decisions) == len(kept.trades) == 5_000


def test_grid_streams(spark):  # F1
    assert streams(spark, "sim_grid")


def test_long_references_beside_nulls(spark):  # a frame's column with a null became floating
    rows = [(1, 0, "resume", 0, None, None, None, None), (1, 1, "strat_limit", 1, "B", 1000, 5, BIG), (1, 2, "trade", 2, "S", 1000, 5, 7)]
    fill = runs.script_events(spark.createDataFrame(rows, SCRIPT), Config()).filter("type = 'F'").first()
    assert fill.ref == BIG + (1 << 62)


def test_book_fold_streams_and_keeps_long_references(spark):  # F6
    assert streams(spark, "book_fold")
    rows = [(1, 1, "A", 5, None, 10, 100, "B"), (1, 2, "U", 5, BIG, 10, 100, "B"), (1, 3, "E", BIG, None, 4, 0, "B"), (1, 4, "A", None, None, 1, 100, "B"), (1, 5, "A", 6, None, None, 100, "B"), (1, 6, "A", 8, None, 1, None, "B")]
    got = runs.book_fold(spark.createDataFrame(rows, "locate long, seq long, type string, order_ref long, new_ref long, shares long, price long, side string"))
    assert [r.error for r in got.orderBy("seq").collect()] == ["none", "none", "none", "none", "bad_qty", "out_of_band"]


def test_portfolio_stream(spark):  # F3
    assert streams(spark, "sim_portfolio")


def test_events_stream(spark):  # F4
    assert streams(spark, "sim_events")


def test_summary_stream(spark):  # F5
    assert streams(spark, "sim_summary")


def test_tearsheet_stream(spark):  # F7
    assert streams(spark, "sim_tearsheet")


def test_forks_stream(spark):  # F8
    assert streams(spark, "time_travel_fork")


def test_a_branch_keeps_its_live_orders_only():  # F8: without trades what rests stays, so a branch's book grows
    def rows(n):
        for i in range(n):
            rests = i % 10 == 0
            yield {"kind": "ext_add" if rests else "strat_ioc", "ts_ns": i, "side": "B" if rests else "S", "price_ticks": 1000 if rests else 2000, "qty": 5, "ref": 1_000 + i}

    def peak(n, keep):
        sim = Simulator(Config())
        tracemalloc.start()
        for _ in runs._script_steps(rows(n), sim, {}, keep):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return len(sim.book.orders), most

    live, most = peak(20_000, keep=False)
    assert live == 2_000 and most < 600 * live
    assert peak(20_000, keep=True)[1] > 600 * 20_000 / 2

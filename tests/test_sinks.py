"""Records as Arrow, logs and reports as files, user grids and branches."""

import pytest

from tapeloom import api
from tapeloom.operators import discovery
from tapeloom.sources import sinks, tables


def test_record_batches(spark):
    rows = spark.createDataFrame([(i, 1, i * 10, 100 + i, 5, "Y", "N", i) for i in range(20)], "match_number long, locate int, ts_ns long, price_ticks long, shares long, printable string, with_price string, order_ref long").repartition(3)
    batches = list(sinks.record_batches(rows, "prints"))
    assert sorted(r["match_number"] for b in batches for r in b.to_pylist()) == list(range(20))
    assert batches[0].schema.names == list(sinks.RECORDS["prints"]) and str(batches[0].schema.field("locate").type) == "int32"


@pytest.mark.parametrize("kind", sinks.FORMATS)
def test_dump(spark, tmp_path, kind):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "x long, y string")
    sinks.dump(rows, str(tmp_path / "log"), kind)
    back = spark.read.csv(str(tmp_path / "log"), header=True, schema="x long, y string") if kind == "csv" else getattr(spark.read, kind)(str(tmp_path / "log"))
    assert sorted(map(tuple, back.select("x", "y").collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        sinks.dump(rows, str(tmp_path / "log"), "xml")


def test_tape_reports(spark, tmp_path):
    kind = "symbol string, price_ticks long, shares long"
    ours = spark.createDataFrame([("A", 10, 5), ("A", 10, 5), ("B", 11, 1)], kind)
    theirs = spark.createDataFrame([("A", 10, 5), ("C", 12, 2), ("C", 12, 2)], kind)
    sinks.tape_reports(ours, theirs, ["symbol", "price_ticks", "shares"], str(tmp_path))
    read = lambda name, schema: sorted(map(tuple, spark.read.csv(f"{tmp_path}/{name}", header=True, schema=schema).collect()))
    assert read("missing", kind) == [("C", 12, 2)] * 2 and read("extra", kind) == [("A", 10, 5), ("B", 11, 1)]
    assert read("buckets", "symbol string, price_ticks long, ours long, theirs long") == [("A", 10, 10, 5), ("B", 11, 1, 0), ("C", 12, 0, 4)]


def test_user_grid(spark):
    points = discovery.grid(spark, {"a": "1,2", "b": "0..2:1"})
    out = api.grid(points, lambda p: {"a": p["a"], "b": p["b"], "ab": p["a"] * p["b"]}, "a double, b double, ab double")
    assert sorted(map(tuple, out.collect())) == sorted((a, b, a * b) for a in (1.0, 2.0) for b in (0.0, 1.0, 2.0))


def test_branches(spark):
    script = tables.flow(spark, 7, 300)
    same, less = script, script.filter("kind <> 'trade'")
    out = {r.branch: r for r in api.branch_report(script, 150, {1000: same, 2000: less}, api.Config(taker_fee_bps=5)).collect()}
    assert out[0].same and out[1000].same and not out[2000].same
    assert (out[1000].fills_change, out[1000].volume_ticks_change, out[1000].fees_cash_change) == (0, 0, 0) and out[2000].fills_change < 0
    assert out[0].fills_at_fork == api.at_step(script, 150, api.Config()).first().fills
    events = api.script_events(script.unionByName(api.fork(script, 150, less, 2000)), api.Config())
    d = api.divergence(events, 0, 2000).first()
    assert d.first_divergence >= 1 and d.compared >= d.first_divergence
    assert api.divergence(events, 0, 0).first().first_divergence is None


def test_divergence_of_lengths(spark):
    rows = [(run, i, "P", i, 0, "B", 100, 1, 0, 0, "", 0) for run, n in ((1, 5), (2, 3)) for i in range(n)]
    events = spark.createDataFrame(rows, "run long, seq long, type string, ts_ns long, ref long, side string, price_ticks long, qty long, fee_cash long, mid_ticks long, ledger string, submit_ns long")
    assert tuple(api.divergence(events, 1, 2).first()) == (3, 3)

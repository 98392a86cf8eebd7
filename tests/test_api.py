"""The façade, the command line, generated flow, the scheduler and reports."""

import json
import struct

from tapeloom import api
from tapeloom.__main__ import main
from tapeloom.sources import tables


def test_names():
    assert all(hasattr(api, n) for n in api.__all__)


def test_scheduler():
    s = api.Scheduler()
    a, b, c = s.push(5, "a"), s.push(3, "b"), s.push(5, "c")
    assert s.cancel(a) and not s.cancel(a) and len(s) == 2
    assert (s.peek(), s.pop(), s.pop(), s.pop()) == ((3, "b"), (3, "b"), (5, "c"), None)
    s.push(1, "x")
    s.clear()
    assert s.pop() is None


def test_flow_strategy_and_grid_repeat(spark):
    script = tables.flow(spark, 7, 400)
    one = [tuple(r) for r in api.script_events(script, api.Config()).orderBy("seq").collect()]
    two = [tuple(r) for r in api.script_events(script.repartition(7), api.Config()).orderBy("seq").collect()]
    assert one == two and any(r[2] == "F" for r in one)
    from tapeloom.operators import discovery

    grid = api.grid_summary(script, discovery.grid(spark, {"taker_fee_bps": "0,5"}), api.Config())
    fees = {r.taker_fee_bps: r.fees_cash for r in grid.collect()}
    assert fees[0.0] == 0 < fees[5.0]
    k = api.at_step(script, 200, api.Config()).first()
    assert k.script_rows == 200
    branch = api.script_summary(script.unionByName(api.fork(script, 200, script, 9)), api.Config()).collect()
    assert len({r.digest for r in branch}) == 1 and {r.run for r in branch} == {0, 9}
    assert api.render(api.Simulator()).startswith("bid None")


def test_strategy_runs(spark):
    class Quote(api.Strategy):
        def on_book(self, ts, bid, ask):
            if ask is not None and not getattr(self, "sent", False):
                self.sent = True
                self.runner.submit(api.Order(2**62 + 1, "B", 5, ask - 1))

    rows = [(run, i, i * 10, "add" if i == 0 else "hit", i + 1, "S" if i == 0 else "B", 10, 100 if i == 0 else 99) for run in (1, 2) for i in range(4)]
    out = api.strategy_runs(spark.createDataFrame(rows, "run long, seq long, ts_ns long, kind string, ref long, side string, qty long, price long"), lambda run: Quote(), api.Config()).collect()
    assert sorted((r.run, r.price_ticks, r.qty) for r in out) == [(1, 99, 5), (2, 99, 5)]


def test_command_line(spark, tmp_path, capsys):
    def said(*argv):
        code = main([str(a) for a in argv])
        text = capsys.readouterr().out.strip()
        return code, json.loads(text) if text else None

    assert said("selftest") == (0, {"selftest": "ok"})
    script = tmp_path / "s.csv"
    script.write_text("kind,ts_ns,side,price_ticks,qty,ref\next_add,100,B,99000,1000,1\next_add,110,S,101000,1000,2\nstrat_limit,150,B,100000,300,10\ntrade,200,S,100000,1200,3\nstrat_ioc,300,S,99000,500,11\n")
    code, out = said("simrun", script, "--maker-fee-bps", "-2", "--taker-fee-bps", "5")
    assert code == 0 and out["fees_cash"] == -6000 + 24750 and out["volume_ticks"] == 79_500_000
    events = tmp_path / "e.csv"
    events.write_text("type,ts_ns,ref,side,price_ticks,qty,fee_cash,mid_ticks,ledger,submit_ns\nF,1,2,B,100,5,-1,110,M,0\n")
    code, out = said("tearsheet", events)
    assert code == 0 and out["fills"] == 1 and out["equity_pnl_ticks"] == 50
    capture = tmp_path / "c.bin"
    add = b"A" + struct.pack(">HH", 1, 0) + (5).to_bytes(6, "big") + struct.pack(">Q", 7) + b"B" + struct.pack(">I", 10) + b"SPY     " + struct.pack(">I", 500)
    hit = b"E" + struct.pack(">HH", 1, 0) + (6).to_bytes(6, "big") + struct.pack(">QIQ", 7, 4, 99)
    capture.write_bytes(add + hit)
    code, out = said("replay", capture)
    assert code == 0 and (out["live_orders"], out["best_bid"], out["failed"]) == (1, 500, 0)
    code, out = said("trades", capture)
    assert code == 0 and out["prints"] == 1
    head = lambda t, ns: t + struct.pack(">HH", 1, 0) + ns.to_bytes(6, "big")
    priced = head(b"C", 7) + struct.pack(">QIQ", 7, 2, 100) + b"N" + struct.pack(">I", 505)
    replace = head(b"U", 8) + struct.pack(">QQII", 7, 8, 30, 490)
    again = head(b"E", 9) + struct.pack(">QIQ", 8, 5, 101)
    folder = tmp_path / "day"
    folder.mkdir()
    (folder / "b.bin").write_bytes(replace + again)  # the day's second file
    (folder / "a.bin").write_bytes(add + hit + priced)
    code, out = said("trades", folder, "--csv", tmp_path / "p.csv", "--stats-csv", tmp_path / "stats.csv")
    assert code == 0 and (out["prints"], out["unpriced"], out["prints_during_halts"]) == (3, 0, 0)
    text = "".join(p.read_text() for p in (tmp_path / "p.csv").glob("part*"))
    assert text.split() == ["99,1,6,500,4,Y,N", "100,1,7,505,2,N,Y", "101,1,9,490,5,Y,N"]
    assert "1,SPY,3,0,490,505,11," in "".join(p.read_text() for p in (tmp_path / "stats.csv").glob("part*"))
    official = tmp_path / "o.csv"
    official.write_text("match_number,locate,ts_ns,price_ticks,shares,printable,with_price\n99,1,6,500,4,Y,N\n100,1,7,505,2,N,Y\n101,1,9,490,5,Y,N\n")
    assert said("trades", folder, "--diff", official)[0] == 0
    official.write_text(official.read_text().replace("490", "491"))
    assert said("trades", folder, "--diff", official)[0] == 4
    code, out = said("replay", folder)
    assert (out["live_orders"], out["best_bid"], out["messages"]) == (1, 490, 5)
    capture.write_bytes(add + b"Z" * 20)
    assert said("replay", capture)[0] == 5
    script.write_text("nonsense\n")
    assert said("simrun", script)[0] == 3

"""Simulations as DataFrames: scripts, grids, portfolios, strategies and time travel, one group each."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import folds
from tapeloom.operators.book import Book
from tapeloom.operators.simulator import STRATEGY, Config, Order, Simulator, fee_of

EVENTS = "run long, seq long, type string, ts_ns long, ref long, side string, price_ticks long, qty long, fee_cash long, mid_ticks long, ledger string, submit_ns long"
SCRIPT_KINDS = ("ext_add", "trade", "strat_limit", "strat_ioc", "strat_cancel", "halt", "resume")


_EVENT = [c.split()[0] for c in EVENTS.split(", ")][1:]


def run_script(rows: Iterable[dict], config: Config) -> tuple[list[dict], dict, Simulator]:
    """Rows (kind, ts_ns, side, price_ticks, qty, ref, peg, offset, hidden) in order: event rows and a summary.
    A row first lets its time pass, then acts, then whatever is due is decided."""
    sim, total = Simulator(config), {}
    events = [dict(zip(_EVENT, e, strict=True)) for e in _script_steps(rows, sim, total, keep=True)]
    return events, total, sim


def _script_steps(rows: Iterable[dict], sim: Simulator, total: dict, keep: bool = False) -> Iterator[tuple]:
    """The event rows of a script as they come; ``total`` becomes the summary. Decisions and trades of rows that are done
    stay with the simulator only if it is to ``keep`` them."""
    config, count, was = sim.config, 0, 0
    total |= {"script_rows": 0, "fills": 0, "maker_fills": 0, "taker_fills": 0, "prints": 0, "volume_ticks": 0, "fees_cash": 0}

    def log(*fields) -> tuple:
        nonlocal count
        kind, ts, ref, side, price, qty, fee, ledger, submit = fields
        count += 1
        return count - 1, kind, ts, ref, side, price, qty, fee, sim.mid(), ledger, submit

    for r in rows:
        total["script_rows"] += 1
        ts, kind = r["ts_ns"], r["kind"]
        if ts > was:
            sim.advance(ts - was)
        was = ts
        if kind in ("halt", "resume"):
            sim.halted = kind == "halt"
            continue
        ref, side, price, qty = r["ref"], r["side"], r["price_ticks"], r["qty"]
        if kind == "ext_add":
            sim.seed_external(ref, side, qty, price)
        elif kind == "trade":
            sim.external("S" if side == "B" else "B", price, qty)
        elif kind == "strat_cancel":
            sim.cancel(ref + STRATEGY)
        else:
            peg = r.get("peg") or "none"
            order = Order(ref + STRATEGY, side, qty, price, "day_limit" if kind == "strat_limit" or peg != "none" else "ioc", peg, int(r.get("offset") or 0), bool(r.get("hidden")))
            sim.submit(order, ts)
        before = len(sim.decisions)
        sim.drain()
        for f in sim.fills:
            yield log("F", ts, f["ref"], f["side"], f["price_ticks"], f["qty"], f["fee"], "M", 0)
            total["maker_fills"] += 1
            total["volume_ticks"] += f["price_ticks"] * f["qty"]
            total["fees_cash"] += f["fee"]
        sim.fills = []
        for d in sim.decisions[before:]:
            if d["filled"]:
                fee = fee_of(d["notional"], config.taker_fee_bps)
                yield log("F", ts, d["ref"], d["side"], (d["notional"] + d["filled"] // 2) // d["filled"], d["filled"], fee, "T", d["decision_ts"])
                total["taker_fills"] += 1
                total["volume_ticks"] += d["notional"]
                total["fees_cash"] += fee
        if kind == "trade" and not sim.halted:
            total["prints"] += 1
            yield log("P", ts, 0, side, price, qty, 0, "", 0)
        if not keep:
            sim.decisions.clear()
            sim.trades.clear()
    total["fills"] = total["maker_fills"] + total["taker_fills"]
    total["digest"] = sim.digest()[:8].hex()


SUMMARY = "run long, script_rows long, fills long, maker_fills long, taker_fills long, prints long, volume_ticks long, fees_cash long, digest string"


def _head(rows: Iterator[dict]) -> tuple[dict, Iterator[dict]]:
    first = next(rows)
    return first, chain([first], rows)


def _summary(rows: Iterator[dict], config: Config) -> tuple:
    total = {}
    for _ in _script_steps(rows, Simulator(config), total):
        pass
    return tuple(total[c.split()[0]] for c in SUMMARY.split(", ")[1:])


def script_events(scripts: DataFrame, config: Config) -> DataFrame:
    """scripts(run, line_no, kind, ...): the event log of every run."""

    def go(rows: Iterator[dict]) -> Iterator[tuple]:
        first, rows = _head(rows)
        return ((first["run"], *e) for e in _script_steps(rows, Simulator(config), {}))

    return folds.ordered(scripts, ["run"], "line_no", go, EVENTS)


def script_summary(scripts: DataFrame, config: Config) -> DataFrame:
    def go(rows: Iterator[dict]) -> Iterator[tuple]:
        first, rows = _head(rows)
        yield first["run"], *_summary(rows, config)

    return folds.ordered(scripts, ["run"], "line_no", go, SUMMARY)


def grid_summary(scripts: DataFrame, points: DataFrame, config: Config) -> DataFrame:
    """Every script under every grid point (columns named like Config's fields): one task each, so a grid scales
    with the cluster. points are few and broadcast."""
    axes = points.columns
    both = scripts.crossJoin(F.broadcast(points.withColumn("task_id", F.monotonically_increasing_id())))

    def go(rows: Iterator[dict]) -> Iterator[tuple]:
        first, rows = _head(rows)
        own = replace(config, **{k: type(getattr(config, k))(first[k]) for k in axes})
        yield first["run"], *(float(first[k]) for k in axes), *_summary(rows, own)

    head, tail = SUMMARY.split(", ", 1)
    return folds.ordered(both, ["run", "task_id"], "line_no", go, ", ".join([head, *(f"`{a}` double" for a in axes), tail]))


def grid(points: DataFrame, task: Callable[[dict], dict], schema: str) -> DataFrame:
    """A user's task of every grid point: a row of ``points`` in, a row of ``schema`` out; a point is a task of its own."""
    n = max(1, points.count())

    def go(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in frames:
            rows = [task(r) for r in pdf.to_dict("records")]
            if rows:
                yield pd.DataFrame(rows)[[c.split()[0].strip("`") for c in schema.split(", ")]]

    return points.repartition(n).mapInPandas(go, schema)


def portfolio(summary: DataFrame) -> DataFrame:
    """Totals over all instruments, and a digest over theirs in order of run."""
    joined = F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("run", "digest"))), lambda x: x["digest"])), 256)
    return summary.agg(F.count("*").alias("instruments"), F.sum("fills").alias("fills"), F.sum("volume_ticks").alias("volume_ticks"), F.sum("fees_cash").alias("fees_cash"), joined.alias("digest"))


def divergence(events: DataFrame, run: int, other: int) -> DataFrame:
    """Where two runs of script_events part: the first seq whose rows differ, and how many both have."""
    from tapeloom.operators.tape import first_divergence

    fields = ["type", "ts_ns", "ref", "side", "price_ticks", "qty", "fee_cash", "mid_ticks", "ledger"]
    one, two = (events.filter(F.col("run") == r).select(F.col("seq").alias("idx"), *fields) for r in (run, other))
    return first_divergence(one, two, ["idx"])


def branch_report(scripts: DataFrame, k: int, others: dict[int, DataFrame], config: Config) -> DataFrame:
    """Every run with its branches: the state at step k (at_fork), and how fills, volume and fees of each branch differ from
    its run's. ``others`` has the rows that follow the fork by branch number, which is added to the run."""
    forked = scripts.withColumn("branch", F.lit(0)).withColumn("origin", F.col("run"))
    for branch, rows in others.items():
        one = fork(scripts, k, rows, branch)
        forked = forked.unionByName(one.withColumn("branch", F.lit(branch)).withColumn("origin", F.col("run") - branch))
    names = forked.select("run", "branch", "origin").distinct()
    done = script_summary(forked.drop("branch", "origin"), config).join(names, "run")
    base = done.filter("branch = 0").select(F.col("origin"), *(F.col(c).alias(f"_{c}") for c in ("fills", "volume_ticks", "fees_cash", "digest")))
    start = at_step(scripts, k, config).select(F.col("run").alias("origin"), F.col("fills").alias("fills_at_fork"))
    j = done.join(base, "origin").join(start, "origin", "left")
    return j.select("origin", "branch", "fills", F.coalesce("fills_at_fork", F.lit(0)).alias("fills_at_fork"), *((F.col(c) - F.col(f"_{c}")).alias(f"{c}_change") for c in ("fills", "volume_ticks", "fees_cash")), (F.col("digest") == F.col("_digest")).alias("same"))


def at_step(scripts: DataFrame, k: int, config: Config) -> DataFrame:
    """Time travel: the state after the first k rows of every script, by folding them again."""
    return script_summary(scripts.filter(F.col("line_no") < k), config)


def fork(scripts: DataFrame, k: int, other: DataFrame, branch: int) -> DataFrame:
    """A branch: the first k rows of a script, then ``other``'s rows, as a run of its own (run + branch)."""
    head = scripts.filter(F.col("line_no") < k)
    return head.unionByName(other.filter(F.col("line_no") >= k)).withColumn("run", F.col("run") + branch)


def book_fold(messages: DataFrame, key: str = "locate", low: int | None = None, high: int | None = None) -> DataFrame:
    """Every message with its error and the touch after it: replace chains, reused references and all. ``key``
    is the instrument; a constant key is one book of all instruments."""
    schema = f"{key} long, seq long, error string, best_bid long, best_ask long, live long"

    def go(rows: Iterator[dict]) -> Iterator[tuple]:
        book = Book(low, high)
        for m in rows:
            error = book.apply(m)
            yield m[key], m["seq"], error, book.best("B"), book.best("S"), len(book.orders)

    return folds.ordered(messages, [key], "seq", go, schema)


class Strategy:
    """What a user overrides; called in causal order."""

    def on_book(self, ts: int, bid: int | None, ask: int | None) -> None: ...

    def on_trade(self, trade: dict) -> None: ...

    def on_fill(self, fill: dict) -> None: ...

    def on_ack(self, decision: dict) -> None: ...


class Runner:
    """A simulator with a strategy: after every step, the book first if its touch changed, then trades, fills and
    decisions merged by seq."""

    def __init__(self, config: Config, strategy: Strategy):
        self.sim, self.strategy, self._seen, self._top = Simulator(config), strategy, [0, 0, 0], None

    def submit(self, order: Order, arrival: int | None = None) -> int:
        return self.sim.submit(order, self.sim.now if arrival is None else arrival)

    def advance(self, ns: int) -> None:
        self.sim.advance(ns)
        self.sim.run_until(self.sim.external_now)
        self._tell()

    def external(self, side: str, price: int, qty: int) -> None:
        self.sim.external(side, price, qty)
        self._tell()

    def _tell(self) -> None:
        s, top = self.sim, (self.sim.book.best("B"), self.sim.book.best("S"))
        top = tuple((p, s.book.qty_at(side, p) if p is not None else 0) for side, p in zip("BS", top, strict=True))
        if top != self._top:
            self._top = top
            self.strategy.on_book(s.now, top[0][0], top[1][0])
        streams = ((s.trades, self.strategy.on_trade), (s.fills, self.strategy.on_fill), (s.decisions, self.strategy.on_ack))
        news = [(row["seq"], k, row) for k, (rows, _) in enumerate(streams) for row in rows[self._seen[k] :]]
        self._seen = [len(rows) for rows, _ in streams]
        for _, k, row in sorted(news, key=lambda x: x[:2]):
            streams[k][1](row)

    def told(self) -> list[dict]:
        """The fills the strategy was told of since the last call; trades, fills and decisions it knows are dropped."""
        s, fills = self.sim, self.sim.fills[: self._seen[1]]
        for rows, seen in zip((s.trades, s.fills, s.decisions), self._seen, strict=True):
            del rows[:seen]
        self._seen = [0, 0, 0]
        return fills


def strategy_runs(flow: DataFrame, make: Callable[[int], Strategy], config: Config) -> DataFrame:
    """flow(run, seq, ts_ns, side, price, qty): external flow per run through the user's strategy; its fills."""
    schema = "run long, visible_ts long, ref long, price_ticks long, qty long, seq long, side string, fee long"
    fields = [c.split()[0] for c in schema.split(", ")][1:]

    def go(rows: Iterator[dict]) -> Iterator[tuple]:
        first, rows = _head(rows)
        run = int(first["run"])
        strategy = make(run)
        runner = Runner(config, strategy)
        strategy.runner = runner
        was = 0
        for m in rows:
            runner.advance(max(0, m["ts_ns"] - was))
            was = m["ts_ns"]
            if m["kind"] == "add":
                runner.sim.seed_external(m["ref"], m["side"], m["qty"], m["price"])
                runner._tell()
            else:
                runner.external(m["side"], m["price"], m["qty"])
            yield from ((run, *(f[k] for k in fields)) for f in runner.told())
        yield from ((run, *(f[k] for k in fields)) for f in runner.sim.fills)

    return folds.ordered(flow, ["run"], "seq", go, schema)


def trace_digest(parts: Iterable[bytes]) -> str:
    return hashlib.sha256(b"".join(parts)).hexdigest()

"""python -m tapeloom VERB: info, selftest, replay, trades, simrun, tearsheet, dump."""

from __future__ import annotations

import argparse
import json
import sys

#: Exit codes.
OK, USAGE, BAD_INPUT, DIFFERS, PARSE, GAP, EMPTY = 0, 2, 3, 4, 5, 6, 7


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tapeloom").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


TYPES = ("A", "F", "E", "C", "X", "D", "U", "S", "H", "I", "Y")


def _messages(spark, args):
    from tapeloom.sources import capture, wire

    return wire.decode(capture.read_frames(spark, args.capture, args.framing), TYPES, strict=False)


def replay(args) -> int:
    from tapeloom.operators import orders

    spark = _spark()
    effect = orders.effects(_messages(spark, args))
    out = orders.summary(effect, orders.resting(effect)).first().asDict()
    out["skipped_by_type"] = {r.type: r["count"] for r in effect.filter("status = 'none'").groupBy("type").count().collect()}
    print(json.dumps(out, sort_keys=True))
    return OK


def trades(args) -> int:
    from tapeloom.functions.scalars import prints_csv
    from tapeloom.operators import orders, session, tape
    from tapeloom.sources import tables

    spark = _spark()
    messages = _messages(spark, args)
    effect = orders.effects(messages)
    prints = orders.prints(effect)
    if args.csv:
        prints.orderBy("seq").select(prints_csv().alias("value")).coalesce(1).write.mode("overwrite").text(args.csv)
    if args.stats_csv:
        stats = orders.with_symbol(orders.locate_stats(effect), orders.symbols(messages))
        names = ["locate", "symbol", "prints", "unpriced", "min_tick", "max_tick", "shares", "vwap_micro"]
        stats.select(names).orderBy("locate").coalesce(1).write.mode("overwrite").csv(args.stats_csv, header=True)
    windows = session.halt_windows(messages.filter("type = 'H'").select("seq", "ts_ns", "locate", "state"))
    out = orders.print_counters(effect).first().asDict() | {"prints_during_halts": session.halted(prints, windows).count()}
    if args.diff:
        out |= tape.diff_report(prints, tables.read_prints(spark, args.diff)).first().asDict()
    print(json.dumps(out, sort_keys=True))
    return DIFFERS if args.diff and (out["price_mismatch"] or out["shares_mismatch"] or out["only_ours"] or out["only_theirs"]) else OK


def simrun(args) -> int:
    from tapeloom.functions.scalars import events_csv
    from tapeloom.operators import runs
    from tapeloom.operators.simulator import Config
    from tapeloom.sources import tables

    spark = _spark()
    script = tables.read_script(spark, args.script)
    config = Config(maker_fee_bps=args.maker_fee_bps, taker_fee_bps=args.taker_fee_bps, wire_ns=args.wire_ns, seed=args.seed)
    if args.events_csv:
        runs.script_events(script, config).orderBy("seq").select(events_csv().alias("value")).coalesce(1).write.mode("overwrite").text(args.events_csv)
    print(json.dumps(runs.script_summary(script, config).drop("run").first().asDict(), sort_keys=True))
    return OK


def tearsheet(args) -> int:
    from tapeloom.operators import tearsheet as t
    from tapeloom.sources import tables

    log = tables.read_events(_spark(), args.events)
    out = t.scalars(log).drop("run").first().asDict() | t.drawdown(t.equity(log)).drop("run").first().asDict()
    out["markouts"] = [r.asDict() for r in t.markouts(log).drop("run").orderBy("horizon_ns").collect()]
    print(json.dumps(out, sort_keys=True))
    return OK


def dump(args) -> int:
    from tapeloom.sources import sinks, tables

    rows = tables.read_events(_spark(), args.events).drop("run")
    sinks.dump(rows, args.out, args.format)
    print(json.dumps({"rows": rows.count()}))
    return OK


def info(_) -> int:
    import pyspark

    print(json.dumps({"engine": "tapeloom", "spark": pyspark.__version__, "python": sys.version.split()[0]}))
    return OK


def selftest(_) -> int:
    from tapeloom.sources.tables import corpus
    from tapeloom.sources.wire import trace_hash

    good = trace_hash(corpus(42, 96)) == 0x308E35B105CFE9D0
    print(json.dumps({"selftest": "ok" if good else "failed"}))
    return OK if good else DIFFERS


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("tapeloom")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name, f in (("info", info), ("selftest", selftest)):
        verbs.add_parser(name).set_defaults(f=f)
    for name, f in (("replay", replay), ("trades", trades)):
        p = verbs.add_parser(name)
        p.add_argument("capture")
        p.add_argument("--framing", default="session", choices=("raw", "session", "lenprefix", "mold", "pcap"))
        if name == "trades":
            p.add_argument("--csv")
            p.add_argument("--diff")
            p.add_argument("--stats-csv")
        p.set_defaults(f=f)
    p = verbs.add_parser("simrun")
    p.add_argument("script")
    p.add_argument("--events-csv")
    for flag in ("--maker-fee-bps", "--taker-fee-bps", "--wire-ns"):
        p.add_argument(flag, type=int, default=0)
    p.add_argument("--seed", type=int, default=1)
    p.set_defaults(f=simrun)
    p = verbs.add_parser("tearsheet")
    p.add_argument("events")
    p.set_defaults(f=tearsheet)
    p = verbs.add_parser("dump")
    p.add_argument("events")
    p.add_argument("out")
    p.add_argument("--format", default="csv", choices=("csv", "json", "parquet"))
    p.set_defaults(f=dump)
    args = parser.parse_args(argv)
    try:
        return args.f(args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return BAD_INPUT
    except Exception as e:  # what a task raised arrives as Spark's error with its text
        text = str(e)
        print(text.splitlines()[0] if text else repr(e), file=sys.stderr)
        for word, code in (("sequence_gap", GAP), ("sequence_regression", GAP), ("empty at", EMPTY), ("FramingError", PARSE), ("decode:", PARSE)):
            if word in text:
                return code
        return BAD_INPUT


if __name__ == "__main__":
    sys.exit(main())

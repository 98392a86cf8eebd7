"""What a user imports: sources, the book, prints, sessions, tapes, simulation, analytics, streams."""

from tapeloom.functions import scalars
from tapeloom.functions.digest import FastDigest, fnv
from tapeloom.operators import asof, discovery, orders, session, tape, tearsheet
from tapeloom.operators.book import Book
from tapeloom.operators.report import render
from tapeloom.operators.runs import Runner, Strategy, at_step, book_fold, branch_report, divergence, fork, grid, grid_summary, portfolio, run_script, script_events, script_summary, strategy_runs
from tapeloom.operators.schedule import Scheduler
from tapeloom.operators.simulator import Config, Order, Simulator
from tapeloom.sources import columnlog, ouch, sinks, tables, wire
from tapeloom.sources.capture import continuity, frames, packets_of, read_frames, read_packets, skipped
from tapeloom.streaming.book import bars, book_stream

__all__ = [
    "Book", "Config", "FastDigest", "Order", "Runner", "Scheduler", "Simulator", "Strategy", "asof", "at_step", "bars", "book_fold", "book_stream", "branch_report", "columnlog", "continuity", "discovery", "divergence",
    "fnv", "fork", "frames", "grid", "grid_summary", "orders", "ouch", "packets_of", "portfolio", "read_frames", "read_packets", "render", "run_script", "scalars", "script_events", "script_summary", "session",
    "sinks", "skipped", "strategy_runs", "tables", "tape", "tearsheet", "wire",
]

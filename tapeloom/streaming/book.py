"""The order fold as a stream: one book per instrument, kept as state, with the results of the batch fold.

There is no lateness to tolerate: messages of an instrument carry consecutive numbers, and a gap is an
error (or a row that says so, with on_gap='quarantine')."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.operators.book import Book

OUT = "locate long, seq long, error string, best_bid long, best_ask long, live long"


class BookProcessor(StatefulProcessor):
    def __init__(self, low: int | None = None, high: int | None = None, on_gap: str = "ignore"):
        self.low, self.high, self.on_gap = low, high, on_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("book", "raw binary, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        book, last = (pickle.loads(self.state.get()[0]), self.state.get()[1]) if self.state.exists() else (Book(self.low, self.high), None)
        out, whole = [], pd.concat(list(rows))
        for m in whole.sort_values("seq").to_dict("records"):
            if self.on_gap != "ignore" and last is not None and m["seq"] != last + 1:
                if self.on_gap == "fail":
                    raise ValueError(f"gap: {last} is followed by {m['seq']}")
                out.append((m["locate"], m["seq"], "sequence_gap", None, None, len(book.orders)))
            last = m["seq"]
            error = book.apply(m)
            out.append((m["locate"], m["seq"], error, book.best("B"), book.best("S"), len(book.orders)))
        book.deltas = []
        self.state.update((pickle.dumps(book), last))
        done = pd.DataFrame(out, columns=["locate", "seq", "error", "best_bid", "best_ask", "live"])
        yield done.astype({"best_bid": "Int64", "best_ask": "Int64"})

    def close(self) -> None:
        pass


def book_stream(messages: DataFrame, **options) -> DataFrame:
    """A streaming DataFrame of messages -> every message with its error and the touch after it."""
    return messages.groupBy("locate").transformWithStateInPandas(BookProcessor(**options), OUT, "Append", "None")


def bars(prints: DataFrame, length: str, lateness: str) -> DataFrame:
    """Volume and price range of prints (ts, locate, price_ticks, shares) in windows of event time."""
    return (
        prints.withWatermark("ts", lateness)
        .groupBy(F.window("ts", length), "locate")
        .agg(F.count("*").alias("prints"), F.sum("shares").alias("volume"), F.min("price_ticks").alias("low"), F.max("price_ticks").alias("high"))
        .select("window.start", "locate", "prints", "volume", "low", "high")
    )

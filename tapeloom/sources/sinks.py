"""What leaves the engine: records as Arrow, logs and reports as files of any format that Spark writes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Columns of the records that are handed out.
RECORDS = {
    "prints": ("match_number", "locate", "ts_ns", "price_ticks", "shares", "printable", "with_price"),
    "fills": ("visible_ts", "ref", "price_ticks", "qty", "seq", "fee", "side"),
    "decisions": ("kind", "filled_qty", "cancelled_qty", "filled_notional", "visible_ts", "ref", "side", "seq", "fee"),
}
FORMATS = ("csv", "json", "parquet")


def record_batches(rows: DataFrame, record: str) -> Iterator[pa.RecordBatch]:
    """The rows as Arrow batches with a record's columns, a partition at a time: the driver never holds all."""
    names = RECORDS[record]
    out = rows.select(*(c for c in names if c in rows.columns))
    kinds = out.limit(0).toArrow().schema
    for row_group in _chunks(out.toLocalIterator(), 8192):
        yield pa.RecordBatch.from_pylist([r.asDict() for r in row_group], schema=kinds)


def _chunks(rows, size: int):
    group: list = []
    for r in rows:
        group.append(r)
        if len(group) == size:
            yield group
            group = []
    if group:
        yield group


def dump(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A log as files, one a partition."""
    if kind not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    writer = rows.write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else getattr(writer, kind)(path)


def tape_reports(ours: DataFrame, theirs: DataFrame, keys: list[str], path: str) -> None:
    """What the tape has and we don't, what we have and it doesn't, and volumes by key, under ``path``."""
    from pyspark.sql import functions as F

    dump(theirs.select(keys).exceptAll(ours.select(keys)), f"{path}/missing")
    dump(ours.select(keys).exceptAll(theirs.select(keys)), f"{path}/extra")
    by = [k for k in keys if k != "shares"]
    a, b = (x.groupBy(*by).agg(F.sum("shares").alias(n)) for x, n in ((ours, "ours"), (theirs, "theirs")))
    dump(a.join(b, by, "full_outer").na.fill(0, ["ours", "theirs"]), f"{path}/buckets")

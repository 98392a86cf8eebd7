"""Ordered Python folds per group, whose rows stream: what is kept is the fold's own state, never a group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that are Python objects at a time, on the way in and on the way out.
PIECE = 1 << 12


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            yield from batch.slice(at, PIECE).to_pylist()


def ordered(rows: DataFrame, keys: list[str], at: str, fold: Callable[[Iterator[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fold`` of every group: the group's rows in order of ``at`` (nulls last), one after another, to tuples of
    ``schema``. Groups are dealt by ranges of their keys, so a few large ones lie in as many tasks as there can be."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = (row for _, group in groupby(_records(batches), itemgetter(*keys)) for row in fold(group))
        while part := list(islice(out, PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), arrow.types, strict=True)], names=arrow.names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, F.col(at).asc_nulls_last()).mapInArrow(go, schema)

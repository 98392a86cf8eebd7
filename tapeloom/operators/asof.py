"""As-of and interval joins without an inequality join: both sides are put in one order and carried along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: A bucket that holds about PIECE right rows is chosen from their number and span.
AUTO, PIECE = -1, 1 << 20


def _bucket(right: DataFrame, at: str) -> int | None:
    """Both figures come from one pass over the right side; few rows need no pieces."""
    lo, hi, n = right.agg(F.min(at), F.max(at), F.count(at)).first()
    return None if n <= PIECE else max(1, (hi - lo) * PIECE // n)


def forward(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], bucket: int | None = AUTO) -> DataFrame:
    """Each left row with the first right row of the same keys at or after it; values are null where none
    comes. One sort, no pairs. With ``bucket`` (a length of time) keys with long histories are cut into
    pieces of that length: a piece takes what follows it from the next piece that has a right row, so no
    task holds a whole history; by default the length follows from the density of the right rows, None is one piece."""
    bucket = _bucket(right, right_at) if bucket == AUTO else bucket
    payload = F.struct(*(F.col(v) for v in values))
    l = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType).alias("_value"))
    r = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), payload.alias("_value"))
    # seen backwards in time, a right row comes before the left rows at its own time
    both = l.union(r)
    if bucket is None:
        w = W.partitionBy(*keys).orderBy(F.desc("_at"), "_side").rowsBetween(W.unboundedPreceding, 0)
        got = both.withColumn("_value", F.last("_value", True).over(w))
    else:
        both = both.withColumn("_piece", F.floor(F.col("_at") / bucket))
        w = W.partitionBy(*keys, "_piece").orderBy(F.desc("_at"), "_side").rowsBetween(W.unboundedPreceding, 0)
        firsts = both.filter("_side = 0").groupBy(*keys, "_piece").agg(F.min_by("_value", "_at").alias("_first"))
        ahead = both.select(*keys, "_piece").distinct().join(firsts, [*keys, "_piece"], "left")
        over = W.partitionBy(*keys).orderBy(F.desc("_piece")).rowsBetween(W.unboundedPreceding, -1)
        ahead = ahead.select(*keys, "_piece", F.last("_first", True).over(over).alias("_next"))
        got = both.withColumn("_value", F.last("_value", True).over(w)).join(ahead, [*keys, "_piece"]).withColumn("_value", F.coalesce("_value", "_next"))
    return got.filter("_side = 1").select("_row.*", *(F.col(f"_value.{v}").alias(v) for v in values))


def inside(points: DataFrame, windows: DataFrame, keys: list[str], at: Column, start: Column, end: Column) -> DataFrame:
    """Points that lie in a window of the same keys: start <= at, and before end where there is one."""
    return points.join(windows, (at >= start) & (end.isNull() | (at < end)) & _same(points, windows, keys), "left_semi")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = a[keys[0]] == b[keys[0]]
    for k in keys[1:]:
        out &= a[k] == b[k]
    return out

"""Exact order statistics without a sort of all rows in one place, and running sums that split a long history.

Values are counted per key; a sketch of the distinct values cuts them into blocks of about equal size, sums of blocks
tell in which block a rank lies, and only those blocks are put in order. A running sum is made in blocks of the
order column, and each block starts at the sum of all before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blocks of the distinct values of a key, about; length of a block of the order column.
BLOCKS, LENGTH = 64, 1 << 20


def at_ranks(rows: DataFrame, keys: list[str], value: Column, ranks: dict[str, Column]) -> DataFrame:
    """Per key a column for each of ``ranks``: the value that stands there when a key's values (nulls left out) are
    sorted, from 0; and n, the number of values, over which a rank is an expression. Beyond the last value it is null."""
    counts = rows.filter(value.isNotNull()).groupBy(*keys, value.alias("_v")).agg(F.count("*").alias("_n"))
    steps = ", ".join(f"{k / BLOCKS}D" for k in range(1, BLOCKS))
    whole = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.expr(f"percentile_approx(_v, array({steps}), 1000)").alias("_cuts"))
    placed = counts.join(whole.select(*keys, F.array_distinct("_cuts").alias("_cuts")), keys)
    placed = placed.withColumn("_block", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    upto = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, 0)  # BLOCKS rows a key at most
    blocks = placed.groupBy(*keys, "_block").agg(F.sum("_n").alias("_in")).withColumn("_before", F.sum("_in").over(upto) - F.col("_in"))
    wanted = whole.select(*keys, "n", F.explode(F.array(*(F.struct(F.lit(k).alias("_name"), r.cast("long").alias("_rank")) for k, r in ranks.items()))).alias("_w")).select(*keys, "n", "_w.*")
    found = blocks.join(wanted, keys).filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_in")))
    found = found.groupBy(*keys, "_block", "_before", "n").agg(F.collect_list(F.struct("_name", "_rank")).alias("_wanted"))  # as many as there are ranks
    within = W.partitionBy(*keys, "_block").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    some = placed.join(found, [*keys, "_block"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(within))
    hit = some.select(*keys, "n", "_v", "_upto", "_n", F.explode("_wanted").alias("_w")).filter((F.col("_upto") > F.col("_w._rank")) & (F.col("_upto") - F.col("_n") <= F.col("_w._rank")))
    return hit.groupBy(*keys, "n").agg(*(F.max(F.when(F.col("_w._name") == k, F.col("_v"))).alias(k) for k in ranks))


def quantiles(rows: DataFrame, keys: list[str], value: Column, points: dict[str, float]) -> DataFrame:
    """Per key a column for each point: the quantile, interpolated between its neighbours."""
    place = {k: F.lit(float(p)) * (F.col("n") - 1) for k, p in points.items()}
    sides = {f"_{s}_{k}": f(x) for k, x in place.items() for s, f in (("lo", F.floor), ("hi", F.ceil))}
    between = lambda k: F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * (place[k] - F.floor(place[k]))
    return at_ranks(rows, keys, value.cast("double"), sides).select(*keys, *(between(k).alias(k) for k in points))


def carried(rows: DataFrame, keys: list[str], at: str, sums: dict[str, Column], length: int | None = None) -> DataFrame:
    """Rows with the running sums of ``sums`` per key in the order of the whole number ``at``, which is unique in a key;
    also _block, the part of the history that a row lies in."""
    rows = rows.withColumn("_block", F.floor(F.col(at) / F.lit(length or LENGTH)).cast("long"))
    totals = rows.groupBy(*keys, "_block").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    ahead = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    start = totals.select(*keys, "_block", *(F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"_from_{k}") for k in sums))
    within = W.partitionBy(*keys, "_block").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    out = rows.select("*", *(F.sum(c).over(within).alias(f"_own_{k}") for k, c in sums.items())).join(start, [*keys, "_block"])
    return out.withColumns({k: F.col(f"_from_{k}") + F.col(f"_own_{k}") for k in sums}).drop(*(f"_{w}_{k}" for k in sums for w in ("from", "own")))


def peaks(rows: DataFrame, keys: list[str], at: str, value: str, name: str, least: int) -> DataFrame:
    """Rows of ``carried`` with the largest ``value`` so far, ``least`` or more."""
    ahead = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    tops = rows.groupBy(*keys, "_block").agg(F.max(value).alias("_top"))
    start = tops.select(*keys, "_block", F.max("_top").over(ahead).alias("_from"))
    within = W.partitionBy(*keys, "_block").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("_own", F.max(value).over(within)).join(start, [*keys, "_block"])
    return out.withColumn(name, F.greatest(F.lit(least), F.col("_own"), F.col("_from"))).drop("_own", "_from")

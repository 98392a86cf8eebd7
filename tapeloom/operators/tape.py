"""Comparing prints with an official tape: keyed, as bags, and per order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import ranks


def diff_report(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Both (match_number, price_ticks, shares): what matches, what differs, and the smallest number that differs.
    Of repeated numbers the last row in ``theirs`` (by line_no, if there is one) counts."""
    if "line_no" in theirs.columns:
        theirs = theirs.groupBy("match_number").agg(F.max_by(F.struct("price_ticks", "shares"), "line_no").alias("v")).select("match_number", "v.*")
    a = ours.select("match_number", F.col("price_ticks").alias("pa"), F.col("shares").alias("sa"))
    b = theirs.select("match_number", F.col("price_ticks").alias("pb"), F.col("shares").alias("sb"))
    both = a.join(b, "match_number", "full_outer")
    common = F.col("pa").isNotNull() & F.col("pb").isNotNull()
    price, shares = common & (F.col("pa") != F.col("pb")), common & (F.col("sa") != F.col("sb"))
    return both.agg(
        F.count_if(common).alias("matched"),
        F.count_if(F.col("pb").isNull()).alias("only_ours"),
        F.count_if(F.col("pa").isNull()).alias("only_theirs"),
        F.count_if(price).alias("price_mismatch"),
        F.count_if(shares).alias("shares_mismatch"),
        F.min(F.when(price | shares, F.col("match_number"))).alias("first_divergence"),
    )


def bag(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Per distinct row how often it stands on either side."""
    a = ours.groupBy(*keys).agg(F.count("*").alias("n_ours"))
    b = theirs.groupBy(*keys).agg(F.count("*").alias("n_theirs"))
    return a.join(b, keys, "full_outer").na.fill(0, ["n_ours", "n_theirs"])


def bag_match(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    n, m = F.col("n_ours"), F.col("n_theirs")
    return bag(ours, theirs, keys).agg(F.sum(F.least(n, m)).alias("matched"), F.sum(F.greatest(n - m, F.lit(0))).alias("extra"), F.sum(F.greatest(m - n, F.lit(0))).alias("missing"))


def apply_corrections(reports: DataFrame, cancels: DataFrame, corrections: DataFrame) -> DataFrame:
    """Reports (center, control, seq, price_ticks, shares) without those cancelled later, at their last correction."""
    gone = cancels.select("center", "control", F.col("seq").alias("_c"))
    kept = reports.join(gone, (reports.center == gone.center) & (reports.control == gone.control) & (gone._c > reports.seq), "left_anti")
    new = corrections.groupBy("center", "control").agg(F.max_by(F.struct("price_ticks", "shares"), "seq").alias("new"))
    return kept.join(new, ["center", "control"], "left").select("center", "control", "seq", F.coalesce("new.price_ticks", "price_ticks").alias("price_ticks"), F.coalesce("new.shares", "shares").alias("shares"), F.col("new").isNotNull().alias("corrected"))


def by_order(fills: DataFrame) -> DataFrame:
    """Quantity and volume-weighted price of each order."""
    return fills.groupBy("ref", "side").agg(F.sum("qty").alias("qty"), (F.sum(F.col("price_ticks") * F.col("qty")) / F.sum("qty")).alias("vwap"))


def agreement(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Orders on either side; of common ones, exact quantities, prices within a tick, and the price gap's mean,
    median, 95th percentile (by index) and largest."""
    a = by_order(ours).select("ref", "side", F.col("qty").alias("qa"), F.col("vwap").alias("va"))
    b = by_order(theirs).select("ref", "side", F.col("qty").alias("qb"), F.col("vwap").alias("vb"))
    both = a.join(b, ["ref", "side"], "full_outer")
    common = F.col("qa").isNotNull() & F.col("qb").isNotNull()
    gap = F.when(common, F.round(F.abs(F.col("va") - F.col("vb")), 6))
    stats = both.agg(
        F.count_if(common).alias("common"),
        F.count_if(F.col("qb").isNull()).alias("only_ours"),
        F.count_if(F.col("qa").isNull()).alias("only_theirs"),
        F.count_if(common & (F.col("qa") == F.col("qb")) & (gap <= 1)).alias("exact"),
        F.round(F.avg(gap), 4).alias("mean_gap"),
        F.max(gap).alias("max_gap"),
        F.lit(0).alias("_k"),
    )
    middle = (F.col("n") - 1) / 2
    at = ranks.at_ranks(both.withColumn("_k", F.lit(0)), ["_k"], gap, {"lo": F.floor(middle), "hi": F.ceil(middle), "p95_gap": F.floor(F.col("n") * 0.95)})
    got = stats.join(F.broadcast(at.drop("n")), "_k", "left")  # one row each
    return got.withColumn("median_gap", F.round((F.col("lo") + F.col("hi")) / 2, 4)).drop("_k", "lo", "hi")


def containment(symbols: DataFrame, bars: DataFrame, tolerance: float) -> DataFrame:
    """Symbols' price ranges inside daily bars, strictly and with a tolerance. symbols(symbol, low, high), bars(symbol, bar_low, bar_high)."""
    j = symbols.join(bars, "symbol")
    strict = (F.col("low") >= F.col("bar_low")) & (F.col("high") <= F.col("bar_high"))
    loose = (F.col("low") >= F.col("bar_low") * (1 - tolerance)) & (F.col("high") <= F.col("bar_high") * (1 + tolerance))
    return j.select("symbol", strict.alias("strict"), loose.alias("within"))


def first_divergence(a: DataFrame, b: DataFrame, order: list[str]) -> DataFrame:
    """Position of the first row at which two streams (idx, fields...) differ; where one ends first, its length."""
    fields = [c for c in a.columns if c != "idx"]
    both = a.select("idx", F.struct(*fields).alias("a")).join(b.select("idx", F.struct(*fields).alias("b")), "idx", "full_outer")
    return both.agg(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("idx"))).alias("first_divergence"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("compared"))

"""Text inputs with fixed headers: prints, scripts, event logs, official tapes; and a message generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.scalars import flag
from tapeloom.operators.runs import SCRIPT_KINDS

#: Headers.
PRINTS_HEADER = "match_number,locate,ts_ns,price_ticks,shares,printable,with_price"
SCRIPT_HEADERS = ("kind,ts_ns,side,price_ticks,qty,ref", "kind,ts_ns,side,price_ticks,qty,ref,flags")
EVENTS_HEADER = "type,ts_ns,ref,side,price_ticks,qty,fee_cash,mid_ticks"


def _lines(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """Header, and the other lines that aren't empty, numbered in their order. One file is one table; it is read in
    splits, so a large one is many tasks."""
    text = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")).filter("line <> ''")
    first = text.orderBy("line_no").limit(1).collect()
    return (first[0].line if first else ""), text.filter(F.col("line_no") > (first[0].line_no if first else 0))


def _whole(c) -> F.Column:
    return F.when(c.rlike("^-?[0-9]{1,19}$"), c.try_cast("long"))


def _fail_if(df: DataFrame, bad, message: str) -> DataFrame:
    """Raises when a row is bad, wherever it is found."""
    return df.filter(F.when(bad, F.raise_error(F.concat(F.lit(message + ": "), F.col("line")))).otherwise(F.lit(True)).cast("boolean"))


def read_prints(spark: SparkSession, path: str) -> DataFrame:
    head, lines = _lines(spark, path)
    if head != PRINTS_HEADER:
        raise ValueError(f"header is {head!r}")
    return parse_prints(lines)


def parse_prints(lines: DataFrame) -> DataFrame:
    """Prints of lines(line_no, line)."""
    f = lines.select("line", "line_no", F.split("line", ",").alias("f"))
    names = ("match_number", "locate", "ts_ns", "price_ticks", "shares")
    out = f.select("line", "line_no", *(_whole(F.get("f", i)).alias(n) for i, n in enumerate(names)), F.get("f", 5).alias("printable"), F.get("f", 6).alias("with_price"))
    bad = F.greatest(*(F.col(n).isNull().cast("int") for n in names)) == 1
    return _fail_if(out, bad, "not a print").drop("line")


def read_script(spark: SparkSession, path: str, run: int = 0) -> DataFrame:
    head, lines = _lines(spark, path)
    if head not in SCRIPT_HEADERS:
        raise ValueError(f"header is {head!r}")
    return parse_script(lines, run)


def parse_script(lines: DataFrame, run: int = 0) -> DataFrame:
    """Script rows of lines(line_no, line)."""
    f = lines.select("line", "line_no", F.split("line", ",").alias("f"))
    number = lambda i: _whole(F.get("f", i))
    out = f.select("line", F.lit(run).cast("long").alias("run"), F.col("line_no").cast("long").alias("line_no"), F.get("f", 0).alias("kind"), number(1).alias("ts_ns"), F.get("f", 2).alias("side"), number(3).alias("price_ticks"), number(4).alias("qty"), number(5).alias("ref"), flag(F.coalesce(F.get("f", 6), F.lit(""))).alias("_f"))
    clock = F.col("kind").isin("halt", "resume")
    full = F.col("side").isin("B", "S") & F.col("price_ticks").isNotNull() & F.col("qty").isNotNull() & F.col("ref").isNotNull()
    good = F.col("kind").isin(*SCRIPT_KINDS) & F.col("ts_ns").isNotNull() & (clock | full) & F.col("_f.ok")
    out = _fail_if(out, ~F.coalesce(good, F.lit(False)), "not a script row")
    return out.select("run", "line_no", "kind", "ts_ns", F.coalesce("side", F.lit("")).alias("side"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("price_ticks", "qty", "ref")), F.col("_f.peg").alias("peg"), F.col("_f.offset").alias("offset"), F.col("_f.hidden").alias("hidden"))


def read_events(spark: SparkSession, path: str, run: int = 0) -> DataFrame:
    head, lines = _lines(spark, path)
    if not head.startswith(EVENTS_HEADER):
        raise ValueError(f"header is {head!r}")
    return parse_events(lines, run)


def parse_events(lines: DataFrame, run: int = 0) -> DataFrame:
    """Event rows of lines(line_no, line)."""
    f = lines.select("line", "line_no", F.split("line", ",").alias("f"))
    number = lambda i: _whole(F.get("f", i))
    out = f.select("line", F.lit(run).cast("long").alias("run"), F.col("line_no").cast("long").alias("seq"), F.get("f", 0).alias("type"), number(1).alias("ts_ns"), number(2).alias("ref"), F.get("f", 3).alias("side"), number(4).alias("price_ticks"), number(5).alias("qty"), number(6).alias("fee_cash"), number(7).alias("mid_ticks"), F.coalesce(F.get("f", 8), F.lit("")).alias("ledger"), F.coalesce(number(9), F.lit(0).cast("long")).alias("submit_ns"))
    good = (F.col("ts_ns") >= 0) & (F.col("price_ticks") >= 0) & (F.col("qty") > 0) & (F.col("mid_ticks") >= 0) & (F.length("side") == 1) & (F.length("ledger") <= 1) & F.col("fee_cash").isNotNull()
    return _fail_if(out, ~F.coalesce(good, F.lit(False)), "not an event").drop("line")


def read_fixed_tape(spark: SparkSession, path: str) -> DataFrame:
    """match_number in columns 0-7, shares in 8-15, price in 25-33 (dollars): prints in ticks."""
    line = F.col("value")
    cut = lambda a, n: F.trim(F.substring(line, a + 1, n))
    return spark.read.text(path).filter("value <> ''").select(cut(0, 8).cast("long").alias("match_number"), cut(8, 8).cast("long").alias("shares"), F.round(cut(25, 9).cast("decimal(18,6)") * 10000).cast("long").alias("price_ticks"))


#: Places and sizes of the fields of an official binary tape's reports, cancels and corrections.
TAPE = {
    "e": {"ts_ns": (3, 6), "center": (17, 1), "symbol": (18, 8), "control": (27, 10), "price_ticks": (37, 8), "shares": (45, 8)},
    "o": {"center": (17, 1), "control": (27, 10)},
    "b": {"center": (17, 1), "control": (27, 10), "price_ticks": (47, 8), "shares": (55, 8)},
}
_TEXTS = ("center", "symbol", "control")


def tape_events(frames: DataFrame, offsets: dict[str, dict[str, tuple[int, int]]] | None = None) -> DataFrame:
    """Reports (e), cancels (o) and corrections (b) of a binary tape; a field that a type or a short frame lacks is null."""
    from tapeloom.sources.wire import number as u
    from tapeloom.sources.wire import text

    offsets = TAPE if offsets is None else offsets
    frame, fields = F.col("frame"), []
    for name in dict.fromkeys(n for own in offsets.values() for n in own):
        column = None
        for t, own in offsets.items():
            if name in own:
                at, size = own[name]
                value = text(frame, at, size) if name in _TEXTS else u(frame, at, size).cast("long")
                column = (F if column is None else column).when((F.col("type") == t) & (F.octet_length(frame) >= at + size), value)
        fields.append(column.alias(name))
    return frames.filter(F.col("type").isin(*offsets)).select("seq", "type", *fields)


def corrected_tape(events: DataFrame) -> DataFrame:
    """Prints of ``tape_events`` as the tape left them: without those cancelled later, at their last correction."""
    from tapeloom.operators.tape import apply_corrections

    key = ["center", "control", "seq"]
    kind = lambda t, *more: events.filter(F.col("type") == t).select(*key, *more)
    kept = apply_corrections(kind("e", "price_ticks", "shares"), kind("o"), kind("b", "price_ticks", "shares").filter("shares IS NOT NULL"))
    return kept.join(kind("e", "ts_ns", "symbol"), key).select("symbol", "ts_ns", *key, "price_ticks", "shares", "corrected")


def splitmix(state: int) -> tuple[int, int]:
    m = (1 << 64) - 1
    state = (state + 0x9E3779B97F4A7C15) & m
    z = state
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & m
    z = (z ^ z >> 27) * 0x94D049BB133111EB & m
    return state, z ^ z >> 31


#: Order of the types, symbols.
CYCLE, SYMBOLS = "AFECXDU", ("SPY", "AAPL", "MSFT", "NVDA", "TSLA", "AMZN", "GOOG", "META")


def corpus(seed: int, count: int, center: int = 0, span: int = 10_000_000, first_ref: int = 1) -> list[dict]:
    """Seeded messages for tests, decoded. Fields are drawn in the order in which a type lists them."""
    state, ref, out = seed, first_ref, []

    def draw(below: int | None = None) -> int:
        nonlocal state
        state, z = splitmix(state)
        return z if below is None else z % below

    for i in range(count):
        kind = CYCLE[i % 7]
        m = {"type": kind, "seq": i, "tracking": 0, "ts_ns": 34_200 * 10**9 + i * 1000 + draw(900), "locate": draw() & 0x1FFF}
        if kind in "AF":
            m |= {"order_ref": ref, "side": "B" if draw() & 1 else "S", "shares": draw(1_000_000) + 1, "price": center + draw(span)}
            m |= {"stock": SYMBOLS[draw() % 8]} | ({"attribution": "FIRM"} if kind == "F" else {})
        else:
            m["order_ref"] = draw()
            if kind in "EC":
                m |= {"shares": draw(500_000) + 1, "match_number": ref}
            if kind == "C":
                m |= {"printable": bool(draw() & 1), "price": draw(10_000_000)}
            if kind == "X":
                m["shares"] = draw(400_000) + 1
            if kind == "U":
                m |= {"new_ref": ref, "shares": draw(900_000) + 1, "price": draw(10_000_000)}
        ref += kind in "AFECU"
        out.append(m)
    return out


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars from a file: symbol, day, and low and high in ticks."""
    raw = spark.read.csv(path, schema="symbol string, day date, low decimal(18,6), high decimal(18,6)", header=True, enforceSchema=False, mode="FAILFAST")
    ticks = lambda c: F.round(F.col(c) * 10000).cast("long")
    return raw.select("symbol", "day", ticks("low").alias("bar_low"), ticks("high").alias("bar_high"))


def flow(spark: SparkSession, seed: int, count: int, center: int = 100_000, shares: tuple[float, float, float] = (0.40, 0.38, 0.22)) -> DataFrame:
    """A seeded script of trades, external adds and strategy orders in these shares. Rows are drawn from hashes of
    their number, so any partition makes its own rows and every cluster makes the same ones."""
    at = lambda name: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "id"), F.lit(1_000_000)) / 1_000_000
    kind = F.when(at("kind") < shares[0], "trade").when(at("kind") < shares[0] + shares[1], "ext_add").when(at("type") < 0.5, "strat_limit").otherwise("strat_ioc")
    side = F.when(at("side") < 0.5, "B").otherwise("S")
    away = F.floor(at("price") * 20).cast("long") * 100
    rests = F.col("kind").isin("ext_add", "strat_limit")
    buys = F.col("side") == "B"
    rows = spark.range(count).select("id", kind.alias("kind"), side.alias("side"))
    price = F.lit(center) + F.when(rests == buys, -away).otherwise(away)
    return rows.select(
        F.lit(0).cast("long").alias("run"), F.col("id").alias("line_no"), "kind", (F.col("id") * 1000).alias("ts_ns"), "side", price.alias("price_ticks"),
        (1 + F.floor(at("qty") * 99)).cast("long").alias("qty"), (F.col("id") + 1).alias("ref"), F.lit("none").alias("peg"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("hidden"),
    )

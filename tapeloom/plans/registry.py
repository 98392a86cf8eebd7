"""The engine's queries over the test tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import scalars as S
from tapeloom.operators import asof, discovery, orders, session, tape, tearsheet
from tapeloom.plans.views import duck, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# --- messages and the book -------------------------------------------------------------------------------



def _fold(band: str = "false") -> str:
    """The fold in SQL: a slot has one live order at most (live_ref), so its messages are folded one after another.
    ``band`` says when an add's price is outside."""
    live, bad = "(f.live_ref = n.order_ref AND f.left_qty > 0)", "WHEN n.shares <= 0 THEN 'bad_qty'"
    add = f"CASE WHEN n.order_ref = 0 THEN 'zero_ref' {bad} WHEN {band} THEN 'out_of_band'"
    status = f"""CASE WHEN n.type = 'I' THEN 'none' WHEN n.type IN ('A', 'F') THEN {add} WHEN {live} THEN 'duplicate_ref' ELSE 'ok' END
      WHEN n.type = 'D' THEN CASE WHEN {live} THEN 'ok' ELSE 'unknown_order' END {bad} WHEN NOT {live} THEN 'unknown_order'
      WHEN n.type <> 'U' AND n.shares > f.left_qty THEN 'over_execute' ELSE 'ok' END"""
    enters = "type IN ('A', 'F', 'U') AND status = 'ok'"
    first = f"CASE WHEN n.type = 'I' THEN 'none' WHEN n.type IN ('A', 'F') THEN {add} ELSE 'ok' END WHEN n.type <> 'D' AND n.shares <= 0 THEN 'bad_qty' ELSE 'unknown_order' END"
    return (
        duck("fx_msg")
        + f""",
n AS (SELECT *, seq % 997 AS slot, row_number() OVER (PARTITION BY seq % 997 ORDER BY seq) AS k FROM fx_msg),
fold AS (
  SELECT * EXCLUDE (status), status, CASE WHEN {enters} THEN coalesce(new_ref, order_ref) END AS live_ref, CASE WHEN {enters} THEN shares ELSE 0 END AS left_qty, CASE WHEN {enters} THEN shares ELSE 0 END AS remaining,
    0::BIGINT AS taken, CASE WHEN {enters} THEN price END AS add_price, CASE WHEN {enters} THEN price END AS level, CASE WHEN {enters} THEN seq END AS entered
  FROM (SELECT n.*, {first} AS status FROM n WHERE k = 1)
  UNION ALL
  SELECT * EXCLUDE (status, was_ref, was_qty, was_level, was_entered), status,
    CASE WHEN {enters} THEN coalesce(new_ref, order_ref) ELSE was_ref END,
    CASE WHEN {enters} THEN shares WHEN status = 'ok' AND type = 'D' THEN 0 WHEN status = 'ok' AND type <> 'I' THEN was_qty - shares ELSE was_qty END,
    CASE WHEN {enters} THEN shares WHEN status = 'ok' AND type = 'D' THEN 0 WHEN status = 'ok' THEN was_qty - shares WHEN type <> 'I' AND was_ref = order_ref THEN was_qty ELSE 0 END,
    CASE WHEN status <> 'ok' OR type IN ('A', 'F') THEN 0 WHEN type IN ('D', 'U') THEN was_qty ELSE shares END,
    CASE WHEN type IN ('A', 'F') AND status = 'ok' THEN price WHEN was_ref = order_ref THEN was_level END,
    CASE WHEN {enters} THEN price ELSE was_level END, CASE WHEN {enters} THEN seq ELSE was_entered END
  FROM (SELECT n.*, {status} AS status, f.live_ref AS was_ref, f.left_qty AS was_qty, f.level AS was_level, f.entered AS was_entered FROM fold f JOIN n ON n.slot = f.slot AND n.k = f.k + 1)),
ends AS (SELECT slot, any_value(locate) AS locate, any_value(side) AS side, arg_max(live_ref, k) AS order_ref, arg_max(level, k) AS price, arg_max(left_qty, k) AS qty, arg_max(entered, k) AS entered FROM fold GROUP BY slot),
rest AS (SELECT order_ref, locate, side, price, qty, entered FROM ends WHERE qty > 0),
lev AS (SELECT locate, side, price, sum(qty)::BIGINT AS qty, count(*) AS orders FROM rest GROUP BY 1, 2, 3),
told AS (
  SELECT order_ref AS ref, seq AS at, CASE WHEN type = 'U' THEN 'replaced' WHEN type = 'D' THEN 'deleted' WHEN remaining = 0 THEN 'drained' ELSE 'resting' END AS fate FROM fold WHERE status = 'ok'
  UNION ALL SELECT new_ref, seq, 'resting' FROM fold WHERE status = 'ok' AND type = 'U'),
fated AS (SELECT f.*, coalesce(t.fate, 'never_added') AS fate FROM fold f ASOF LEFT JOIN told t ON t.ref = f.order_ref AND f.seq > t.at),
pr AS (
  SELECT match_number, locate, ts_ns, CASE WHEN type = 'C' THEN price ELSE add_price END AS price_ticks, shares, CASE WHEN coalesce(printable, true) THEN 'Y' ELSE 'N' END AS printable, CASE WHEN type = 'C' THEN 'Y' ELSE 'N' END AS with_price, order_ref
  FROM fold WHERE type IN ('E', 'C') AND status = 'ok')
"""
    )


FOLD = _fold()


def effects(spark: SparkSession, d: str) -> DataFrame:
    return orders.effects(view(spark, d, "fx_msg"))


def rest(spark: SparkSession, d: str) -> DataFrame:
    return orders.resting(effects(spark, d))


@query("type_counts", duck("fx_msg") + "SELECT type, count(*) AS n FROM fx_msg GROUP BY type")
def type_counts(spark, d):
    return view(spark, d, "fx_msg").groupBy("type").agg(F.count("*").alias("n"))


@query("skip_counts", duck("fx_msg") + "SELECT type, count(*) AS n FROM fx_msg WHERE type NOT IN ('A','F','E','C','X','D','U') GROUP BY type")
def skip_counts(spark, d):
    return view(spark, d, "fx_msg").filter(~F.col("type").isin("A", "F", "E", "C", "X", "D", "U")).groupBy("type").agg(F.count("*").alias("n"))


@query("order_effects", FOLD + "SELECT seq, order_ref, type, status, remaining, taken FROM fold")
def order_effects(spark, d):
    return effects(spark, d).select("seq", "order_ref", "type", "status", "remaining", "taken")


@query("band_checks", duck("fx_msg") + "SELECT seq, CASE WHEN order_ref = 0 THEN 'zero_ref' WHEN shares <= 0 THEN 'bad_qty' WHEN price < 102000 THEN 'ok' ELSE 'out_of_band' END AS status FROM fx_msg WHERE type = 'A'")
def band_checks(spark, d):
    return orders.effects(view(spark, d, "fx_msg").filter("type = 'A'"), 0, 102000).select("seq", "status")


@query("print_prices", FOLD + "SELECT match_number, locate, ts_ns, price_ticks, shares, printable, with_price FROM pr")
def print_prices(spark, d):
    return orders.prints(effects(spark, d)).drop("order_ref", "seq")


@query("print_counters", FOLD + "SELECT count(*) FILTER (type IN ('E','C') AND status = 'ok') AS prints, count(*) FILTER (type IN ('E','C') AND status <> 'ok') AS unpriced, count(*) FILTER (status NOT IN ('ok','none')) AS failed FROM fold")
def print_counters(spark, d):
    return orders.print_counters(effects(spark, d))


@query("price_volume", FOLD + "SELECT locate, price_ticks, sum(shares)::BIGINT AS volume FROM pr GROUP BY 1, 2")
def price_volume(spark, d):
    return orders.prints(effects(spark, d)).groupBy("locate", "price_ticks").agg(F.sum("shares").alias("volume"))


@query("locate_stats", FOLD + """SELECT locate, count(*) FILTER (status = 'ok') AS prints, count(*) FILTER (status <> 'ok') AS unpriced, min(px) AS min_tick, max(px) AS max_tick,
  coalesce(sum(shares) FILTER (status = 'ok'), 0)::BIGINT AS shares, ((sum(px * shares) FILTER (status = 'ok')) * 1000000 // sum(shares) FILTER (status = 'ok'))::BIGINT AS vwap_micro
FROM (SELECT *, CASE WHEN status = 'ok' THEN CASE WHEN type = 'C' THEN price ELSE add_price END END AS px FROM fold WHERE type IN ('E','C')) t GROUP BY locate""")
def locate_stats(spark, d):
    return orders.locate_stats(effects(spark, d))


@query("top_locates", FOLD + "SELECT locate, count(*) AS prints, sum(shares)::BIGINT AS shares FROM pr GROUP BY locate HAVING count(*) >= 20 ORDER BY shares DESC, locate LIMIT 3")
def top_locates(spark, d):
    return orders.prints(effects(spark, d)).groupBy("locate").agg(F.count("*").alias("prints"), F.sum("shares").alias("shares")).filter("prints >= 20").orderBy(F.desc("shares"), "locate").limit(3)


@query("l2_snapshot", FOLD + "SELECT locate, side, price, qty, orders FROM lev")
def l2_snapshot(spark, d):
    return orders.levels(rest(spark, d))


@query("bbo_snapshot", FOLD + "SELECT locate, max(price) FILTER (side = 'B') AS best_bid, min(price) FILTER (side = 'S') AS best_ask FROM rest GROUP BY locate")
def bbo_snapshot(spark, d):
    return orders.best(rest(spark, d))


@query("qty_at", FOLD + "SELECT p.side, p.price, coalesce(sum(lev.qty), 0)::BIGINT AS qty FROM (SELECT DISTINCT side, price FROM fx_msg) p LEFT JOIN lev ON lev.side = p.side AND lev.price = p.price GROUP BY 1, 2")
def qty_at(spark, d):
    """What rests at every side and price that a message names."""
    points = view(spark, d, "fx_msg").select("side", "price").distinct()
    return points.join(orders.levels(rest(spark, d)), ["side", "price"], "left").groupBy("side", "price").agg(F.coalesce(F.sum("qty"), F.lit(0)).alias("qty"))


@query("remaining_of", FOLD + "SELECT r.order_ref, coalesce(rest.qty, 0)::BIGINT AS remaining, coalesce(rest.side, '?') AS side FROM (SELECT order_ref FROM fx_msg UNION SELECT new_ref FROM fx_msg WHERE new_ref IS NOT NULL) r LEFT JOIN rest ON rest.order_ref = r.order_ref")
def remaining_of(spark, d):
    """What remains of every reference that a message names."""
    m = view(spark, d, "fx_msg")
    named = m.select("order_ref").union(m.filter("new_ref IS NOT NULL").select("new_ref")).distinct()
    return named.join(rest(spark, d), "order_ref", "left").select("order_ref", F.coalesce("qty", F.lit(0)).alias("remaining"), F.coalesce("side", F.lit("?")).alias("side"))


@query("queue_ahead", FOLD + """SELECT locate, side, price, order_ref, qty, row_number() OVER w AS place, coalesce(sum(qty) OVER (PARTITION BY locate, side, price ORDER BY entered ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
FROM rest WINDOW w AS (PARTITION BY locate, side, price ORDER BY entered)""")
def queue_ahead(spark, d):
    return orders.queue(rest(spark, d))


@query("front_orders", FOLD + "SELECT locate, side, price, arg_min(order_ref, entered) AS front_ref FROM rest GROUP BY 1, 2, 3")
def front_orders(spark, d):
    return orders.fronts(rest(spark, d))


@query("level_gaps", FOLD + "SELECT locate, side, price, lag(price) OVER w AS below, lead(price) OVER w AS above FROM lev WINDOW w AS (PARTITION BY locate, side ORDER BY price)")
def level_gaps(spark, d):
    return orders.neighbours(orders.levels(rest(spark, d)))


@query("depth_n", FOLD + """SELECT locate, side, level, price, qty, round((1.0::DOUBLE + level) ** -1.5, 6) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY locate, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) - 1 AS level FROM lev) t WHERE level < 5""")
def depth_n(spark, d):
    return orders.depth(orders.levels(rest(spark, d)), 5, 1.5)


@query("live_orders", FOLD + "SELECT count(*) AS live FROM rest")
def live_orders(spark, d):
    return rest(spark, d).agg(F.count("*").alias("live"))


DELTAS = FOLD + """, del AS (SELECT seq, locate, side, add_price AS price, -taken AS delta, 0 AS part FROM fold WHERE status = 'ok' AND taken <> 0
 UNION ALL SELECT seq, locate, side, price, shares, 1 FROM fold WHERE status = 'ok' AND type IN ('A', 'F', 'U')) """


@query("level_deltas", DELTAS + "SELECT * FROM del")
def level_deltas(spark, d):
    return orders.deltas(effects(spark, d))


@query("delta_ring", DELTAS + "SELECT *, (SELECT greatest(count(*) - 64, 0) FROM del) AS dropped FROM (SELECT * FROM del ORDER BY seq DESC, part DESC LIMIT 64) t")
def delta_ring(spark, d):
    return orders.last_deltas(orders.deltas(effects(spark, d)), 64)


@query("book_audit", DELTAS + """, folded AS (SELECT locate, side, price, sum(delta) AS d FROM del GROUP BY 1, 2, 3), j AS (SELECT coalesce(lev.qty, 0) AS qty, coalesce(d, 0) AS d FROM lev FULL JOIN folded ON lev.locate = folded.locate AND lev.side = folded.side AND lev.price = folded.price)
SELECT count(*) FILTER (qty <> d) AS level_mismatch, count(*) FILTER (d < 0) AS negative_level, (SELECT count(*) FROM fold WHERE remaining < 0) AS negative_order FROM j""")
def book_audit(spark, d):
    e = effects(spark, d)
    return orders.audit(e, orders.resting(e), orders.deltas(e))


@query("replay_summary", FOLD + """SELECT count(*) AS messages, count(*) FILTER (status = 'none') AS skipped, count(*) FILTER (status NOT IN ('ok','none')) AS failed, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts,
  (SELECT count(*) FROM rest) AS live_orders, (SELECT max(price) FROM rest WHERE side = 'B') AS best_bid, (SELECT min(price) FROM rest WHERE side = 'S') AS best_ask FROM fold""")
def replay_summary(spark, d):
    e = effects(spark, d)
    return orders.summary(e, orders.resting(e))


@query("error_histogram", FOLD + "SELECT status AS error, fate <> 'never_added' AS seen, count(*) AS n FROM fated WHERE status NOT IN ('ok','none') GROUP BY 1, 2")
def error_histogram(spark, d):
    return orders.error_histogram(effects(spark, d))


@query("ref_fate", FOLD + "SELECT fate, count(*) AS n FROM fated WHERE type IN ('E','C') AND status <> 'ok' GROUP BY 1")
def ref_fate(spark, d):
    return orders.fates(effects(spark, d))


@query("add_failures", _fold("n.price >= 102000") + "SELECT status AS error, count(*) AS n FROM fold WHERE type IN ('A','F') AND status <> 'ok' GROUP BY 1")
def add_failures(spark, d):
    e = orders.effects(view(spark, d, "fx_msg"), 0, 102000)
    return e.filter(F.col("type").isin("A", "F") & (F.col("status") != "ok")).groupBy(F.col("status").alias("error")).agg(F.count("*").alias("n"))


@query("sequence_gaps", duck("fx_msg") + "SELECT seq, was FROM (SELECT seq, lag(seq + 1) OVER (PARTITION BY locate ORDER BY seq) AS was FROM fx_msg) t WHERE was <> seq")
def sequence_gaps(spark, d):
    from pyspark.sql import Window as W

    return view(spark, d, "fx_msg").select("seq", F.lag(F.col("seq") + 1).over(W.partitionBy("locate").orderBy("seq")).alias("was")).filter("was <> seq")


@query("prints_csv", FOLD + "SELECT concat_ws(',', match_number, locate, ts_ns, price_ticks, shares, printable, with_price) AS line FROM pr")
def prints_csv(spark, d):
    return orders.prints(effects(spark, d)).select(S.prints_csv().alias("line"))


STOCK = "'SY' || (locate * 7 + order_ref % 5)"


@query("locate_first_ref", duck("fx_msg") + f"SELECT locate, arg_min(order_ref, seq) AS first_ref, arg_min({STOCK}, seq) AS symbol FROM fx_msg WHERE type IN ('A', 'F') GROUP BY locate")
def locate_first_ref(spark, d):
    return orders.symbols(view(spark, d, "fx_msg").withColumn("stock", F.expr(STOCK)))


@query("prints_by_symbol", FOLD + f", sym AS (SELECT locate, arg_min({STOCK}, seq) AS symbol FROM fx_msg WHERE type IN ('A', 'F') GROUP BY locate) SELECT symbol, count(*) AS prints, sum(shares)::BIGINT AS volume FROM pr JOIN sym USING (locate) GROUP BY symbol")
def prints_by_symbol(spark, d):
    m = view(spark, d, "fx_msg").withColumn("stock", F.expr(STOCK))
    return orders.with_symbol(orders.prints(orders.effects(m)), orders.symbols(m)).groupBy("symbol").agg(F.count("*").alias("prints"), F.sum("shares").alias("volume"))


@query("prints_by_flag", FOLD + "SELECT printable, with_price, count(*) AS prints, sum(shares)::BIGINT AS volume FROM pr GROUP BY 1, 2")
def prints_by_flag(spark, d):
    return orders.prints(effects(spark, d)).groupBy("printable", "with_price").agg(F.count("*").alias("prints"), F.sum("shares").alias("volume"))


@query("replaced_orders", FOLD + "SELECT order_ref, new_ref, seq, status, taken, remaining, side FROM fold WHERE type = 'U'")
def replaced_orders(spark, d):
    """Replacements with what they removed and what rests after them."""
    return effects(spark, d).filter("type = 'U'").select("order_ref", "new_ref", "seq", "status", "taken", "remaining", "side")


# --- session ----------------------------------------------------------------------------------------------

SESS = (
    duck("fx_sess")
    + """,
acts AS (SELECT *, kind <> 'T' AS op, coalesce(lag(kind <> 'T') OVER (PARTITION BY locate ORDER BY seq), false) AS was FROM fx_sess WHERE kind IN ('H','T')),
turns AS (SELECT locate, seq, ts_ns, op, lead(seq) OVER w AS close_seq, lead(ts_ns) OVER w AS end_ns FROM acts WHERE op <> was WINDOW w AS (PARTITION BY locate ORDER BY seq)),
win AS (SELECT locate, seq AS open_seq, ts_ns AS start_ns, close_seq, end_ns FROM turns WHERE op),
noii AS (SELECT * FROM fx_sess WHERE kind = 'I')
"""
)


def _kind(spark, d, *kinds):
    return view(spark, d, "fx_sess").filter(F.col("kind").isin(*kinds))


@query("session_phase", duck("fx_sess") + "SELECT arg_max(code, CASE WHEN code <> 'Z' THEN seq END) AS phase, count(*) AS events, count(*) FILTER (code = 'Z') AS ignored FROM (SELECT seq, CASE WHEN kind = 'T' THEN CASE WHEN seq % 2 = 0 THEN 'Q' ELSE 'M' END ELSE 'Z' END AS code FROM fx_sess WHERE kind IN ('T','H')) t")
def session_phase(spark, d):
    code = F.when(F.col("kind") == "H", "Z").when(F.col("seq") % 2 == 0, "Q").otherwise("M")
    return session.phase(_kind(spark, d, "T", "H").select("seq", code.alias("code")))


@query("halt_windows", SESS + "SELECT * FROM win")
def halt_windows(spark, d):
    return session.halt_windows(_kind(spark, d, "H", "T").withColumnRenamed("kind", "state"))


@query("halted_prints", SESS + "SELECT p.seq, p.locate FROM fx_sess p WHERE kind = 'P' AND EXISTS (SELECT 1 FROM win w WHERE w.locate = p.locate AND w.open_seq < p.seq AND w.start_ns <= p.ts_ns AND (w.close_seq IS NULL OR w.close_seq > p.seq OR p.ts_ns < w.end_ns))")
def halted_prints(spark, d):
    w = session.halt_windows(_kind(spark, d, "H", "T").withColumnRenamed("kind", "state"))
    return session.halted(_kind(spark, d, "P"), w).select("seq", "locate")


@query("noii_latest", SESS + "SELECT locate, max(seq) AS last_seq, max(seq) FILTER (paired > 0 OR imbalance > 0) AS told_seq, " + ", ".join(f"arg_max({c}, seq) FILTER (paired > 0 OR imbalance > 0) AS {c}" for c in ("paired", "imbalance", "direction", "near")) + ", count(*) AS n FROM noii GROUP BY locate")
def noii_latest(spark, d):
    return session.latest_imbalance(_kind(spark, d, "I"))


@query("opening_crosses", SESS + "SELECT locate, 'opening' AS kind, arg_max(near, seq) AS price, arg_max(paired + imbalance, seq) AS qty FROM noii WHERE (paired > 0 OR imbalance > 0) AND seq < (SELECT max(seq) FROM fx_sess WHERE kind = 'T' AND seq % 2 = 0) GROUP BY locate")
def opening_crosses(spark, d):
    return session.market_crosses(_kind(spark, d, "I"), _kind(spark, d, "T").filter("seq % 2 = 0"), "opening")


@query("closing_crosses", SESS + "SELECT locate, 'closing' AS kind, arg_max(near, seq) AS price, arg_max(paired + imbalance, seq) AS qty FROM noii WHERE (paired > 0 OR imbalance > 0) AND seq < (SELECT max(seq) FROM fx_sess WHERE kind = 'T' AND seq % 2 = 1) GROUP BY locate")
def closing_crosses(spark, d):
    return session.market_crosses(_kind(spark, d, "I"), _kind(spark, d, "T").filter("seq % 2 = 1"), "closing")


@query("resume_crosses", SESS + """SELECT t.locate, t.seq, n.near AS price, n.paired + n.imbalance AS qty FROM fx_sess t JOIN noii n ON n.locate = t.locate
WHERE t.kind = 'T' AND EXISTS (SELECT 1 FROM fx_sess h WHERE h.kind = 'H' AND h.locate = t.locate AND h.seq < t.seq)
  AND n.seq = (SELECT max(seq) FROM noii m WHERE m.locate = t.locate AND m.seq < t.seq AND (m.paired > 0 OR m.imbalance > 0))""")
def resume_crosses(spark, d):
    return session.resume_crosses(_kind(spark, d, "H", "T").withColumnRenamed("kind", "state"), _kind(spark, d, "I"))


@query("short_sale", duck("fx_sess") + "SELECT locate, arg_max(direction, seq) AS action, count(*) AS n FROM fx_sess WHERE kind = 'T' GROUP BY locate")
def short_sale(spark, d):
    return session.short_sale(_kind(spark, d, "T").select("seq", "locate", F.col("direction").alias("action")))


@query("session_counters", duck("fx_sess") + "SELECT kind, count(*) AS n, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts FROM fx_sess GROUP BY kind")
def session_counters(spark, d):
    return view(spark, d, "fx_sess").groupBy("kind").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"))


# --- tape -------------------------------------------------------------------------------------------------

TAPE = duck("fx_ours", "fx_theirs")
BAG = ["symbol", "price_ticks", "shares"]


def _both(spark, d):
    return view(spark, d, "fx_ours"), view(spark, d, "fx_theirs")


@query("diff_report", TAPE + """SELECT count(*) FILTER (a.match_number IS NOT NULL AND b.match_number IS NOT NULL) AS matched, count(*) FILTER (b.match_number IS NULL) AS only_ours, count(*) FILTER (a.match_number IS NULL) AS only_theirs,
 count(*) FILTER (a.price_ticks <> b.price_ticks) AS price_mismatch, count(*) FILTER (a.shares <> b.shares) AS shares_mismatch, min(a.match_number) FILTER (a.price_ticks <> b.price_ticks OR a.shares <> b.shares) AS first_divergence
FROM fx_ours a FULL JOIN fx_theirs b ON a.match_number = b.match_number""")
def diff_report(spark, d):
    return tape.diff_report(*_both(spark, d))


@query("tape_match", TAPE + """SELECT sum(least(n, m))::BIGINT AS matched, sum(greatest(n - m, 0))::BIGINT AS extra, sum(greatest(m - n, 0))::BIGINT AS missing FROM (
 SELECT coalesce(a.n, 0) AS n, coalesce(b.m, 0) AS m FROM (SELECT symbol, price_ticks, shares, count(*) AS n FROM fx_ours GROUP BY 1, 2, 3) a FULL JOIN (SELECT symbol, price_ticks, shares, count(*) AS m FROM fx_theirs GROUP BY 1, 2, 3) b USING (symbol, price_ticks, shares)) t""")
def tape_match(spark, d):
    return tape.bag_match(*_both(spark, d), BAG)


@query("tape_extra", TAPE + "SELECT symbol, price_ticks, shares FROM fx_ours EXCEPT ALL SELECT symbol, price_ticks, shares FROM fx_theirs")
def tape_extra(spark, d):
    a, b = _both(spark, d)
    return a.select(BAG).exceptAll(b.select(BAG))


@query("tape_missing", TAPE + "SELECT symbol, price_ticks, shares FROM fx_theirs EXCEPT ALL SELECT symbol, price_ticks, shares FROM fx_ours")
def tape_missing(spark, d):
    a, b = _both(spark, d)
    return b.select(BAG).exceptAll(a.select(BAG))


@query("tape_common", TAPE + "SELECT symbol, price_ticks, shares FROM fx_ours INTERSECT ALL SELECT symbol, price_ticks, shares FROM fx_theirs")
def tape_common(spark, d):
    a, b = _both(spark, d)
    return a.select(BAG).intersectAll(b.select(BAG))


@query("missing_top", TAPE + "SELECT symbol, count(*) AS n FROM (SELECT symbol, price_ticks, shares FROM fx_theirs EXCEPT ALL SELECT symbol, price_ticks, shares FROM fx_ours) t GROUP BY symbol ORDER BY n DESC, symbol LIMIT 10")
def missing_top(spark, d):
    return tape_missing(spark, d).groupBy("symbol").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol").limit(10)


@query("volume_buckets", TAPE + "SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.price_ticks, b.price_ticks) AS price_ticks, coalesce(a.v, 0)::BIGINT AS ours, coalesce(b.v, 0)::BIGINT AS theirs FROM (SELECT symbol, price_ticks, sum(shares) AS v FROM fx_ours GROUP BY 1, 2) a FULL JOIN (SELECT symbol, price_ticks, sum(shares) AS v FROM fx_theirs GROUP BY 1, 2) b ON a.symbol = b.symbol AND a.price_ticks = b.price_ticks")
def volume_buckets(spark, d):
    a, b = (x.groupBy("symbol", "price_ticks").agg(F.sum("shares").alias(n)) for x, n in zip(_both(spark, d), ("ours", "theirs"), strict=True))
    return a.join(b, ["symbol", "price_ticks"], "full_outer").na.fill(0, ["ours", "theirs"])


@query("center_counts", TAPE + "SELECT center, count(*) AS n FROM fx_theirs WHERE match_number BETWEEN (SELECT min(match_number) FROM fx_ours) AND (SELECT max(match_number) FROM fx_ours) GROUP BY center")
def center_counts(spark, d):
    a, b = _both(spark, d)
    window = a.agg(F.min("match_number").alias("lo"), F.max("match_number").alias("hi"))
    return b.join(F.broadcast(window), F.col("match_number").between(F.col("lo"), F.col("hi"))).groupBy("center").agg(F.count("*").alias("n"))


CORRECTIONS = duck("fx_theirs") + """,
r AS (SELECT center, match_number % 3000 AS control, match_number AS seq, price_ticks, shares FROM fx_theirs WHERE match_number % 5 < 3),
c AS (SELECT center, match_number % 3000 AS control, match_number AS seq FROM fx_theirs WHERE match_number % 5 = 3),
b AS (SELECT center, match_number % 3000 AS control, match_number AS seq, price_ticks, shares FROM fx_theirs WHERE match_number % 5 = 4)
"""


@query("bust_correct", CORRECTIONS + """SELECT r.center, r.control, r.seq, coalesce(n.p, r.price_ticks) AS price_ticks, coalesce(n.s, r.shares) AS shares, n.p IS NOT NULL AS corrected
FROM r LEFT JOIN (SELECT center, control, arg_max(price_ticks, seq) AS p, arg_max(shares, seq) AS s FROM b GROUP BY 1, 2) n ON n.center = r.center AND n.control = r.control
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.center = r.center AND c.control = r.control AND c.seq > r.seq)""")
def bust_correct(spark, d):
    t = view(spark, d, "fx_theirs").select("center", (F.col("match_number") % 3000).alias("control"), F.col("match_number").alias("seq"), "price_ticks", "shares")
    kind = F.col("seq") % 5
    return tape.apply_corrections(t.filter(kind < 3), t.filter(kind == 3), t.filter(kind == 4))


AGREE = duck("fx_fill") + """,
a AS (SELECT ref, side, sum(qty) AS q, sum(price_ticks * qty) / sum(qty) AS v FROM fx_fill WHERE line % 7 <> 6 GROUP BY 1, 2),
b AS (SELECT ref, side, sum(qty) AS q, sum((price_ticks + CASE WHEN part % 10 = 0 THEN 1 ELSE 0 END) * qty) / sum(qty) AS v FROM fx_fill WHERE line % 7 <> 5 GROUP BY 1, 2),
j AS (SELECT a.q AS qa, b.q AS qb, round(abs(a.v - b.v), 6) AS g FROM a FULL JOIN b ON a.ref = b.ref AND a.side = b.side)
"""


@query("agreement", AGREE + """SELECT count(g) AS common, count(*) FILTER (qb IS NULL) AS only_ours, count(*) FILTER (qa IS NULL) AS only_theirs, count(*) FILTER (qa = qb AND g <= 1) AS exact, round(avg(g), 4) AS mean_gap, round(quantile_cont(g, 0.5), 4) AS median_gap, max(g) AS max_gap,
 (SELECT g FROM (SELECT g, row_number() OVER (ORDER BY g) - 1 AS k FROM j WHERE g IS NOT NULL) WHERE k = (SELECT floor(count(g) * 0.95) FROM j)) AS p95_gap FROM j""")
def agreement(spark, d):
    f = view(spark, d, "fx_fill")
    theirs = f.withColumn("price_ticks", F.col("price_ticks") + F.when(F.col("part") % 10 == 0, 1).otherwise(0))
    return tape.agreement(f.filter("line % 7 <> 6"), theirs.filter("line % 7 <> 5"))


@query("containment", duck("fx_fill") + """SELECT s.symbol, s.low >= b.bar_low AND s.high <= b.bar_high AS strict, s.low >= b.bar_low * 0.99::DOUBLE AND s.high <= b.bar_high * 1.01::DOUBLE AS within
FROM (SELECT supp AS symbol, min(price_ticks) AS low, max(price_ticks) AS high FROM fx_fill WHERE line % 2 = 0 GROUP BY 1) s JOIN (SELECT supp AS symbol, min(price_ticks) AS bar_low, max(price_ticks) AS bar_high FROM fx_fill WHERE line % 2 = 1 GROUP BY 1) b USING (symbol)""")
def containment(spark, d):
    f = view(spark, d, "fx_fill").withColumnRenamed("supp", "symbol")
    low, high = F.min("price_ticks"), F.max("price_ticks")
    return tape.containment(f.filter("line % 2 = 0").groupBy("symbol").agg(low.alias("low"), high.alias("high")), f.filter("line % 2 = 1").groupBy("symbol").agg(low.alias("bar_low"), high.alias("bar_high")), 0.01)


@query("decision_divergence", TAPE + """SELECT min(idx) FILTER (x IS DISTINCT FROM y) AS first_divergence, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS compared FROM (
 SELECT coalesce(a.match_number, b.match_number) AS idx, a.price_ticks || ':' || a.shares AS x, b.price_ticks || ':' || b.shares AS y FROM fx_ours a FULL JOIN fx_theirs b ON a.match_number = b.match_number) t""")
def decision_divergence(spark, d):
    a, b = (x.select(F.col("match_number").alias("idx"), "price_ticks", "shares") for x in _both(spark, d))
    return tape.first_divergence(a, b, ["idx"])


# --- execution quality ------------------------------------------------------------------------------------

LOG = duck("fx_log")
SIGNED = "CASE WHEN side = 'B' THEN qty ELSE -qty END"
CURVE = LOG + f""",
l AS (SELECT *, coalesce(arg_max(mid_ticks, seq) FILTER (mid_ticks > 0) OVER (PARTITION BY run), 0) AS last_mid FROM fx_log),
c AS (SELECT run, seq, sum(CASE WHEN type = 'F' THEN -({SIGNED}) * price_ticks ELSE 0 END) OVER w AS cash, sum(CASE WHEN type = 'F' THEN {SIGNED} ELSE 0 END) OVER w AS inventory, CASE WHEN mid_ticks > 0 THEN mid_ticks ELSE last_mid END AS m FROM l WINDOW w AS (PARTITION BY run ORDER BY seq)),
e AS (SELECT run, seq, cash::BIGINT AS cash, inventory::BIGINT AS inventory, (cash + inventory * m)::BIGINT AS equity FROM c),
curve AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY run ORDER BY seq)) AS peak FROM e)
"""


@query("tearsheet", LOG + f"""SELECT *, CASE WHEN me > 0 THEN round(hi / me, 6) ELSE 0.0 END AS hit_rate, cash_pnl_ticks + final_inventory * final_mid_ticks AS equity_pnl_ticks FROM (SELECT run, count(*) FILTER (type = 'F') AS fills, count(*) FILTER (type = 'P') AS prints,
 coalesce(sum(qty) FILTER (type = 'F' AND side = 'B'), 0)::BIGINT AS buy_qty, coalesce(sum(qty) FILTER (type = 'F' AND side = 'S'), 0)::BIGINT AS sell_qty, coalesce(sum(price_ticks * qty) FILTER (type = 'F'), 0)::BIGINT AS volume_ticks,
 coalesce(sum(fee_cash) FILTER (type = 'F'), 0)::BIGINT AS fees_cash, coalesce(sum(fee_cash) FILTER (type = 'F' AND ledger = 'M'), 0)::BIGINT AS fees_maker_cash, coalesce(sum(fee_cash) FILTER (type = 'F' AND ledger = 'T'), 0)::BIGINT AS fees_taker_cash,
 coalesce(sum({SIGNED}) FILTER (type = 'F'), 0)::BIGINT AS final_inventory, coalesce(sum(-({SIGNED}) * price_ticks) FILTER (type = 'F'), 0)::BIGINT AS cash_pnl_ticks, coalesce(arg_max(mid_ticks, seq) FILTER (mid_ticks > 0), 0)::BIGINT AS final_mid_ticks,
 count(*) FILTER (type = 'F' AND CASE WHEN side = 'B' THEN mid_ticks > price_ticks ELSE mid_ticks < price_ticks END) AS hi, count(*) FILTER (type = 'F' AND mid_ticks > 0 AND mid_ticks <> price_ticks) AS me FROM fx_log GROUP BY run) t""".replace("SELECT *, CASE WHEN me", "SELECT * EXCLUDE (hi, me), CASE WHEN me"))
def tearsheet_scalars(spark, d):
    return tearsheet.scalars(view(spark, d, "fx_log"))


@query("equity_curve", CURVE + "SELECT run, seq, cash, inventory, equity, peak FROM curve")
def equity_curve(spark, d):
    return tearsheet.equity(view(spark, d, "fx_log"))


@query("drawdown", CURVE + "SELECT run, max(peak - equity) AS max_drawdown_ticks, round(coalesce(max((peak - equity) / peak) FILTER (peak > 0), 0.0) * 10000, 4) AS max_drawdown_bps FROM curve GROUP BY run")
def drawdown(spark, d):
    return tearsheet.drawdown(tearsheet.equity(view(spark, d, "fx_log")))


def _markout_sql(horizons, source, value, mean, move):
    return LOG + f""",
f AS (SELECT run, seq, side, price_ticks AS px, ts_ns + h AS at, h FROM fx_log, (SELECT unnest([{', '.join(map(str, horizons))}]::BIGINT[]) AS h) hs WHERE type = 'F' AND price_ticks > 0),
p AS (SELECT run, ts_ns, arg_min({value}, seq) AS v FROM fx_log WHERE {source} GROUP BY 1, 2)
SELECT f.run, h AS horizon_ns, count(v) AS measured, round(coalesce(avg({move}), 0.0), 6) AS {mean} FROM f ASOF LEFT JOIN p ON f.run = p.run AND f.at <= p.ts_ns GROUP BY 1, 2"""


HOUR = 3_600 * 10**9


@query("markout_bps", _markout_sql((10**9, 10**11, 10**12), "type = 'P' AND price_ticks > 0", "price_ticks", "mean_bps", "CASE WHEN side = 'B' THEN 1 ELSE -1 END * (v - px) / px * 10000"))
def markout_bps(spark, d):
    return tearsheet.markouts(view(spark, d, "fx_log"), (10**9, 10**11, 10**12), 24 * HOUR)


@query("markout_ms", _markout_sql(tearsheet.HORIZONS_NS, "type = 'P' AND price_ticks > 0", "price_ticks", "mean_bps", "CASE WHEN side = 'B' THEN 1 ELSE -1 END * (v - px) / px * 10000"))
def markout_ms(spark, d):
    return tearsheet.markouts(view(spark, d, "fx_log"))


@query("markout_us", _markout_sql(tearsheet.TELEMETRY_NS, "mid_ticks > 0", "mid_ticks", "mean_ticks", "CASE WHEN side = 'B' THEN 1 ELSE -1 END * (v - px)"))
def markout_us(spark, d):
    return tearsheet.tick_markouts(view(spark, d, "fx_log"), bucket=24 * HOUR)


@query("account", LOG + f"SELECT run, seq, (sum(-({SIGNED}) * price_ticks - fee_cash) OVER w)::BIGINT AS net_cash, (sum({SIGNED}) OVER w)::BIGINT AS inventory, (sum(fee_cash) OVER w)::BIGINT AS fees FROM fx_log WHERE type = 'F' WINDOW w AS (PARTITION BY run ORDER BY seq)")
def account(spark, d):
    return tearsheet.account(view(spark, d, "fx_log"))


@query("latency_hist", LOG + "SELECT run, CASE WHEN lat < 16 THEN 0 ELSE least(length(bin(lat)) - 1 - 4, 31) END::BIGINT AS bucket, count(*) AS n, max(lat) AS largest FROM (SELECT run, ts_ns - submit_ns AS lat FROM fx_log WHERE type = 'F' AND submit_ns > 0) t WHERE lat >= 0 GROUP BY 1, 2")
def latency_hist(spark, d):
    return tearsheet.latency_histogram(view(spark, d, "fx_log"))


@query("latency_fit", LOG + "SELECT run, n, round(m, 4) AS mean_ns, round(s, 4) AS sd_ns, CASE WHEN abs(s / m - 1) < 0.25 THEN 'exponential' WHEN abs(s / m - 0.577) < 0.15 THEN 'uniform' ELSE 'normal' END AS shape FROM (SELECT run, count(*) AS n, avg(ts_ns - submit_ns) AS m, stddev_pop((ts_ns - submit_ns)::DOUBLE) AS s FROM fx_log WHERE type = 'F' AND ledger = 'T' AND submit_ns > 0 AND ts_ns >= submit_ns GROUP BY run) t WHERE n >= 8")
def latency_fit(spark, d):
    return tearsheet.latency_fit(view(spark, d, "fx_log"))


@query("merged_stream", LOG + "SELECT seq, stream, stream_rank, price_ticks, mid_ticks FROM (SELECT seq, 'trade' AS stream, 0 AS stream_rank, price_ticks, NULL::BIGINT AS mid_ticks FROM fx_log WHERE type = 'P' UNION ALL SELECT seq, 'fill', 1, price_ticks, mid_ticks FROM fx_log WHERE ledger = 'M' UNION ALL SELECT seq, 'decision', 2, NULL, mid_ticks FROM fx_log WHERE ledger = 'T') t")
def merged_stream(spark, d):
    log = view(spark, d, "fx_log")
    return tearsheet.merged([("trade", log.filter("type = 'P'").select("seq", "price_ticks")), ("fill", log.filter("ledger = 'M'").select("seq", "price_ticks", "mid_ticks")), ("decision", log.filter("ledger = 'T'").select("seq", "mid_ticks"))]).select("seq", "stream", "stream_rank", "price_ticks", "mid_ticks")


@query("bbo_changes", LOG + "SELECT run, seq, bid_px, bid_qty, ask_px, ask_qty FROM (SELECT run, seq, mid_ticks // 100000 AS bid_px, qty % 2 AS bid_qty, mid_ticks // 100000 + 1 AS ask_px, 1 AS ask_qty, lag(mid_ticks // 100000 || ':' || qty % 2) OVER (PARTITION BY run ORDER BY seq) AS was FROM fx_log) t WHERE was IS DISTINCT FROM bid_px || ':' || bid_qty")
def bbo_changes(spark, d):
    px = F.expr("mid_ticks div 100000")
    quotes = view(spark, d, "fx_log").select("run", "seq", px.alias("bid_px"), (F.col("qty") % 2).alias("bid_qty"), (px + 1).alias("ask_px"), F.lit(1).alias("ask_qty"))
    return tearsheet.quote_changes(quotes)


@query("events_csv", LOG + "SELECT concat_ws(',', type, ts_ns, ref, side, price_ticks, qty, fee_cash, mid_ticks, ledger, submit_ns) AS line FROM fx_log")
def events_csv(spark, d):
    return view(spark, d, "fx_log").select(S.events_csv().alias("line"))


@query("fill_totals", LOG + "SELECT count(*) AS fills, sum(qty)::BIGINT AS model_qty, sum(qty) FILTER (ledger = 'T')::BIGINT AS aggressive_qty, sum(price_ticks * qty)::BIGINT AS notional, sum(fee_cash)::BIGINT AS fees FROM fx_log WHERE type = 'F'")
def fill_totals(spark, d):
    return view(spark, d, "fx_log").filter("type = 'F'").agg(F.count("*").alias("fills"), F.sum("qty").alias("model_qty"), F.sum(F.when(F.col("ledger") == "T", F.col("qty"))).alias("aggressive_qty"), F.sum(F.col("price_ticks") * F.col("qty")).alias("notional"), F.sum("fee_cash").alias("fees"))


@query("portfolio_totals", LOG + "SELECT run, count(*) AS fills, sum(price_ticks * qty)::BIGINT AS notional, sum(fee_cash)::BIGINT AS fees FROM fx_log WHERE type = 'F' GROUP BY ROLLUP(run)")
def portfolio_totals(spark, d):
    return view(spark, d, "fx_log").filter("type = 'F'").rollup("run").agg(F.count("*").alias("fills"), F.sum(F.col("price_ticks") * F.col("qty")).alias("notional"), F.sum("fee_cash").alias("fees"))


# --- scalars ----------------------------------------------------------------------------------------------


@query("session_class", LOG + """, t AS (SELECT seq, ts_ns // 86400000000000 AS day, ts_ns % 86400000000000 AS ns, (ts_ns // 86400000000000) % 9 = 0 AS early FROM fx_log)
SELECT seq, (day + 4) % 7 AS weekday, CASE WHEN (day + 4) % 7 IN (0, 6) THEN 'non_trading_day' WHEN ns < 34200000000000 THEN 'before_open' WHEN ns > CASE WHEN early THEN 46800000000000 ELSE 57600000000000 END THEN 'after_close' ELSE 'in_session' END AS session FROM t""")
def session_class(spark, d):
    day, ns = F.expr("ts_ns div 86400000000000"), F.expr("ts_ns % 86400000000000")
    return view(spark, d, "fx_log").select("seq", S.weekday(day).alias("weekday"), S.classify(day, ns, S.close_ns(day % 9 == 0)).alias("session"))


@query("fees", "SELECT event_id, (sign(event_id % 11 - 5) * ((event_id * 7919) * abs(event_id % 11 - 5) // 10000))::BIGINT AS fee FROM events")
def fees(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", S.fee(F.col("event_id") * 7919, F.col("event_id") % 11 - 5).alias("fee"))


@query("saturating", """SELECT event_id, least(greatest(a::HUGEINT + b, -9223372036854775808), 9223372036854775807)::BIGINT AS added, least(greatest(a::HUGEINT - b, -9223372036854775808), 9223372036854775807)::BIGINT AS subtracted, least(greatest(a::HUGEINT * b, -9223372036854775808), 9223372036854775807)::BIGINT AS multiplied
FROM (SELECT event_id, (event_id % 1000 - 500) * 9007199254740993 AS a, (event_id % 7 - 3) * 900719925474099 AS b FROM events) t""")
def saturating(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    a, b = (F.col("event_id") % 1000 - 500) * 9007199254740993, (F.col("event_id") % 7 - 3) * 900719925474099
    return e.select("event_id", S.sat_add(a, b).alias("added"), S.sat_sub(a, b).alias("subtracted"), S.sat_mul(a, b).alias("multiplied"))


@query("mids", """SELECT event_id, CASE WHEN b > 0 AND a > 0 THEN (b + a) // 2 ELSE 0 END AS mid, CASE WHEN b IS NOT NULL AND a IS NOT NULL THEN b + a WHEN a IS NOT NULL THEN 2 * a WHEN b IS NOT NULL THEN 2 * b ELSE 0 END AS doubled, CASE WHEN b IS NOT NULL AND a IS NOT NULL THEN (b + a) / 2.0::DOUBLE ELSE 0.0 END AS portfolio, (b + a) // 2 - 3 AS peg_mid, b + 5 AS peg_bid
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 1000 + event_id % 17 END AS b, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 1020 + event_id % 23 END AS a FROM events) t""")
def mids(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_id") % 3 != 0, 1000 + F.col("event_id") % 17).alias("b"), F.when(F.col("event_id") % 5 != 0, 1020 + F.col("event_id") % 23).alias("a"))
    b, a = F.col("b"), F.col("a")
    return e.select("event_id", S.mid(b, a).alias("mid"), S.doubled_mid(b, a).alias("doubled"), S.portfolio_mid(b, a).alias("portfolio"), S.peg("mid", F.lit(-3), b, a).alias("peg_mid"), S.peg("bid", F.lit(5), b, a).alias("peg_bid"))


@query("tokens", "SELECT event_id, lpad(event_id::VARCHAR, 14, '0') AS token, event_id AS parsed, rtrim(rpad('SY' || event_id % 50, 8, ' ')) AS symbol, (event_id * 31 + (event_id % 9 + 1) // 2) // (event_id % 9 + 1) AS taker_price FROM events")
def tokens(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    name = S.padded_symbol(F.concat(F.lit("SY"), F.col("event_id") % 50))
    return e.select("event_id", S.token(F.col("event_id")).alias("token"), S.token_id(S.token(F.col("event_id"))).cast("long").alias("parsed"), S.symbol(name).alias("symbol"), S.taker_price(F.col("event_id") * 31, F.col("event_id") % 9 + 1).alias("taker_price"))


@query("flags", """SELECT * FROM (VALUES ('', 'none', 0, false, true), ('nd', 'none', 0, true, true), ('mid', 'mid', 0, true, true), ('bid:-3', 'bid', -3, true, true), ('ask:+12', 'ask', 12, true, true), ('mud', 'none', 0, false, false)) t(flag, peg, "offset", hidden, ok)""")
def flags(spark, d):
    f = spark.createDataFrame([("",), ("nd",), ("mid",), ("bid:-3",), ("ask:+12",), ("mud",)], "flag string")
    return f.select("flag", S.flag(F.col("flag")).alias("f")).select("flag", "f.*")


# --- discovery, impact, sweeps ----------------------------------------------------------------------------

SERIES = duck("fx_series")
LEADLAG = SERIES + """,
lags AS (SELECT unnest(generate_series(-5, 5)) AS lag),
p AS (SELECT lag, a.x::DOUBLE AS x, b.y::DOUBLE AS y FROM fx_series a, lags, fx_series b WHERE b.i = a.i + lag),
m AS (SELECT lag, avg(x) AS mx, avg(y) AS my FROM p GROUP BY lag),
s AS (SELECT lag, sum((x - mx) * (y - my)) AS sxy, sum((x - mx) ** 2) AS sxx, sum((y - my) ** 2) AS syy FROM p JOIN m USING (lag) GROUP BY lag),
r AS (SELECT lag, round(CASE WHEN sxx > 0 AND syy > 0 THEN sxy / sqrt(sxx * syy) ELSE 0 END, 9) AS rho FROM s)
"""


@query("lead_lag", LEADLAG + "SELECT lag, rho FROM r")
def lead_lag(spark, d):
    return discovery.lead_lag(view(spark, d, "fx_series"), 5)


@query("best_lag", LEADLAG + "SELECT lag, rho FROM r ORDER BY abs(rho) DESC, lag LIMIT 1")
def best_lag(spark, d):
    return discovery.best_lag(discovery.lead_lag(view(spark, d, "fx_series"), 5))


@query("info_share", SERIES + """, v AS (SELECT var_pop(x) AS v1, var_pop(y) AS v2, covar_pop(x, y) AS c FROM fx_series),
w AS (SELECT (sqrt(v1) - c / sqrt(v1)) ** 2 AS a1, greatest(v2 - c * c / v1, 0) AS b1, (sqrt(v2) - c / sqrt(v2)) ** 2 AS a2, greatest(v1 - c * c / v2, 0) AS b2 FROM v),
s AS (SELECT least(a1 / (a1 + b1), b2 / (a2 + b2)) AS lo, greatest(a1 / (a1 + b1), b2 / (a2 + b2)) AS hi FROM w)
SELECT round(lo, 6) AS lower_1, round(hi, 6) AS upper_1, round(1 - hi, 6) AS lower_2, round(1 - lo, 6) AS upper_2, round((lo + hi) / 2, 6) AS mid_1 FROM s""")
def info_share(spark, d):
    v = view(spark, d, "fx_series").agg(F.var_pop("x").alias("v1"), F.var_pop("y").alias("v2"), F.covar_pop("x", "y").alias("c"))
    return discovery.information_share(v)


FILLS = duck("fx_fill")
IMPACT = dict(volume=1e6, sigma=0.02)
IMPACT_SQL = "SELECT seq, supp, CASE WHEN side = 'B' THEN qty ELSE -qty END AS q, seq * 1000000 AS ts_ns FROM (SELECT *, row_number() OVER (PARTITION BY supp ORDER BY ref, line, part, side, price_ticks, qty) AS seq FROM fx_fill) t"


def _shocks(spark, d):
    from pyspark.sql import Window as W

    f = view(spark, d, "fx_fill").withColumn("seq", F.row_number().over(W.partitionBy("supp").orderBy("ref", "line", "part", "side", "price_ticks", "qty")).cast("long"))
    return f.withColumn("q", F.when(F.col("side") == "B", F.col("qty")).otherwise(-F.col("qty"))).withColumn("ts_ns", F.col("seq") * 1_000_000)


@query("impact", FILLS + f"SELECT supp, seq, round(sign(q) * 0.3 * 0.02 * (abs(q) / 1e6) ** 0.5 * 10000, 6) AS permanent, round(sign(q) * 0.1 * 0.02 * (abs(q) / 2.0 * 23400 / 1e6) ** 0.6 * 10000, 6) AS temporary FROM ({IMPACT_SQL}) t")
def impact(spark, d):
    q = F.col("q")
    return _shocks(spark, d).select("supp", "seq", F.round(discovery.permanent_impact(q, gamma=0.3, alpha=0.5, **IMPACT), 6).alias("permanent"), F.round(discovery.temporary_impact(q, F.lit(2.0), eta=0.1, beta=0.6, **IMPACT), 6).alias("temporary"))


@query("impact_state", FILLS + f""", s AS (SELECT *, q / 100.0::DOUBLE AS p, q / 10.0::DOUBLE AS t FROM ({IMPACT_SQL}) x),
st AS (SELECT supp, seq, ts_ns, p AS permanent, t AS temporary FROM s WHERE seq = 1 UNION ALL
 SELECT s.supp, s.seq, s.ts_ns, st.permanent + s.p, st.temporary * exp(-ln(2.0::DOUBLE) / 5e6 * (s.ts_ns - st.ts_ns)) + s.t FROM st JOIN s ON s.supp = st.supp AND s.seq = st.seq + 1)
SELECT supp AS key, seq, round(permanent, 6) AS permanent, round(temporary, 6) AS temporary FROM st""")
def impact_state(spark, d):
    s = _shocks(spark, d).select(F.col("supp").alias("key"), "seq", "ts_ns", (F.col("q") / 100.0).alias("permanent"), (F.col("q") / 10.0).alias("temporary"))
    return discovery.impact_state(s, 5e6)


TRAJECTORY = """WITH k AS (SELECT acosh(1 + 0.5 * 1e-4 * 0.02 * 0.02 * 60.0 * 60.0 / 1e-3) / 60.0 AS kappa), t AS (SELECT unnest(generate_series(0, 20)) AS step),
h AS (SELECT step, 10000.0::DOUBLE * sinh(kappa * (1200.0 - step * 60.0)) / sinh(kappa * 1200.0) AS x FROM t, k),
g AS (SELECT step, x, coalesce(lag(x) OVER (ORDER BY step) - x, 0.0) AS trade FROM h)
"""
TRAJECTORY = TRAJECTORY.replace("sinh(kappa * (1200.0 - step * 60.0))", "((exp(kappa * (1200.0 - step * 60.0)) - exp(-kappa * (1200.0 - step * 60.0))) / 2)").replace("sinh(kappa * 1200.0)", "((exp(kappa * 1200.0) - exp(-kappa * 1200.0)) / 2)")


def _schedule(spark):
    return discovery.trajectory(spark, 10000.0, 20, 1200.0, 0.02, 1e-4, 1e-3)


@query("trajectory", TRAJECTORY + "SELECT step, round(x, 6) AS remaining, round(trade, 6) AS trade FROM g")
def trajectory(spark, d):
    return _schedule(spark)


@query("shortfall", TRAJECTORY + ", r AS (SELECT step, round(trade, 6) AS t FROM g), c AS (SELECT t * 0.02 / 1e6 * (0.3 * sum(t) OVER (ORDER BY step) + 0.1 * t / 60.0 * 23400.0) AS c, t FROM r) SELECT round(sum(c), 6) AS shortfall, round(sum(t), 6) AS traded FROM c")
def shortfall(spark, d):
    return discovery.shortfall(_schedule(spark), 60.0, gamma=0.3, eta=0.1, **IMPACT)


def _bands(k):
    return f"SELECT '{k}' AS key, count({k}) AS n, round(min({k})::DOUBLE, 6) AS lo, round(avg({k}), 6) AS mean, round(max({k})::DOUBLE, 6) AS hi, round(quantile_cont({k}::DOUBLE, 0.05), 6) AS p5, round(quantile_cont({k}::DOUBLE, 0.5), 6) AS p50, round(quantile_cont({k}::DOUBLE, 0.95), 6) AS p95 FROM fx_fill"


@query("sweep_bands", FILLS + " UNION ALL ".join(_bands(k) for k in ("price_ticks", "qty", "part")))
def sweep_bands(spark, d):
    return discovery.sweep_bands(view(spark, d, "fx_fill"), ["price_ticks", "qty", "part"])


@query("sweep_distinct", FILLS + "SELECT 'side' AS key, count(DISTINCT side) AS distinct_values FROM fx_fill UNION ALL SELECT 'supp', count(DISTINCT supp) FROM fx_fill")
def sweep_distinct(spark, d):
    return discovery.distinct_values(view(spark, d, "fx_fill"), ["side", "supp"])


@query("sweep_grid", "SELECT a.v AS fee, b.v AS latency FROM (VALUES (1.0::DOUBLE), (2.0), (5.0)) a(v), (VALUES (0.0::DOUBLE), (50.0), (100.0)) b(v)")
def sweep_grid(spark, d):
    return discovery.grid(spark, {"fee": "1,2,5", "latency": "0..100:50"})


@query("perf_medians", FILLS + "SELECT name, round(m, 6) AS median, round(m / b, 6) AS ratio, m / b > 1.0 AS slower FROM (SELECT name, median(m) AS m FROM (SELECT supp % 5 AS name, line, median(price_ticks) AS m FROM fx_fill GROUP BY 1, 2) t GROUP BY 1) x JOIN (SELECT supp % 5 AS name, median(price_ticks) AS b FROM fx_fill WHERE side = 'B' GROUP BY 1) y USING (name)")
def perf_medians(spark, d):
    f = view(spark, d, "fx_fill").select((F.col("supp") % 5).alias("name"), F.col("line").alias("repetition"), F.col("price_ticks").alias("value"), "side")
    return discovery.medians(f, f.filter("side = 'B'"), 1.0)


@query("fills_by_order", FILLS + "SELECT ref, side, sum(qty)::BIGINT AS qty, round(sum(price_ticks * qty) / sum(qty), 4) AS vwap FROM fx_fill GROUP BY 1, 2")
def fills_by_order(spark, d):
    return tape.by_order(view(spark, d, "fx_fill")).withColumn("vwap", F.round("vwap", 4))


@query("static_sweep", FILLS + """SELECT supp, side, ref, line, part, taken FROM (SELECT *, greatest(least(qty, 500 - ahead), 0) AS taken FROM (
 SELECT *, coalesce(sum(qty) OVER (PARTITION BY supp, side ORDER BY CASE WHEN side = 'S' THEN price_ticks ELSE -price_ticks END, ref, line, part, qty ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM fx_fill) t) u WHERE taken > 0""".replace("part, taken FROM", "part, taken::BIGINT AS taken FROM"))
def static_sweep(spark, d):
    """What 500 units take from each supplier's side by price and time: the relational twin of a level walk."""
    from pyspark.sql import Window as W

    near = F.when(F.col("side") == "S", F.col("price_ticks")).otherwise(-F.col("price_ticks"))
    w = W.partitionBy("supp", "side").orderBy(near, "ref", "line", "part", "qty").rowsBetween(W.unboundedPreceding, -1)
    f = view(spark, d, "fx_fill").withColumn("ahead", F.coalesce(F.sum("qty").over(w), F.lit(0)))
    return f.withColumn("taken", F.greatest(F.least(F.col("qty"), 500 - F.col("ahead")), F.lit(0))).filter("taken > 0").select("supp", "side", "ref", "line", "part", "taken")


# --- frames -----------------------------------------------------------------------------------------------


@query("decode_frames", duck("fx_msg") + """SELECT seq, locate::INT AS locate, ts_ns % 281474976710656 AS ts_ns, type, order_ref, new_ref, CASE WHEN type IN ('A', 'F') THEN side END AS side, CASE WHEN type <> 'D' THEN shares END AS shares,
 CASE WHEN type IN ('A', 'F') THEN 'SYM' || locate END AS stock, CASE WHEN type = 'F' THEN 'FRM' || locate END AS attribution, CASE WHEN type IN ('A', 'F', 'C', 'U') THEN price END AS price, match_number, printable, NULL::VARCHAR AS decode_error
FROM fx_msg WHERE type <> 'I'""")
def decode_frames(spark, d):
    """Every message as a frame and back: encoding by SQL functions, decoding in arrays."""
    from tapeloom.sources import wire

    m = view(spark, d, "fx_msg").filter("type <> 'I'").withColumns({"stock": F.concat(F.lit("SYM"), F.col("locate")), "attribution": F.concat(F.lit("FRM"), F.col("locate")), "ts_ns": F.col("ts_ns") % 2**48})
    frames = wire.encode(m).select("seq", "type", "frame")
    return wire.decode(frames, ("A", "F", "E", "C", "X", "D", "U")).select("seq", "locate", "ts_ns", "type", "order_ref", "new_ref", "side", "shares", "stock", "attribution", "price", "match_number", "printable", "decode_error")


@query("decode_session", duck("fx_sess") + """SELECT seq, CASE WHEN kind = 'I' THEN 'I' ELSE 'S' END AS type, locate::INT AS locate, CASE WHEN kind = 'I' THEN paired END AS paired, CASE WHEN kind = 'I' THEN imbalance END AS imbalance,
 CASE WHEN kind = 'I' THEN direction END AS direction, CASE WHEN kind = 'I' THEN near END AS near, CASE WHEN kind <> 'I' THEN kind END AS code FROM fx_sess""")
def decode_session(spark, d):
    from tapeloom.sources import wire

    m = view(spark, d, "fx_sess").withColumn("code", F.col("kind")).withColumn("type", F.when(F.col("kind") == "I", "I").otherwise("S")).withColumn("ts_ns", F.col("ts_ns") % 2**48)
    return wire.decode(wire.encode(m).select("seq", "type", "frame"), ("I", "S")).select("seq", "type", "locate", "paired", "imbalance", "direction", "near", "code")


# --- framings: captures of 4,096 events each, made of frames and walked again --------------------------------

SIZES = "CASE type WHEN 'A' THEN 36 WHEN 'F' THEN 40 WHEN 'E' THEN 31 WHEN 'C' THEN 36 WHEN 'X' THEN 23 WHEN 'D' THEN 19 WHEN 'U' THEN 35 WHEN 'S' THEN 12 WHEN 'I' THEN 50 END"


def _placed(view_name: str, where: str) -> str:
    """Each message's file, place in it, size, and the bytes before it."""
    return duck(view_name) + f""",
m AS (SELECT *, seq // 4096 AS file, {SIZES} AS size FROM (SELECT *, {"type" if view_name == "fx_msg" else "CASE WHEN kind = 'I' THEN 'I' ELSE 'S' END AS type"} FROM {view_name}) t WHERE {where})
"""


def _content(spark, d, name, pack):
    """files(path, ordinal, content): ``pack`` makes the hexadecimal text of a file of its frames (seq, ts_ns, h), in order."""
    from tapeloom.sources import wire

    m = view(spark, d, name)
    if name == "fx_msg":
        m = m.filter("type <> 'I'").withColumns({"stock": F.lit("SYM"), "attribution": F.lit("FRM")})
    else:
        m = m.withColumns({"code": F.col("kind"), "type": F.when(F.col("kind") == "I", "I").otherwise("S")})
    framed = wire.encode(m.withColumn("ts_ns", F.col("ts_ns") % 2**48)).select("seq", "ts_ns", F.expr("seq div 4096").alias("ordinal"), F.hex("frame").alias("h"))
    files = framed.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("seq", "ts_ns", "h"))).alias("fs"))
    return files.select(F.col("ordinal").cast("string").alias("path"), "ordinal", F.unhex(pack(F.col("fs"))).alias("content"))


def _hex(value, size):
    return F.lpad(F.hex(value.cast("long")), 2 * size, "0")


def _walked(frames):
    return frames.select(F.col("file").cast("long").alias("file"), F.col("offset"), (F.col("seq") % 2**40).alias("place"), F.expr("cast(seq div 1099511627776 as bigint)").alias("ordinal"), "type", F.hex(F.substring("frame", 12, 8)).alias("head"))


_HEAD = "CASE WHEN type IN ('S', 'I') THEN NULL ELSE upper(printf('%016x', order_ref)) END"
_ROW = "file, place - 1 AS place, file AS ordinal, type"


@query("frames_raw", _placed("fx_msg", "type <> 'I'") + "SELECT file, (coalesce(sum(size) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS offset, row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS place, file AS ordinal, type, upper(printf('%016x', order_ref)) AS head FROM m".replace(" AS offset", ' AS "offset"'))
def frames_raw(spark, d):
    from tapeloom.sources import capture

    return _walked(capture.frames(_content(spark, d, "fx_msg", lambda fs: F.array_join(F.transform(fs, lambda f: f["h"]), "")), "raw"))


@query("frames_session", _placed("fx_sess", "true") + """SELECT file, type, count(*) AS n, sum(size)::BIGINT AS bytes FROM m GROUP BY 1, 2""")
def frames_session(spark, d):
    """Session messages, which the strict framing refuses."""
    from tapeloom.sources import capture

    got = capture.frames(_content(spark, d, "fx_sess", lambda fs: F.array_join(F.transform(fs, lambda f: f["h"]), "")), "session")
    return got.groupBy(F.col("file").cast("long").alias("file"), "type").agg(F.count("*").alias("n"), F.sum(F.octet_length("frame")).alias("bytes"))


@query("frames_skipped", _placed("fx_sess", "true") + "SELECT type, count(*) AS n FROM m GROUP BY 1")
def frames_skipped(spark, d):
    from tapeloom.sources import capture

    return capture.skipped(capture.frames(_content(spark, d, "fx_sess", lambda fs: F.array_join(F.transform(fs, lambda f: f["h"]), "")), "session"))


@query("frames_lenprefix", _placed("fx_msg", "type <> 'I'") + """SELECT file, (2 + coalesce(sum(size + 2) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS place, file AS ordinal, type, upper(printf('%016x', order_ref)) AS head FROM m""")
def frames_lenprefix(spark, d):
    from tapeloom.sources import capture

    pack = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat(_hex(F.length(f["h"]) / 2, 2), f["h"])), "")
    return _walked(capture.frames(_content(spark, d, "fx_msg", pack), "lenprefix"))


@query("frames_sequenced", _placed("fx_msg", "type <> 'I'") + """SELECT file, row_number() OVER (PARTITION BY file ORDER BY seq) + 6 AS number, type, upper(printf('%016x', order_ref)) AS head FROM m""")
def frames_sequenced(spark, d):
    """Packets of eight messages, numbered from 7, and an end."""
    from tapeloom.sources import capture

    head = lambda first, n: F.concat(F.lit("53" * 10), _hex(first, 8), _hex(n, 2))

    def pack(fs):
        def packet(k):
            own = F.slice(fs, k * 8 + 1, F.lit(8))
            return F.concat(head(k * 8 + 7, F.size(own)), F.array_join(F.transform(own, lambda f: F.concat(_hex(F.length(f["h"]) / 2, 2), f["h"])), ""))

        packets = F.transform(F.sequence(F.lit(0), F.floor((F.size(fs) - 1) / 8).cast("int")), packet)
        return F.concat(F.array_join(packets, ""), head(F.lit(0), F.lit(0)))

    got = capture.frames(_content(spark, d, "fx_msg", pack), "mold")
    return got.select(F.col("file").cast("long").alias("file"), "number", "type", F.hex(F.substring("frame", 12, 8)).alias("head"))


@query("packets", _placed("fx_msg", "type <> 'I'") + """SELECT ts_ns % 281474976710656 // 1000 * 1000 AS ts_ns, 30000 + file % 1000 AS src_port, 26400 AS dst_port, 17 AS protocol, size, type, upper(printf('%016x', order_ref)) AS head FROM m""".replace("30000 + file % 1000 AS src_port, 26400 AS dst_port, 17 AS protocol", "30001::INT AS src_port, 26400::INT AS dst_port, 17::INT AS protocol"))
def packets(spark, d):
    """Packet captures in microseconds: Ethernet, IPv4 and UDP around each frame."""
    from tapeloom.sources import capture

    little = lambda v: F.concat(*(F.substring(_hex(v, 4), k, 2) for k in (7, 5, 3, 1)))

    def packet(f):
        size = (F.length(f["h"]) / 2).cast("long")
        ip = F.concat(F.lit("4500"), _hex(size + 28, 2), F.lit("00000000" + "4011" + "0000" + "0A000001" + "E9360C01"))
        udp = F.concat(_hex(F.lit(30001), 2), _hex(F.lit(26400), 2), _hex(size + 8, 2), F.lit("0000"))
        whole = F.concat(F.lit("01005E360C01" + "020000000001" + "0800"), ip, udp, f["h"])
        sec, sub = F.floor(f["ts_ns"] / 10**9), F.floor(f["ts_ns"] % 10**9 / 1000)
        return F.concat(little(sec), little(sub), little(size + 42), little(size + 42), whole)

    pack = lambda fs: F.concat(F.lit("D4C3B2A1" + "02000400" + "00000000" * 2 + "FFFF0000" + "01000000"), F.array_join(F.transform(fs, packet), ""))
    got = capture.packets_of(_content(spark, d, "fx_msg", pack))
    return got.select("ts_ns", "src_port", "dst_port", "protocol", F.octet_length("payload").alias("size"), F.decode(F.substring("payload", 1, 1), "ISO-8859-1").alias("type"), F.hex(F.substring("payload", 12, 8)).alias("head"))


@query("packet_gaps", duck("fx_msg") + """, p AS (SELECT seq // 4096 AS file, seq // 8 AS pkt, min(seq) AS first, count(*) AS n, row_number() OVER (PARTITION BY seq // 4096 ORDER BY seq // 8) AS k FROM fx_msg WHERE seq % 1000 <> 7 GROUP BY 1, 2)
SELECT file, pkt AS pkt_off, was AS expected, first AS seq, CASE WHEN first > was THEN 'sequence_gap' ELSE 'sequence_regression' END AS error FROM (SELECT *, lag(first + n) OVER (PARTITION BY file ORDER BY pkt) AS was FROM p) t WHERE was <> first""")
def packet_gaps(spark, d):
    """Breaks in the numbers of packets from which some messages are gone."""
    from tapeloom.sources import capture

    m = view(spark, d, "fx_msg").filter("seq % 1000 <> 7")
    told = m.groupBy(F.expr("seq div 4096").alias("file"), F.expr("seq div 8").alias("pkt_off")).agg(F.min("seq").alias("seq"), F.count("*").alias("count")).withColumn("session", F.lit("S"))
    return capture.continuity(told).drop("session")


@query("tape_binary", duck("fx_theirs") + """,
t AS (SELECT *, match_number % 5 AS k, match_number % 3000 AS control FROM fx_theirs),
r AS (SELECT * FROM t WHERE k < 3), c AS (SELECT * FROM t WHERE k = 3), b AS (SELECT * FROM t WHERE k = 4)
SELECT 'S' || r.symbol AS symbol, r.match_number * 1000 AS ts_ns, chr((65 + r.center)::INT) AS center, r.control::VARCHAR AS control, r.match_number AS seq, coalesce(n.p, r.price_ticks) AS price_ticks, coalesce(n.s, r.shares) AS shares, n.p IS NOT NULL AS corrected
FROM r LEFT JOIN (SELECT center, control, arg_max(price_ticks, match_number) AS p, arg_max(shares, match_number) AS s FROM b GROUP BY 1, 2) n ON n.center = r.center AND n.control = r.control
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.center = r.center AND c.control = r.control AND c.match_number > r.match_number)""")
def tape_binary(spark, d):
    """The official tape as binary reports, cancels and corrections, read and settled."""
    from tapeloom.sources import tables

    t = view(spark, d, "fx_theirs").withColumn("type", F.when(F.col("match_number") % 5 < 3, "e").when(F.col("match_number") % 5 == 3, "o").otherwise("b"))
    text = lambda c, n: F.hex(F.encode(F.rpad(c.cast("string"), n, " "), "ISO-8859-1"))
    head = F.concat(F.hex(F.encode("type", "ISO-8859-1")), F.lit("0000"), _hex(F.col("match_number") * 1000, 6), F.lit("00" * 8), text(F.chr(F.col("center") + 65), 1), text(F.concat(F.lit("S"), F.col("symbol")), 8), F.lit("00"), text(F.col("match_number") % 3000, 10))
    figures = F.concat(_hex(F.col("price_ticks"), 8), _hex(F.col("shares"), 8))
    frame = F.when(F.col("type") == "e", F.concat(head, figures)).when(F.col("type") == "o", head).otherwise(F.concat(head, F.lit("00" * 10), figures))
    return tables.corrected_tape(tables.tape_events(t.select(F.col("match_number").alias("seq"), "type", F.unhex(frame).alias("frame"))))


@query("read_prints", FOLD + "SELECT match_number, locate::BIGINT AS locate, ts_ns, price_ticks, shares, printable, with_price FROM pr")
def read_prints(spark, d):
    """Prints as lines and back."""
    from tapeloom.sources import tables

    return tables.parse_prints(orders.prints(effects(spark, d)).select(F.col("seq").alias("line_no"), S.prints_csv().alias("line"))).drop("line_no")


@query("read_events", LOG + "SELECT seq, type, ts_ns, ref, side, price_ticks, qty, fee_cash, greatest(mid_ticks, 0) AS mid_ticks, ledger, submit_ns FROM fx_log WHERE price_ticks >= 0")
def read_events(spark, d):
    from tapeloom.sources import tables

    log = view(spark, d, "fx_log").filter("price_ticks >= 0").withColumn("mid_ticks", F.greatest("mid_ticks", F.lit(0)))
    return tables.parse_events(log.select(F.col("seq").alias("line_no"), S.events_csv().alias("line"))).drop("run")


@query("read_script", duck("fx_msg") + """SELECT seq AS line_no, CASE type WHEN 'A' THEN 'ext_add' WHEN 'E' THEN 'trade' ELSE 'strat_limit' END AS kind, ts_ns, side, price AS price_ticks, shares AS qty, order_ref AS ref,
 CASE WHEN seq % 4 = 2 THEN 'mid' WHEN seq % 4 = 3 THEN 'bid' ELSE 'none' END AS peg, (CASE WHEN seq % 4 = 2 THEN -3 WHEN seq % 4 = 3 THEN 12 ELSE 0 END)::BIGINT AS "offset", seq % 4 > 0 AS hidden FROM fx_msg WHERE type IN ('A', 'E', 'F')""")
def read_script(spark, d):
    from tapeloom.sources import tables

    kind = F.when(F.col("type") == "A", "ext_add").when(F.col("type") == "E", "trade").otherwise("strat_limit")
    flag = F.when(F.col("seq") % 4 == 1, "nd").when(F.col("seq") % 4 == 2, "mid:-3").when(F.col("seq") % 4 == 3, "bid:+12").otherwise("")
    m = view(spark, d, "fx_msg").filter("type IN ('A', 'E', 'F')")
    line = F.concat_ws(",", kind, "ts_ns", "side", "price", "shares", "order_ref", flag)
    return tables.parse_script(m.select(F.col("seq").alias("line_no"), line.alias("line"))).drop("run")


@query("symbol_bars", duck("fx_fill") + "SELECT supp AS symbol, count(*) AS fills, sum(qty)::BIGINT AS volume, min(price_ticks) AS low, max(price_ticks) AS high FROM fx_fill GROUP BY 1")
def symbol_bars(spark, d):
    return view(spark, d, "fx_fill").groupBy(F.col("supp").alias("symbol")).agg(F.count("*").alias("fills"), F.sum("qty").alias("volume"), F.min("price_ticks").alias("low"), F.max("price_ticks").alias("high"))


# --- simulations: one group each, no SQL says them ----------------------------------------------------------


def _scripts(spark, d):
    slot = F.col("seq") % 997
    adds = F.col("type").isin("A", "F")
    kind = F.when(adds, "ext_add").when(F.col("type").isin("E", "C"), "trade").when(F.col("type") == "I", "strat_limit").when(F.col("type") == "X", "strat_ioc")
    level = 100000 + 100 * (slot % 41)
    price = F.when(F.col("type") == "I", level).otherwise(level + F.when(F.col("side") == "B", -2000).otherwise(2000))
    side = F.when(F.col("type").isin("E", "C"), F.when(F.col("side") == "B", "S").otherwise("B")).otherwise(F.col("side"))
    rows = view(spark, d, "fx_msg").withColumn("kind", kind).filter("kind is not null AND shares > 0")
    return rows.select((slot % 5).alias("run"), F.col("seq").alias("line_no"), "kind", F.col("seq").alias("ts_ns"), side.alias("side"), price.alias("price_ticks"), F.col("shares").alias("qty"), (F.col("seq") + 1).alias("ref"), F.lit("none").alias("peg"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("hidden"))


def _config():
    from tapeloom.operators.simulator import Config

    return Config(maker_fee_bps=-2, taker_fee_bps=5)


@query("sim_events")
def sim_events(spark, d):
    from tapeloom.operators import runs

    return runs.script_events(_scripts(spark, d), _config())


@query("sim_summary")
def sim_summary(spark, d):
    from tapeloom.operators import runs

    return runs.script_summary(_scripts(spark, d), _config())


@query("sim_grid")
def sim_grid(spark, d):
    from tapeloom.operators import runs

    return runs.grid_summary(_scripts(spark, d), discovery.grid(spark, {"maker_fee_bps": "-2,0", "wire_ns": "0..100:50"}), _config())


@query("sim_portfolio")
def sim_portfolio(spark, d):
    from tapeloom.operators import runs

    return runs.portfolio(runs.script_summary(_scripts(spark, d), _config()))


@query("time_travel")
def time_travel(spark, d):
    from tapeloom.operators import runs

    return runs.at_step(_scripts(spark, d), 2000, _config())


@query("time_travel_fork")
def time_travel_fork(spark, d):
    from tapeloom.operators import runs

    s = _scripts(spark, d)
    return runs.script_summary(s.unionByName(runs.fork(s, 2000, s.filter("kind <> 'trade'"), 1000)), _config())


@query("book_fold", FOLD + "SELECT locate, seq, CASE WHEN status = 'ok' OR status = 'none' THEN 'none' ELSE status END AS error FROM fold")
def book_fold(spark, d):
    from tapeloom.operators import runs

    return runs.book_fold(view(spark, d, "fx_msg")).select("locate", "seq", "error")


@query("sim_tearsheet")
def sim_tearsheet(spark, d):
    from tapeloom.operators import runs

    return tearsheet.scalars(runs.script_events(_scripts(spark, d), _config()))

"""Order-lifecycle tables derived from the general test tables, for queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDERS = 997  # references of the derived messages

#: The same text runs in both engines; NS is the nanosecond clock of either.
#: fx_msg: rounds of one message for each of k slots. The first round adds an order in every slot (reference 0 too, and
#: some without a quantity); in every seventh round from the fourth all are replaced, and the slot's messages name the new
#: reference from then on, but for some executions, cancels and deletes that still name the first. Later F adds meet
#: live orders or bring back dead ones.
SQL = {
    "fx_msg": """
SELECT event_id AS seq, {ns} AS ts_ns, order_ref, slot % 8 AS locate, CASE WHEN slot % 2 = 0 THEN 'B' ELSE 'S' END AS side, type,
  CASE WHEN event_id % 89 = 0 AND type IN ('A', 'F', 'E', 'C', 'X') THEN 0 WHEN event_id < {k} THEN 200 + 10 * (user_id % 10)
       WHEN type = 'U' THEN 100 + user_id % 50 WHEN type = 'F' THEN 50 + user_id % 60 ELSE 1 + user_id % 60 END AS shares,
  CASE WHEN event_id < {k} THEN 100000 + 100 * (slot % 41) WHEN type = 'U' THEN 100000 + 100 * (event_id % 17) WHEN type = 'F' THEN 100000 + 100 * ((slot + 7) % 41)
       WHEN type = 'C' THEN 100000 + CAST(round(value * 100) AS BIGINT) ELSE 0 END AS price,
  CASE WHEN type = 'U' THEN 1000000000 + event_id END AS new_ref, CASE WHEN type IN ('E', 'C') THEN 5000000000 + event_id * 3 END AS match_number,
  CASE WHEN type = 'C' THEN event_id % 3 <> 0 END AS printable
FROM (SELECT *, CASE WHEN event_id {div} {k} < 4 OR (event_id % 13 = 0 AND type IN ('E', 'C', 'X', 'D')) THEN slot
             ELSE 1000000000 + (7 * ((event_id {div} {k} - 4) {div} 7) + 3) * {k} + slot END AS order_ref
  FROM (SELECT event_id, ts, user_id, value, event_id % {k} AS slot, CASE WHEN event_id < {k} THEN CASE WHEN event_id % 4 = 1 THEN 'F' ELSE 'A' END
          WHEN event_id {div} {k} % 7 = 3 THEN 'U' WHEN event_type = 'click' THEN 'E' WHEN event_type = 'purchase' THEN 'C' WHEN event_type = 'view' THEN 'X'
          WHEN event_type = 'error' THEN 'D' WHEN event_id % 5 = 0 THEN 'F' ELSE 'I' END AS type
        FROM events WHERE event_id IS NOT NULL) a) b""",
    "fx_log": """
SELECT user_id % 4 AS run, event_id AS seq, CASE WHEN event_type IN ('purchase', 'signup') THEN 'F' ELSE 'P' END AS type,
  {ns} AS ts_ns, event_id AS ref, CASE WHEN user_id % 2 = 0 THEN 'B' ELSE 'S' END AS side,
  CAST(round(value * 10000) AS BIGINT) AS price_ticks, 1 + user_id % 100 AS qty,
  CASE WHEN event_type = 'purchase' THEN -(user_id % 7) WHEN event_type = 'signup' THEN user_id % 11 ELSE 0 END AS fee_cash,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(round(value * 10000) AS BIGINT) + user_id % 13 - 6 END AS mid_ticks,
  CASE WHEN event_type = 'purchase' THEN 'M' WHEN event_type = 'signup' THEN 'T' ELSE '' END AS ledger,
  CASE WHEN event_type = 'signup' THEN {ns} - (user_id * user_id * 977) % 1000003 ELSE 0 END AS submit_ns
FROM events""",
    "fx_sess": """
SELECT event_id AS seq, {ns} AS ts_ns, user_id % 8 AS locate,
  CASE WHEN event_type = 'error' THEN 'H' WHEN event_type = 'signup' THEN 'T' WHEN event_type = 'click' THEN 'I' ELSE 'P' END AS kind,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS paired, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(round(value) AS BIGINT) END AS imbalance,
  CASE WHEN user_id % 2 = 0 THEN 'B' ELSE 'S' END AS direction, CAST(round(value * 100) AS BIGINT) AS near
FROM events""",
    "fx_ours": """
SELECT event_id AS match_number, user_id % 8 AS center, CAST(round(value * 100) AS BIGINT) AS price_ticks, 1 + user_id % 50 AS shares, user_id % 100 AS symbol
FROM events WHERE event_type IN ('purchase', 'click')""",
    "fx_theirs": """
SELECT event_id AS match_number, user_id % 8 AS center, CAST(round(value * 100) AS BIGINT) + CASE WHEN event_id % 91 = 0 THEN 1 ELSE 0 END AS price_ticks,
  1 + user_id % 50 + CASE WHEN event_id % 77 = 0 THEN 1 ELSE 0 END AS shares, user_id % 100 AS symbol
FROM events WHERE (event_type IN ('purchase', 'click') AND event_id % 50 <> 0) OR (event_type = 'view' AND event_id % 40 = 0)""",
    "fx_series": """
SELECT CAST(i AS BIGINT) AS i, count(CASE WHEN event_type = 'view' THEN 1 END) AS x, count(CASE WHEN event_type = 'click' THEN 1 END) AS y
FROM (SELECT event_id, event_type, event_id {div} 25 AS i FROM events) t GROUP BY i""",
    "fx_fill": """
SELECT l_orderkey AS ref, CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'B' END AS side, CAST(round(l_extendedprice / l_quantity * 10000) AS BIGINT) AS price_ticks,
  CAST(l_quantity AS BIGINT) AS qty, CAST(l_suppkey AS BIGINT) AS supp, CAST(l_partkey AS BIGINT) AS part, CAST(l_linenumber AS BIGINT) AS line
FROM lineitem""",
}

NS = {"spark": "unix_micros(CAST(ts AS TIMESTAMP)) * 1000", "duck": "epoch_us(ts) * 1000"}
DIV = {"spark": "div", "duck": "//"}
TABLES = {"fx_fill": "lineitem"}


def text(name: str, engine: str, k: int = ORDERS) -> str:
    return SQL[name].format(ns=NS[engine], div=DIV[engine], k=k)


def view(spark: SparkSession, sf_dir: str, name: str, k: int = ORDERS) -> DataFrame:
    source = TABLES.get(name, "events")
    sql = text(name, "spark", k).replace(f"FROM {source}", "FROM {src}")
    return spark.sql(sql, src=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def duck(*names: str) -> str:
    """A WITH clause of views in DuckDB's dialect."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({text(n, 'duck')})" for n in names)

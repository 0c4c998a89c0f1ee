"""The engine's tables, derived from the given ones.

Price bars are long: one row per symbol and day. Every per-symbol operator is a window
partitioned by symbol, so symbols spread over the cluster and none needs the driver.
"""

from __future__ import annotations

#: Daily bars: a symbol per order priority.
BARS = """
SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS dt,
  min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  max_by(o_totalprice, o_orderkey) AS close, count(*) AS volume, sum(o_totalprice) AS amount
FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)"""

#: Bars of the whole market: one symbol.
INDEX_BARS = """
SELECT 'MARKET' AS symbol, CAST(o_orderdate AS DATE) AS dt,
  min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  max_by(o_totalprice, o_orderkey) AS close, count(*) AS volume, sum(o_totalprice) AS amount
FROM orders GROUP BY CAST(o_orderdate AS DATE)"""

#: Weekly bars that end on Fridays; weeks without a day have no row.
FRIDAY = ("next_day(date_sub(dt, 1), 'FRI')", "CAST(dt + CAST((12 - isodow(dt)) % 7 AS INTEGER) AS DATE)")


def weekly(bars: str, spark: bool) -> str:
    end = FRIDAY[0 if spark else 1]
    return f"""
SELECT symbol, {end} AS dt, min_by(open, dt) AS open, max(high) AS high, min(low) AS low,
  max_by(close, dt) AS close, CAST(sum(volume) AS BIGINT) AS volume, sum(amount) AS amount
FROM ({bars}) b GROUP BY symbol, {end}"""


WEEKLY_BARS = (weekly(BARS, True), weekly(BARS, False))

#: Posts: documents with counts derived from their ids.
POSTS = """
SELECT doc_id AS seq, source AS symbol, substr(text, 1, 60) AS title, text AS content, lang, source AS platform,
  (doc_id * 7) % 100 AS likes, (doc_id * 13) % 40 AS comments, (doc_id * 3) % 20 AS reposts
FROM documents"""

#: Annual facts in exact decimals: a company per supplier nation. Each is a sum over the lines of the year.
_AMOUNT = "CAST(l.l_extendedprice AS DECIMAL(18,2))"
FACT_COLUMNS = {
    "revenue": f"{_AMOUNT} * CAST(1 - l.l_discount AS DECIMAL(4,2))",
    "cost": f"{_AMOUNT} * CAST(0.55 + 2 * l.l_tax AS DECIMAL(4,2))",
    "net_profit": f"{_AMOUNT} * CAST(0.15 - l.l_discount * 2 AS DECIMAL(4,2))",
    "operating_cash_flow": f"CASE WHEN l.l_returnflag = 'R' THEN -{_AMOUNT} WHEN l.l_returnflag = 'A' THEN {_AMOUNT} ELSE CAST(0.04 AS DECIMAL(4,2)) * {_AMOUNT} END",
    "receivables": f"CASE WHEN l.l_linestatus = 'O' THEN {_AMOUNT} ELSE CAST(0.1 AS DECIMAL(4,2)) * {_AMOUNT} END",
    "inventory": f"CASE WHEN l.l_quantity > 40 THEN {_AMOUNT} ELSE CAST(0.05 AS DECIMAL(4,2)) * {_AMOUNT} END",
    "impairment": f"CASE WHEN l.l_quantity > 48 THEN CAST(0.2 AS DECIMAL(4,2)) * {_AMOUNT} ELSE CAST(0 AS DECIMAL(18,2)) END",
    "cash": f"CASE WHEN l.l_returnflag = 'N' THEN CAST(0.3 AS DECIMAL(4,2)) * {_AMOUNT} ELSE CAST(0 AS DECIMAL(18,2)) END",
    "rd_expense": f"CASE WHEN l.l_tax >= 0.06 THEN CAST(0.4 AS DECIMAL(4,2)) * {_AMOUNT} ELSE CAST(0 AS DECIMAL(18,2)) END",
    "rd_capitalised": f"CASE WHEN l.l_tax >= 0.07 AND l.l_discount > 0.04 THEN CAST(0.4 AS DECIMAL(4,2)) * {_AMOUNT} ELSE CAST(0 AS DECIMAL(18,2)) END",
    "deducted_profit": f"{_AMOUNT} * CAST(0.13 - l.l_discount * 2 AS DECIMAL(4,2))",
    "subsidies": f"CASE WHEN l.l_linenumber = 1 THEN CAST(0.05 AS DECIMAL(4,2)) * {_AMOUNT} ELSE CAST(0 AS DECIMAL(18,2)) END",
    "old_receivables": f"CASE WHEN l.l_linestatus = 'O' AND l.l_returnflag = 'N' AND l.l_discount > 0.07 THEN {_AMOUNT} ELSE CAST(0 AS DECIMAL(18,2)) END",
    "fixed_assets": f"CASE WHEN l.l_linenumber >= 4 THEN {_AMOUNT} ELSE CAST(0 AS DECIMAL(18,2)) END",
    "construction": f"CASE WHEN l.l_linenumber >= 4 AND l.l_discount > 0.05 THEN {_AMOUNT} ELSE CAST(0 AS DECIMAL(18,2)) END",
    "restricted_assets": f"CASE WHEN l.l_quantity < 2 THEN {_AMOUNT} ELSE CAST(0 AS DECIMAL(18,2)) END",
    "acquisitions": f"CASE WHEN l.l_linenumber = 7 THEN {_AMOUNT} ELSE CAST(0 AS DECIMAL(18,2)) END",
    "fair_value_assets": f"CASE WHEN l.l_linenumber = 6 THEN {_AMOUNT} ELSE CAST(0 AS DECIMAL(18,2)) END",
}
_FACT_SUMS = ",\n  ".join(f"CAST(sum({e}) AS DECIMAL(24,2)) AS {c}" for c, e in FACT_COLUMNS.items())
FACTS = f"""
SELECT n.n_name AS stock_code, year(l.l_shipdate) AS report_year,
  {_FACT_SUMS}
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
GROUP BY n.n_name, year(l.l_shipdate)"""

#: The largest five customers' share of each company's year, in per cent.
TOP_CUSTOMERS = """
SELECT stock_code AS c_code, report_year AS c_year, CAST(100 * sum(CASE WHEN rk <= 5 THEN v END) / sum(v) AS DOUBLE) AS top5_share FROM (
SELECT *, row_number() OVER (PARTITION BY stock_code, report_year ORDER BY v DESC, o_custkey) AS rk FROM (
SELECT n.n_name AS stock_code, year(l.l_shipdate) AS report_year, o.o_custkey, sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS v
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
GROUP BY n.n_name, year(l.l_shipdate), o.o_custkey) a) b GROUP BY stock_code, report_year"""

#: Fund flow per symbol and day, from events.
FLOW = """
SELECT symbol, dt, main_in, main_out, small, main_in - main_out AS main_net, total,
  total / nullif(lag(total) OVER (PARTITION BY symbol ORDER BY dt), 0) - 1 AS change_pct
FROM (SELECT user_id % 20 AS symbol, CAST(ts AS DATE) AS dt,
    coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END), 0) AS main_in,
    coalesce(sum(CASE WHEN event_type IN ('error', 'logout') THEN value END), 0) AS main_out,
    coalesce(sum(CASE WHEN event_type NOT IN ('purchase', 'error', 'logout') THEN value END), 0) AS small,
    sum(value) AS total
  FROM events GROUP BY user_id % 20, CAST(ts AS DATE)) x"""

"""Queries by recurrences, streams and grouped folds that have no plain SQL form, and those with an independent one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds
from ..operators import recurrences as rec
from ..sources.tables import BARS
from ..streaming.bars import event_bars
from .stages import Given, _named


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {"orders": spark.read.parquet(f"{sf_dir}/orders.parquet")}
    return spark.sql(_named(BARS, frames), **frames)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("symbol", F.col("dt").cast("string").alias("dt"), *(F.round(c, 4).alias(c) for c in cols))


def q_i02_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rec.ema(bars(spark, sf_dir)), "ema12", "ema26")


def q_i09_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rec.macd(bars(spark, sf_dir)), "macd", "macd_signal", "macd_hist")


def q_i16_macd_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign and growth of the histogram."""
    h = rec.macd(bars(spark, sf_dir)).selectExpr("symbol", "dt", "macd_hist AS h", "lag(macd_hist) OVER (PARTITION BY symbol ORDER BY dt) AS p")
    phase = "CASE WHEN p IS NULL OR h = p THEN 'unconfirmed' WHEN h > 0 AND h > p THEN 'bull_expanding' WHEN h > 0 THEN 'bull_shrinking' WHEN h < p THEN 'bear_expanding' ELSE 'bear_shrinking' END"
    return h.selectExpr("symbol", "CAST(dt AS STRING) AS dt", f"{phase} AS phase")


def q_t03_opposing_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = "OVER (PARTITION BY symbol ORDER BY dt)"
    h = rec.macd(bars(spark, sf_dir)).selectExpr("symbol", "dt", "macd_hist AS h", f"lag(macd_hist) {w} AS p1", f"lag(macd_hist, 2) {w} AS p2")
    return h.selectExpr("symbol", "CAST(dt AS STRING) AS dt", "coalesce(h < p1 AND p1 < p2, false) AS falling", "coalesce(h > p1 AND p1 > p2, false) AS rising")


def q_p15_zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.zigzag(bars(spark, sf_dir)).select("symbol", "pivot_no", F.col("dt").cast("string").alias("dt"), "price", "kind")


def q_st01_event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = event_bars(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return out.select("symbol", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "open", "high", "low", "close", "volume", F.round("amount", 4).alias("amount"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def q_x17_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.chunk_pack(_documents(spark, sf_dir))


def q_e05_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.selection_batches(_documents(spark, sf_dir))


def q_l07_prose_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.prose_blocks(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (q_i02_ema, q_i09_macd, q_i16_macd_phase, q_t03_opposing_macd, q_p15_zigzag, q_st01_event_bars, q_x17_chunks, q_e05_batches, q_l07_prose_blocks)}


def _fold(values: str, span: int) -> str:
    a = 2 / (span + 1)
    return f"list_reduce({values}, lambda e, x: {a!r}::DOUBLE * x + {1 - a!r}::DOUBLE * e)"


_LINES = f"""b AS ({BARS}),
l AS (SELECT symbol, dt, list(close) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS xs FROM b),
e AS (SELECT symbol, dt, {_fold('xs', 12)} AS ema12, {_fold('xs', 26)} AS ema26 FROM l),
m AS (SELECT symbol, dt, ema12 - ema26 AS macd, list(ema12 - ema26) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ms FROM e),
h AS (SELECT symbol, dt, macd, {_fold('ms', 9)} AS macd_signal, macd - {_fold('ms', 9)} AS macd_hist FROM m)"""
#: The oscillator's line and signal of every bar.
MACD = Given(lambda spark, sf_dir: rec.macd(bars(spark, sf_dir)), f"WITH {_LINES} SELECT symbol, dt, macd, macd_signal, macd_hist FROM h")

#: One bar a step: the way so far, the running extreme, and the pivot that the bar confirms.
_ZIGZAG = f"""WITH RECURSIVE b AS ({BARS}),
x AS (SELECT symbol, dt, close AS px, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM b),
z AS (
  SELECT symbol, i, n, 0 AS way, dt AS top_dt, px AS top, i AS top_i, NULL::DATE AS p_dt, NULL::DOUBLE AS p_px, NULL::VARCHAR AS p_kind FROM x WHERE i = 0 AND n >= 3
  UNION ALL
  SELECT symbol, i, n, new_way, CASE WHEN moved THEN dt ELSE top_dt END, CASE WHEN moved THEN px ELSE top END, CASE WHEN moved THEN i ELSE top_i END,
    CASE WHEN turned THEN top_dt END, CASE WHEN turned THEN top END, CASE WHEN turned THEN CASE WHEN new_way > 0 THEN 'valley' ELSE 'peak' END END
  FROM (SELECT *, CASE WHEN turned THEN CASE WHEN px > top THEN 1 ELSE -1 END ELSE way END AS new_way, turned OR (way > 0 AND px > top) OR (way < 0 AND px < top) AS moved
    FROM (SELECT x.symbol, x.i, x.n, x.dt, x.px, z.way, z.top_dt, z.top, z.top_i,
        CASE z.way WHEN 0 THEN abs((x.px - z.top) / z.top) >= 0.05 WHEN 1 THEN x.px <= z.top AND (z.top - x.px) / z.top >= 0.05 ELSE x.px >= z.top AND (x.px - z.top) / z.top >= 0.05 END AS turned
      FROM z JOIN x ON x.symbol = z.symbol AND x.i = z.i + 1) q) r),
p AS (SELECT symbol, i, p_dt, p_px, p_kind FROM z WHERE p_kind IS NOT NULL),
e AS (SELECT z.symbol, z.i + 1 AS i, z.top_dt AS p_dt, z.top AS p_px, CASE WHEN l.p_px IS NULL THEN 'valley' WHEN z.top > l.p_px THEN 'peak' ELSE 'valley' END AS p_kind
  FROM z LEFT JOIN (SELECT symbol, max_by(p_px, i) AS p_px, max_by(p_dt, i) AS p_dt FROM p GROUP BY symbol) l ON l.symbol = z.symbol
  WHERE z.i = z.n - 1 AND (l.p_dt IS NULL OR l.p_dt <> z.top_dt))
SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY i) - 1 AS pivot_no, CAST(p_dt AS VARCHAR) AS dt, p_px AS price, p_kind AS kind FROM (SELECT * FROM p UNION ALL SELECT * FROM e) u"""

#: One cut a step, at 2000 characters or the last line break or full stop beyond the half.
_CHUNKS = """WITH RECURSIVE c AS (
  SELECT doc_id, coalesce(text, '') AS t, 0 AS chunk, 0 AS lo, 0 AS hi FROM documents
  UNION ALL
  SELECT doc_id, t, chunk + 1, hi, CASE WHEN length(t) <= hi + 2000 THEN length(t) ELSE
    CASE WHEN position(chr(10) IN s) > 0 OR position('.' IN s) > 0
      THEN hi + 2000 - least(CASE WHEN position(chr(10) IN s) > 0 THEN position(chr(10) IN s) ELSE 9999 END, CASE WHEN position('.' IN s) > 0 THEN position('.' IN s) ELSE 9999 END) + 1
      ELSE hi + 2000 END END
  FROM (SELECT *, reverse(substring(t, hi + 1001, 1000)) AS s FROM c WHERE hi < length(t)) q)
SELECT doc_id, CAST(chunk - 1 AS BIGINT) AS chunk, CAST(lo AS BIGINT) AS "start", CAST(hi AS BIGINT) AS "end" FROM c WHERE chunk > 0"""

#: One block a step: it opens the next batch if it doesn't fit.
_BATCHES = """WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS b FROM documents),
c AS (
  SELECT doc_id, b, 0 AS block, 0 AS batch, length(b[1]) + 96 AS used FROM l WHERE len(b) > 0
  UNION ALL
  SELECT doc_id, b, block + 1, CASE WHEN fits THEN batch ELSE batch + 1 END, CASE WHEN fits THEN used ELSE 0 END + n + 96
  FROM (SELECT *, length(b[block + 2]) AS n, used + length(b[block + 2]) + 96 <= 4000 AS fits FROM c WHERE block + 1 < len(b)) q)
SELECT doc_id, CAST(block AS BIGINT) AS block, CAST(batch AS BIGINT) AS batch FROM c"""

#: Paragraphs by line; a long one grows sentence by sentence until the next does not fit.
_PROSE = """WITH RECURSIVE l AS (SELECT doc_id, unnest(range(len(p))) AS line, unnest(p) AS para FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents) q),
s AS (SELECT doc_id, line, para, CASE WHEN length(para) <= 260 THEN [para] ELSE string_split(regexp_replace(para, '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)) END AS parts FROM l),
c AS (
  SELECT doc_id, line, parts, 1 AS k, length(parts[1]) AS used, 0 AS block, trim(parts[1]) <> '' AS filled FROM s
  UNION ALL
  SELECT doc_id, line, parts, k + 1, CASE WHEN fits THEN CASE WHEN used > 0 THEN used + 1 + n ELSE n END ELSE n END, CASE WHEN fits THEN block ELSE block + 1 END, CASE WHEN fits THEN filled OR more ELSE more END
  FROM (SELECT *, length(parts[k + 1]) AS n, used = 0 OR used + 1 + length(parts[k + 1]) <= 260 AS fits, trim(parts[k + 1]) <> '' AS more FROM c WHERE k < len(parts)) q),
e AS (SELECT doc_id, line, block, max(used) AS chars, max(k) AS k, bool_or(filled) AS filled FROM c GROUP BY doc_id, line, block)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, block) - 1 AS block, CAST(chars AS BIGINT) AS chars FROM e WHERE filled"""
ORACLE_SQL = {
    "q_p15_zigzag": _ZIGZAG,
    "q_x17_chunks": _CHUNKS,
    "q_e05_batches": _BATCHES,
    "q_l07_prose_blocks": _PROSE,
    "q_i02_ema": f"WITH {_LINES} SELECT symbol, CAST(dt AS VARCHAR) AS dt, round(ema12, 4) AS ema12, round(ema26, 4) AS ema26 FROM e",
    "q_i09_macd": f"WITH {_LINES} SELECT symbol, CAST(dt AS VARCHAR) AS dt, round(macd, 4) AS macd, round(macd_signal, 4) AS macd_signal, round(macd_hist, 4) AS macd_hist FROM h",
    "q_i16_macd_phase": f"WITH {_LINES}, p AS (SELECT symbol, dt, macd_hist AS h, lag(macd_hist) OVER (PARTITION BY symbol ORDER BY dt) AS p FROM h) SELECT symbol, CAST(dt AS VARCHAR) AS dt, CASE WHEN p IS NULL OR h = p THEN 'unconfirmed' WHEN h > 0 AND h > p THEN 'bull_expanding' WHEN h > 0 THEN 'bull_shrinking' WHEN h < p THEN 'bear_expanding' ELSE 'bear_shrinking' END AS phase FROM p",
    "q_t03_opposing_macd": f"WITH {_LINES}, p AS (SELECT symbol, dt, macd_hist AS h, lag(macd_hist) OVER (PARTITION BY symbol ORDER BY dt) AS p1, lag(macd_hist, 2) OVER (PARTITION BY symbol ORDER BY dt) AS p2 FROM h) SELECT symbol, CAST(dt AS VARCHAR) AS dt, coalesce(h < p1 AND p1 < p2, false) AS falling, coalesce(h > p1 AND p1 > p2, false) AS rising FROM p",
    "q_st01_event_bars": "SELECT event_type AS symbol, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close, count(*) AS volume, round(sum(value), 4) AS amount FROM events GROUP BY event_type, time_bucket(INTERVAL '1 hour', ts)",
}

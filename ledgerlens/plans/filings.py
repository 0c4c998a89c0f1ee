"""Queries over the tables of filings (X06, X08, X10, X11, X24, X25, X26): numbers are written into texts, read back by the
parser, and compared with SQL over the tables that they came from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anchors
from ..operators import filings as read
from ..operators.dedupe import written
from ..sources.filings import CELLS, COST, CUSTOMERS, GROSS, HOMES, REVENUE, VENDORS
from ..sources.filings import filings

METRICS = read.FORMS["metrics"][0]
PRODUCTS = 6


def _wide(cells: DataFrame, by: list[str], metrics: tuple[str, ...]) -> DataFrame:
    return cells.groupBy(*by).agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics))


def q_x24_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(read.cells_of(filings(spark, sf_dir), read.metric_rows), ["doc_id", "section", "label"], METRICS)


def q_x10_business_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = read.cells_of(filings(spark, sf_dir), read.metric_rows, read.stock_rows, read.concentration)
    return cells.where("value IS NOT NULL").select("doc_id", "section", "label", "metric", "value")


def q_x08_table_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six products of each filing with all their numbers, and how heavily it hangs on five customers."""
    from pyspark.sql import Window

    cells = read.cells_of(filings(spark, sf_dir), read.metric_rows, read.concentration)
    of_doc, metrics = Window.partitionBy("doc_id"), ("revenue", "cost", "gross_margin", "revenue_yoy", "margin_delta")
    read_once = _wide(cells.where("section = 'segment' OR section = 'customers' AND metric = 'top_five_share'"), ["doc_id", "section", "line", "label"], (*metrics, "top_five_share"))
    rows = read_once.withColumn("customer_share", F.max("top_five_share").over(of_doc)).where("section = 'segment'").dropna(subset=["doc_id", "line", "label", *metrics])
    first = rows.withColumn("place", F.row_number().over(of_doc.orderBy("line"))).where(F.col("place") <= PRODUCTS)
    return first.select("doc_id", "label", *metrics, "place", "customer_share", F.when(F.col("customer_share") >= 50, "medium").otherwise("info").alias("severity"))


def q_x11_value_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.cells_of(filings(spark, sf_dir), read.metric_rows).where("normalized IS NOT NULL").select("doc_id", "section", "label", "metric", "normalized")


def q_x25_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.cells_of(filings(spark, sf_dir), read.concentration).select("doc_id", "section", "metric", "value")


def q_x26_scaled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wide(read.cells_of(filings(spark, sf_dir), read.statement_cells), ["doc_id", "line"], ("current", "prior"))
    return rows.select("doc_id", F.col("line").alias("row"), "current", "prior")


def q_x06_metric_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.growth_of(filings(spark, sf_dir), {k: (v,) for k, v in REVENUE.items()}).select("doc_id", "value", "growth")


#: A company's facts as a data service delivers them: millions with two decimals, pieces as they are. In ten-thousandths.
_FACTS = tuple(
    f"""SELECT concat(company, '-', report_year) AS doc_id, metric, lang, CASE WHEN metric = 'made' THEN v * 10000 ELSE CAST(round(v * u / 1000000.0) AS BIGINT) * 100000000 END AS value, CASE WHEN metric = 'made' THEN 5000 ELSE 50000000 END AS tolerance
FROM (SELECT company, lang, report_year, metric, CASE metric WHEN 'revenue' THEN revenue WHEN 'cost' THEN -cost WHEN 'gross' THEN revenue - cost ELSE made END AS v, CASE WHEN lang = 'zh' THEN 1 ELSE 1000 END AS u
  FROM {cells} {many}) f"""
    for cells, many in (("{c}", "LATERAL VIEW explode(array('revenue', 'cost', 'gross', 'made')) m AS metric"), (f"({CELLS[1]}) c", "CROSS JOIN (SELECT unnest(['revenue', 'cost', 'gross', 'made']) AS metric) m WHERE section = 'whole'"))
)
_MADE = {"en": "Production", "de": "Produktion", "fr": "Production", "es": "Producción", "zh": "生产量"}


def q_x14_fact_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed = written(filings(spark, sf_dir).select("company", "report_year", "lang", "doc_id", "text", "revenue", "cost", "made"))  # facts and texts of one pass over the lines
    facts = spark.sql(_FACTS[0], c=filed).select("doc_id", "metric", "value", F.col("tolerance").cast("long").alias("tolerance"), F.lit("").alias("digits"))
    labels = {k: {"revenue": REVENUE[k], "cost": COST[k], "gross": GROSS[k], "made": _MADE[k]} for k in HOMES.values()}
    return anchors.anchored(facts, anchors.text_amounts(filed, labels)).select("doc_id", "metric", "value", "status", "part", "amount")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (q_x24_table_rows, q_x10_business_metrics, q_x08_table_values, q_x11_value_cells, q_x25_sanitize, q_x26_scaled_cells, q_x06_metric_value, q_x14_fact_anchor)
}

_UNIT = "CASE WHEN lang = 'zh' THEN 1 ELSE 1000 END"
_DOC = "concat(company, '-', report_year) AS doc_id"
_PRINTED = "(section IN ('region', 'channel') OR (section = 'segment' AND NOT is_first) OR (section = 'industry' AND is_first))"
_ROWS = f"""SELECT {_DOC}, section, label, lang, revenue * {_UNIT} / 100.0 AS revenue, cost * {_UNIT} / 100.0 AS cost, margin / 100.0 AS gross_margin, revenue_yoy / 100.0 AS revenue_yoy,
  CASE WHEN lang <> 'fr' THEN cost_yoy / 100.0 END AS cost_yoy, margin_delta / 100.0 AS margin_delta FROM ({CELLS[1]}) c WHERE {_PRINTED}"""
_LONG = " UNION ALL ".join(f"SELECT doc_id, section, label, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ({_ROWS}) r" for m in METRICS)
_STOCK = " UNION ALL ".join(
    f"SELECT {_DOC}, 'stock' AS section, CASE WHEN section = 'whole' THEN 'whole' ELSE label END AS label, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM ({CELLS[1]}) c WHERE section = CASE WHEN lang = 'es' THEN 'whole' ELSE 'segment' END"
    for m, e in (("production", "made"), ("sales", "sold"), ("stock", "held"), ("production_yoy", "made_yoy / 100.0"), ("sales_yoy", "sold_yoy / 100.0"), ("stock_yoy", "held_yoy / 100.0"))
)
_FIVE = " UNION ALL ".join(
    f"SELECT {_DOC}, '{s}' AS section, '{s}' AS label, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM ({q[1]}) c WHERE {w}"
    for s, q in (("customers", CUSTOMERS), ("vendors", VENDORS))
    for m, e, w in (("top_five_amount", f"five * {_UNIT} / 100.0", "five > 0"), ("top_five_share", "five_share / 100.0", "true"), ("largest_amount", f"one * {_UNIT} / 100.0", "one > 0"), ("largest_share", "one_share / 100.0", "true"),
        ("related_amount", "0", "lang IN ('en', 'zh')"), ("related_share", "0", "lang IN ('en', 'zh', 'de')"))
)
#: What the filing prints beside the label, in ten-thousandths; Chinese filings don't name what was made, and only Spanish ones print it as a whole.
_PRINTED_FACT = "CASE metric WHEN 'revenue' THEN revenue WHEN 'cost' THEN -cost WHEN 'gross' THEN revenue - cost ELSE CASE WHEN lang = 'es' THEN made * 100 END END * CASE WHEN metric = 'made' OR lang = 'zh' THEN 100 ELSE 100000 END"
ORACLE_SQL = {
    "q_x14_fact_anchor": f"""WITH f AS ({_FACTS[1]}), p AS (SELECT {_DOC}, m.metric, lang, {_PRINTED_FACT} AS printed FROM ({CELLS[1]}) c CROSS JOIN (SELECT unnest(['revenue', 'cost', 'gross', 'made']) AS metric) m WHERE section = 'whole'),
j AS (SELECT f.*, p.printed, p.printed IS NOT NULL AND abs(f.value - p.printed) <= f.tolerance AS hit FROM f JOIN p ON f.doc_id = p.doc_id AND f.metric = p.metric)
SELECT doc_id, metric, CAST(value AS BIGINT) AS value, CASE WHEN hit THEN 'anchored' WHEN metric = 'made' AND lang = 'zh' THEN 'no_label' ELSE 'no_amount' END AS status,
  CASE WHEN hit THEN CASE WHEN metric = 'made' THEN 'stock' ELSE 'statement' END END AS part, CASE WHEN hit THEN CAST(printed AS BIGINT) END AS amount FROM j""",
    "q_x24_table_rows": f"SELECT doc_id, section, label, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in METRICS)} FROM ({_ROWS}) r",
    "q_x10_business_metrics": f"SELECT * FROM ({_LONG} UNION ALL {_STOCK} UNION ALL {_FIVE}) x WHERE value IS NOT NULL",
    "q_x08_table_values": f"""SELECT r.doc_id, label, CAST(revenue AS DOUBLE) AS revenue, CAST(cost AS DOUBLE) AS cost, gross_margin, revenue_yoy, margin_delta,
  CAST(row_number() OVER (PARTITION BY r.doc_id ORDER BY label) AS INT) AS place, five_share / 100.0 AS customer_share, CASE WHEN five_share >= 5000 THEN 'medium' ELSE 'info' END AS severity
FROM ({_ROWS}) r JOIN (SELECT {_DOC}, five_share FROM ({CUSTOMERS[1]}) c) s ON r.doc_id = s.doc_id
WHERE section = 'segment' AND revenue IS NOT NULL AND cost IS NOT NULL AND gross_margin IS NOT NULL AND revenue_yoy IS NOT NULL AND margin_delta IS NOT NULL QUALIFY place <= {PRODUCTS}""",
    "q_x11_value_cells": " UNION ALL ".join(f"SELECT doc_id, section, label, '{m}' AS metric, round({m} / 100.0) / 100.0 AS normalized FROM ({_ROWS}) r" for m in ("revenue", "cost")),
    "q_x25_sanitize": f"SELECT doc_id, section, metric, value FROM ({_FIVE}) x",
    "q_x26_scaled_cells": " UNION ALL ".join(
        f"SELECT {_DOC}, CAST({k} AS BIGINT) AS row, CAST({now} * {_UNIT} / 100.0 AS DOUBLE) AS current, CAST({was} * {_UNIT} / 100.0 AS DOUBLE) AS prior FROM ({CELLS[1]}) c WHERE section = 'whole'"
        for k, now, was in ((1, "revenue", "revenue_was"), (2, "-cost", "-cost_was"), (3, "(revenue - cost)", "(revenue_was - cost_was)"))
    ),
    "q_x06_metric_value": f"SELECT {_DOC}, CAST(revenue * {_UNIT} / 100.0 AS DOUBLE) AS value, revenue_yoy / 100.0 AS growth FROM ({CELLS[1]}) c WHERE section = 'whole'",
}

"""Stored answers of services, from the given tables, and what is read back from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import payloads as pl
from ..sources.tables import FACTS, FLOW
from .stages import Query
from .texts import DOCS, SENTENCES

TODAY = "1998-09-01"


def q_s07_fund_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily flow of each symbol as one answer; every seventh symbol's is an error."""
    rows = Query(FLOW, (), ("symbol", "CAST(dt AS STRING) AS showtime", "CAST(total AS STRING) AS closepx", "CAST(main_net AS STRING) AS extMainIn", "CAST(small AS STRING) AS littleNetIn"), tables=("events",)).run(spark, sf_dir)
    row = F.struct("showtime", "closepx", "extMainIn", "littleNetIn")
    code = F.when(F.col("symbol") % 7 == 6, "1").otherwise("0").alias("ResultCode")
    answers = rows.groupBy("symbol").agg(F.collect_list(row).alias("list")).select("symbol", F.to_json(F.struct(code, F.struct("list").alias("Result"))).alias("payload"))
    out = pl.fund_flow_rows(answers)
    return out.select("symbol", F.col("dt").cast("string").alias("dt"), F.round("close", 6).alias("close"), F.round("main_net", 6).alias("main_net"), F.round("small_net", 6).alias("small_net"))


def q_s10_broker_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports on ten stocks, 100 a page, newest first."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    rows = orders.select(
        (F.col("o_custkey") % 10).alias("symbol"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("title"), F.col("o_orderpriority").alias("orgSName"), F.col("o_orderstatus").alias("emRatingName"),
        F.when(F.col("o_orderkey") % 50 == 0, "not a date").otherwise(day).alias("publishDate"), F.col("o_orderkey").cast("string").alias("infoCode"),
        F.row_number().over(Window.partitionBy(F.col("o_custkey") % 10).orderBy(F.desc("o_orderdate"), "o_orderkey")).alias("n"),
    )
    row = F.struct("n", "title", "orgSName", "emRatingName", "publishDate", "infoCode")
    pages = rows.groupBy("symbol", F.floor((F.col("n") - 1) / 100).alias("page")).agg(F.array_sort(F.collect_list(row)).alias("data"))
    out = pl.broker_reports(pages.select("symbol", "page", F.to_json(F.struct("data")).alias("payload")), TODAY)
    return out.select("symbol", F.col("rk").cast("long").alias("rk"), "title", "institution", "rating", F.col("published").cast("string").alias("published"), "url")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query(FACTS, (), ("stock_code", "report_year", "revenue", "net_profit", "operating_cash_flow"), tables=("lineitem", "supplier", "nation")).run(spark, sf_dir)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's years as rows of a table, every other one of a half year."""
    half = F.explode(F.array(F.lit("-12-31 00:00:00"), F.lit("-06-30 00:00:00")))
    rows = _facts(spark, sf_dir).withColumn("end", half)
    row = F.struct(
        F.concat(F.col("report_year").cast("string"), "end").alias("REPORT_DATE"), F.col("revenue").cast("string").alias("OPERATE_INCOME"),
        F.when(F.col("net_profit") > 0, F.col("net_profit").cast("string")).otherwise("--").alias("PARENT_NETPROFIT"), F.col("operating_cash_flow").cast("string").alias("NETCASH_OPERATE"),
    )
    return rows.groupBy(F.col("stock_code").alias("symbol")).agg(F.collect_list(row).alias("data")).select("symbol", F.to_json(F.struct(F.struct("data").alias("result"))).alias("payload"))


def q_s16_data_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pl.data_center_rows(_answers(spark, sf_dir))
    return rows.select("symbol", F.substring(F.col("fields")["REPORT_DATE"], 1, 10).alias("report_date"), F.col("fields")["OPERATE_INCOME"].try_cast("double").alias("revenue"))


def q_s17_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pl.statement_rows(_answers(spark, sf_dir))
    return rows.select("symbol", "report_year", "metric_key", F.col("value").cast("double").alias("value"))


def _every_sixth(k: int) -> Column:
    return F.filter("items", lambda x: x["n"] % 6 == k)


def q_u04_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's output for each document: its first sentences as judgments, with defects by place; its evidence is those sentences."""
    units = Query(SENTENCES, (), ("doc_id", "CAST(pos AS INT) AS pos", "sentence"), "pos < 12", tables=DOCS).run(spark, sf_dir)
    evidence = units.select("doc_id", F.concat(F.lit("u"), "pos").alias("ref"), F.col("sentence").alias("text"))
    text = F.when(F.col("pos") == 3, F.concat("sentence", F.lit(" [1]"))).when(F.col("pos") == 5, F.concat("sentence", F.lit(" 987.65"))).when(F.col("pos") == 7, F.concat("sentence", F.lit(" https://x.org"))).otherwise(F.col("sentence"))
    refs = F.when(F.col("pos") == 1, F.array(F.lit("nowhere"))).when(F.col("pos") == 2, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("u"), "pos")))
    item = F.struct(F.col("pos").alias("n"), text.alias("judgment"), refs.alias("evidence_refs"), F.when(F.col("pos") == 4, "sure").otherwise("High").alias("confidence"))
    per = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    titles = [*pl.SECTIONS[:5], None]
    parts = [F.struct((F.lit(t) if t else F.when(F.col("doc_id") % 9 == 8, "other").otherwise(pl.SECTIONS[5])).alias("title"), _every_sixth(k).alias("judgments")) for k, t in enumerate(titles)]
    version = F.when(F.col("doc_id") % 9 == 7, "v0").otherwise(pl.SCHEMA_VERSION)
    whole = F.to_json(F.struct(version.alias("schema_version"), F.array(*parts).alias("sections")))
    payload = F.when(F.col("doc_id") % 9 == 6, F.lit("no answer")).otherwise(F.concat(F.lit("Here it is: "), whole))
    out = pl.model_judgments(per.select("doc_id", payload.alias("payload")), evidence)
    return out.groupBy("doc_id", "verdict").agg(F.count("*").alias("judgments"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (q_s07_fund_flow, q_s10_broker_reports, q_s16_data_center, q_s17_statements, q_u04_judgments)}

#: What went into the answers, without any of them.
ORACLE_SQL = {
    "q_s07_fund_flow": f"SELECT symbol, CAST(dt AS VARCHAR) AS dt, round(total, 6) AS close, round(main_net, 6) AS main_net, round(small, 6) AS small_net FROM ({FLOW}) f WHERE symbol % 7 <> 6",
    "q_s10_broker_reports": f"""SELECT symbol, rk, concat('order ', o_orderkey) AS title, o_orderpriority AS institution, o_orderstatus AS rating, strftime(o_orderdate, '%Y-%m-%d') AS published, concat('report/', o_orderkey, '.pdf') AS url
FROM (SELECT *, o_custkey % 10 AS symbol, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderdate DESC, o_orderkey) AS rk FROM orders
  WHERE o_orderkey % 50 <> 0 AND CAST(o_orderdate AS DATE) >= DATE '{TODAY}' - 120) r WHERE rk <= 20""",
    "q_s16_data_center": f"SELECT stock_code AS symbol, concat(CAST(report_year AS VARCHAR), e) AS report_date, CAST(revenue AS DOUBLE) AS revenue FROM ({FACTS}) f, (SELECT unnest(['-12-31', '-06-30']) AS e) h",
    "q_s17_statements": f"""SELECT stock_code AS symbol, CAST(report_year AS INT) AS report_year, metric_key, CAST(value AS DOUBLE) AS value
FROM (SELECT stock_code, report_year, unnest(['revenue', 'net_profit', 'operating_cash_flow']) AS metric_key, unnest([revenue, CASE WHEN net_profit > 0 THEN net_profit END, operating_cash_flow]) AS value FROM ({FACTS}) f) m WHERE value IS NOT NULL""",
    "q_u04_judgments": f"""WITH s AS (SELECT doc_id, pos, sentence FROM ({SENTENCES[1]}) q WHERE pos < 12),
v AS (SELECT doc_id, CASE doc_id % 9 WHEN 6 THEN 'json_parse_failed' WHEN 7 THEN 'schema_version_mismatch' WHEN 8 THEN 'sections_mismatch' ELSE
  CASE pos WHEN 1 THEN 'unknown_evidence_ref' WHEN 2 THEN 'no_evidence_refs' WHEN 3 THEN 'citation_marker' WHEN 4 THEN CASE WHEN {{0}} THEN {{1}} ELSE 'bad_confidence' END WHEN 5 THEN CASE WHEN {{0}} THEN {{1}} ELSE 'not_grounded' END WHEN 7 THEN CASE WHEN {{2}} THEN 'citation_marker' ELSE 'raw_url' END
    ELSE CASE WHEN {{0}} THEN {{1}} ELSE 'admitted' END END END AS verdict FROM s)
SELECT doc_id, verdict, CASE WHEN doc_id % 9 > 5 THEN 1 ELSE count(*) END AS judgments FROM v GROUP BY doc_id, verdict""".replace("{0}", "regexp_matches(sentence, '\\[\\^?[0-9]+\\]') OR regexp_matches(sentence, 'https?://|www\\.')").replace("{1}", "CASE WHEN regexp_matches(sentence, '\\[\\^?[0-9]+\\]') THEN 'citation_marker' ELSE 'raw_url' END").replace("{2}", "regexp_matches(sentence, '\\[\\^?[0-9]+\\]')"),
}

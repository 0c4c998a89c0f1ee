"""Rows of stored service answers: fund flow, broker reports, data-centre tables, statements, model output.

Each takes a DataFrame with a column `payload` (one JSON text per row, as a service sent it) and
gives typed rows. Answers that aren't JSON or report an error give no rows; missing fields are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FLOW_FIELDS = {
    "showtime": "dt", "closepx": "close", "ratio": "change_pct", "superNetIn": "super_net", "largeNetIn": "large_net",
    "mediumNetIn": "medium_net", "littleNetIn": "small_net", "extMainIn": "main_net",
}


def _number(text: Column) -> Column:
    """Numbers with separators, blanks or a per-cent sign."""
    return F.regexp_replace(text, "[, %]", "").try_cast("double")


def fund_flow_rows(payloads: DataFrame) -> DataFrame:
    """symbol, dt, close, change_pct and net flows by size of order, of answers with result code 0."""
    fields = ", ".join(f"{k}: string" for k in _FLOW_FIELDS)
    answer = F.from_json("payload", f"ResultCode string, Result struct<list: array<struct<{fields}>>>")
    rows = payloads.select("symbol", answer.alias("a")).where("a.ResultCode = '0'").select("symbol", F.explode("a.Result.list").alias("r"))
    numbers = [_number(F.col(f"r.{k}")).alias(v) for k, v in _FLOW_FIELDS.items() if k != "showtime"]
    return rows.select("symbol", F.to_date(F.try_to_timestamp(F.substring("r.showtime", 1, 10))).alias("dt"), *numbers).where("dt IS NOT NULL")


def broker_reports(payloads: DataFrame, today: str, months: int = 4, most: int = 20) -> DataFrame:
    """symbol, rk, title, institution, rating, published, url: reports of the last months * 30 days, in the order they
    were sent, at most `most` for each symbol. `payloads` has a page number `page`."""
    schema = "data array<struct<title: string, orgSName: string, emRatingName: string, publishDate: string, infoCode: string>>"
    rows = payloads.select("symbol", "page", F.posexplode(F.from_json("payload", schema)["data"]).alias("pos", "r"))
    day = F.to_date(F.try_to_timestamp(F.substring("r.publishDate", 1, 10)))
    recent = rows.withColumn("published", day).where(F.col("published") >= F.date_sub(F.lit(today).cast("date"), months * 30))
    ranked = recent.withColumn("rk", F.row_number().over(Window.partitionBy("symbol").orderBy("page", "pos"))).where(F.col("rk") <= most)
    url = F.when(F.length("r.infoCode") > 0, F.concat(F.lit("report/"), F.col("r.infoCode"), F.lit(".pdf")))
    text = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(""))
    return ranked.select("symbol", "rk", text("title").alias("title"), text("orgSName").alias("institution"), text("emRatingName").alias("rating"), "published", url.alias("url"))


def data_center_rows(payloads: DataFrame) -> DataFrame:
    """symbol, pos and a map of the fields of each row of `result.data`."""
    rows = F.from_json("payload", "result struct<data: array<map<string,string>>>")["result"]["data"]
    return payloads.select("symbol", F.posexplode(rows).alias("pos", "fields"))


def statement_rows(payloads: DataFrame) -> DataFrame:
    """symbol, report_year, metric_key, value of whole fiscal years (reports of 31 December), a row for each known field."""
    rows = data_center_rows(payloads).where("fields['REPORT_DATE'] LIKE '____-12-31%'")
    known = {"OPERATE_INCOME": "revenue", "PARENT_NETPROFIT": "net_profit", "NETCASH_OPERATE": "operating_cash_flow"}
    pairs = F.array(*(F.struct(F.lit(v).alias("metric_key"), F.col("fields")[k].try_cast("decimal(24,2)").alias("value")) for k, v in known.items()))
    long = rows.select("symbol", F.substring(F.col("fields")["REPORT_DATE"], 1, 4).cast("int").alias("report_year"), F.explode(pairs).alias("m"))
    return long.select("symbol", "report_year", "m.metric_key", "m.value").where("value IS NOT NULL")


SCHEMA_VERSION = "fulltext_analysis.v1"
SECTIONS = ("business", "products", "customers", "finance", "risks", "outlook")


def model_judgments(outputs: DataFrame, evidence: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """doc_id, section, pos, judgment, confidence, verdict of each judgment of a model's output (doc_id, payload).

    `evidence` has (doc_id, ref, text). The output is refused as a whole if its JSON, version or section titles are
    wrong (one row with a verdict and no judgment). A judgment is refused if it has no references, one that
    doesn't exist, a citation mark or an address; it is left out if its confidence is none of high, medium, low
    or a number of it (two digits or more) is in none of its evidence; else it is admitted."""
    item = "struct<judgment: string, evidence_refs: array<string>, confidence: string>"
    answer = F.from_json(F.regexp_extract("payload", r"(?s)(\{.*\})", 1), f"schema_version string, sections array<struct<title: string, judgments: array<{item}>>>")
    parsed = outputs.select("doc_id", answer.alias("a"))
    wrong = (
        F.when(F.col("a").isNull() | (F.col("a.schema_version").isNull() & F.col("a.sections").isNull()), "json_parse_failed")
        .when(~F.col("a.schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), "schema_version_mismatch")
        .when(~F.transform("a.sections", lambda s: s["title"]).eqNullSafe(F.array(*map(F.lit, sections))), "sections_mismatch")
    )
    parsed = parsed.withColumn("wrong", wrong)
    refused = parsed.where("wrong IS NOT NULL").selectExpr("doc_id", "CAST(NULL AS STRING) AS section", "CAST(NULL AS INT) AS pos", "CAST(NULL AS STRING) AS judgment", "CAST(NULL AS STRING) AS confidence", "wrong AS verdict")
    rows = parsed.where("wrong IS NULL").select("doc_id", F.explode("a.sections").alias("s")).select("doc_id", F.col("s.title").alias("section"), F.posexplode("s.judgments").alias("pos", "j"))
    rows = rows.select("doc_id", "section", "pos", F.trim("j.judgment").alias("judgment"), F.col("j.evidence_refs").alias("refs"), F.lower(F.trim("j.confidence")).alias("confidence"))
    # a judgment meets the evidence it names only
    named = rows.select("doc_id", "section", "pos", F.explode(F.array_distinct("refs")).alias("ref")).join(evidence.select("doc_id", "ref", "text"), ["doc_id", "ref"], "left")
    seen = named.groupBy("doc_id", "section", "pos").agg(F.count_if(F.col("text").isNull()).alias("unknown"), F.flatten(F.collect_list(F.regexp_extract_all("text", F.lit("[0-9]+(?:[.][0-9]+)?"), F.lit(0)))).alias("known"))
    rows = rows.join(seen, ["doc_id", "section", "pos"], "left")
    numbers = F.filter(F.regexp_extract_all("judgment", F.lit("[0-9]+(?:[.][0-9]+)?"), F.lit(0)), lambda x: F.length(x) >= 2)
    verdict = (
        F.when(F.coalesce(F.size("refs"), F.lit(0)) <= 0, "no_evidence_refs")
        .when(F.col("unknown") > 0, "unknown_evidence_ref")
        .when(F.col("judgment").rlike(r"\[\^?[0-9]+\]"), "citation_marker")
        .when(F.col("judgment").rlike(r"https?://|www\."), "raw_url")
        .when(~F.coalesce(F.col("confidence").isin("high", "medium", "low"), F.lit(False)), "bad_confidence")
        .when(F.coalesce(F.col("judgment"), F.lit("")) == "", "empty")
        .when(F.size(F.array_except(numbers, F.col("known"))) > 0, "not_grounded")
        .otherwise("admitted")
    )
    return rows.select("doc_id", "section", "pos", "judgment", "confidence", verdict.alias("verdict")).unionByName(refused)

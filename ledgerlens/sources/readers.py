"""File sources: bars from CSV or JSON columns, items from JSON lines, notes from Markdown.

Bad rows don't fail a scan: values that can't be read become NULL and rows without a needed
value are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Other names of bar columns.
ALIASES = {"date": "dt", "datetime": "dt", "day": "dt", "vol": "volume", "turnover": "amount", "code": "symbol"}
NUMBERS = ("open", "high", "low", "close", "volume", "amount")


def normalise_bars(raw: DataFrame, symbol: str | None = None, limit: int | None = None, seq: str | None = None) -> DataFrame:
    """Renamed and typed bars without incomplete rows; of repeated days the last row (by `seq`, or as read) stays, and
    of each symbol the last `limit` days."""
    named = raw.select(*(F.col(f"`{c}`").alias(ALIASES.get(c.lower().lstrip("﻿"), c.lower().lstrip("﻿"))) for c in raw.columns))
    if "symbol" not in named.columns:
        named = named.withColumn("symbol", F.lit(symbol))
    typed = named.select("symbol", F.to_date(F.try_to_timestamp(F.col("dt").cast("string"))).alias("dt"), *(F.expr(f"try_cast({c} AS DOUBLE)").alias(c) if c in named.columns else F.lit(None).cast("double").alias(c) for c in NUMBERS), (F.col(seq) if seq else F.monotonically_increasing_id()).alias("_seq"))
    whole = typed.na.drop(subset=["symbol", "dt", "open", "high", "low", "close"])
    once = whole.withColumn("_r", F.row_number().over(Window.partitionBy("symbol", "dt").orderBy(F.desc("_seq"), F.desc("close")))).where("_r = 1")
    if limit is not None:
        once = once.withColumn("_b", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt")))).where(F.col("_b") <= limit).drop("_b")
    return once.drop("_r", "_seq")


def read_bars_csv(spark: SparkSession, path: str, symbol: str | None = None, **kw) -> DataFrame:
    return normalise_bars(spark.read.option("header", True).csv(path), symbol, **kw)


def read_bars_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents of parallel column lists: {"symbol": ..., "date": [...], "open": [...], ...}."""
    lists = ", ".join(f"{c}: array<double>" for c in NUMBERS)
    raw = spark.read.schema(f"symbol string, date array<string>, {lists.replace(':', '')}").option("multiLine", True).json(path)
    cols = ["date", *NUMBERS]
    rows = raw.select("symbol", F.explode(F.arrays_zip(*cols)).alias("r")).select("symbol", *(F.col(f"r.{c}").alias(c) for c in cols))
    return normalise_bars(rows)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Content items, one JSON object a line; unknown fields are kept as text in `extra`."""
    schema = "title string, content string, author string, url string, publish_time string, likes int, comments int, reposts int, extra map<string,string>"
    return spark.read.schema(schema).json(path)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes with JSON front matter between `---` lines: path, meta (map), body."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("note"))
    front = F.regexp_extract("note", r"(?s)\A---\s*\n(.*?)\n---\s*\n?", 1)
    body = F.regexp_replace("note", r"(?s)\A---\s*\n.*?\n---\s*\n?", "")
    return raw.select("path", F.from_json(front, "map<string,string>").alias("meta"), body.alias("body"))


def newest(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The newest file whose name matches: path and time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime")
    return files.agg(F.max_by("path", "modificationTime").alias("path"), F.max("modificationTime").alias("modified"))

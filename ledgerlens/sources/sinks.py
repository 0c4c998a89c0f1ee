"""Sinks: tables with an integrity hash, upserts by key, JSON sidecars, Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_hash(df: DataFrame) -> DataFrame:
    """`df` with row_hash, of all columns in order of name."""
    return df.withColumn("row_hash", F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new`, and those of `old` whose key it doesn't have."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` (with row_hash) that `old` doesn't hold unchanged."""
    return new.join(old.select("row_hash"), "row_hash", "left_anti")


def write_bars(df: DataFrame, path: str) -> None:
    """One folder per symbol; the committer makes the write atomic."""
    df.write.mode("overwrite").partitionBy("symbol").parquet(path)


def write_sidecar(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, group: str, title: str, lines: str, order: str) -> DataFrame:
    """A Markdown text per group: a heading and its lines in order (a report's lines, so few per group)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, lines))), lambda x: F.concat(F.lit("- "), x[lines]))
    return df.groupBy(group, title).agg(F.concat(F.lit("# "), F.first(title), F.lit("\n"), F.array_join(ordered, "\n")).alias("markdown")).select(group, "markdown")

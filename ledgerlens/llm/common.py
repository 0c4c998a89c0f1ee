"""Helpers shared by the training-data operators: tables, scratch space, streams of groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session whose executors are threads of this machine
    (tests, a notebook) may go without one; on a cluster rows written to local folders would be lost."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: it is computed once, and a lost
    executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/ledgerlens-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no remainder modulo 5 (null ids are never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sorted_groups(batches: Iterable[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by `by`, each whole, whatever the batch limits."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tab = pa.Table.from_batches([batch])
        if rest is not None:
            tab = pa.concat_tables([rest, tab])
        key = tab.column(by).to_pylist()
        start = 0
        for i in range(1, len(key)):
            if key[i] != key[start]:
                yield tab.slice(start, i - start)
                start = i
        rest = tab.slice(start)
    if rest is not None:
        yield rest

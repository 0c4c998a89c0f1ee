"""All queries of the analytics operators by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import cards, dedupe, editorial, evidence, facts, filings, folds, forums, increments, market, more, news, packs, payloads, scoring, texts, topics
from .plans.stages import Query

_DECLARED: dict[str, Query] = {**market.QUERIES, **scoring.QUERIES, **texts.QUERIES, **facts.QUERIES, **more.QUERIES, **cards.QUERIES, **evidence.QUERIES, **editorial.QUERIES}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**{name: q.run for name, q in _DECLARED.items()}, **folds.QUERIES, **dedupe.QUERIES, **payloads.QUERIES, **topics.QUERIES, **filings.QUERIES, **forums.QUERIES, **news.QUERIES, **packs.QUERIES, **increments.QUERIES}
ORACLE_SQL: dict[str, str] = {**{name: q.to_sql() for name, q in _DECLARED.items()}, **folds.ORACLE_SQL, **dedupe.ORACLE_SQL, **payloads.ORACLE_SQL, **topics.ORACLE_SQL, **filings.ORACLE_SQL, **forums.ORACLE_SQL, **news.ORACLE_SQL, **packs.ORACLE_SQL, **increments.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.FLAGSHIP.run(spark, sf_dir)

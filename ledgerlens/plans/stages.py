"""Operators as stages of column expressions.

A stage adds columns computed from the columns before it. Expressions are plain SQL, so one
definition gives both the lazily composed DataFrame (`apply`) and an equivalent query for
another engine (`to_sql`), which the correctness check runs beside it. Where dialects differ an
expression is a pair (Spark, other).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..functions.lexicon import expand
from ..operators.dedupe import written

Expr = str | tuple[str, str]
DATES = frozenset({"dt", "latest_gap", "first_touch", "published", "week"})


def over(rows: str | None = None, by: str = "symbol", order: str = "dt") -> str:
    """A window per `by`, ordered by `order`; `rows` like "19 PRECEDING AND CURRENT ROW"."""
    frame = f" ROWS BETWEEN {rows}" if rows else ""
    return f"OVER (PARTITION BY {by} ORDER BY {order}{frame})"


def last(n: int) -> str:
    """The last n rows, this one included."""
    return over(f"{n - 1} PRECEDING AND CURRENT ROW")


def pick(e: Expr, spark: bool) -> str:
    chosen = expand(e if isinstance(e, str) else e[0 if spark else 1], spark)
    return chosen.replace("starts_with(", "startswith(") if spark else chosen


@dataclass(frozen=True)
class Stage:
    """`columns`: new columns by name; `where`: rows to keep after that; `spread`: on Spark, rows that can't matter to this stage and
    those behind it go before it, in many tasks."""

    columns: dict[str, Expr] = field(default_factory=dict)
    where: Expr | None = None
    spread: Callable[[DataFrame], DataFrame] | None = None


def stage(where: Expr | None = None, **columns: Expr) -> Stage:
    return Stage(columns, where)


def apply(df: DataFrame, stages: Iterable[Stage]) -> DataFrame:
    for s in stages:
        if s.spread is not None:
            df = s.spread(df)
        if s.columns:
            kept = [f"`{c}`" for c in df.columns if c not in s.columns]
            df = df.selectExpr(*kept, *(f"{pick(e, True)} AS {n}" for n, e in s.columns.items()))
        if s.where is not None:
            df = df.where(pick(s.where, True))
    return df


class Source(Protocol):
    """What gives a DataFrame and the SQL for the same rows."""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame: ...

    def to_sql(self) -> str: ...


@dataclass(frozen=True)
class Given:
    """A source whose two forms are written independently of each other."""

    frame: Callable[[SparkSession, str], DataFrame]
    sql: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.frame(spark, sf_dir)

    def to_sql(self) -> str:
        return self.sql


@dataclass(frozen=True)
class Query:
    """A source (SQL over the input tables), stages, and the columns to return.

    `final` may replace the plain projection by a whole SELECT over the last stage, named `t`.
    """

    source: Expr
    stages: tuple[Stage, ...] = ()
    select: tuple[Expr, ...] = ()
    where: Expr | None = None
    final: Expr | None = None
    tables: tuple[str, ...] = ("orders",)
    replaces: tuple[str, ...] = ()  # columns of the source that a stage redefines
    uses: Mapping[str, Source] = field(default_factory=dict)  # results of other queries, by the names the source calls them
    once: tuple[str, ...] = ()  # what `final` needs of the last stage, written once for a `final` that reads it several times

    def _columns(self, spark: bool) -> list[str]:
        """Dates are returned as text, which every engine writes alike."""
        return [f"CAST({c} AS VARCHAR(10)) AS {c}" if c in DATES else c for c in (pick(c, spark) for c in self.select)]

    def _final(self, spark: bool) -> str:
        if self.final is not None:
            return pick(self.final, spark)
        cols = ", ".join(self._columns(spark)) or "*"
        return f"SELECT {cols} FROM t" + (f" WHERE {pick(self.where, spark)}" if self.where is not None else "")

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables}
        frames |= {name: q.run(spark, sf_dir) for name, q in self.uses.items()}
        df = apply(spark.sql(_named(pick(self.source, True), frames), **frames), self.stages)
        if self.final is None:
            if self.where is not None:
                df = df.where(pick(self.where, True))
            return df.selectExpr(*self._columns(True)) if self.select else df
        if self.once:
            df = written(df.selectExpr(*self.once))
        return spark.sql(_named(self._final(True), {"t": df}), t=df)

    def to_sql(self) -> str:
        parts, prev, seen = [f"{name} AS ({q.to_sql()})" for name, q in self.uses.items()], "s0", set(self.replaces)
        parts.append(f"s0 AS ({pick(self.source, False)})")
        for k, s in enumerate(self.stages, 1):
            new = ", ".join(f"{pick(e, False)} AS {n}" for n, e in s.columns.items())
            again = sorted(seen & s.columns.keys())
            seen |= s.columns.keys()
            body = f"SELECT *{f' EXCLUDE ({', '.join(again)})' if again else ''}{', ' + new if new else ''} FROM {prev}"
            if s.where is not None:
                body = f"SELECT * FROM ({body}) WHERE {pick(s.where, False)}"
            parts.append(f"s{k} AS ({body})")
            prev = f"s{k}"
        parts.append(f"t AS (SELECT * FROM {prev})")
        final = self._final(False)
        return "WITH " + ",\n".join(parts) + (",\n" + final[5:] if final.startswith("WITH ") else "\n" + final)


def nested(source: Expr, stages: Iterable[Stage], spark: bool) -> str:
    """Stages over a source as one subquery (no stage may redefine a column)."""
    sql = pick(source, spark)
    for s in stages:
        new = ", ".join(f"{pick(e, spark)} AS {n}" for n, e in s.columns.items())
        sql = f"SELECT *{', ' + new if new else ''} FROM ({sql}) x"
        if s.where is not None:
            sql = f"SELECT * FROM ({sql}) x WHERE {pick(s.where, spark)}"
    return sql


def _named(sql: str, frames: dict[str, DataFrame]) -> str:
    """Put {name} for each table after FROM or JOIN, which `spark.sql` binds to its DataFrame."""
    import re

    names = "|".join(sorted(frames, key=len, reverse=True))
    return re.sub(rf"\b(FROM|JOIN)\s+({names})\b", r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}"))

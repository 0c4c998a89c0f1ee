"""Mixing sources to target weights by iterative proportional fitting.

Every document falls into a cell of source, language and topic. Tokens are summed per cell;
raking scales the cells' inclusion probabilities to the target tokens of each source, then
language, then topic, caps them at 1, and repeats until all marginals hold. Documents are then
sampled independently with the probability of their cell, by a hash of their id, so a rerun
keeps the same ones and the expected tokens of each marginal are the targets.

Targets are the given weights of the levels of an axis (`weights`, e.g. {"source": {"web": 3, "books": 1}};
levels without a weight get no tokens) or, for an axis without weights, tempered shares: the share of a
level in the corpus to a power below 1, so large sources are used less and small ones more. They are
multiplied by the budget (`KEEP` of all tokens); no level is to give more than nine tenths of its tokens,
and what it can't give goes to the others in proportion. If an axis can't reach the budget, all
axes get the smaller one.

Every source, language and topic is a stratum of its own, however many there are. Up to `DRIVER_CELLS`
cells (levels of the marginals multiplied) are raked as an array and broadcast; more are raked by
the same rule on Spark, a join and a grouped sum for each marginal and round, and joined to the
documents. `gap` tells how far the worst marginal is from its target, as a share of it, when raking ends
(conflicting targets can't all be met; the last axis then holds best).

Defined results: null source, language and text count as `(none)`, `(none)` and no tokens;
documents without tokens are kept with the probability of their cell like any other; a marginal
whose target cannot be reached (too few tokens) gets all it has; repeated rows of one id are
kept or left together; rows of null ids are drawn by their text. Other columns are passed on unread; an empty
table gives no rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

DRIVER_CELLS = 20_000
KEEP = 0.5
POWERS = (0.6, 0.7, 0.8)
AXES = ("s", "l", "t")
COLUMNS = ("source", "lang", "topic")
NONE = "(none)"
MOST = 0.9
Weights = dict[str, dict[str, float]]


def n_tokens() -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(r"\S+")), F.lit(0)).cast("long")


def topic(tokens: Column) -> Column:
    """A coarse content type by shares of signs and by length."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    signs = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return (
        F.when(tokens == 0, "empty")
        .when(signs(r"[|\t]") * 10 >= tokens, "table")
        .when(signs(r"[{}=<>;\\]") * 3 >= tokens, "code")
        .when(signs("[0-9]") * 10 >= F.length(text), "figures")
        .when(signs("[!?\"\u201e\u201c\u00ab\u00bb]") * 10 >= tokens, "talk")
        .when(tokens < 100, "short")
        .when(tokens >= 1000, "long")
        .otherwise("prose")
    )


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = 500, tol: float = 1e-9) -> np.ndarray:
    """Inclusion probabilities of the cells of `tokens` (one axis per marginal), at most 1, with
    which the expected tokens of each marginal meet its target as far as the cells allow."""
    p = np.where(tokens > 0, min(1.0, targets[0].sum() / max(tokens.sum(), 1)), 0.0)
    for _ in range(rounds):
        before = p.copy()
        for axis, target in enumerate(targets):
            now = _marginal(p * tokens, axis)
            scale = np.divide(target, now, out=np.ones_like(now), where=now > 0)
            shape = [1] * tokens.ndim
            shape[axis] = -1
            p = np.minimum(1.0, p * scale.reshape(shape))
        if np.abs(p - before).max(initial=0) < tol:
            break
    return p


def _marginal(x: np.ndarray, axis: int) -> np.ndarray:
    return x.sum(axis=tuple(a for a in range(x.ndim) if a != axis))


def gap_of(p: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray]) -> float:
    """The largest distance of a marginal's expected tokens from its target, as a share of the target."""
    return max((float((np.abs(_marginal(p * tokens, a) - t) / np.where(t > 0, t, 1)).max(initial=0)) for a, t in enumerate(targets)), default=0.0)


def shared_out(totals: np.ndarray, share: np.ndarray, total: float, most: float = MOST) -> np.ndarray:
    """Targets in proportion to `share`, none above `most` of what its level has; what such levels
    can't take goes to the others in proportion."""
    target = np.zeros_like(totals, float)
    free = (totals > 0) & (share > 0)
    left = min(total, most * totals[free].sum())
    while free.any():
        part = np.where(free, share, 0.0)
        part = part / part.sum() * left
        over = free & (part > most * totals)
        if not over.any():
            return target + part
        target[over] = most * totals[over]
        left, free = left - target[over].sum(), free & ~over
    return target


def tempered(totals: np.ndarray, power: float, total: float, most: float = MOST) -> np.ndarray:
    return shared_out(totals, np.where(totals > 0, totals, 0.0) ** power * (totals > 0), total, most)


def shared_out_on_spark(totals: DataFrame, axis: str, total: float) -> DataFrame:
    """(axis, target) as `shared_out` gives it, of the levels of `totals` (axis, n, share)."""
    totals = materialize(totals.where("n > 0 AND share > 0"), "totals")
    left = min(total, MOST * (totals.agg(F.sum("n")).first()[0] or 0.0))
    factor, capped = 0.0, -1
    while True:
        # the factor only grows, so a level that can't take its share never can
        over = F.lit(factor) * F.col("share") > MOST * F.col("n")
        held, free, now = totals.agg(F.sum(F.when(over, F.col("n"))), F.sum(F.when(~over, F.col("share"))), F.count_if(over)).first()
        if not free or now == capped:
            return totals.select(axis, F.when(over, MOST * F.col("n")).otherwise(factor * F.col("share")).alias("target"))
        factor, capped = max(factor, (left - MOST * (held or 0.0)) / free), now


def shares_on_spark(cells: DataFrame, axis: str, power: float, weights: dict[str, float] | None) -> DataFrame:
    """(axis, n, share) of all levels."""
    totals = cells.groupBy(axis).agg(F.sum("n").cast("double").alias("n"))
    if weights is None:
        return totals.withColumn("share", F.pow("n", F.lit(power)))
    given = cells.sparkSession.createDataFrame(sorted(weights.items()), f"{axis} string, share double")
    return totals.join(given, axis, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))


def tempered_on_spark(cells: DataFrame, axis: str, power: float, total: float) -> DataFrame:
    return shared_out_on_spark(shares_on_spark(cells, axis, power, None), axis, total)


def _forget(df: DataFrame) -> None:
    """Remove a scratch table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def rake_on_spark(cells: DataFrame, keep: float, powers: tuple[float, float, float], weights: Weights, base: float, rounds: int = 500, tol: float = 1e-9) -> tuple[DataFrame, float]:
    """(s, l, t, prob) of all `cells` (s, l, t, n), and the gap: what `rake` does, with no more than one row
    a task or a few numbers in the driver."""
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    shares = [materialize(shares_on_spark(cells, a, w, weights.get(c)), "shares") for a, c, w in zip(AXES, COLUMNS, powers, strict=True)]
    reach = [MOST * (x.where("share > 0").agg(F.sum("n")).first()[0] or 0.0) for x in shares]
    budget = min(keep * total, *reach)
    targets = [materialize(x.select(a).join(shared_out_on_spark(x, a, budget), a, "left").na.fill(0.0), "targets") for a, x in zip(AXES, shares, strict=True)]
    state = materialize(cells.where("n > 0").withColumn("prob", F.lit(min(1.0, budget / max(total, 1)))), "rake")
    for _ in range(rounds):
        after, scales = state.withColumn("_before", F.col("prob")), []
        for axis, target in zip(AXES, targets, strict=True):
            sums = after.groupBy(axis).agg(F.sum(F.col("prob") * F.col("n")).alias("now"))
            scale = F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(1.0)
            scales.append(materialize(sums.join(target, axis).select(axis, scale.alias("_scale")), "scale"))
            after = after.join(scales[-1], axis).withColumn("prob", F.least(F.lit(1.0), F.col("prob") * F.col("_scale"))).drop("_scale")
        after = materialize(after, "rake")
        change = after.agg(F.max(F.abs(F.col("prob") - F.col("_before")))).first()[0] or 0.0
        for old in (state, *scales):
            _forget(old)
        state = after.drop("_before")
        if change < tol:
            break
    gap = 0.0
    for axis, target in zip(AXES, targets, strict=True):
        sums = state.groupBy(axis).agg(F.sum(F.col("prob") * F.col("n")).alias("now")).join(target, axis)
        off = F.abs(F.col("now") - F.col("target")) / F.when(F.col("target") > 0, F.col("target")).otherwise(1.0)
        gap = max(gap, sums.agg(F.max(off)).first()[0] or 0.0)
    without = cells.where("n = 0").select(*AXES, F.lit(base).alias("prob"))
    return state.select(*AXES, "prob").unionByName(without), gap


@dataclass
class Mix:
    cells: list[dict] | DataFrame  # source, lang, topic, prob
    gap: float

    def attach(self, docs: DataFrame) -> DataFrame:
        """`docs` with _tokens, _source, _lang, _topic, _prob and _kept."""
        if isinstance(self.cells, DataFrame):
            cells = self.cells.toDF("_source", "_lang", "_topic", "_prob")
        else:
            schema = "array<struct<source:string,lang:string,topic:string,prob:double>>"
            lit = F.from_json(F.lit(json.dumps(self.cells)), schema)
            # at most DRIVER_CELLS
            cells = F.broadcast(docs.sparkSession.range(1).select(F.inline(lit)).toDF("_source", "_lang", "_topic", "_prob"))
        rows = docs.withColumn("_tokens", n_tokens()).withColumn("_topic", topic(F.col("_tokens")))
        rows = rows.withColumn("_source", _stratum("source")).withColumn("_lang", _stratum("lang"))
        draw = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text"))), 11) / float(1 << 53)
        joined = rows.join(cells, ["_source", "_lang", "_topic"])
        return joined.withColumn("_kept", draw < F.col("_prob"))


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NONE))


def fit_mix(docs: DataFrame, keep: float = KEEP, powers: tuple[float, float, float] = POWERS, weights: Weights | None = None) -> Mix:
    weights = weights or {}
    rows = docs.withColumn("_tokens", n_tokens())
    rows = rows.select(_stratum("source").alias("s"), _stratum("lang").alias("l"), topic(F.col("_tokens")).alias("t"), F.col("_tokens").alias("n"))
    # one pass over the texts; a row for each cell and task at most is shuffled
    cells = materialize(rows.groupBy(*AXES).agg(F.sum("n").alias("n")), "cells")
    base = min(1.0, keep)  # of cells without tokens
    levels = cells.agg(*(F.count_distinct(c) for c in AXES)).first()
    if math.prod(levels) > DRIVER_CELLS:
        return Mix(*rake_on_spark(cells, keep, powers, weights, base))
    cells = sorted(cells.collect())
    axes = [sorted({r[k] for r in cells}) for k in AXES]
    index = [{v: i for i, v in enumerate(a)} for a in axes]
    at = [tuple(x[r[k]] for x, k in zip(index, AXES, strict=True)) for r in cells]
    tokens = np.zeros([len(a) for a in axes])
    for where, r in zip(at, cells, strict=True):
        tokens[where] = r["n"]
    totals = [_marginal(tokens, a) for a in range(3)]
    shares = [np.array([weights[c].get(v, 0.0) for v in levels]) if c in weights else n**power * (n > 0) for c, levels, n, power in zip(COLUMNS, axes, totals, powers, strict=True)]
    budget = min(keep * tokens.sum(), *(MOST * n[x > 0].sum() for n, x in zip(totals, shares, strict=True)))
    targets = [shared_out(n, x, budget) for n, x in zip(totals, shares, strict=True)]
    p = rake(tokens, targets)
    out = [{"source": r["s"], "lang": r["l"], "topic": r["t"], "prob": float(p[where]) if r["n"] else base} for where, r in zip(at, cells, strict=True)]
    return Mix(out, gap_of(p, tokens, targets))


def mix_documents(docs: DataFrame, keep: float = KEEP, weights: Weights | None = None) -> DataFrame:
    """doc_id, n_tokens, source, lang and topic strata, prob, weight (prob over the budget's share), kept, for every row."""
    out = fit_mix(docs, keep, weights=weights).attach(docs.select("doc_id", "text", "lang", "source"))
    return out.select(
        "doc_id",
        F.col("_tokens").alias("n_tokens"),
        F.col("_source").alias("source_stratum"),
        F.col("_lang").alias("lang_stratum"),
        F.col("_topic").alias("topic"),
        F.col("_prob").alias("prob"),
        (F.col("_prob") / keep).alias("weight"),
        F.col("_kept").alias("kept"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir))

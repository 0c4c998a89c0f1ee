from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerlens.llm import op08_mixing as M


def corpus(spark, n=600):
    rng = random.Random(1)
    data = []
    for i in range(n):
        text = " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 150))) + rng.choice(["", " a | b", " x@y.zz", "!! "])
        data.append((i, text, rng.choices(["en", "de", None], [6, 3, 1])[0], rng.choices(["a", "b", "c", None], [10, 3, 2, 1])[0], len(text)))
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_rake_meets_all_marginals():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 100, (4, 3, 5)).astype(float)
    targets = [M.tempered(tokens.sum(axis=tuple(b for b in range(3) if b != a)), 0.7, 0.5 * tokens.sum()) for a in range(3)]
    p = M.rake(tokens, targets)
    assert (p >= 0).all() and (p <= 1).all()
    for a in range(3):
        assert np.allclose((p * tokens).sum(axis=tuple(b for b in range(3) if b != a)), targets[a], rtol=1e-6)


def test_tempered_targets_are_within_reach():
    totals = np.array([1000.0, 10.0, 0.0, 5.0])
    t = M.tempered(totals, 0.1, 700.0)
    assert abs(t.sum() - 700) < 1e-9 and (t <= 0.9 * totals + 1e-9).all()
    assert M.tempered(np.zeros(3), 0.5, 0.0).sum() == 0


def test_expected_tokens_equal_targets_and_the_sample_follows(spark):
    docs = corpus(spark)
    got = M.mix_documents(docs).toPandas()
    assert sorted(got.doc_id) == list(range(600))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(n == len(texts[i].split()) for i, n in zip(got.doc_id, got.n_tokens, strict=True))
    for column, power in zip(("source_stratum", "lang_stratum", "topic"), M.POWERS, strict=True):
        g = got.assign(e=got.n_tokens * got.prob).groupby(column)
        n, e = g.n_tokens.sum(), g.e.sum()
        assert np.allclose(e, M.tempered(n.to_numpy(float), power, M.KEEP * n.sum()), rtol=1e-4)
    assert abs(got[got.kept].n_tokens.sum() / got.n_tokens.sum() - M.KEEP) < 0.1
    again = M.mix_documents(docs.repartition(5)).toPandas()
    assert set(got[got.kept].doc_id) == set(again[again.kept].doc_id)


def scaled(cells, targets, rounds=3000):
    """Proportional fitting of a plain table {(source, lang, topic): tokens}, one level after the other."""
    p = {c: min(1.0, sum(targets[0].values()) / sum(cells.values())) for c, n in cells.items() if n}
    for _ in range(rounds):
        for axis, target in enumerate(targets):
            for level, want in target.items():
                own = [c for c in p if c[axis] == level]
                have = sum(p[c] * cells[c] for c in own)
                for c in own if have else ():
                    p[c] = min(1.0, p[c] * want / have)
    return p


@pytest.mark.parametrize("on_spark", [False, True])
def test_given_weights_against_plain_fitting(spark, monkeypatch, on_spark):
    if on_spark:
        monkeypatch.setattr(M, "DRIVER_CELLS", 0)
    weights = {"source": {"a": 1.0, "b": 1.0, "c": 2.0}, "lang": {"en": 1.0, "de": 1.0, M.NONE: 0.5}}
    docs = corpus(spark, 500)
    mixed = M.fit_mix(docs, 0.2, weights=weights)
    got = mixed.attach(docs).toPandas()
    cells = {k: int(n) for k, n in got.groupby(["_source", "_lang", "_topic"])._tokens.sum().items()}
    totals = [{} for _ in range(3)]
    for c, n in cells.items():
        for axis in range(3):
            totals[axis][c[axis]] = totals[axis].get(c[axis], 0) + n
    budget = 0.2 * sum(cells.values())
    targets = []
    for axis, name in enumerate(M.COLUMNS):
        share = [weights[name].get(x, 0.0) if name in weights else n ** M.POWERS[axis] for x, n in totals[axis].items()]
        targets.append(dict(zip(totals[axis], M.shared_out(np.array(list(totals[axis].values()), float), np.array(share), budget), strict=True)))
    assert targets[0][M.NONE] == 0 and abs(targets[0]["c"] - 2 * targets[0]["a"]) < 1e-6
    want = scaled(cells, targets, 300)
    for key, p in got.groupby(["_source", "_lang", "_topic"])._prob.first().items():
        assert abs(p - want.get(key, 0.2)) < 1e-4, key
    assert mixed.gap < 1e-3


def test_conflicting_targets_are_told(spark):
    data = [(1, "w " * 100, "en", "a", 1), (2, "w " * 100, "de", "b", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    assert M.fit_mix(docs, weights={"source": {"a": 1.0}, "lang": {"de": 1.0}}).gap > 0.5
    assert M.fit_mix(docs).gap < 1e-6


def test_odd_and_empty(odd, empty):
    got = M.mix_documents(odd).collect()
    assert len(got) == 8 and all(0 <= r.prob <= 1 for r in got)
    assert M.mix_documents(empty).count() == 0


def test_every_source_meets_its_own_target(spark):
    """Also beyond the 500 sources that once had strata of their own."""
    data = [(i, "w " * (1 + i % 7 + 20 * (i % 560 == 0)), "en", f"s{i % 560}", 1) for i in range(1680)]
    got = M.mix_documents(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")).toPandas()
    g = got.assign(e=got.n_tokens * got.prob).groupby("source_stratum")
    n, e = g.n_tokens.sum(), g.e.sum()
    assert len(n) == 560
    assert np.allclose(e, M.tempered(n.to_numpy(float), M.POWERS[0], M.KEEP * n.sum()), rtol=1e-4)


def test_raking_on_spark_gives_the_same(spark, monkeypatch):
    docs = corpus(spark, 300)
    want = {r.doc_id: r.prob for r in M.mix_documents(docs).collect()}
    monkeypatch.setattr(M, "DRIVER_CELLS", 0)
    got = {r.doc_id: r.prob for r in M.mix_documents(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert M.mix_documents(docs.limit(0)).count() == 0


def test_tempered_on_spark(spark):
    for totals, power, total in (([1000.0, 10.0, 5.0, 80.0], 0.1, 700.0), ([9.0, 1.0], 0.7, 5.0), ([3.0, 2.0], 0.5, 50.0), ([1000.0, 40.0, 2.0, 1.0], 0.3, 150.0)):
        cells = spark.createDataFrame([(str(i), t) for i, t in enumerate(totals)], "s string, n double")
        got = sorted((r.s, r.target) for r in M.tempered_on_spark(cells, "s", power, total).collect())
        assert np.allclose([t for _, t in got], M.tempered(np.array(totals), power, total))


def test_null_ids_are_drawn_one_by_one(spark):
    docs = corpus(spark, 400).selectExpr("CAST(NULL AS long) doc_id", "concat(text, ' ', doc_id) text", "'en' lang", "'a' source", "n_chars")
    got = M.mix_documents(docs).toPandas()
    assert abs(got[got.kept].n_tokens.sum() / got.n_tokens.sum() - M.KEEP) < 0.1

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from ledgerlens.llm import op07_quality as M


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    p = {"E": rng.normal(size=(M.WIDTH, M.HIDDEN)) / 9, "e": rng.normal(size=M.HIDDEN), "V": rng.normal(size=(M.HIDDEN, M.ATTEND)), "U": rng.normal(size=(M.HIDDEN, M.ATTEND)), "w": rng.normal(size=M.ATTEND), "c": rng.normal(size=M.HIDDEN), "b": rng.normal(size=1)}
    x, first, y = rng.normal(size=(9, M.WIDTH)), np.array([0, 1, 4, 9]), np.array([1.0, 0, 1])

    def loss():
        s = M._forward(p, x, first)["y"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    g = M._gradient(p, M._forward(p, x, first), first, y)
    for k in p:
        for at in [tuple(rng.integers(0, n) for n in p[k].shape) for _ in range(4)]:
            old = p[k][at]
            p[k][at] = old + 1e-6
            up = loss()
            p[k][at] = old - 1e-6
            down = loss()
            p[k][at] = old
            assert abs((up - down) / 2e-6 - g[k][at]) < 1e-5


def corpus(spark, n=400):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(10, 300))]
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = M.score_quality(docs, M.fit(docs, labels)).join(labels, "doc_id").join(docs.select("doc_id", M.held_out(docs.doc_id).alias("out")), "doc_id").where("out").collect()
    assert len(got) > 40 and sum((r.score >= M.THRESHOLD) == r.quality for r in got) >= 0.97 * len(got)


def test_passages_cover_the_whole_text():
    texts = ["", "a" * M.PASSAGE, "b" * (M.PASSAGE + 1), "c" * (5 * M.PASSAGE - 1)]
    feats, first = M.passages(texts)
    assert np.diff(first).tolist() == [1, 1, 2, 5] and feats.shape == (9, M.WIDTH) and np.isfinite(feats).all()
    alone = np.concatenate([M.passages([t])[0] for t in texts])
    assert np.allclose(alone, feats)


def test_odd_and_empty(spark, odd, empty):
    docs, labels = corpus(spark, 60)
    model = M.fit(docs, labels)
    got = M.score_quality(odd, model).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert M.score_quality(empty, model).count() == 0
    assert M.fit(docs, labels.where("false")) is None and M.fit(empty, labels) is None
    assert {r.score for r in M.score_quality(odd, None).collect()} == {0.5}


def test_training_passages_are_bounded_and_scoring_reads_all(spark, monkeypatch):
    docs, labels = corpus(spark, 60)
    long = spark.createDataFrame([(1, "Calm words here. " * 20_000, "en", "s", 1)], docs.schema)
    first = next(iter(M._described([pa.RecordBatch.from_pydict({"doc_id": [1], "label": [1.0], "text": [long.first().text]})])))
    assert len(first.column("bag")[0].as_py()) == 4 * M.WIDTH * M.TRAIN_PASSAGES
    model = M.fit(docs, labels)
    for text in ("", "short", "WORDS!! " * 900, "Calm words. " * 300 + "LOUD!! " * 200):  # against one passage at a time
        feats, starts = M.passages([text])
        x = np.clip((feats - model.mean) / model.scale, -8, 8)
        h = [np.tanh(row @ model.p["E"] + model.p["e"]) for row in x]
        a = np.exp([float((np.tanh(v @ model.p["V"]) * M._sigmoid(v @ model.p["U"])) @ model.p["w"]) for v in h])
        z = sum(w * v for w, v in zip(a / a.sum(), h, strict=True))
        assert len(feats) == max(1, -(-len(text) // M.PASSAGE))
        assert abs(float(M._sigmoid(z @ model.p["c"] + model.p["b"])[0]) - float(model.score(feats, starts)[0])) < 1e-6


def test_a_hot_id_gives_a_few_texts(spark, monkeypatch):
    from ledgerlens.llm import op07_quality as op

    hot = next(i for i in range(1, 100) if not spark.range(1).select(op.held_out(op.F.lit(i))).first()[0])
    docs = spark.createDataFrame([(hot, f"text number {i} of the hot id", "en", "a", 0) for i in range(600)] + [(1000 + i, f"other text {i}", "en", "a", 0) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(hot, 1, 0)] * 50 + [(1000 + i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    bags = []
    monkeypatch.setattr(op, "learn", lambda b, y: bags.extend(b))
    op.fit(docs, labels)
    assert op.TEXTS_OF_ID < len(bags) <= 300 + op.TEXTS_OF_ID

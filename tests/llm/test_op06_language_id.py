from __future__ import annotations

import random
import re

from ledgerlens.llm import op06_language_id as M

STEMS = {"en": "the and tion ing er th wh ly".split(), "de": "der die und ung keit sch ü ß".split(), "fr": "le la et eau é è ment que".split()}


def corpus(spark, n=300, seed=1):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        text = " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80)))
        data.append((i, text, lang, "s", len(text)))
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_held_out_accuracy_and_no_rejects(spark):
    docs = corpus(spark)
    got = M.identify(docs, M.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert not any(r.rejected for r in got) and all(0 <= r.score <= 1 for r in got)


def test_strange_text_is_rejected_and_rows_pass_whole(spark):
    docs = corpus(spark)
    model = M.fit(docs)
    strange = spark.createDataFrame([(1, "жшщ юя " * 40, None, "x", 0), (2, "12 !!", None, None, None), (3, None, "en", "s", 0), (4, "the and ing the tion and " * 20, "en", "s", 5)], docs.schema)
    assert {r.doc_id: r.rejected for r in M.identify(strange, model).collect()} == {1: True, 2: True, 3: True, 4: False}
    kept = M.keep_identified(strange, model)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [4]


FOREIGN = """kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto
wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem
watu wote wamezaliwa huru hadhi na haki zao ni sawa wote wamejaliwa akili na dhamiri hivyo yapasa watendeane kindugu
minden emberi lény szabadon születik és egyenlő méltósága és joga van az emberek ésszel és lelkiismerettel bírván
όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα είναι προικισμένοι με λογική""".splitlines()


def test_foreign_texts_are_rejected_and_mixed_ones_are_not(spark):
    docs = corpus(spark)
    model = M.fit(docs)
    rows = [r for r in docs.collect()]
    by = {k: [r.text for r in rows if r.lang == k] for k in STEMS}
    mixed = [by["en"][i] + " " + by["de"][i] for i in range(20)] + [by["fr"][i] + " " + by["en"][i] + " 12 !!" for i in range(20)]
    long = [by["en"][0] * 400]
    texts = FOREIGN + [t + " " + t for t in FOREIGN] + mixed + long
    got = {r.doc_id: r for r in M.identify(spark.createDataFrame([(i, t, None, "x", 0) for i, t in enumerate(texts)], docs.schema), model).collect()}
    assert [got[i].rejected for i in range(10)] == [True] * 10
    assert not any(got[i].rejected for i in range(10, len(texts)))
    assert {got[i].lang_pred for i in range(10)} <= set(STEMS) and all(got[i].lang_pred in ("en", "de") for i in range(10, 30))


def nearest(text, model):
    """The language by one dot product after the other, from n-grams counted one by one."""
    low, grams = text.lower(), {}
    words = re.findall(r"[^\W\d_]+", low)
    for w in words:
        padded = " " + w + " "
        for g in [*w, *(padded[i : i + 2] for i in range(len(padded) - 1)), *(padded[i : i + 3] for i in range(len(padded) - 2))]:
            grams[g] = grams.get(g, 0) + 1
    return sum(grams.values()), max(range(len(model.of)), key=lambda k: model.vectors(next(iter(M.gram_counts([text])))[1])[0] @ model.centroids[k])


def test_against_brute_force(spark):
    docs = corpus(spark, 150)
    model = M.fit(docs)
    got = {r.doc_id: r for r in M.identify(docs, model).collect()}
    for r in docs.collect()[:60]:
        n, k = nearest(r.text, model)
        assert got[r.doc_id].lang_pred == model.languages[model.of[k]]
        assert n == next(iter(M.gram_counts([r.text])))[1].sum()


def test_same_model_at_any_partitioning(spark):
    docs = corpus(spark, 120)
    a, b = M.fit(docs.repartition(1)), M.fit(docs.repartition(7))
    assert (a.centroids == b.centroids).all() and (a.idf == b.idf).all()


def test_counts_do_not_depend_on_buffers(monkeypatch):
    texts = ["The Über and", "", None, "a b", "x" * 50]
    whole = [c for _, counts, _ in M.gram_counts(texts) for c in counts]
    monkeypatch.setattr(M, "_DOCS", 1)
    single = [c for _, counts, _ in M.gram_counts(texts) for c in counts]
    assert all((a == b).all() for a, b in zip(whole, single, strict=True))


def test_odd_and_empty(spark, odd, empty):
    model = M.fit(odd)
    got = M.identify(odd, model).collect()
    assert len(got) == 8 and {r.lang_pred for r in got if r.doc_id in (1, 2, 5, 6)} == {"und"}
    assert M.fit(empty) is None and M.identify(empty, None).count() == 0
    assert {r.lang_pred for r in M.identify(odd, None).collect()} == {"und"}
    assert M.keep_identified(odd, None).count() == 0


def test_a_hot_id_neither_fills_nor_empties_the_sample(spark, monkeypatch):
    """A third of the rows under one id, and a text that is there a thousand times, leave the bound and the languages alone."""
    from ledgerlens.llm import op06_language_id as op

    monkeypatch.setattr(op, "TRAIN_ROWS", 400)
    seen = []
    learn = op._cluster
    monkeypatch.setattr(op, "_cluster", lambda x, k: (seen.append(len(x)), learn(x, k))[1])
    words = {"en": "the of and with that from", "de": "der die und mit nicht auch"}
    text = lambda lang, i: " ".join(words[lang].split()[j % 6] + "aeiou"[(i * j) % 5] for j in range(30)) + f" {i}"
    hot = next(i for i in range(1, 100) if not spark.range(1).select(op.held_out(op.F.lit(i))).first()[0])
    rows = [(hot, text("en", i), "en", "a", 0) for i in range(1500)] + [(1000 + i, text("de", i), "de", "a", 0) for i in range(1500)] + [(None, text("en", i), "en", "a", 0) for i in range(500)] + [(7, text("de", 3), "de", "a", 0)] * 1000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert op.fit(df, per_language=200).languages == ["de", "en"]
    assert sum(seen) <= 500 and min(seen) >= 50

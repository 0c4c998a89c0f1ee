from __future__ import annotations

import random

import corpus_pipeline as P
from ledgerlens.llm.common import materialize
from ledgerlens.llm.op04_decontamination import contaminated
from ledgerlens.llm.op06_language_id import fit, identify
from ledgerlens.llm.op08_mixing import mix_documents
from ledgerlens.llm.op10_ngram_join import ngram_jaccard_join


def words(rng, n, lang):
    stems = {"en": "the and tion ing er".split(), "de": "der die ung keit sch".split()}[lang]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def build(spark, path):
    rng = random.Random(1)
    items = [words(rng, 30, "en") for _ in range(5)]
    data = []
    for i in range(300):
        lang = rng.choice(["en", "de"])
        text = words(rng, rng.randrange(20, 90), lang)
        if i % 20 == 3:
            text += " " + rng.choice(items)
        data.append((i, text, lang, f"s{i % 4}", len(text)))
    for i in range(300, 330):  # copies and near copies
        t = data[rng.randrange(300)][1]
        data.append((i, t + (" extra" if i % 2 else ""), "en", "s0", len(t)))
    data += [(330, "12 34 !!", "en", "s0", 8), (331, None, "en", "s0", None)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_apply_the_operators_decisions(spark, tmp_path):
    build(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    expect = [
        lambda d: {r.doc_id for r in identify(d, fit(d)).where("NOT rejected").collect()},
        lambda d: {r.class_id for r in ngram_jaccard_join(d).collect()},
        lambda d: {r.doc_id for r in d.collect()} - {r.doc_id for r in contaminated(d, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()},
        lambda d: {r.doc_id for r in mix_documents(d).where("kept").collect()},
        lambda d: {r.doc_id for r in d.collect()},
    ]
    sizes = []
    for (name, stage), want in zip(P.STAGES, expect, strict=True):
        kept = want(docs)
        out = materialize(stage(spark, docs, str(tmp_path)), name)
        assert {r.doc_id for r in out.select("doc_id").collect()} == kept and out.count() == len(kept)
        if name != "shard":
            assert out.columns == docs.columns
        sizes.append(out.count())
        docs = out
    assert sizes[0] == 330 and sizes[1] < sizes[0] and sizes[2] <= sizes[1] - 10 and sizes[3] < sizes[2] and sizes[4] == sizes[3]


def test_run_gives_the_same(spark, tmp_path):
    build(spark, str(tmp_path))
    out = P.run(spark, str(tmp_path))
    assert {"doc_id", "shard", "slot"} <= set(out.columns) and out.count() > 50


def test_stages_on_odd_rows_and_empty_tables(spark, odd, empty, tmp_path):
    """Null ids and texts, empty and very long texts, repeats, clashing columns: no crash, whole rows, the same columns."""
    spark.createDataFrame([(1, "Hello there, you."), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {"language_id": {3, 4, None}, "near_duplicates": {1, 3, 4, 5, 6}, "decontaminate": {1, 2, 3, 5, 6}}
    rows = {tuple(r) for r in odd.collect()}
    for name, stage in P.STAGES:
        out = stage(spark, odd, str(tmp_path))
        got = out.collect()
        if name != "shard":
            assert out.columns == odd.columns and {tuple(r) for r in got} <= rows
        assert name not in kept or {r.doc_id for r in got} == kept[name], name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name

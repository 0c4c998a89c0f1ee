from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm.op13_filter_audit import audit, inverted, labelled, mask_of, parity_sums

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def split(text):
    out, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            out, word = out + [word] * (word != ""), ""
        else:
            word += c
    return out


def brute(docs, labels):
    """Each order applied document by document."""
    fails = []
    for i, text, _, source, _ in docs:
        t, words = text or "", split(text or "")
        smaller = any((u or "") == t and j is not None and (i is None or j < i) for j, u, *_ in docs)
        flags = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": smaller}
        good, toxic = (i is not None and any(j == i and row[k] == 1 for j, *row in labels) for k in (0, 1))
        fails.append((source or "", {f for f, bad in flags.items() if bad}, good, toxic))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, kept = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                failed = [d for d in mine if f in d[1]]
                out[part, "".join(order), step] = [len(kept), len(gone), len(failed) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[f] += len(gone)
                left = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def result(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_equals_every_order_applied(spark):
    rng = np.random.default_rng(11)
    words = ["alpha", "Beta", "gamma", "d#", "épsilon", "ZETA", "x\x0by", "n b"]
    docs = []
    for i in range(160):
        n = int(rng.choice([0, 3, 199, 200, 230]))
        t = " ".join(rng.choice(words[: int(rng.integers(1, 9))], n)) if rng.random() < 0.6 else "\t".join(f"w{j}" for j in range(n))
        docs.append((i, t, "en", f"s{int(rng.integers(3))}", 0))
    docs += [(int(rng.integers(300)), docs[int(rng.integers(160))][1], "en", f"s{int(rng.integers(3))}", 0) for _ in range(60)]
    docs += [(None, "", None, None, None), (None, "only here", "en", "", 1), (None, "only here", "en", "s1", 1), (7, None, "en", "s1", 0), (7, None, "en", "s1", 0), (9, "W x " * 30_000, "en", "s2", 0)]
    labels = [(int(rng.integers(300)), int(rng.integers(2)), int(rng.integers(2))) for _ in range(200)] + [(None, 1, 1), (3, None, None)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(4).withColumn("mask", F.lit("x")).withColumn("part", F.lit("x")).withColumn("n", F.lit(5))
    got = result(audit(df, spark.createDataFrame(labels, LABELS)))
    want = brute(docs, labels)
    assert got == want and len(got) == 600 * 4


def test_transform_is_inverted_exactly(spark):
    counts = [int(c) for c in np.random.default_rng(2).integers(0, 10**15, 32)]
    masks = spark.createDataFrame([("p", 0, 1, m, c) for m, c in enumerate(counts)], "part string, good int, toxic int, mask int, n long")
    got = {r.label: r.cells for r in inverted(parity_sums(masks)).collect()}
    assert got == {"all": counts, "toxic": counts}


def test_bounds_of_the_filters():
    text = lambda n, k: " ".join(f"w{i % k}" for i in range(n)).encode()
    assert mask_of(text(200, 100), 10**6) == 0 and mask_of(text(199, 199), 10**6) == 1 and mask_of(text(200, 99), 10**6) == 2
    assert mask_of(b"AB" + b" x1" * 200, 100) & 4 == 0 and mask_of(b"ABC" + b" x1" * 200, 100) & 4 == 4
    assert mask_of(b"", 0) == 1 and mask_of("ÄÖÜ 100 €".encode(), 9) == 1 and mask_of(b"a|b", 3) == 9


def test_empty_tables(spark, empty, make):
    labels = spark.createDataFrame([], LABELS)
    assert audit(empty, labels).count() == 0
    got = audit(make([None, "", "a"]), labels)
    assert got.count() == 3 * 600 and dict(got.dtypes)["step"] == "int" and got.where("kept > 0 AND step = 5").count() == 0


def test_salted_labels_are_not_broadcast(spark):
    failed = spark.createDataFrame([(k, "p", b"d", 0, k % 8) for k in range(20)], "doc_id long, part string, digest binary, mask int, salt int")
    known = labelled(failed, spark.createDataFrame([(k, 1, 0) for k in range(0, 20, 2)], LABELS))
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert known.selectExpr("count(*)", "sum(good)", "sum(toxic)").first()[:] == (20, 10, 0)

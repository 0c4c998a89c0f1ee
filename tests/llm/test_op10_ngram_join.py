from __future__ import annotations

import random
import re
from itertools import combinations

import pytest

from ledgerlens.llm import op10_ngram_join as M
from ledgerlens.llm.components import connected_components


def brute(texts):
    """(copy class of each text, links between classes, component of each class)."""
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = frozenset(tuple(w[k : k + M.K]) for k in range(max(1, len(w) - M.K + 1))) if w else frozenset([("", t or "")])
    head = {}
    for i, s in sets.items():
        head.setdefault(s, i)
    reps = {i: s for s, i in head.items()}
    live = [i for i, s in reps.items() if not any(x[0] == "" for x in s)]
    links = [(a, b) for a, b in combinations(sorted(live), 2) if 10 * len(reps[a] & reps[b]) >= 8 * len(reps[a] | reps[b])]
    root = {i: i for i in reps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: head[s] for i, s in sets.items()}, links, {i: find(i) for i in reps}


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    words = lambda k: [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi".split()) + str(rng.randrange(40)) for _ in range(k)]
    passage = words(30)
    texts = [None, "", "  ", "one two", "One  two!", "a b c d e", "..."]
    for _ in range(n):
        base = words(rng.randrange(40, 160))
        if rng.random() < 0.4:
            base[5:5] = passage
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            near = list(base)
            for _ in range(rng.randrange(0, 4)):
                near[rng.randrange(len(near))] = "edit" + str(rng.randrange(999))
            texts.append(" ".join(near) if rng.random() < 0.8 else " ".join(base).upper())
    hub = words(120)  # a large group of near copies
    for i in range(25):
        near = list(hub)
        near[rng.randrange(len(near))] = f"own{i}"
        texts.append(" ".join(near))
    return texts


@pytest.mark.parametrize("small", [1000, 4])
def test_equals_brute_force(make, small):
    """Also when nearly all buckets must be split and dealt over blocks."""
    texts = corpus()
    copy, links, root = brute(texts)
    got = {r.doc_id: r for r in M.ngram_jaccard_join(make(texts), small).collect()}
    assert sorted(got) == list(range(len(texts)))
    n = dict.fromkeys(root, 0)
    for a, b in links:
        n[a], n[b] = n[a] + 1, n[b] + 1
    assert sum(n.values()) > 100
    for i in got:
        assert (got[i].copy_id, got[i].n_links, got[i].class_id) == (copy[i], n[copy[i]], root[copy[i]]), texts[i]
        assert got[i].n_copies == sum(c == copy[i] for c in copy.values())


def test_one_of_each_group_stays(make):
    texts = corpus(20, 2)
    _, _, root = brute(texts)
    kept = M.keep_one_of_each(make(texts))
    assert kept.columns == make(texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def test_recall_is_the_promised_one():
    for levels in (1, 3, 6, 12):
        runs = M.runs_for(levels=levels)
        assert M.recall(runs, levels) >= M.TARGET > M.recall(runs - 1, levels)


def common_passage(n=120):
    """Texts that share half of their words and are otherwise different, and a few near copies of some."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(n):
        own = passage + [word() for _ in range(50)]
        texts.append(" ".join(own))
        if i % 10 == 0:
            own[80] = word()
            texts.append(" ".join(own))
    return texts


def test_large_buckets_are_split_until_small(make, monkeypatch):
    """A common passage puts all texts into one bucket; near copies are still found on deeper levels."""
    texts = common_passage()
    levels = []
    find = M.find_buckets

    def watched(*args):
        out = find(*args)
        levels.append((out[2], out[0].groupBy("bucket").count().agg({"count": "max"}).first()[0]))
        return out

    monkeypatch.setattr(M, "find_buckets", watched)
    _, links, _ = brute(texts)
    got = {r.doc_id: r.n_links for r in M.ngram_jaccard_join(make(texts), 3).collect()}
    assert len(links) == 12 and {i for i, n in got.items() if n} == {i for pair in links for i in pair}
    assert len(levels) == 2 and levels[0][0] > M.LEVELS


def test_units_are_bounded_by_tokens(make, monkeypatch):
    texts = corpus(25, 3)
    want = sorted(map(tuple, M.ngram_jaccard_join(make(texts)).collect()), key=str)
    monkeypatch.setattr(M, "WEIGHT", 500)
    assert sorted(map(tuple, M.ngram_jaccard_join(make(texts)).collect()), key=str) == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300) if i % 100 != 99] + [(0, 0), (5, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 100 * 100 for i in range(300)}


def test_odd_and_empty(odd, empty):
    got = M.ngram_jaccard_join(odd).collect()
    assert len(got) == 8
    assert [r.n_copies for r in got if r.doc_id == 4] == [3, 3]
    kept = M.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == [(1, 0), (3, 300_000), (4, 17), (5, 7), (6, 4)]
    assert M.ngram_jaccard_join(empty).count() == 0 and M.keep_one_of_each(empty).count() == 0


def mixed_ids(spark, near=""):
    """Seven groups whose rows have null or shared ids; `near` is appended to some copies."""
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e, f, g = (text() for _ in range(7))
    data = [(None, a), (None, a), (None, a + near), (None, b), (None, c), (7, d), (7, e), (7, e), (3, f), (9, f + near), (9, g), (None, g.upper())]
    return [a, b, c, d, e, f, g], spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_rows_of_null_and_shared_ids_stay_or_go_by_their_own_group(spark):
    groups, docs = mixed_ids(spark)
    kept = [(r.doc_id, r.text.removesuffix(" more")) for r in M.keep_one_of_each(docs).collect()]
    want = list(zip([None, None, None, 7, 7, 3, 9], groups, strict=True))
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_links_of_null_and_shared_ids(spark):
    groups, docs = mixed_ids(spark, " more")
    got = M.ngram_jaccard_join(docs).collect()
    assert len({r.class_key for r in got}) == len(groups) and len({r.copy_key for r in got}) == len(groups) + 2
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_copies, r.n_links) for r in got if r.n_links) == [(0, 0, 1, 1), (0, 0, 2, 1), (0, 0, 2, 1), (3, 3, 1, 1), (9, 3, 1, 1)]
    kept = sorted((r.doc_id or 0, r.text.removesuffix(" more")) for r in M.keep_one_of_each(docs).collect())
    assert kept == sorted(zip([0, 0, 0, 7, 7, 3, 9], groups, strict=True))


def test_a_large_batch_is_sketched_in_parts():
    """A task holds the texts, sets and paths of some rows at a time, however many rows a batch has."""
    texts = [f"alpha beta gamma delta eps zeta {i}" for i in range(5000)]
    batch = M.pa.record_batch([M.pa.array(range(5000), M.pa.int64()), M.pa.array(texts), M.pa.array([b""] * 5000, M.pa.binary())], names=["doc_id", "text", "text_hash"])
    out = list(M._sketch([batch, batch.slice(0, 0)]))
    assert max(b.num_rows for b in out) <= 512
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(5000))
    assert M.pa.Table.from_batches(out).column("key").to_pylist() == [M._key(t, "") for t in M._sets(texts)]

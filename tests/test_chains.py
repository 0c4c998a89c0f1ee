"""Chains of rules: scores of the documented cases, demotion, ties, and a walk over every item in plain Python."""

from __future__ import annotations

import random

from ledgerlens.operators.chains import Chain, Hop, manifest, plain, relevance

CHAIN = Chain("capacity_to_pricing", (Hop("memory", ("memory demand", "dram"), True), Hop("capacity", ("12 inch capacity", "wafer starts"), True), Hop("supply", ("tight supply",)), Hop("product", ("image sensors",))), "image sensors")
ITEMS = "seq long, text string, name string, source string"


def rated(spark, texts, chains=(CHAIN,), products=("Image Sensors",), background=("semiconductor",), name="Acme Corp"):
    df = spark.createDataFrame([(i, t, name, "s") for i, t in enumerate(texts)], ITEMS)
    return {r.seq: r for r in relevance(df, chains, products, background).collect()}


def test_documented_classes(spark):
    got = rated(spark, [
        "ACMECORP wins an order", "DRAM and memory demand: 12inch capacity is short, tight supply", "dram up, wafer starts down", "Dram demand in the semiconductor sector", "semiconductor index up", "weather", None, "",
    ])
    told = [(r.relevance_class, r.confidence, r.chain_id, r.sections, r.tone) for _, r in sorted(got.items())]
    assert told == [
        ("company_event", 0.95, "company_direct", "4.1,4.2,4.3", ""),
        ("industry_chain_relevant", 0.95, "capacity_to_pricing", "4.1", "cautious"),
        ("industry_chain_relevant", 0.95, "capacity_to_pricing", "4.1", "cautious"),
        ("sector_background", 0.25, "sector_background", "4.1", ""),  # a required hop is missing: 0.35 is not enough
        ("sector_background", 0.25, "sector_background", "4.1", ""),
        *[("noise", 0.0, "noise", "", "")] * 3,
    ]
    assert got[1].hops == "memory:memorydemand,capacity:12inchcapacity,supply:tightsupply,product:stock"


def test_a_product_alone_is_watched_only_and_the_first_of_equal_chains_counts(spark):
    open_ = Chain("open", (Hop("x", ("xxx",)),), "image sensors")
    assert [(r.chain_id, r.confidence, r.tone) for r in rated(spark, ["nothing"], (open_, Chain("twin", open_.hops, "image sensors"))).values()] == [("open", 0.4, "watch_variable_only")]
    assert rated(spark, ["xxx"], (open_,), products=())[0].relevance_class == "noise"  # 0.33
    assert rated(spark, ["xxx"], (), background=("xxx",))[0].relevance_class == "sector_background"


def brute(text, name, chains, products, background):
    low, ours = plain(text), {plain(p) for p in products}
    if plain(name) in low:
        return "company_event", 0.95
    best = 0.0
    for c in chains:
        news = [any(plain(w) in low for w in h.words) for h in c.hops]
        required = [n for n, h in zip(news, c.hops) if h.needs_news]
        score = 0.25 + 0.35 * bool(required) + {0: 0, 1: 0.08}.get(sum(news), 0.2) + 0.15 * (plain(c.product) in ours)
        best = max(best, 0.35 if not all(required) else min(round(score, 2), 0.95))
    return ("industry_chain_relevant", best) if best >= 0.4 else ("sector_background", 0.25) if any(plain(b) in low for b in background) else ("noise", 0.0)


def test_equals_plain_python(spark):
    rng = random.Random(8)
    vocabulary = ["aa", "b b", "cc", "dd", "AaB", "ee", "f'f", "g\\g", "acme corp", "zz"]
    chains = tuple(Chain(f"c{k}", tuple(Hop(f"h{j}", tuple(rng.sample(vocabulary[:8], rng.randrange(1, 4))), rng.random() < 0.4) for j in range(rng.randrange(1, 5))), rng.choice(["aa", "zz", ""])) for k in range(6))
    texts = [" ".join(rng.choices(vocabulary if rng.random() < 0.2 else vocabulary[:8] + ["qq"], k=rng.randrange(0, 6))) for _ in range(300)]
    got = rated(spark, texts, chains, ("AA",), ("ee", "qq"))
    assert {i: (r.relevance_class, r.confidence) for i, r in got.items()} == {i: brute(t, "Acme Corp", chains, ("AA",), ("ee", "qq")) for i, t in enumerate(texts)}


def test_manifest_names_each_chain_once(spark):
    df = spark.createDataFrame([(3, "acme corp", "Acme Corp", "a"), (1, "acmecorp", "Acme Corp", "a"), (2, "dram wafer starts", "Acme Corp", "a"), (9, "acme corp", "Acme Corp", "b")], ITEMS)
    got = manifest(relevance(df, (CHAIN,), (), ()).join(df.select("seq", "source"), "seq"), "source")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "company_direct", 0.95, 1), ("b", "company_direct", 0.95, 9)]

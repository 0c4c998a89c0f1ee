"""Duplicate groups and near cards against plain loops; sources and claims against the documented tables."""

from __future__ import annotations

import random

import pytest

from ledgerlens.operators.dedupe import greedy_kept, shared_key_groups
from ledgerlens.plans import dedupe, texts
from ledgerlens.plans.stages import apply


def test_groups_follow_any_shared_key(spark):
    rng = random.Random(2)
    pairs = [(i, f"k{rng.randrange(90)}" if rng.random() < 0.9 else None) for i in range(80) for _ in range(2)]
    pairs += [(i, f"chain{i // 2}") for i in range(100, 130)] + [(i, f"chain{(i + 1) // 2}") for i in range(100, 130)]
    root = {i: i for i, _ in pairs}
    changed = True
    while changed:
        changed = False
        for a, ka in pairs:
            for b, kb in pairs:
                if ka is not None and ka == kb and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    got = {r.id: r.root for r in shared_key_groups(spark.createDataFrame(pairs, "id long, key string")).collect()}
    assert got == root and got[129] == 100
    assert shared_key_groups(spark.createDataFrame([], "id long, key string")).count() == 0


def test_a_card_goes_only_if_it_is_near_one_that_stays(spark):
    words = [f"w{i}" for i in range(20)]
    chain = [" ".join([*words[k:], *(f"x{j}" for j in range(k))]) for k in range(4)]  # each near the next, the ends apart
    units = [(1, p, s) for p, s in enumerate(chain)] + [(2, 0, "a b c"), (2, 1, "a b c"), (3, 0, "one two three four"), (3, 5, "Four three two one")]
    df = spark.createDataFrame(units, "doc_id long, pos long, sentence string")
    sets = {(d, p): set(s.lower().split()) for d, p, s in units}
    kept, want = {}, {}
    for d, p in sorted(sets):
        near = [q for q in kept.get(d, []) if len(sets[d, p]) >= 4 and len(sets[d, p] & sets[d, q]) >= 0.85 * len(sets[d, p] | sets[d, q])]
        if near:
            want[d, p] = min(near)
        else:
            kept.setdefault(d, []).append(p)
    got = {(r.doc_id, r.pos): r.kept_pos for r in greedy_kept(dedupe.near_pairs(df)).collect()}
    assert got == want and (1, 1) in got and (1, 2) not in got and got[3, 5] == 0


@pytest.mark.parametrize(
    ("url", "kind", "credit", "usage"),
    [
        ("https://www.sec.gov/x", "exchange_announcement", 98, "core_fact_allowed"),
        ("https://filings.sec.gov/x", "exchange_announcement", 98, "core_fact_allowed"),
        ("https://acme.com/investor/2024", "company_ir", 88, "core_fact_allowed"),
        ("https://acme.com/investors", "unknown_web", 30, "lead_only"),
        ("company.example.com", "company_official", 85, "core_fact_allowed"),
        ("http://research.acme.com/a", "broker_research", 72, "professional_observation"),
        ("https://m.reuters.com/a", "mainstream_media", 65, "professional_observation"),
        ("https://heise.de", "industry_media", 55, "professional_observation"),
        ("https://blog.acme.com", "social_discussion", 35, "discussion_only"),
        ("https://nosec.gov", "unknown_web", 30, "lead_only"),
        ("no host here", "missing_source", 10, "excluded"),
        (None, "missing_source", 10, "excluded"),
    ],
)
def test_sources_by_register(spark, url, kind, credit, usage):
    r = apply(spark.createDataFrame([(url,)], "url string"), texts.CREDIT).first()
    assert (r.source_type, r.source_credit, r.usage) == (kind, credit, usage)


def test_claims_by_the_pair_score(spark):
    """Against all pairs of low and better claims."""
    bits = ["MIT License applies.", "Apache License text", "version two", "password here", "mail a@b", "worthless stuff", "x | y", "released"]
    rng = random.Random(4)
    rows = [(i, rng.choice(["en", "de"]), f"src{s}", s, " ".join(rng.sample(bits, rng.randrange(1, 4))), rng.randrange(60)) for i in range(160) for s in [rng.randrange(20)]]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, src int, text string, day int")
    t = apply(df, texts.CLAIMS)
    claims = t.collect()
    got = {r.doc_id: (r.action, r.confidence, r.verified_by) for r in spark.sql(texts.VERIFY[0].replace("FROM t", "FROM {t}").replace("FROM (SELECT * FROM t", "FROM (SELECT * FROM {t}"), t=t).collect()}
    split = lambda x: set(filter(None, x.split(",")))
    for low in [c for c in claims if c.claim_tier == "low"]:
        found = []
        for s in [c for c in claims if c.claim_tier != "low" and c.lang == low.lang]:
            a, b = split(low.topics), split(s.topics)
            if not (a & b or ("access" in a and "contact" in b) or ("contact" in a and "access" in b)):
                continue
            specific = bool(split(low.specific) & split(s.specific))
            score = 60 * specific + 10 * bool(split(low.generic) & split(s.generic)) + 10 * (abs(low.day - s.day) <= 30)
            if score:
                found.append((0 if s.claim_tier == "high" and specific else 1 if s.claim_tier == "high" else 2, -score, s.doc_id, specific))
        rank, score, by, specific = min(found, default=(3, 0, None, False))
        action = "verified" if rank == 0 else "needs_review" if rank == 1 else "supported" if rank == 2 and specific else "unverified"
        confidence = {"verified": min(100, 70 + -score // 5), "needs_review": 0, "supported": min(69, 40 + -score // 5), "unverified": 20}[action]
        assert got[low.doc_id] == (action, confidence, by if action != "unverified" else None)
    assert {a for a, _, _ in got.values()} >= {"verified", "needs_review"}

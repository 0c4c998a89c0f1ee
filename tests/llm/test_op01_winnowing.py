from __future__ import annotations

import hashlib
import random

import numpy as np

from ledgerlens.llm import op01_winnowing as M


def brute(text, k=M.K, w=M.WINDOW):
    s = [ord(c) for c in text if not (ord(c) == 32 or 9 <= ord(c) <= 13 or ord(c) in (0x85, 0xA0))]
    s = [c + 33 if 65 <= c <= 90 else c + 1 for c in s]
    if not s:
        return []
    k = min(k, len(s))
    hashes = []
    for i in range(len(s) - k + 1):
        h = 0
        for x in s[i : i + k]:
            h = (h * M._FACTOR + x) % 2**64
        hashes.append(int(M.mix(np.array([h], np.uint64))[0]) >> 24)
    w = min(w, len(hashes))
    out = []
    for i in range(len(hashes) - w + 1):
        least = min(hashes[i : i + w])
        place = max(j for j in range(i, i + w) if hashes[j] == least)
        if not out or out[-1] != (least, place):
            out.append((least, place))
    return out


def test_winnow_equals_brute_force():
    rng = random.Random(1)
    texts = ["", " \n", "a", "a" * 400, "ab" * 300, "Hello World " * 9] + ["".join(rng.choice("abcd EF\n") for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    for t in texts:
        a = M.winnow(t)
        assert list(zip(a[0].tolist(), a[1].tolist(), strict=True)) == brute(t)


def test_blocks_do_not_change_the_result(monkeypatch):
    rng = random.Random(2)
    t = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    whole = M.winnow(t)
    monkeypatch.setattr(M, "_BLOCK", 100)
    parts = M.winnow(t)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_shared_run_is_found():
    rng = random.Random(3)
    run = "".join(rng.choice("abcdefghij") for _ in range(M.K + M.WINDOW - 1))
    other = lambda: "".join(rng.choice("klmnopqrs") for _ in range(200))
    a, b = M.winnow(other() + run + other()), M.winnow(other() + run + other())
    assert set(a[0].tolist()) & set(b[0].tolist())


def test_edited_and_next(make, monkeypatch):
    monkeypatch.setattr(M, "ROWS", 2)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcde é\U0001f600") for _ in range(rng.randrange(0, 200))) for _ in range(37)] + [None, ""]
    got = {r.doc_id: r for r in M.compare_edited(make(texts, 5)).collect()}
    order = sorted(range(len(texts)), reverse=True)
    assert len(got) == len(texts)
    for n, i in enumerate(order):
        own, nxt = texts[i] or "", texts[order[(n + 1) % len(order)]] or ""
        e = own[: len(own) - len(own) // 2] + nxt[: len(own) // 2]
        r = got[5 + i]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == M.as_string(*M.winnow(own)) and r.edited_fingerprint == M.as_string(*M.winnow(e))
        assert r.near_edited == M.likeness({h for h, _ in brute(own)}, {h for h, _ in brute(e)})
        assert r.near_next == M.likeness({h for h, _ in brute(own)}, {h for h, _ in brute(nxt)})


def test_odd_and_empty(odd, empty):
    got = M.compare_edited(odd).collect()
    assert len(got) == 8 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert M.compare_edited(empty).count() == 0
    assert {r.doc_id: r.fingerprint for r in M.fingerprints(odd).collect()}[2] == ""


def test_single_document_follows_itself(make):
    (r,) = M.compare_edited(make(["some words of text that stand alone here"], partitions=1)).collect()
    assert r.near_next == 1.0

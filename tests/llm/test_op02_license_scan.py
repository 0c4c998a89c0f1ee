from __future__ import annotations

import re

import duckdb
import pandas as pd

from ledgerlens.llm import op02_license_scan as M

TEXTS = [
    "Released under the MIT License.",
    "mit license MIT-LICENSE, mit  license",
    "Licensed under the Apache License, Version 2.0 and the General Public License",
    "mit licenseé and émit license",
    "MIT LİCENSE toKen mit licenſe",
    "This work is licensed under the GNU General Public License, version 3.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "license mit", "CC BY-NC 4.0", None, "", "general public general public license license",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Redistribution and use in source and binary forms, also with some modification, are permitted provided that the following conditions are met",
    "redistribution and use in source and binary forms with a great many more words put in between is permitted provided that the following conditions are met",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
    "Foundation, that is, either version 2 of the License or (at your option) any later version. Redistribution of it is under the MIT License. " * 2,
    "provided that the following conditions are met redistribution and use in source and binary forms",
    "permission is granted to anyone to use this software for any purpose in no event will the authors be held liable for any damages",
]


def brute(text):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(M.WORD, t)
    starts = []
    for _, phrase in M.BASE:
        p = phrase.split()
        starts += [i for i in range(len(words)) if words[i : i + len(p)] == p]
    labels = sorted({x for x, phrase in M.BASE for p in [phrase.split()] if any(words[i : i + len(p)] == p for i in range(len(words)))})
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(labels)


def test_base_equals_brute_force(make):
    got = {r.doc_id: r for r in M.scan(make(TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert got[5].labels == "gpl,gpl-3.0" and got[8].labels == "cc-by-nc-4.0" and got[12].labels == "bsd"


def test_a_word_put_in_between_phrases_does_not_hide_a_notice(make):
    got = {r.doc_id: r for r in M.scan(make(TEXTS)).collect()}
    assert got[13].labels == "bsd" and got[13].score < got[12].score and got[14].labels == ""
    assert got[15].labels == "gpl,gpl-2.0-or-later,mit" and got[15].n_notices == 4 and got[15].score > 0.9
    assert got[16].labels == got[17].labels == ""


def test_postings_are_the_rarest_words_and_intersect(make):
    index = {t["label"]: t for t in M.index_postings({w: 5 if w == "license" else 1 for t in M.templates() for p in t["phrases"] for w in p["words"]}, 10)}
    assert [p["word"] for p in index["apache"]["postings"]] == ["apache", "license"]
    assert all(len(t["postings"]) == min(M.RARE, len(t["key"])) for t in index.values())


def test_sql_gives_the_same(make):
    df = make(TEXTS * 3)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_notices"]
    plain = lambda x: None if pd.isna(x) else x if isinstance(x, str) else float(x)
    key = lambda d: sorted((tuple(map(plain, r)) for r in d[cols].itertuples(index=False)), key=repr)
    assert key(M.scan(df).toPandas()) == key(con.execute(M.ORACLE_SQL).df())


def test_odd_and_empty(odd, empty):
    got = M.scan(odd).collect()
    assert len(got) == 8 and all(r.n_base == 0 and r.labels == "" and r.score == 0 for r in got)
    assert M.scan(empty).count() == 0


def test_plan_is_native(spark, tmp_path, make):
    make(TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    plan = M.op2_license_scan(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

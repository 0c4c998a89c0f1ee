"""Licence scan by a positional rare-token index.

Words are runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII characters. Each
template is a notice with mandatory key phrases at fixed places in it. The index holds, for each
template, postings (word, place in the template) of its `RARE` highest-IDF key-phrase words, by
document frequency over all documents. A file's licence words are looked up, highest IDF first: a template
without one of its key words is out; of the others, each posting puts the template's start at
where the word stands in the file less its place in the template, and the starts that all postings
agree on (up to `SHIFT` words between different phrases, so an inserted or missing word between
them doesn't matter) are intersected. There the mandatory key phrases are verified, word by word.
A phrase is only ever found where all its words stand consecutively, and wherever they do: its own
words are what is indexed, so the index loses no place.

The score is the largest share of a notice's words that stand within `SHIFT` words of their
relative places, over all verified places, and at least 0.5 where a base phrase stands. A notice's
place is that of its first key phrase less that phrase's place in the notice.

Everything happens within a row, by DataFrame functions; nothing is shuffled but the document
frequencies of the templates' own words (a fixed list), counted per task first.

Defined results: a null text counts as empty and has 0 words, no places, empty labels and score
0. All places count, overlapping ones too. Repeated rows are scored alike; only doc_id and text
are read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# Labels, notices, and the key phrases that must stand in them.
BASE = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
copies of the software""", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge to any person obtaining a copy"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", """you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis""",
     ["you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0-or-later", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the
free software foundation either version 2 of the license or at your option any later version""", ["under the terms of the gnu general public license as published by the free software foundation", "either version 2 of the license"]),
    ("gpl-3.0-or-later", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the
free software foundation either version 3 of the license or at your option any later version""", ["under the terms of the gnu general public license as published by the free software foundation", "either version 3 of the license"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0"]),
    ("cc0-1.0", "cc0 1 0 universal", ["cc0 1 0"]),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer""",
     ["redistribution and use in source and binary forms", "provided that the following conditions are met"]),
    ("bsd-3-clause", """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission""", ["may be used to endorse or promote products derived from this software"]),
    ("mpl-2.0", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can
obtain one at http mozilla org mpl 2 0""", ["mozilla public license v 2 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software", "with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("bsl-1.0", "boost software license version 1 0", ["boost software license"]),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from
the use of this software permission is granted to anyone to use this software for any purpose including commercial applications""",
     ["in no event will the authors be held liable for any damages", "permission is granted to anyone to use this software for any purpose"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0"]),
]
RARE = 3
SHIFT = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[dict]:
    """label, base, words, phrases [{at, words}], all by words."""
    out = []
    for label, phrase, keys, base in [(x, p, [p], True) for x, p in BASE] + [(x, p, k, False) for x, p, k in NOTICES]:
        words = phrase.split()
        phrases = []
        for key in keys:
            k = key.split()
            at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
            phrases.append({"at": at, "words": k})
        out.append({"label": label, "base": base, "words": words, "phrases": phrases})
    return out


def words_of(text: Column) -> Column:
    # the Kelvin sign is the one character whose lower case is an ASCII letter; another non-ASCII one stands in for it
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))
    # cutting at what lies between words takes half the time of matching them; only the ends can be empty
    return F.array_remove(F.split(F.lower(plain), GAP), "")


def document_frequency(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many documents each template word stands (the words are a fixed list), and the number of documents."""
    vocabulary = sorted({w for t in templates() for p in t["phrases"] for w in p["words"]})
    have = F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), have)).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    return {w: counts.get(w, 0) for w in vocabulary}, counts.get("", 0)


def index_postings(df: dict[str, int], n: int) -> list[dict]:
    """Per template: its key words, the postings (word, place, how far the start may be off) of the `RARE` words
    with the highest IDF, its rarest word's own first, and what is to be verified."""
    out = []
    for t in templates():
        places: dict[str, tuple[int, int]] = {}  # of each word, the first place and its phrase
        for k, p in enumerate(t["phrases"]):
            for i, w in enumerate(p["words"]):
                places.setdefault(w, (p["at"] + i, k))
        ranked = sorted(places, key=lambda w: (-math.log((1 + n) / (1 + df[w])), places[w]))[:RARE]
        home = places[ranked[0]][1]
        postings = [{"word": w, "q": places[w][0], "off": 0 if places[w][1] == home else 2 * SHIFT} for w in ranked]
        first, *others = t["phrases"]
        out.append({"key": sorted(places), "postings": postings, "spread": 0 if home == 0 else SHIFT, "first": first, "others": others, **{c: t[c] for c in ("label", "base", "words")}})
    return out


_PHRASE = "struct<at:int,words:array<string>>"
_TEMPLATE = f"struct<key:array<string>,postings:array<struct<word:string,q:int,off:int>>,spread:int,first:{_PHRASE},others:array<{_PHRASE}>,label:string,base:boolean,words:array<string>>"


def _stands(w: Column, at: Column, words: Column) -> Column:
    """The words stand at place `at` (from 0) of w."""
    return F.when((at >= 0) & (at + F.size(words) <= F.size(w)), F.slice(w, at + 1, F.size(words)) == words).otherwise(False)


def _near(w: Column, at: Column, word: Column) -> Column:
    lo, hi = F.greatest(at - SHIFT, F.lit(0)), at + SHIFT + 1
    return F.when(hi > lo, F.array_contains(F.slice(w, lo + 1, hi - lo), word)).otherwise(False)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_notices for every row."""
    index = index_postings(*document_frequency(docs))
    lookup = F.from_json(F.lit(json.dumps(index)), f"array<{_TEMPLATE}>")
    rarest = F.array(*map(F.lit, sorted({t["postings"][0]["word"] for t in index})))
    vocabulary = F.array(*map(F.lit, sorted({w for t in index for w in t["key"]})))

    rows = docs.select("doc_id", words_of(F.col("text")).alias("_w"))
    rows = rows.select("doc_id", "_w", F.size("_w").cast("long").alias("n_words"), F.arrays_overlap("_w", rarest).alias("_any"))
    w = F.col("_w")
    # the file's licence words, and the templates whose key words are all among them
    rows = rows.withColumn("_have", F.when(F.col("_any"), F.array_intersect(w, vocabulary)))
    possible = F.filter(lookup, lambda t: F.size(F.array_except(t["key"], F.col("_have"))) == 0)

    def starts(posting: Column) -> Column:
        """Where the template would start for each place of the posting's word."""
        at = F.filter(F.transform(w, lambda x, i: F.when(x == posting["word"], i - posting["q"])), lambda i: i.isNotNull())
        return F.when(posting["off"] == 0, at).otherwise(F.flatten(F.transform(at, lambda i: F.sequence(i - posting["off"], i + posting["off"]))))

    def places(t: Column) -> Column:
        rest = F.slice(t["postings"], 2, RARE)
        agreed = F.aggregate(rest, F.array_distinct(starts(t["postings"][0])), lambda found, p: F.array_intersect(found, starts(p)))
        spread = F.when(t["spread"] == 0, agreed).otherwise(F.array_distinct(F.flatten(F.transform(agreed, lambda i: F.sequence(i - t["spread"], i + t["spread"])))))
        shifts = F.sequence(F.lit(-SHIFT), F.lit(SHIFT))
        verified = lambda i: _stands(w, i + t["first"]["at"], t["first"]["words"]) & F.forall(t["others"], lambda p: F.exists(shifts, lambda d: _stands(w, i + p["at"] + d, p["words"])))
        return F.filter(spread, verified)

    def share(t: Column, start: Column) -> Column:
        there = F.size(F.filter(t["words"], lambda x, i: _near(w, start + i, x)))
        return there / F.size(t["words"])

    found = F.flatten(F.transform(possible, lambda t: F.transform(places(t), lambda i: F.struct(t["base"].alias("base"), t["label"].alias("label"), i.alias("start"), F.when(t["base"], 0.5).otherwise(share(t, i)).alias("share")))))
    empty = F.array().cast("array<struct<base:boolean,label:string,start:int,share:double>>")
    rows = rows.select("doc_id", "n_words", F.when(F.col("_any"), found).otherwise(empty).alias("_v"))

    base = F.filter("_v", lambda v: v["base"])
    starts_of = F.transform(base, lambda v: v["start"].cast("long"))
    join = lambda vs: F.array_join(F.array_sort(F.array_distinct(F.transform(vs, lambda v: v["label"]))), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts_of).alias("first_word"),
        F.array_max(starts_of).alias("last_word"),
        join(base).alias("base_labels"),
        join(F.col("_v")).alias("labels"),
        F.coalesce(F.array_max(F.transform("_v", lambda v: v["share"])), F.lit(0.0)).alias("score"),
        (F.size("_v") - F.size(base)).cast("long").alias("n_notices"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    """Places by every occurrence of the first key phrase, without an index."""

    def listed(xs: list[str]) -> str:
        return "[" + ", ".join("'" + x + "'" for x in xs) + "]"

    def stands(at: str, words: list[str]) -> str:
        return f"({at} >= 0 AND list_slice(w, {at} + 1, {at} + {len(words)}) = {listed(words)})"

    parts = []
    for t in templates():
        first, *others = t["phrases"]
        holds = stands(f"(s + {first['at']})", first["words"])
        for p in others:
            holds += " AND (" + " OR ".join(stands(f"(s + {p['at'] + d})", p["words"]) for d in range(-SHIFT, SHIFT + 1)) + ")"
        near = f"list_contains(list_slice(w, greatest(s + q - {SHIFT}, 0) + 1, s + q + {SHIFT + 1}), {listed(t['words'])}[q + 1]) AND s + q + {SHIFT} >= 0"
        share = "0.5" if t["base"] else f"CAST(len(list_filter(range({len(t['words'])}), lambda q: {near})) AS DOUBLE) / {len(t['words'])}"
        rows = f"SELECT r, w, i - 1 - {first['at']} AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) WHERE w[i] = '{first['words'][0]}'"
        parts.append(f"SELECT r, {str(t['base']).lower()} AS base, '{t['label']}' AS label, s, CAST({share} AS DOUBLE) AS share FROM ({rows}) WHERE {holds}")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents),
v AS ({" UNION ALL ".join(parts)}),
g AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(share) AS share, count(*) FILTER (NOT base) AS n_notices
  FROM v GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(share, 0.0)::DOUBLE AS score, coalesce(n_notices, 0) AS n_notices
FROM d LEFT JOIN g USING (r)"""


ORACLE_SQL = _sql()

"""Relevance of news by chains of rules.

A chain leads over hops from an event to a product; a hop is supported by the text if that holds one of its words, or
by the stock's list of products. All words of all chains are found in one pass over each text (an automaton of all patterns, built in
each task from the rule table); scores are column expressions over the array of words found.

Score of a chain: 0.35 if a hop that must be in the news isn't there; else 0.25, with 0.35 if hops are required, 0.20 for two hops or more in
the news (0.08 for one) and 0.15 for a product of the stock, at most 0.95. The best chain counts, the earlier one among equals.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIGH, CAUTIOUS = 0.70, 0.40


@dataclass(frozen=True)
class Hop:
    name: str
    words: tuple[str, ...]
    needs_news: bool = False
    statement: str = ""


@dataclass(frozen=True)
class Chain:
    name: str
    hops: tuple[Hop, ...]
    product: str = ""


def plain(text: str) -> str:
    """Lower case without blanks, as texts and words are compared."""
    return text.strip().lower().replace(" ", "")


def words_of(chains: Iterable[Chain], background: Iterable[str]) -> list[str]:
    """All words that are looked for, each once: a word's number is its place."""
    return list(dict.fromkeys(w for w in map(plain, [*(w for c in chains for h in c.hops for w in h.words), *background]) if w))


def found_words(items: DataFrame, words: list[str]) -> DataFrame:
    """`items` (seq, text, name) as (seq, found: the numbers of the words in each text, in order; named: the name is in it)."""
    schema = pa.schema([("seq", pa.int64()), ("found", pa.list_(pa.int32())), ("named", pa.bool_())])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, w in enumerate(words):
            automaton.add_word(w, k)
        automaton.make_automaton()
        for batch in batches:
            found, named = [], []
            for text, name in zip(batch.column("text").to_pylist(), batch.column("name").to_pylist()):
                low = plain(text or "")
                found.append(sorted({k for _, k in automaton.iter(low)}) if words else [])
                named.append(bool(plain(name or "")) and plain(name) in low)
            yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(found, pa.list_(pa.int32())), pa.array(named)], schema=schema)

    return items.select(F.col("seq").cast("long").alias("seq"), "text", "name").mapInArrow(search, "seq long, found array<int>, named boolean")


def _hop(hop: Hop, number: dict[str, int], chain: Chain, products: frozenset[str]) -> tuple[str, str]:
    """(expression: the hop is in the news, expression: what supports it)."""
    own = [plain(w) for w in hop.words if plain(w)]
    ids = ", ".join(str(number[w]) for w in own)
    first = f"filter(array({ids}), x -> array_contains(found, x))" if ids else "cast(array() as array<int>)"
    by_stock = any(w in products for w in own)
    fallback = f"'{hop.name}:stock'" if by_stock else f"'{hop.name}:missing'"
    return f"(size({first}) > 0)", f"CASE WHEN size({first}) > 0 THEN concat('{hop.name}:', words[{first}[0]]) ELSE {fallback} END"


def chain_score(chain: Chain, number: dict[str, int], products: frozenset[str]) -> tuple[str, str]:
    """(score, support of the hops) of a chain as expressions over `found`."""
    told = [_hop(h, number, chain, products) for h in chain.hops]
    news = " + ".join(f"CAST({n} AS INT)" for n, _ in told)
    required = [n for (n, _), h in zip(told, chain.hops) if h.needs_news]
    base = 0.25 + (0.35 if required else 0) + (0.15 if chain.product and plain(chain.product) in products else 0)
    score = f"least(0.95D, round({base}D + CASE WHEN {news} >= 2 THEN 0.20D WHEN {news} = 1 THEN 0.08D ELSE 0D END, 2))"
    if required:
        score = f"CASE WHEN {' AND '.join(required)} THEN {score} ELSE 0.35D END"
    return score, "concat_ws(',', " + ", ".join(s for _, s in told) + ")"


def relevance(items: DataFrame, chains: tuple[Chain, ...], products: Iterable[str], background: tuple[str, ...]) -> DataFrame:
    """(seq, relevance_class, confidence, chain_id, hops, sections, tone) of `items` (seq, text, name)."""
    words = words_of(chains, background)
    number = {w: k for k, w in enumerate(words)}
    ours = frozenset(map(plain, products))
    scored = []
    for k, c in enumerate(chains):
        if c.hops:
            score, hops = chain_score(c, number, ours)
            scored.append(f"struct(-({score}) AS minus, {k} AS place, '{c.name}' AS chain, {hops} AS hops)")
    listed = "array(" + ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words) + ")"
    at = found_words(items, words).withColumn("words", F.expr(listed))
    best = f"array_min(array({', '.join(scored)}))" if scored else "struct(0D AS minus, 0 AS place, '' AS chain, '' AS hops)"
    at = at.withColumn("best", F.expr(best)).withColumn("score", F.expr("-best.minus"))
    sector = f"arrays_overlap(found, array({', '.join(str(number[plain(w)]) for w in background)}))" if background else "false"
    kind = F.when(F.col("named"), "company_event").when(F.col("score") >= CAUTIOUS, "industry_chain_relevant").when(F.expr(sector), "sector_background").otherwise("noise")
    at = at.withColumn("relevance_class", kind)
    chain_of = F.when(F.col("relevance_class") == "company_event", "company_direct").when(F.col("relevance_class") == "industry_chain_relevant", F.col("best.chain")).otherwise(F.col("relevance_class"))
    score_of = F.when(F.col("relevance_class") == "company_event", 0.95).when(F.col("relevance_class") == "industry_chain_relevant", F.col("score")).when(F.col("relevance_class") == "sector_background", 0.25).otherwise(0.0)
    sections = F.when(F.col("relevance_class") == "company_event", "4.1,4.2,4.3").when(F.col("relevance_class") == "noise", "").otherwise("4.1")
    tone = F.when(F.col("relevance_class") != "industry_chain_relevant", "").when(F.col("score") >= HIGH, "cautious").otherwise("watch_variable_only")
    hops = F.when(F.col("relevance_class") == "company_event", "company_mention").when(F.col("relevance_class") == "industry_chain_relevant", F.col("best.hops")).otherwise("")
    return at.select("seq", "relevance_class", score_of.alias("confidence"), chain_of.alias("chain_id"), hops.alias("hops"), sections.alias("sections"), tone.alias("tone"))


def manifest(rated: DataFrame, by: str) -> DataFrame:
    """(*by, chain_id, confidence, first): each chain that may appear among events and catalysts, once for each `by`, with its first item."""
    allowed = rated.where(F.array_contains(F.split("sections", ","), "4.3"))
    return allowed.groupBy(by, "chain_id").agg(F.min_by("confidence", "seq").alias("confidence"), F.min("seq").alias("first"))

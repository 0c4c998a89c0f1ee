"""Relevance of posts to a stock by chains of rules (N01, N02), with SQL written on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chains import Chain, Hop, manifest, plain, relevance

#: Parameters: the stock, its products, the chains that lead to them and words of its sector. The first chain and the name suit the given corpus.
STOCK = "Apache"
PRODUCTS = ("software", "memory chips")
CHAINS = (
    Chain("licence_to_release", (Hop("terms", ("licensed under", "license", "lizenz", "licence", "licencia"), True), Hop("release", ("version", "release", "veröffentlich", "publié")), Hop("product", ("software", "programm", "logiciel"))), "software"),
    Chain("breach_to_trust", (Hop("breach", ("password", "secret", "api_key", "akia", "passwort"), True), Hop("contact", ("mail", "phone", "telefon"), True), Hop("trust", ("lawsuit", "klage", "procès", "demanda"))), "hosting"),
    Chain("capacity_to_price", (Hop("capacity", ("capacity cut", "plant shutdown", "kapazitätsabbau", "réduction de capacité"), True), Hop("supply", ("shortage", "engpass", "pénurie", "escasez")), Hop("price", ("price increase", "preiserhöhung", "hausse des prix")), Hop("product", ("memory chips",))), "memory chips"),
)
BACKGROUND = ("semiconductor", "chip", "wafer", "equipment", "robot", "sector", "industry", "branche", "industrie", "secteur", "industria", "ai model")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id IS NOT NULL")
    return docs.select(F.col("doc_id").cast("long").alias("seq"), F.coalesce("source", F.lit("")).alias("source"), F.col("text"), F.lit(STOCK).alias("name"))


def q_n01_news_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance(_items(spark, sf_dir), CHAINS, PRODUCTS, BACKGROUND)


def q_n02_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return manifest(relevance(items, CHAINS, PRODUCTS, BACKGROUND).join(items.select("seq", "source"), "seq"), "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (q_n01_news_relevance, q_n02_manifest)}


def _quoted(word: str) -> str:
    return "'" + plain(word).replace("'", "''") + "'"


def _sql() -> str:
    """Each hop and score spelled out over `low`, the text in lower case without blanks."""
    ours = {plain(p) for p in PRODUCTS}
    hops, scores, supports = [], [], []
    for c, chain in enumerate(CHAINS):
        for h, hop in enumerate(chain.hops):
            hops.append("CASE " + " ".join(f"WHEN contains(low, {_quoted(w)}) THEN {_quoted(w)}" for w in hop.words) + f" END AS h{c}_{h}")
        n = " + ".join(f"CAST(h{c}_{h} IS NOT NULL AS INT)" for h in range(len(chain.hops)))
        needed = " AND ".join(f"h{c}_{h} IS NOT NULL" for h, hop in enumerate(chain.hops) if hop.needs_news)
        product = 15 if plain(chain.product) in ours else 0
        scores.append(f"CASE WHEN {needed} THEN least(95, 60 + {product} + CASE WHEN {n} >= 2 THEN 20 WHEN {n} = 1 THEN 8 ELSE 0 END) ELSE 35 END AS s{c}")
        supports.append(" || ',' || ".join(f"'{hop.name}:' || coalesce(h{c}_{h}, '{'stock' if {plain(w) for w in hop.words} & ours else 'missing'}')" for h, hop in enumerate(chain.hops)))
    best = "greatest(" + ", ".join(f"s{c}" for c in range(len(CHAINS))) + ")"
    which = "CASE " + " ".join(f"WHEN s{c} = best THEN {c}" for c in range(len(CHAINS))) + " END"
    sector = " OR ".join(f"contains(low, {_quoted(w)})" for w in BACKGROUND)
    names = "CASE which " + " ".join(f"WHEN {c} THEN '{chain.name}'" for c, chain in enumerate(CHAINS)) + " END"
    told = "CASE which " + " ".join(f"WHEN {c} THEN {s}" for c, s in enumerate(supports)) + " END"
    return f"""WITH i AS (SELECT doc_id AS seq, coalesce(source, '') AS source, replace(lower(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))), ' ', '') AS low FROM documents WHERE doc_id IS NOT NULL),
a AS (SELECT *, {', '.join(hops)} FROM i), b AS (SELECT *, {', '.join(scores)} FROM a), c AS (SELECT *, {best} AS best FROM b), d AS (SELECT *, {which} AS which FROM c),
e AS (SELECT *, CASE WHEN contains(low, {_quoted(STOCK)}) THEN 'company_event' WHEN best >= 40 THEN 'industry_chain_relevant' WHEN {sector} THEN 'sector_background' ELSE 'noise' END AS relevance_class FROM d),
r AS (SELECT seq, source, relevance_class, CASE relevance_class WHEN 'company_event' THEN 0.95 WHEN 'industry_chain_relevant' THEN best / 100.0 WHEN 'sector_background' THEN 0.25 ELSE 0.0 END AS confidence,
  CASE relevance_class WHEN 'company_event' THEN 'company_direct' WHEN 'industry_chain_relevant' THEN {names} ELSE relevance_class END AS chain_id,
  CASE relevance_class WHEN 'company_event' THEN 'company_mention' WHEN 'industry_chain_relevant' THEN {told} ELSE '' END AS hops,
  CASE relevance_class WHEN 'company_event' THEN '4.1,4.2,4.3' WHEN 'noise' THEN '' ELSE '4.1' END AS sections,
  CASE WHEN relevance_class <> 'industry_chain_relevant' THEN '' WHEN best >= 70 THEN 'cautious' ELSE 'watch_variable_only' END AS tone FROM e)"""


ORACLE_SQL = {
    "q_n01_news_relevance": f"{_sql()} SELECT seq, relevance_class, CAST(confidence AS DOUBLE) AS confidence, chain_id, hops, sections, tone FROM r",
    "q_n02_manifest": f"{_sql()} SELECT source, chain_id, CAST(arg_min(confidence, seq) AS DOUBLE) AS confidence, min(seq) AS first FROM r WHERE contains(sections, '4.3') GROUP BY source, chain_id",
}

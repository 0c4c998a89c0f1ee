"""Queries of duplicates by shared keys and of near cards, with SQL written on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import both, replace_re, sha256
from ..operators.dedupe import near_kept, shared_key_groups
from .stages import Query, stage
from .texts import CANONICAL, DOCS, PAGE_ROWS, PAGES, POSTS, SENTENCES, STRIP

#: Pages by canonical address and, from 16 characters of plain text on, by its fingerprint.
PAGE_KEYS = Query(
    PAGE_ROWS,
    (*CANONICAL, *STRIP, stage(text_key=both("CASE WHEN length(plain) >= 16 THEN {0} END", sha256("lower(plain)")))),
    ("page_id AS id", "domain", "source_credit AS worth", "concat('url:', canonical) AS key1", "concat('text:', text_key) AS key2"), tables=PAGES,
)
#: Posts by squeezed title and by text.
POST_KEYS = Query(
    POSTS,
    (stage(squeezed=replace_re("lower(coalesce(title, ''))", "[^a-z0-9]+", ""), h=sha256("content")),),
    ("seq AS id", "CAST(likes AS INT) AS worth", "CASE WHEN length(squeezed) >= 16 THEN concat('title:', squeezed) END AS key1", "concat('text:', h) AS key2"), tables=DOCS,
)


def _best_of_groups(items: DataFrame) -> DataFrame:
    """id, worth and group size of the item of most worth (ties: the first) of each group of shared keys."""
    pairs = items.select("id", F.explode(F.array("key1", "key2")).alias("key"))
    grouped = items.join(shared_key_groups(pairs), "id")
    best = grouped.groupBy("root").agg(F.max_by(F.struct("id", "worth"), F.struct("worth", -F.col("id"))).alias("b"), F.count("*").alias("members"))
    return best.select(F.col("b.id").alias("id"), F.col("b.worth").alias("worth"), "members")


def q_d06_display_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best_of_groups(PAGE_KEYS.run(spark, sf_dir)).toDF("page_id", "source_credit", "members")


def q_d09_item_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best_of_groups(POST_KEYS.run(spark, sf_dir)).toDF("seq", "likes", "members")


def near_pairs(units: DataFrame, similarity: float = 0.85, least: int = 4) -> DataFrame:
    """(doc_id, first_pos, pos) of the units of a document whose sets of words have that Jaccard similarity.

    Words are ordered from the rarest over all units on; two such sets share one of the first n - ceil(0.85 n) + 1
    words in that order, so only units that share a rare word are compared."""
    words = units.select("doc_id", "pos", F.explode(F.array_distinct(F.split(F.lower("sentence"), " +"))).alias("word"))
    order = words.groupBy("word").agg(F.count("*").alias("df"))
    sets = words.join(order, "word").groupBy("doc_id", "pos").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).getField("word").alias("w"))
    sets = sets.withColumn("n", F.size("w")).where(F.col("n") >= least)
    prefix = sets.withColumn("word", F.explode(F.slice("w", F.lit(1), (F.col("n") - F.ceil(similarity * F.col("n")) + 1).cast("int"))))
    a, b = prefix.alias("a"), prefix.alias("b")
    met = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.pos") < F.col("b.pos")))
    common = F.size(F.array_intersect("a.w", "b.w"))
    near = met.where(common >= similarity * (F.col("a.n") + F.col("b.n") - common))
    return near.select(F.col("a.doc_id").alias("doc_id"), F.col("a.pos").cast("long").alias("first_pos"), F.col("b.pos").cast("long").alias("pos")).distinct()


def q_d12_near_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_kept(Query(SENTENCES, (), ("doc_id", "pos", "sentence"), tables=DOCS).run(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (q_d06_display_dedupe, q_d09_item_dedupe, q_d12_near_cards)}


def _groups_sql(items: Query, names: tuple[str, str, str]) -> str:
    """Groups by following shared keys from item to item until nothing new is reached."""
    return f"""WITH RECURSIVE i AS ({items.to_sql()}),
k AS (SELECT id, key1 AS key FROM i WHERE key1 IS NOT NULL UNION SELECT id, key2 FROM i WHERE key2 IS NOT NULL),
e AS (SELECT DISTINCT a.id, m.low AS other FROM k a JOIN (SELECT key, min(id) AS low FROM k GROUP BY key) m ON a.key = m.key),
n AS (SELECT id, other FROM e UNION SELECT other, id FROM e),
r AS (SELECT id, id AS seen FROM i UNION SELECT r.id, n.other FROM r JOIN n ON n.id = r.seen),
g AS (SELECT id, min(seen) AS root FROM r GROUP BY id),
b AS (SELECT i.*, g.root, row_number() OVER (PARTITION BY g.root ORDER BY worth DESC, i.id) AS rk, count(*) OVER (PARTITION BY g.root) AS members FROM i JOIN g ON i.id = g.id)
SELECT id AS {names[0]}, worth AS {names[1]}, {names[2]} FROM b WHERE rk = 1"""


_NEAR_SQL = f"""WITH RECURSIVE u AS (SELECT doc_id, pos, list_distinct(regexp_split_to_array(lower(sentence), ' +')) AS w FROM ({SENTENCES[1]}) q),
c AS (SELECT * FROM u WHERE len(w) >= 4),
p AS (SELECT a.doc_id, a.pos AS first_pos, b.pos AS pos FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.pos < b.pos
  AND len(a.w) >= 0.85 * len(b.w) AND len(b.w) >= 0.85 * len(a.w) WHERE len(list_intersect(a.w, b.w)) >= 0.85 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
s AS (SELECT doc_id, pos, list(first_pos) AS near, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS step FROM p GROUP BY doc_id, pos),
g AS (SELECT doc_id, 0::BIGINT AS step, NULL::BIGINT AS pos, NULL::BIGINT AS kept_pos, []::BIGINT[] AS gone FROM (SELECT DISTINCT doc_id FROM s) d
  UNION ALL
  SELECT doc_id, step, pos, kept_pos, CASE WHEN kept_pos IS NULL THEN gone ELSE list_append(gone, pos) END
  FROM (SELECT s.doc_id, s.step, s.pos, list_min(list_filter(s.near, lambda x: NOT list_contains(g.gone, x))) AS kept_pos, g.gone FROM g JOIN s ON s.doc_id = g.doc_id AND s.step = g.step + 1) z)
SELECT doc_id, pos, kept_pos FROM g WHERE kept_pos IS NOT NULL"""

ORACLE_SQL = {
    "q_d06_display_dedupe": _groups_sql(PAGE_KEYS, ("page_id", "source_credit", "members")),
    "q_d09_item_dedupe": _groups_sql(POST_KEYS, ("seq", "likes", "members")),
    "q_d12_near_cards": _NEAR_SQL,
}

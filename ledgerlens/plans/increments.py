"""Sentences of outside sources against those of owners (A07), with SQL written on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import all_re, replace_re
from ..operators.dedupe import written
from ..operators.increments import LEAST, incremental
from .evidence import FAMILIES
from .stages import Query, stage
from .texts import DOCS, SENTENCES

#: Years and quarters, numbers with units, codes of letters and digits, short names in capitals.
ANCHOR = "\\b20[0-9][0-9](?:Q[1-4])?\\b|[0-9]+(?:[.,][0-9]+)?(?:%| ?(?:per ?cent|million|billion|Mio|Mrd|milliards?|millones|USD|EUR|kg|months?|Monate|mois|meses)\\b)|\\b[A-Z]+[0-9]+(?:[.][0-9]+)?\\b|\\b[A-Z][A-Z]{1,7}\\b"
#: Words for events.
EVENTS = ("rumour", "denied", "respond", "lowered", "raised", "shortage", "bottleneck", "supply chain", "deliver", "order", "certif", "licen", "releas", "version", "mass production", "sanction", "policy", "halt", "delay", "postpone", "adjust", "replace", "price cut", "price increase", "first", "only", "secret", "password", "token", "phone")
ATTRIBUTION = "^(?:external (?:material|article|report)s?|the (?:article|report|material)|der artikel|das material|l.article|el artículo)(?: (?:says|said|holds|shows|notes|meint|zeigt|indique|dice))?[:, ]*"
_BITS = " | ".join(f"(CASE WHEN contains(low, '{w}') THEN {1 << k} ELSE 0 END)" for k, w in enumerate(EVENTS))
_FAMILIES = ", ".join("CASE WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + f" THEN '{f}' END" for f, words in FAMILIES.items())
ROWS = Query(
    SENTENCES,
    (
        # letters beyond ASCII count as lower-case letters, as engines don't agree on word bounds beside them
        stage(plain=replace_re("sentence", "[^\\x00-\\x7F]", "x"), unmarked=replace_re("lower(sentence)", "[\\[]\\^[0-9]+[\\]]", "")),
        stage(low=replace_re("unmarked", ATTRIBUTION, "")),
        stage(squeezed=replace_re("low", "\\s+", "")),
        stage(body=replace_re("squeezed", "^[.;,:!?]+|[.;,:!?]+$", ""), found=all_re("plain", ANCHOR)),
        stage(
            anchors=("array_distinct(transform(found, x -> lower(replace(x, ' ', ''))))", "list_distinct(list_transform(found, lambda x: lower(replace(x, ' ', ''))))"),
            families=(f"array_compact(array({_FAMILIES}))", f"list_filter([{_FAMILIES}], lambda x: x IS NOT NULL)"),
            events=f"CAST({_BITS} AS BIGINT)",
        ),
    ),
    ("lang AS scope", "concat(CAST(doc_id AS VARCHAR(20)), ':', CAST(pos AS VARCHAR(20))) AS id", "coalesce(tier_no, 3) = 0 AS owner", "body", "families", "anchors", "events"), tables=DOCS,
)


def q_a07_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(ROWS.run(spark, sf_dir).where("scope IS NOT NULL"))  # read in several branches, and made by patterns over whole texts
    return incremental(rows.where("NOT owner"), rows.where("owner")).select(F.col("scope").alias("lang"), "id", "outcome")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"q_a07_incremental": q_a07_incremental}
ORACLE_SQL = {
    "q_a07_incremental": f"""WITH r AS MATERIALIZED ({ROWS.to_sql()}), e AS (SELECT * FROM r WHERE NOT owner AND scope IS NOT NULL), o AS (SELECT * FROM r WHERE owner),
bodies AS (SELECT DISTINCT scope, body FROM o WHERE body <> ''), long AS (SELECT DISTINCT scope, body FROM e WHERE length(body) >= {LEAST}),
inside AS (SELECT DISTINCT l.scope, l.body FROM long l JOIN bodies b ON l.scope = b.scope AND length(b.body) >= length(l.body) AND contains(b.body, l.body) UNION SELECT DISTINCT e.scope, e.body FROM e JOIN bodies b ON e.scope = b.scope AND e.body = b.body),
ef AS (SELECT scope, id, unnest(list_concat(families, anchors)) AS feature FROM e), owned AS (SELECT scope, feature, bit_or(events) AS events FROM (SELECT scope, events, unnest(list_concat(families, anchors)) AS feature FROM o) x GROUP BY scope, feature),
known AS (SELECT ef.scope, ef.id, bit_or(owned.events) AS events FROM ef JOIN owned ON ef.scope = owned.scope AND ef.feature = owned.feature GROUP BY ef.scope, ef.id),
fresh AS (SELECT DISTINCT a.scope, a.id FROM (SELECT scope, id, unnest(anchors) AS anchor FROM e) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT scope, unnest(anchors) AS anchor FROM o) w WHERE w.scope = a.scope AND w.anchor = a.anchor))
SELECT e.scope AS lang, e.id, CASE WHEN i.body IS NOT NULL THEN 'owner_text_duplicate' WHEN k.id IS NULL THEN 'new_topic_context' WHEN f.id IS NOT NULL THEN 'new_concrete_anchor' WHEN (e.events & ~k.events) <> 0 THEN 'new_event_variable' ELSE 'owner_theme_without_delta' END AS outcome
FROM e LEFT JOIN inside i ON e.scope = i.scope AND e.body = i.body LEFT JOIN known k ON e.scope = k.scope AND e.id = k.id LEFT JOIN fresh f ON e.scope = f.scope AND e.id = f.id"""
}

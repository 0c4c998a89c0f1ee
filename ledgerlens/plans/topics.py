"""Topic clusters over sources and their summary (D10, D11), with SQL written on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import TOPICS
from ..operators.clusters import MOST, consolidated
from ..operators.dedupe import written
from .stages import Query, stage
from .texts import DOCS, POSTS, SCORE

OTHER = "other"
RUN = ["lang", "week"]
_TEXT = "lower(concat(coalesce(title, ''), ' ', coalesce(substr(content, 1, 300), '')))"
#: Posts by language and week: topic numbers in the order of the lists, distinct words of the title and the first 300 characters.
ITEMS = Query(
    POSTS,
    (
        *SCORE,
        stage(
            found="concat_ws(',', " + ", ".join(f"CASE WHEN has(both_texts, {t}) THEN '{k}' END" for k, t in enumerate(TOPICS)) + ")",
            # Han characters count as words
            words=(
                f"array_distinct(filter(split(regexp_replace({_TEXT}, '(\\\\p{{IsHan}})', ' $1 '), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x <> ''))",
                f"list_distinct(list_filter(regexp_split_to_array(regexp_replace({_TEXT}, '(\\p{{Han}})', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))",
            ),
        ),
        stage(found=f"CASE WHEN found = '' THEN '{len(TOPICS)}' ELSE found END"),
    ),
    ("CAST(seq AS BIGINT) AS seq", "coalesce(lang, '') AS lang", "CAST(CAST(date_trunc('week', published) AS DATE) AS VARCHAR(10)) AS week", "coalesce(source, '') AS source", "coalesce(title, '') AS title", "coalesce(quality, 0.0) AS quality", ("cast(split(found, ',') as array<int>) AS topics", "CAST(string_split(found, ',') AS INTEGER[]) AS topics"), ("coalesce(words, array()) AS words", "coalesce(words, []) AS words")), tables=DOCS,
)
NAMES = (*(t.removeprefix("t_") for t in TOPICS), OTHER)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items, written once: clustering reads them in several branches, and their word lists make a plan that is large."""
    return written(ITEMS.run(spark, sf_dir).where("seq IS NOT NULL"))


def _name(number) -> F.Column:
    return F.array(*map(F.lit, NAMES))[number]


def q_d10_topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidated(items(spark, sf_dir), RUN).select(
        "lang", "week", _name(F.col("topic")).alias("topic"), F.col("seed").alias("first_seq"), F.col("best").alias("best_seq"), F.round("quality", 4).alias("best_quality"),
        "members", F.size("sources").alias("sources"), F.array_join("others", ",").alias("cross_sources"),
    )


def q_d11_cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run the ten best clusters of several items, a line each."""
    from pyspark.sql import Window

    posts = items(spark, sf_dir)
    several = consolidated(posts, RUN).where("members > 1")
    ranked = several.withColumn("place", F.row_number().over(Window.partitionBy(*RUN).orderBy(F.desc("quality"), "best"))).where("place <= 10")
    titles = posts.select(F.col("seq").alias("best"), F.substring("title", 1, 50).alias("t"))
    two = F.expr("array_join(transform(slice(topics, 1, 2), x -> array({})[x]), ', ')".format(", ".join(f"'{n}'" for n in NAMES)))
    line = F.concat(F.lit("- ["), two, F.lit("] **"), F.col("t"), F.lit("** : "), F.array_join("sources", " + "))
    return ranked.join(titles, "best").select("lang", "week", "place", line.alias("line"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (q_d10_topic_clusters, q_d11_cross_source)}

_NAMES = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
#: The greedy walk step by step over whole lists of a group.
_CLUSTERS = f"""WITH RECURSIVE i AS ({ITEMS.to_sql()}),
e AS (SELECT lang, week, seq, unnest(topics) AS topic FROM i),
f AS (SELECT lang, week, topic, min(seq) AS first FROM e GROUP BY ALL),
o AS (SELECT e.seq, arg_min(e.topic, [f.first, e.topic]) AS topic FROM e JOIN f USING (lang, week, topic) GROUP BY e.seq),
g AS (SELECT lang, week, o.topic, list({{'seq': seq, 'source': source, 'words': words}} ORDER BY seq) AS rest FROM i JOIN o USING (seq) GROUP BY ALL),
r AS (SELECT lang, week, topic, NULL::BIGINT AS seed, []::BIGINT[] AS took, rest FROM g
  UNION ALL
  SELECT lang, week, topic, rest[1].seq, took, list_filter(rest[2:], lambda x: NOT list_contains(took, x.seq)) FROM (
    SELECT lang, week, topic, rest, list_transform(list_filter(rest[2:], lambda x: x.source <> rest[1].source OR (len(x.words) > 0 AND len(rest[1].words) > 0
      AND 2.0 * len(list_intersect(x.words, rest[1].words)) / (len(x.words) + len(rest[1].words)) >= 0.55))[:{MOST - 1}], lambda x: x.seq) AS took FROM r WHERE len(rest) > 0) z),
m AS (SELECT lang, week, topic, seed, unnest(list_prepend(seed, took)) AS seq FROM r WHERE seed IS NOT NULL),
k AS (SELECT m.*, source, quality, topics, title, row_number() OVER (PARTITION BY seed ORDER BY quality DESC, m.seq) AS rk FROM m JOIN i USING (seq)),
c AS (SELECT lang, week, topic, seed, min(seq) FILTER (rk = 1) AS best, max(quality) AS quality, count(*) AS members, list_sort(list_distinct(list(source))) AS sources,
  coalesce(string_agg(concat(source, ':', seq), ',' ORDER BY rk) FILTER (rk > 1), '') AS others, any_value(topics) FILTER (rk = 1) AS topics, any_value(title) FILTER (rk = 1) AS title
  FROM k GROUP BY lang, week, topic, seed)"""
ORACLE_SQL = {
    "q_d10_topic_clusters": f"{_CLUSTERS} SELECT lang, week, {_NAMES}[topic + 1] AS topic, seed AS first_seq, best AS best_seq, round(quality, 4) AS best_quality, CAST(members AS INT) AS members, CAST(len(sources) AS INT) AS sources, others AS cross_sources FROM c",
    "q_d11_cross_source": f"""{_CLUSTERS}, p AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, week ORDER BY quality DESC, best) AS INT) AS place FROM c WHERE members > 1)
SELECT lang, week, place, '- [' || array_to_string(list_transform(topics[1:2], lambda x: {_NAMES}[x + 1]), ', ') || '] **' || substr(title, 1, 50) || '** : ' || array_to_string(sources, ' + ') AS line FROM p WHERE place <= 10""",
}

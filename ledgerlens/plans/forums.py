"""List rows, posts and comments (S19, S20): of web pages as given, and of conversations written as forum pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.html import COMMENTS, comments_of, posts_of, rows_of_lists

BASE = "https://forum.example.org"
#: Conversations a list page shows.
PER_PAGE = 20


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long").alias("id"), "url", "html")


def _escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("id"), "turn", _escaped(F.coalesce("role", F.lit(""))).alias("role"), _escaped(text).alias("text"), F.length(text).alias("n"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, url, html): a conversation as a post with replies; a reply's likes are the length of its text."""
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    reply = say('<div class="reply-item"><p>by <a class="user-name" href="#">', F.col("role"), '</a><div class="reply-text"><p>', F.col("text"), '<br></div><span class="like-count">', F.format_number("n", 0), "</span></div>")
    first = say("<!DOCTYPE html><html><body><h1>", F.col("role"), '</h1><div><div id="post_content"><p>', F.col("text"), "</div></div>")
    at = F.row_number().over(_of_conversation())
    pieces = _turns(spark, sf_dir).withColumn("at", at).select("id", F.struct("at", F.when(F.col("at") == 1, first).otherwise(reply).alias("piece")).alias("p"))
    html = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["piece"]), "")
    return pieces.groupBy("id").agg(html.alias("html")).select("id", F.concat(F.lit(f"{BASE}/thread/"), "id").alias("url"), "html")


def _of_conversation():
    from pyspark.sql import Window

    return Window.partitionBy("id").orderBy("turn", "n")


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, url, html): list pages of conversations, a table row each, cells unclosed as such pages have them."""
    first = _turns(spark, sf_dir).groupBy("id").agg(F.min_by(F.struct("role", "text"), F.struct("turn", "n")).alias("f"), F.count("*").alias("turns"), F.sum("n").alias("n"))
    row = F.concat(
        F.lit('<tr class="listitem odd"><td><div class="read">'), F.format_number("n", 0), F.lit('</div><td><div class="reply">'), (F.col("turns") - 1).cast("string"),
        F.lit('</div><td><div class="title"><a href="/thread/'), F.col("id").cast("string"), F.lit('">'), F.col("f.text"), F.lit('</a></div><td><div class="author"><a href="#">'), F.col("f.role"), F.lit("</a></div>"),
    )
    rows = first.select(F.floor(F.col("id") / PER_PAGE).alias("page"), F.struct("id", row.alias("row")).alias("p"))
    table = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["row"]), "")
    return rows.groupBy("page").agg(F.concat(F.lit("<table><tr><th>title</th></tr>"), table, F.lit("</table>")).alias("html")).select(F.col("page").alias("id"), F.lit(BASE).alias("url"), "html")


def _sha(text: str) -> Column:
    return F.sha2(text, 256)


def q_s19_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of_lists(_pages(spark, sf_dir)).select(F.col("id").alias("page_id"), "row", "title", "link")


def q_s19_thread_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of_lists(lists(spark, sf_dir)).select(F.col("id").alias("page_id"), "row", _sha("title").alias("title_sha"), "link", "author", "reads", "comments")


def q_s20_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts_of(_pages(spark, sf_dir)).select(F.col("id").alias("page_id"), "pattern", "title", _sha("content").alias("content_sha"), F.length("content").cast("long").alias("content_chars"), "comments")


def q_s20_thread_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments_of(threads(spark, sf_dir)).select(F.col("id").alias("conv_id"), "place", "author", _sha("content").alias("content_sha"), "likes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (q_s19_list_rows, q_s19_thread_rows, q_s20_detail, q_s20_thread_comments)}


def _clean(text: str) -> str:
    return f"trim(regexp_replace({text}, '[ \\t\\r\\n\\f\\v\\xA0]+', ' ', 'g'), ' ')"


def _plain(html: str) -> str:
    for name, sign in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        html = f"replace({html}, '{name}', '{sign}')"
    return html


_INLINE = "regexp_replace({0}, '</?(a|b|i|em|strong|span|u|code|small)( [^>]*)?>', '', 'g')"
_TEXT = _clean(_plain("regexp_replace(" + _INLINE + ", '<[^>]*>', ' ', 'g')"))
_TURNS = "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(coalesce(text, ''))) AS nth FROM conversations"
ORACLE_SQL = {
    "q_s19_list_rows": f"""WITH i AS (SELECT page_id, url, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS items FROM pages), r AS (SELECT page_id, url, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS n FROM i),
l AS (SELECT page_id, n, regexp_extract(url, '^(https?://[^/]*)', 1) AS root, regexp_extract(item, '<a href="([^"]*)"', 1) AS href, {_TEXT.format("regexp_extract(item, '<a [^>]*>(.*?)</a>', 1)")} AS title FROM r)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) AS INT) AS row, title, CASE WHEN starts_with(href, '/') THEN root || href ELSE href END AS link FROM l WHERE title <> '' AND href <> ''""",
    "q_s19_thread_rows": f"""WITH t AS ({_TURNS}), f AS (SELECT conv_id, max(text) FILTER (WHERE nth = 1) AS text, max(role) FILTER (WHERE nth = 1) AS role, count(*) - 1 AS comments, CAST(sum(length(text)) AS BIGINT) AS reads FROM t GROUP BY conv_id),
c AS (SELECT *, {_clean("text")} AS title FROM f)
SELECT conv_id // {PER_PAGE} AS page_id, CAST(row_number() OVER (PARTITION BY conv_id // {PER_PAGE} ORDER BY conv_id) AS INT) AS row, sha256(title) AS title_sha, '{BASE}/thread/' || conv_id AS link, role AS author, reads, comments FROM c WHERE title <> ''""",
    "q_s20_detail": f"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS head FROM pages),
c AS (SELECT page_id, {_TEXT.format("body")} AS content, {_TEXT.format("head")} AS title FROM a)
SELECT page_id, 'article' AS pattern, title, sha256(content) AS content_sha, length(content) AS content_chars, CAST(0 AS BIGINT) AS comments FROM c""",
    "q_s20_thread_comments": f"""WITH t AS ({_TURNS}), c AS (SELECT conv_id, nth - 1 AS k, role, {_clean("text")} AS content, length(text) AS likes FROM t WHERE nth BETWEEN 2 AND {COMMENTS + 1})
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY k) AS INT) AS place, role AS author, sha256(content) AS content_sha, likes FROM c WHERE content <> ''""",
}

"""List rows and posts against the parser of the standard library, and pages that are not well formed."""

from __future__ import annotations

from html.parser import HTMLParser

from ledgerlens.operators.html import Page, absolute, comments_of, list_rows, number, post, posts_of, rows_of_lists


class Links(HTMLParser):
    """Text and address of the first link of every list item of well-formed pages."""

    def __init__(self):
        super().__init__()
        self.depth, self.rows, self.open = 0, [], None

    def handle_starttag(self, tag, attrs):
        if tag == "li":
            self.depth += 1
            self.rows.append(["", None])
        if tag == "a" and self.depth and self.rows[-1][1] is None:
            self.rows[-1][1] = dict(attrs).get("href")
            self.open = self.rows[-1]

    def handle_endtag(self, tag):
        self.depth -= tag == "li"
        self.open = None if tag == "a" else self.open

    def handle_data(self, data):
        if self.open is not None:
            self.open[0] += data


def test_rows_of_given_pages_equal_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("page_id AS id", "url", "html")
    got = {}
    for r in rows_of_lists(pages).collect():
        got.setdefault(r.id, []).append((r.title, r.link))
    for r in pages.collect():
        parser = Links()
        parser.feed(r.html)
        want = [(" ".join(t.split()), absolute(h, r.url)) for t, h in parser.rows if t.split() and h]
        assert got.get(r.id, []) == want


TABLE = """<table><tr class="head"><th>x</th></tr>
<TR class='odd listitem'><td><div class="read">1.2万</div><td><div class="reply">3,4</div><td><div class="title"><em></em><a title="a > b" href="//h.org/1?a=1&amp;b=2">One <b>bold</b> &amp; two</a></div><td><div class="author"><a>Ann</a></div><div class="update">09-01</div></tr>
<tr class="listitem"><td><div class="title">no link</div>
<tr class="listitem"><td><div class="title"><a href="rel/2">Unclosed<td>cell"""


def test_table_rows_unclosed_cells_and_links():
    assert list(list_rows(TABLE, "http://s.example.org/list?x")) == [(1, "One bold & two", "https://h.org/1?a=1&b=2", "Ann", "09-01", 12000, 34), (2, "Unclosed", "http://s.example.org/rel/2", "", "", 0, 0)]
    loose = '<table><tr><td class="l1"><a href="/a">A</a></td></tr><tr><td><a href="/b">B</a></td></tr></table><ul><li><a href="/c">C</a></ul>'
    assert [r[1:3] for r in list_rows(loose, "https://h.org")] == [("A", "https://h.org/a")]
    nested = '<ul><li><a href="/1">one</a><ul><li><a href="/2">two</a><li><a href="/3">three</a></ul><li>none</li><li><a href="https://o.org">four</a></ul>'
    assert [r[1:3] for r in list_rows(nested, "")] == [("one", "/1"), ("two", "/2"), ("three", "/3"), ("four", "https://o.org")]
    assert list(list_rows("", "")) == [] and list(list_rows("<li><a href=x>", "u")) == []


def test_content_patterns_in_order_and_nested_elements():
    assert post('<article>c</article><div class="x stockcodec y">b<div>in</div>side</div>')[0::2][:2] == ("stockcodec", "b in side")
    assert post('<div id="post_content">a <!-- <p>not</p> --><script>var t = "</div>";</script><div><div>deep</div></div> end</div> after')[2] == "a deep end"
    assert post('<div class="article-body"><p>one<p>two<br>three</div>')[::2][:2] == ("article-body", "one two three")
    assert post("<h1>T</h1><article>x</b></i></article></article>y") == ("article", "T", "x", []) and post("no tags") == ("", "", "", [])


def test_ten_comments_at_most_and_those_without_text():
    block = lambda n: f'<div class="reply-item"><a class="user-name">u{n}</a><div class="reply-text"><p>c{n}<p>more</div><span class="like-count">{n}k</span></div>'
    html = '<div class="reply-item"><a class="user-name">x</a></div>' + '<div class="reply-item"><div class="my text">plain</div></div>' + "".join(map(block, range(20)))
    comments = post(html)[3]
    assert comments[:2] == [("", "plain", 0), ("u0", "c0 more", 0)] and comments[-1] == ("u7", "c7 more", 7000) and len(comments) == 9  # the first of ten has no text


def test_numbers():
    assert [number(x) for x in ("1,234", "2.5k", "1.2万", "3千", "", "many", "-4")] == [1234, 2500, 12000, 3000, 0, 0, 0]


def test_deep_and_long_pages_are_read_in_time():
    page = Page("<div><b>" * 50_000 + "x" + "</u></p>" * 50_000)
    assert len(page.elements) == 100_000 and page.text(page.elements[0]) == "x"
    assert len(list(list_rows("<ul>" + '<li><a href="/x">y</a>' * 20_000, "https://h.org"))) == 20_000


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<li><a href='/a'>t</a>"), (2, "", "<article>"), (2, "", "<article>")], "id long, url string, html string")
    assert [(r.id, r.link) for r in rows_of_lists(df).collect()] == [(None, "/a")] or rows_of_lists(df).first().link == "https://u/a"
    assert posts_of(df).count() == 4 and comments_of(df).count() == 0 and posts_of(df.limit(0)).count() == 0


def test_entities_need_their_semicolon():
    page = "<h1>a &amp b &amp; c &lt;&#65;&#x42; &nosuch; &ampx; d&amp</h1><article><a href='/x?a=1&copy=2&amp;b'>x</a> y&quot</article>"
    _, title, content, _ = post(page)
    assert title == "a &amp b & c <AB &nosuch; &ampx; d&amp"
    assert content == "x y&quot"
    assert next(e for e in Page(page).elements if e.tag == "a").named["href"] == "/x?a=1&copy=2&b"

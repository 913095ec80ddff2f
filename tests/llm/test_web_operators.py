"""URL filters, WARC files and HTML extraction."""

import base64
import hashlib
import re
import time
from datetime import date
from html import unescape

import duckdb
import pytest

from tidemark.llm import html_extract, queries, url_filters, warc


def _host(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    return rest.split("/")[0].split("?")[0].split("#")[0].rsplit("@", 1)[-1].split(":")[0].lower().rstrip(".")


def test_filters_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.execute(queries.ORACLES["op4_url_filters"]).fetchall()
    columns = [c[0] for c in con.description]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.op4_url_filters(spark, sf).select(*columns).collect())


def test_filters_by_brute_force(spark):
    entries = [
        ("l", "block", "Bad.org", "add", date(2024, 1, 10)), ("l", "block", "Bad.org", "remove", date(2024, 2, 1)), ("l", "block", "Bad.org", "add", date(2024, 3, 1)),
        ("l", "allow", "ok.bad.org", "add", date(2024, 1, 1)), ("m", "block", "ok.bad.org/x", "add", date(2024, 1, 1)), ("l", "block", None, "add", date(2024, 1, 1)),
        ("l", "block", "gone.org", "add", date(2024, 1, 5)), ("l", "block", "gone.org", "remove", date(2024, 1, 5)), ("l", "allow", "Bad.org", "add", date(2024, 3, 1)), ("l", "block", "nodate.org", "add", None),
    ]
    df = spark.createDataFrame(entries, "list_name string, verdict string, pattern string, action string, listed_on date")
    cases = [
        ("http://bad.org/", date(2024, 1, 9), False), ("http://bad.org/", date(2024, 1, 10), True), ("https://a.b.BAD.org:8080/p", date(2024, 1, 31), True), ("http://bad.org./", date(2024, 2, 1), False),
        ("http://bad.org", date(2024, 3, 2), False), ("http://ok.bad.org/y", date(2024, 1, 15), False), ("http://ok.bad.org/x/z?q", date(2024, 1, 15), True), ("http://ok.bad.org/xy", date(2024, 1, 15), False),
        ("http://gone.org", date(2024, 1, 6), False), ("http://notbad.org", date(2024, 1, 15), False), (None, date(2024, 1, 15), False), ("", None, False), ("nonsense", date(2024, 1, 15), False), ("http://bad.org/", None, False), ("http://nodate.org", date(2024, 5, 1), False),
    ]
    captures = spark.createDataFrame([(i, u, d, "x") for i, (u, d, _) in enumerate([*cases, cases[1]])], "id long, url string, fetched_on date, rule string")
    got = {r.id: r for r in url_filters.evaluate(captures, df).collect()}
    assert {i: r.blocked for i, r in got.items()} == {i: b for i, (_, _, b) in enumerate([*cases, cases[1]])}
    assert all(r.host == _host(r.url) for r in got.values())
    assert url_filters.evaluate(captures.limit(0), df).count() == 0 and url_filters.evaluate(captures, df.limit(0)).where("blocked").count() == 0


def test_filters_take_any_column_names(spark):
    entries = spark.createDataFrame([("l", "block", "bad.org", "add", date(2024, 1, 1))], "list_name string, verdict string, pattern string, action string, listed_on date")
    names = ["id", "url", "fetched_on", "__blocked", "__rule", "__url", "__on", "__best", "domain", "valid_from", "path"]
    rows = [(1, "http://bad.org/", date(2024, 1, 2), *"abcdefgh"), (1, "http://bad.org/", date(2024, 1, 2), *"abcdefgh"), (2, "http://ok.org/", None, *"abcdefgh")]
    got = url_filters.evaluate(spark.createDataFrame(rows, names), entries).collect()
    assert [tuple(r)[3:11] for r in got] == [tuple("abcdefgh")] * 3 and sorted((r.id, r.blocked, r.rule) for r in got) == [(1, True, "l:bad.org"), (1, True, "l:bad.org"), (2, False, None)]


def test_warc_round_trip(spark, sf):
    pages = duckdb.sql(f"select page_id, coalesce(html, '') from '{sf}/pages.parquet'").fetchall()
    first = {}
    for i, h in sorted(pages):
        first.setdefault(h, i)
    got = queries.op6_warc(spark, sf).collect()
    assert len(got) == len(pages)
    html = dict(pages)
    for r in got:
        raw = html[r.page_id].encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        own = first[html[r.page_id]] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first[html[r.page_id]]))


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_warc_of_odd_pages(spark, min_bytes):
    rows = [(1, "http://a/", None, 0), (2, "http://a/", "", 0), (3, None, "same text", 0), (4, "http://b/", "same text", 0), (5, "", "\x1f\u008b\x08 gzip \x1f\u008b", 0), (6, "http://c/\r\nX: y", "ab", 0), (7, "http://d/", "ab", 0), (8, "http://e/", "x" * 2_000_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages, warc.new_folder(pages), min_bytes=min_bytes)).collect()}
    assert sorted(got) == [r[0] for r in rows]
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == ({2: 1, 4: 3, 7: 6} if min_bytes == 0 else {4: 3})
    assert all(r.payload_bytes == len((rows[i - 1][2] or "").encode()) for i, r in got.items())


PAGE = """<html><head><title>T</title><style>x</style></head><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>
<div class="wrap"><div class="post-{n}"><h1>Title {n}</h1><p>First  paragraph&nbsp;of &amp; about the text, long enough to count as one.</p><ul><li>one</li><li>two</li></ul><p>Second <b>bold</b> part<script>bad()</script> ends.</p></div>
<aside>Related</aside><section class="comments"><p>A reader comment that is rather long too, but is none of the article.</p></section></div><form><input>Search</form><footer>Imprint</footer></body></html>"""


@pytest.mark.parametrize("split_bytes", [37, 1000, 5000])
def test_warc_splits_inside_files(spark, split_bytes):
    """Each record is read once wherever the ranges begin, also where payloads hold magic bytes or whole members."""
    stored = warc._member(b"WARC/1.1\r\nWARC-Record-ID: <x>\r\nContent-Length: 0\r\n\r\n", 6).decode("latin-1")
    pages = [(i, f"http://h/{i}", f"page {i} " + "\x1f\x8b\x08" * (i % 4) + "".join(chr(97 + (i * k * k) % 23) for k in range(60 * i))) for i in range(20)]
    pages += [(30, "http://h/m", stored), (31, "http://h/e", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2, "page_id")
    files = warc.write_archives(df, warc.new_folder(df), level=0)
    got = [(r.page_id, r.url, r.payload.decode()) for r in warc.read_archives(files, split_bytes).collect()]
    assert sorted(got) == pages


def test_html(spark):
    rows = [(n, f"http://h.org/{n}", PAGE.replace("{n}", str(n)), "t") for n in range(3)]
    rows += [(10, None, None, "t"), (11, "", "", "t"), (12, "http://x.org", "<p>broken <b", "t"), (13, "http://x.org", "plain &lt;text&gt;", "t"), (14, "http://x.org", "<nav>only a menu</nav>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert len(got) == len(rows)
    for n in range(3):
        assert got[n].text == f"Title {n}\nFirst paragraph of & about the text, long enough to count as one.\none\ntwo\nSecond bold part ends."
    assert [got[i].text for i in (10, 11, 13, 14)] == ["", "", "plain <text>", ""] and got[12].text.startswith("broken")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_keeps_blocks_beside_an_inner_container(spark):
    body = "".join(f"<p>Sentence {i} of the article's main text, with some words more.</p>" for i in range(20))
    page = f"<html><body><div><a href=/>Home</a> | <a href=/n>News</a></div><article><p>The lead.</p><div class=body>{body}</div><p>The end.</p></article></body></html>"
    df = spark.createDataFrame([(n, f"http://h.org/{n}", page) for n in range(3)], "page_id long, url string, html string")
    for r in html_extract.extract(df).collect():
        lines = r.text.split("\n")
        assert (lines[0], lines[-1], len(lines), r.path) == ("The lead.", "The end.", 22, "/html/body/article")


@pytest.mark.parametrize("start", ["<div class='content has-sidebar'>", "<div id='main-no-ads'>", "<article class='post with-comments'>", "<div class=sidebar-layout>", "<div class='widget'><section id=comments>", "<main class=content-banner>"])
def test_html_keeps_articles_with_telling_names(start):
    page = f"<body><nav>Menu</nav><p>Before.</p>{start}<p>The text of the article, which is most of the page.</p><div class='cookie-notice'>We use cookies</div></body>"
    assert html_extract.text_by_path(page, None)[0] == "Before.\nThe text of the article, which is most of the page."


@pytest.mark.parametrize("name", ["ad", "ad-1", "page-footer", "box sidebar", "cookie-notice"])
def test_html_leaves_out_named_boilerplate(name):
    page = f"<body><article>The text of the article, which is most of the page.</article><div class='{name}'>Not this.</div><p>The end.</p></body>"
    assert html_extract.text_by_path(page, None)[0] == "The text of the article, which is most of the page.\nThe end."


def test_html_leaves_out_an_advert_longer_than_the_article():
    page = "<body><div class=ad>An advert that is longer than the article.</div><article>Short text.</article></body>"
    assert html_extract.text_by_path(page, None)[0] == "Short text."


@pytest.mark.parametrize(("body", "text"), [
    ("<article><p>one <script>x()</script>two<!-- c --> <style>p{}</style>three</p></article>", "one two three"),
    ("<header>Site</header><article><header><h1>Title</h1><nav>menu</nav></header><p>Text</p><footer>foot</footer></article>", "Title\nText"),
    ("<nav>menu</nav><form action=/><div><p>All of the page is in a form.</p><p>And more.</p></div></form>", "All of the page is in a form.\nAnd more."),
    ("<article><p>Text of the page.</p></article><form><p>Write to us, in as many words as you like to, please.</p></form>", "Text of the page."),
    ("<article><p class=byline>By A. B.</p><p>Text</p><div class=comments><p>First!</p></div></article>", "By A. B.\nText"),
    ("<article><p>a<br>b<p>c<blockquote>d<p>e</blockquote>f <button>no</button>g</article>", "a\nb\nc\nd\ne\nf g"),
    ("<article><p><a href=/x>all<p>links end with their block</p> so <b>this</b> counts</article>", "all\nlinks end with their block\nso this counts"),
    ("<ul><li>one<li>two<ul><li>in<li>ner</ul><li>three</ul><table><tr><td>x<td>y<tr><td>z</table>", "one\ntwo\nin\nner\nthree\nx\ny\nz"),
    ("<p>5 &lt; 6 &amp;&nbsp;7 &#8364;</p><p>\u00a0</p></div></p></section><p>stray</p>", "5 < 6 & 7 \u20ac\nstray"),
])
def test_html_by_hand(body, text):
    assert html_extract.text_by_path(f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>", None)[0] == text
    assert html_extract.text_by_path(f"<head><title>t</title>{body}", None)[0] == text


@pytest.mark.parametrize("start", ["<div>", "<div class='c{i}'><p>", "<blockquote>", "<ul><li>", "<table><tr><td>", "<a href=/>", "<b>", "<form>", "<div class=ad>", "<p", "<!--", "</div><x", "<button>"])
def test_html_takes_time_in_proportion_to_its_length(start):
    page = "".join(start.replace("{i}", str(i)) + f"t{i} " for i in range(20_000)) + "</div></p></li></td></x>" * 20_000
    begun = time.perf_counter()
    html_extract.text_by_path(f"<body><p>text</p>{page}", "0123456789abcdef")
    assert time.perf_counter() - begun < 6


def _article(html):
    """The text of a test page by plain replacement: all of them hold one article, without boilerplate in it."""
    inner = re.split(r"</article>|<footer>", html.partition("<article>")[2])[0]
    lines = re.sub(r"</?(?:p|h1|h2|br|div|ul|ol|li|blockquote)\b[^>]*>", "\n", re.sub(r"<!--.*?-->", "", inner, flags=re.S).replace("\n", " "))
    lines = (" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in lines.split("\n"))
    return "\n".join(x for x in lines if x)


def test_html_by_brute_force(spark, sf):
    want = {i: _article(h or "") for i, h in duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall()}
    assert {r.page_id: r.text for r in queries.op8_html_extract(spark, sf).collect()} == want


def test_html_whole_table(spark, sf):
    got = queries.op8_html_extract(spark, sf).collect()
    assert len(got) == duckdb.sql(f"select count(*) from '{sf}/pages.parquet'").fetchall()[0][0]
    assert all(r.n_chars == len(r.text) and "<script" not in r.text for r in got) and sum(bool(r.text) for r in got) > len(got) / 2

"""Links: markup, resolution, plans. The standard library is the brute-force oracle."""

import random
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from doctables.functions import html as H
from doctables.functions import urls
from doctables.operators import links as L

PAGES = [
    '<a class="usa-link Document" href="/a.pdf">x</a><A HREF=\'b.pdf\'>y</A>',
    "<a href=/plain?x=1&y=2 class=Document>t</a>",
    '<a href="/q?a=1&amp;b=2" class="Document usa-link">t</a>',
    '<!-- <a href="/hidden"> --><a href="/seen">',
    '<script>var s = "<a href=\'/no\'>";</script><a href="/yes">',
    '<style>a{}</style><div title="<a href=\'/no\'>"><a title="href=\'/no\'" href="/yes"/></div>',
    '<a name="x">no link</a><a href>empty</a><a href="">also</a>',
    '<a href="/1" href="/2">twice</a>',
    '<a class="  usa-link\n Document " href="/blank">',
    '<a href="/unclosed',
    '<script>never closed <a href="/x">',
    '<!-- never closed <a href="/x">',
    '<a href="/a"class="Document">glued</a>',
    "<abbr href='/no'>x</abbr><a\nhref = \"/line\"\tid=z>",
    '<!--x--y--><a href="/c">',
    '<a href="/é?ü=1">accents</a> 1 < 2 <3 <a data-href="/no">',
    '<p a=b"c><a href="/quote">"</p>',
    "<a href=x/><br/><a href=y />",
    '<?php <a href="/pi"> ?><a href="/after">',
    "",
    "plain text",
    '<script src="x"/><a href="/selfclosed">',
    '<a href="/nbsp"><a href="/z">',
]


def _random_page(rng: random.Random) -> str:
    bits = ["<a ", "<a", "href", "=", '"', "'", "/x", ">", "</a>", " ", "<!--", "-->", "<script>", "</script>",
            "class", "Document", "<b>", "&amp;", "&lt;", "&", "&copy=", "t", "<", "/", "<style", "--", "\n", "é"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))


def test_anchors_equal_the_standard_parser(spark):
    rng = random.Random(7)
    attrs = ['href="/a"', "href='b c'", "href=d", "class='k'", 'id="q>r"', "hidden", 'href="/e&amp;f"', 'href="/g&lt;h&i=&#x41;"', 'title="<a href=1>"', '(click)="x"', '*if', '[y]=\'>\'', 'data-href=/no', '{{z}}=1', '`href=2']
    pages = PAGES + [_random_page(rng) for _ in range(3000)]
    for _ in range(500):
        parts = []
        for _ in range(rng.randint(1, 6)):
            tag = rng.choice(["a", "A", "p", "div", "script", "style"])
            some = " ".join(rng.sample(attrs, rng.randint(0, 4)))
            body = rng.choice(["text", "<b>x</b>", "1 < 2", "<!-- <a href='/c'> -->"])
            parts.append(f"<{tag} {some}>{body}</{tag}>")
        pages.append("".join(parts))
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id INT, html STRING").repartition(4)
    got = {r.id: [(a.href, a.cls) for a in r.a] for r in df.select(
        "id", _anchors(F.col("html")).alias("a")).collect()}
    for i, page in enumerate(pages):
        assert got[i] == [(a["href"], a["cls"]) for a in H.parse_anchors(page)], page


def _anchors(html):
    tokens = H.anchor_tokens(html)
    return F.coalesce(H.parsed_anchors(H.for_parser(html, tokens)), H.strict_anchors(tokens))


def test_well_formed_pages_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(p,) for p in (PAGES[0], PAGES[3], PAGES[4], PAGES[5], PAGES[8], PAGES[17])], "html STRING")
    tokens = H.anchor_tokens(F.col("html"))
    assert df.filter(H.for_parser(F.col("html"), tokens).isNotNull()).count() == 0


def test_references_send_only_the_anchors_to_the_parser(spark):
    page = "<p>long text</p><a href='/x?a=1&amp;amp;b' class=c>t</a><a href=\"/y?a&copy;&#65;&lt=1&b\">u</a>"
    df = spark.createDataFrame([(page,), (page.split("<a href=\"")[0],)], "html STRING")
    rows = df.select(H.for_parser(F.col("html"), H.anchor_tokens(F.col("html"))), _anchors(F.col("html")))
    (both, found), (none, first) = rows.collect()
    assert "long text" not in both and [a.href for a in found] == ["/x?a=1&amp;b", "/y?a©A<=1&b"]
    assert none is None and [a.href for a in first] == ["/x?a=1&amp;b"]


def test_huge_pages(spark):
    """No deep recursion and no repeated scanning, whatever the page is made of."""
    n = 200_000
    pages = [
        "<script>" + "a<b " * n + "</script><a href='/1'>",
        "<!--" + "a-b " * n + "--><a href='/1'>",
        "<p " + " ".join(f"a{i}='{i}'" for i in range(n // 4)) + "><a href='/1'>",
        '<p title="' + "x" * (4 * n) + '"><a href=\'/1\'>',
        "<b>" * n + "<a href='/1'>",
        "text < 1 " * n + "<a href='/1'>",
    ]
    df = spark.createDataFrame([(p,) for p in pages], "html STRING")
    for r in df.select(_anchors(F.col("html")).alias("a")).collect():
        assert [a.href for a in r.a] == ["/1"]
    hard = ["<script>a" * 20_000, "<!doctype " * 20_000, "<a href='" * 20_000, "<!-- " * 20_000, "<style" * 20_000]
    df = spark.createDataFrame([(p,) for p in hard], "html STRING")
    assert df.filter(H.is_odd(H.anchor_tokens(F.col("html")))).count() == len(hard)


@pytest.mark.parametrize("wanted,expected", [
    ("usa-link Document", {"/exact", "/blanks"}),
    ("Document", {"/exact", "/blanks", "/swapped", "/extra"}),
])
def test_class_rule(spark, wanted, expected):
    page = (
        '<a class="usa-link Document" href="/exact"><a class=" usa-link  Document" href="/blanks">'
        '<a class="Document usa-link" href="/swapped"><a class="usa-link Document x" href="/extra"><a href="/none">'
    )
    df = spark.createDataFrame([("u", page)], "url STRING, html STRING")
    assert {r.href for r in L.extract_links(df, wanted).collect()} == expected


HREFS = [
    "/a", "a/b", "//h/x", "http://o.org/p", "https://o.org/p?q#f", "mailto:x@y", "#f", "?k", "", " ", "../a", "/../a",
    "/a/../b", "./a", "a/./b/..", "a//b", "/a//b", "/a/..", "..", ".", "a;p", "/a;p?q#f", ";p", "a/b;p/c", "http:rel",
    "HTTP://Up.org/x", "/x?y=/../z", "/x#../y", "///triple", "//", "a#", "a?", "/a?#", "\t/tab\n", " /lead", "/trail ",
    "/a b", "javascript:void(0)", "a:b", "1a:b", "//h", "//h?x", "//h#", "/.hidden", "/a.b", "/...", "http://o.org", "http://o.org#",
    "?", "x/../../..", "/é/ü", "https:/one", "https:", "http:",
]


@pytest.mark.parametrize("page", ["https://p.org:8080/d/e.html?x#y", "http://p.org"])
def test_resolution_equals_urljoin(spark, page):
    rng = random.Random(3)
    bits = ["/", "..", ".", "a", "?", "#", ";", "b c", "//", "%20"]
    many = HREFS + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(2000)]
    df = spark.createDataFrame([(page, h) for h in many], "u STRING, h STRING")
    for r in df.select("h", urls.resolve_link(F.col("u"), F.col("h")).alias("got")).collect():
        assert r.got == urljoin(urljoin(page, "/"), r.h), r.h


def test_url_path(spark):
    many = ["http://h/a/b.pdf?x#y", "http://h", "http://h/a;p", "mailto:a@b", "http://h/a;b/c;d", "http://h?x"]
    df = spark.createDataFrame([(u,) for u in many], "u STRING")
    for r in df.select("u", urls.url_path(F.col("u")).alias("p")).collect():
        assert r.p == urlparse(r.u).path


def test_catalog_links_and_plans(spark):
    page = '<a class="usa-link Document" href="/1.pdf"><a class="usa-link Document" href="d/2.pdf"><a href="/n">'
    pages = spark.createDataFrame(
        [("http://s/p", page), ("http://s/p", page), ("http://s/none", "<p>")], "url STRING, html STRING")
    catalog = spark.createDataFrame(
        [(1, "http://s/p"), (2, "http://s/none"), (3, "http://s/lost"), (4, "http://s/p")], "publication_id LONG, url STRING")
    rows = L.catalog_links(catalog, pages)
    assert sorted((r.publication_id, r.link_pos, r.link_url) for r in rows.collect()) == [
        (1, 0, "http://s/1.pdf"), (1, 1, "http://s/d/2.pdf"), (4, 0, "http://s/1.pdf"), (4, 1, "http://s/d/2.pdf")]
    plan = {r.publication_id: (r.link_url, r.file_path, r.n_links) for r in L.download_plan_by_id(rows).collect()}
    assert plan == {1: ("http://s/d/2.pdf", "1.pdf", 2), 4: ("http://s/d/2.pdf", "4.pdf", 2)}
    assert sorted((r.publication_id, r.link_pos) for r in L.overwritten_links(rows).collect()) == [(1, 0), (4, 0)]
    listed = {r.publication_id: [(x.link_pos, x.link_url) for x in r.links] for r in L.download_candidates(rows).collect()}
    assert listed[4] == [(1, "http://s/d/2.pdf"), (0, "http://s/1.pdf")]
    paths = {r.file_path: r.n_links for r in L.download_plan_by_path(rows).collect()}
    assert paths == {"1.pdf": 2, "d/2.pdf": 2}


def test_copies_of_pages(spark):
    """The newest copy with links wins; without times the fullest; an empty one never."""
    def page(*hrefs):
        return "".join(f'<a class="usa-link Document" href="{h}">' for h in hrefs)

    rows = [("http://s/a", 1, page("/x", "/y")), ("http://s/a", 2, page("/z")), ("http://s/a", 3, "<p>busy</p>"), ("http://s/b", 1, "<p>")]
    pages = spark.createDataFrame(rows, "url STRING, fetched_at INT, html STRING")
    assert {r.url: r.hrefs for r in L.page_lists(pages).collect()} == {"http://s/a": ["/z"], "http://s/b": []}
    assert {r.url: r.hrefs for r in L.page_lists(pages.drop("fetched_at")).collect()}["http://s/a"] == ["/x", "/y"]


def test_order_of_a_catalog_with_repeated_ids(spark):
    pages = spark.createDataFrame([("http://s/p", '<a class="usa-link Document" href="/a0"><a class="usa-link Document" href="/a1">'),
                                   ("http://s/q", '<a class="usa-link Document" href="/b0">')], "url STRING, html STRING")
    catalog = spark.createDataFrame([(1, "http://s/p", 0), (1, "http://s/q", 1), (2, "http://s/q", 2), (2, "http://s/q", 3)],
                                    "publication_id LONG, url STRING, catalog_pos INT")
    links = L.catalog_links(catalog, pages)
    assert {r.publication_id: (r.link_url, r.n_links) for r in L.download_plan_by_id(links).collect()} == {1: ("http://s/b0", 3), 2: ("http://s/b0", 2)}
    lost = sorted((r.publication_id, r.catalog_pos, r.link_pos) for r in L.overwritten_links(links).collect())
    assert lost == [(1, 0, 0), (1, 0, 1), (2, 2, 0)]
    seeds = catalog.select("url", "catalog_pos")
    assert {r.file_path: r.n_links for r in L.download_plan_by_path(L.catalog_links(seeds, pages)).collect()} == {"a0": 1, "a1": 1, "b0": 3}


def test_only_named_pages_are_parsed(spark, monkeypatch):
    """The semi-join is below the parser, whatever the catalog's length, and page bodies do not move."""
    pages = spark.range(2_000).select(
        F.concat(F.lit("http://s/p"), F.col("id").cast("string")).alias("url"),
        F.concat(F.lit('<a class="usa-link Document" href="/f'), F.col("id").cast("string"), F.lit('.pdf">x</a>')).alias("html"),
    )
    pages = pages.unionByName(spark.createDataFrame([(None, "<a href=x>")], "url STRING, html STRING"))
    rows = [(i, f"http://s/p{i}") for i in range(0, 4_000, 100)] + [(-1, "http://s/p0"), (-2, None)]
    catalog = spark.createDataFrame(rows, "publication_id LONG, url STRING")
    wanted = L.wanted_pages(catalog, pages)
    assert wanted.columns == pages.columns
    assert sorted(r.url for r in wanted.collect()) == sorted(f"http://s/p{i}" for i in range(0, 2_000, 100))
    want = sorted((i, f"http://s/f{u[10:]}.pdf") for i, u in rows if u and int(u[10:]) < 2_000)
    links = L.catalog_links(catalog, pages)
    assert sorted((r.publication_id, r.link_url) for r in links.collect()) == want
    plan = links._jdf.queryExecution().executedPlan().toString()
    arrow, semi = plan.index("ArrowEvalPython"), plan.index("LeftSemi")
    assert arrow < semi and "Exchange" not in plan[arrow:semi]
    # A set that is too small for its catalog lets more pages through and changes nothing else.
    monkeypatch.setattr(L, "WANTED_BITS", 64)
    assert L.wanted_pages(catalog, pages).count() > len(want)
    assert sorted((r.publication_id, r.link_url) for r in L.catalog_links(catalog, pages).collect()) == want
    # Repeated and missing URLs in an empty catalog.
    assert L.catalog_links(catalog.limit(0), pages).count() == 0

"""Main text: what marks, hidden elements and templates decide, on single pages and whole hosts."""

from collections import Counter

import pytest

from tapeflow.llm import html_extract

STORY = "<p>" + "Long story text here. " * 30 + "</p>"
TEXT = "Long story text here. " * 30


def alone(page):
    return html_extract.extract(page, {}, set(), any(x[4] for x in html_extract.events(page)[0]))


@pytest.mark.parametrize(
    ("page", "there", "gone"),
    [
        (f'<body class="home no-sidebar">{STORY}</body>', [], []),
        (f'<body class="with-sidebar"><div class="page has-menu">{STORY}</div><div class="sidebar">SIDE</div></body>', [], ["SIDE"]),
        (f'<form id="aspnetForm"><div>{STORY}</div><input></form>', [], []),
        (f'<div>{STORY}</div><form><p>Your name</p></form>', [], ["Your name"]),
        (f'<article class="post ad-free">{STORY}</article>', [], []),
        (f'<main><section class="comments-off">{STORY}</section></main>', [], []),
        (f'<article>{STORY}<ul class="steps share-list"><li>One</li><li>Two</li></ul></article>', ["One", "Two"], []),
        (f'<article>{STORY}<ul class="share-list"><li><a href=1>Tell one</a></li><li><a href=2>Tell all</a></li></ul></article>', [], ["Tell"]),
        (f'<article>{STORY}<p class="advert">BUY<p>After</article>', ["After"], ["BUY"]),
        (f'<article><p>Text <span class="comment">READER</span> more</p>{STORY}</article>', ["Text more"], ["READER"]),
        (f'<article>{STORY}<ul><li class="comment"><p>READER</p><p>AGAIN</p></li><li>Fine</li></ul></article>', ["Fine"], ["READER", "AGAIN"]),
        (f'<article>{STORY}<p hidden>SECRET</p><p aria-hidden="true">SECRET</p><p style="display: none">SECRET</p>Seen</article>', ["Seen"], ["SECRET"]),
        (f'<div id="commentList"><div>READER</div></div><div>{STORY}</div>', [], ["READER"]),
        (f'<div class="x"><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div>{STORY}</div>', [], ["One", "Three"]),
        (f'<p class="advert">BUY<div>{STORY}</div>tail', ["tail"], ["BUY"]),
        ("<b>" * 3000 + f"<p>{STORY}" + "<p>x" * 3000, ["x"], []),
    ],
)
def test_single_pages(page, there, gone):
    got = alone(page)
    assert " ".join(TEXT.split()) in got
    assert all(x in got for x in there) and not any(x in got for x in gone)


def test_template_tells_content_by_itself(spark, sf_dir):
    """Given pages whose elements are all called alike: the template finds what the names told before."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    want = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages).collect()}
    names = {'<div class="ad">': '<div class="k1">', "<nav>": '<div class="k0">', "</nav>": "</div>", "<article>": '<div class="k2">', "</article>": "</div>", "<footer>": '<div class="k3">', "</footer>": "</div>"}
    rows = []
    for r in pages.collect():
        page = r["html"]
        for old, new in names.items():
            page = page.replace(old, new)
        rows.append((r["page_id"], r["url"], page))
    hosts = Counter(u.split("/")[2] for _, u, _ in rows)
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, pages.schema)).collect()}
    large = [p for p, u, _ in rows if hosts[u.split("/")[2]] >= html_extract.HOST_PAGES]
    assert large and all(got[p] == want[p] for p in large)
    bare = {p: alone(page) for p, _, page in rows}
    assert all(bare[p] != want[p] for p in large if want[p])


def test_hosts_of_copies_keep_their_article(spark):
    page = '<html><body><div class="a{i}">x{i}</div><div><p>The one story that all pages of this host are copies of.</p></div></body></html>'
    df = spark.createDataFrame([(i, f"http://a.example.com/{i}", page.format(i=i)) for i in range(12)], "page_id long, url string, html string")
    assert all("The one story" in r["text"] for r in html_extract.extract_main_text(df).collect())


def test_small_hosts_lose_their_boilerplate(spark):
    page = "<html><body><div><p>Story {i} that is told at some length</p><p>and goes on {i} for more than that</p></div><div>All rights reserved</div></body></html>"
    for n in (3, 4, 20):
        df = spark.createDataFrame([(i, f"http://a.example.com/{i}", page.format(i=i)) for i in range(n)], "page_id long, url string, html string")
        got = [r["text"] for r in html_extract.extract_main_text(df).collect()]
        assert all(t.startswith("Story") and "All rights" not in t for t in got)


def test_classes_by_occurrence_equal_plain_deduction(spark):
    """Tokens with one occurrence vector form a class, whatever the order of pages and copies of them."""
    rows = []
    for i in range(9):
        extra = "<section><h4>x</h4></section>" if i % 3 == 0 else ""
        rows.append((i, "http://h.example.com/", f"<html><body><div class=top>T{i}</div>{extra}<div class=end>E{i}</div></body></html>"))
    vectors = {}
    for i, _, page in rows:
        for token, *_ in html_extract.events(page)[0]:
            if token:
                vectors.setdefault(token, set()).add(i)
    classes = Counter(frozenset(v) for v in vectors.values())
    assert classes == {frozenset(range(9)): 7, frozenset((0, 3, 6)): 4}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(df).collect()}
    assert all(got[i].split("\n") == [f"T{i}", *(["x"] if i % 3 == 0 else []), f"E{i}"] for i in range(9))

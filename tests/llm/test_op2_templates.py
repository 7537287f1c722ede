import html
import os
import random
import re
import time
from collections import defaultdict

import pytest

from hearthstat.llm.html import BLOCK, Page
from hearthstat.llm.op2_templates import extract_text, op2_site_templates, site_templates

CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<article><h1>T &amp; u</h1><p>x <b>y</b><br>z\n\tw<p>q", "T & u\n\nx y z w\n\nq"),
    ("<nav>m</nav><header><h1>site</h1></header><main><div>one<aside>side</aside>two</div></main><footer>f", "one\n\ntwo"),
    ("<article><div class='cookie-notice'>n</div><p>t</p><form>f<p>g</p></form><section id=comments><article>c</article></section></article>", "t"),
    ('<article><p title="a>b" class=lead>x</p><script>var t="</p>";</script><style>p{}</style><!-- c --><p>y&nbsp;&eacute;&#8212;&bogus;&amp</p></article>', "x\n\ny é—&bogus;&"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\n\nb\n\nc\n\nd"),
    ("a < b <3 </nope> c <p hidden>h</p> d", "a < b <3 c\n\nd"),
    ("<article>x<!-- open", "x"), ("<article>x<script>open", "x"), ("", ""), ("<", "<"), ("<a title='open>x", "x"),
    ("<div>" * 3000 + "deep", "deep"), ("<article class='post share'>kept</article>", "kept"),
]


@pytest.mark.parametrize("source, text", CASES)
def test_pages(source, text):
    assert Page(source).text() == text


@pytest.mark.parametrize("source, text", [
    ('<article><h2 id="related-work">Related work</h2><h2 id="comments">Comments</h2><p>x</p></article>', "Related work\n\nComments\n\nx"),
    ('<article><section id="social-impact">a</section><div class="share-price">b</div><p class="menu-item-text">c</p><div class="post-widget">d</div></article>', "a\n\nb\n\nc\n\nd"),
    ('<main><div class="search">a</div><div class="ad-slot">b</div><div class="cookie-banner">c</div><div role="search">d</div></main>', "a\n\nd"),
    ('<main><h1>T</h1><p>body</p><article>teaser</article></main>', "T\n\nbody\n\nteaser"),
    ('<main><p>by x</p><article><p>a long article text that is most of it</p></article></main>', "a long article text that is most of it"),
    ('<div class="sidebar"><article>side</article></div><main><p>body</p></main>', "body"),
    ('<div class="sidebar">s</div><div class="share-box">s</div><p class="share-price">p</p>', "p"),
])
def test_names_are_whole_and_main_text_stays(source, text):
    assert Page(source).text() == text


def test_recurring_subtrees_go_but_copied_articles_stay(spark):
    page = lambda i, extra="": f"<article><h1>t{i}</h1><p>text {i}</p>{extra}</article>"
    box = "<div><p>Read <i>more</i> here</p></div>"
    rows = [(i, f"http://A.example/{i}", page(i, box)) for i in range(40)]
    rows += [(100 + i, f"https://u:p@b.example:80/{i}", page("same", box)) for i in range(40)]
    rows += [(200 + i, f"http://c.example/{i}", page(i, box if i % 3 == 0 else "")) for i in range(60)]
    rows += [(300, None, None), (301, "no url", ""), (302, None, "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as host", "'d' as templates")
    got = {r["row"]["page_id"]: r["text"] for r in extract_text(df, ["page_id", "host"]).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"t{i}\n\ntext {i}" for i in range(40))
    assert all(got[100 + i] == "tsame\n\ntext same\n\nRead more here" for i in range(40))
    assert all(got[200 + i] == f"t{i}\n\ntext {i}" + ("\n\nRead more here" if i % 3 == 0 else "") for i in range(60))
    assert (got[300], got[301], got[302]) == ("", "", "x")
    assert extract_text(df.limit(0), ["page_id"]).count() == 0


def test_small_hosts_pages_without_article_and_folders(spark):
    rows = [(i, f"http://small.example/{i}", f"<div class=x><p>Home of things</p></div><div><p>text {i}</p></div><div>all rights {'kept' if i else 'left'}</div>") for i in range(3)]
    rows += [(100 + i, f"http://big.example/{'shop' if i < 6 else 'blog'}/{i}", ("<div>Basket of the shop</div>" if i < 6 else "") + f"<p>page {i}</p>") for i in range(60)]
    rows += [(200 + i, f"http://two.example/{i}", f"<p>Shared words</p><p>page {i}</p>") for i in range(2)]
    got = {r["row"]["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert [got[i] for i in range(3)] == ["text 0\n\nall rights left", *(f"text {i}\n\nall rights kept" for i in (1, 2))]
    assert all(got[100 + i] == f"page {i}" for i in range(60))
    assert all(got[200 + i] == f"Shared words\n\npage {i}" for i in range(2))


def test_near_copies_on_a_small_host_keep_their_text(spark):
    rows = [(i, f"http://n.example/{i}", f"<article><h1>t</h1><p>the same text</p><p>edit {i}</p></article>") for i in range(4)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()
    assert all(r["text"] == f"t\n\nthe same text\n\nedit {r['row']['page_id']}" for r in got)


def test_article_sections_named_like_notices_stay():
    source = (
        "<main><h1>Daemons</h1><p>first</p><math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math><section id='login'><h2>Login</h2><p>the login daemon</p></section>"
        "<div id='notice'>On notice periods</div><p aria-hidden='true'>seen</p><div id='comments'><p>Comments on the law</p></div><p>last</p>"
        "<div id='login-box'><p>Log in</p><form><input></form></div><div id='comments'><article>a reply</article></div><div id='ad-1'>buy</div></main>"
    )
    assert Page(source).text() == "Daemons\n\nfirst\n\nx=1\n\nLogin\n\nthe login daemon\n\nOn notice periods\n\nseen\n\nComments on the law\n\nlast"


def test_deep_and_long_pages_take_linear_time():
    start = time.perf_counter()
    assert Page("<div>" * 20_000 + "deep").text() == "deep"
    assert Page("<p>" + "<b><i>" * 20_000 + "deep" + "</i></b>" * 20_000 + "<div>x").text() == "deep\n\nx"
    assert len(Page("<article>" + "<p>some words &amp; more</p>" * 50_000 + "</article>").text()) == 50_000 * 19 - 2
    assert time.perf_counter() - start < 10


def test_boilerplate_in_main_goes_on_small_hosts(spark):
    box = "<div><p>Read more of our stories here</p></div>"
    rows = [(i, f"http://s.example/{i}", f"<main><h1>title {i}</h1><p>a text of its own, {i}</p><p>and another one, {i}</p>{box}</main>") for i in range(3)]
    got = {r["row"]["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert got == {i: f"title {i}\n\na text of its own, {i}\n\nand another one, {i}" for i in range(3)}


def test_passages_that_a_few_articles_quote_stay(spark):
    rows = [(i, f"http://q.example/{i}", f"<article><h1>title {i}</h1><p>a quoted passage</p><p>its own text {i}</p><p>more of it {i}</p></article>") for i in range(5)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()
    assert all("a quoted passage" in r["text"] for r in got)


def test_templates_like_a_dictionary_of_subtrees(spark):
    rnd = random.Random(4)
    boxes = [f"<div><p>box {k}</p><ul><li>{k}</ul></div>" for k in range(6)]
    rows = []
    for i in range(120):
        host, folder = rnd.choice("abc"), rnd.choice(["", "x/", "y/"])
        own = rnd.choice(["same", f"text {i}"])
        inner = "".join(b for b in boxes if rnd.random() < 0.5)
        rows.append((i, f"http://{host}.example/{folder}{i}", f"{inner}<article><p>{own}</p></article>"))
    rows += rows[:10]
    where = lambda url: (url.split("/")[2], "/".join(url.split("/")[2:-1]))
    contents, stands = defaultdict(set), defaultdict(set)
    for _, url, source in rows:
        page = Page(source)
        hashes, context = page.hashes(), re.search("<article>.*", source)[0]
        for site in set(where(url)):
            contents[site].add(context)
            for i in range(1, len(hashes)):
                if page.names[i] in BLOCK:
                    stands[site, hashes[i]].add(context)
    often = defaultdict(set)
    for (site, subtree), found in stands.items():
        if len(found) >= 3 and len(found) >= 0.5 * len(contents[site]):
            often[site].add(subtree)
    want = {section: often[host] | often[section] for host, section in {where(url) for _, url, _ in rows}}
    df = spark.createDataFrame([(*where(url), source) for _, url, source in rows], "host string, section string, html string")
    got = {r["section"]: set(r["templates"]) for r in site_templates(df.repartition(5)).collect()}
    assert any(want.values()) and got == {section: found for section, found in want.items() if found}


def test_query_on_table(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op2_site_templates(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", rows[r["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?p>|</?h1>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"]) and r["url"] == rows[r["page_id"]]["url"]

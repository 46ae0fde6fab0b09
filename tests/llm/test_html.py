from maskwright.llm import html_text
from maskwright.llm.html_text import parse

PAGES = "page_id bigint, url string, html string, text string, rid int, blocks string, host string, kept int"
EXTRA = ("t", 1, "b", "h", 2)


def texts(spark, rows, **options):
    table = spark.createDataFrame([(*r, *EXTRA) for r in rows], PAGES).repartition(3)
    return sorted(((r.page_id, r.text) for r in html_text.extract(table, **options).collect()), key=str)


def test_blocks():
    only = lambda h: [t for t, _ in parse(h)]
    assert only("<article><h1>T &amp; t</h1><p><b>One\n two<br><p>Three <i>fo</i>ur&nbsp;</article>") == ["T & t", "One two", "Three four"]
    assert only("<p>a<script>if (x < 1) '</p>'</script>b</p><style>p{}</style><!-- c --><p>d") == ["ab", "d"]
    assert only("<body><header>h</header><nav>n</nav><main><header><h1>t</h1></header>x<aside>s</aside></main><footer>f</footer>") == ["t", "x"]
    assert only("<div class='cookie-notice'>c</div><div id=comments>r</div><div class=adBox>a</div><p hidden>h</p><p>stays</p>") == ["stays"]
    assert only("<form><p>f</p></form><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert only("") == [] and only("a < b") == ["a < b"] and only("<p class=\"x>y") == ["y"] and only("</p></div>x") == ["x"]
    assert only("<p>&lt;p&gt; &#233; &bogus;</p>") == ["<p> é &bogus;"]


def test_values_are_no_attributes_and_articles_keep_their_words():
    kept = [
        '<a href="/the-hidden-gem">x</a>', '<a href="/q?id=search-results">x</a>', '<a href="/x?role=banner">x</a>', '<p title="hidden truths">x</p>',
        '<div data-hidden="false">x</div>', '<p id="related-work">x</p>', '<section id="social-history">x</section>', '<p class="notice-period">x</p>',
        '<h2 id="search">x</h2>', '<div class="widget-theory">x</div>', "<p data-x='class=\"ad\"'>x</p>", "<div alt = 'style=display:none'>x</div>",
        '<p data-class="menu" aria-hidden="false">x</p>', "<ul class=adverbs>x</ul>",
    ]
    for h in kept:
        assert [t for t, _ in parse(f"<article><p>before</p>{h}<p>after</p></article>")] == ["before", "x", "after"], h
    gone = ['<div class="related">x</div>', "<ul class='x share'>x</ul>", "<div ID=newsletter>x</div>", "<p hidden>x</p>", "<div hidden=''>x</div>", "<span style='display: none'>x</span>", "<section role=search>x</section>"]
    for h in gone:
        assert [t for t, _ in parse(f"<article><p>before</p>{h}<p>after</p></article>")] == ["before", "after"], h


def test_both_ways_to_the_templates(spark, monkeypatch):
    rows = [(i, f"https://{'ab'[i % 7 == 0]}.example.com/p", page(i, "Body of page", f"Share {i % 3}")) for i in range(60)] + [(99, None, page(99, "Alone"))]
    few = texts(spark, rows)
    monkeypatch.setattr(html_text, "SENT", 0)
    assert texts(spark, rows) == few and dict(few)[4] == "Body of page 4" and dict(few)[99].startswith("Share")


def test_query(spark, tmp_path):
    rows = [(i, f"https://a.example.com/{i}", f"<nav>m</nav><article><p>Text 😀 {i}</p></article>") for i in range(6)] + [(7, None, None)]
    spark.createDataFrame([(*r, *EXTRA) for r in rows], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: tuple(r)[1:] for r in html_text.op5_html_text(spark, str(tmp_path)).collect()}
    assert got == {**{i: (f"https://a.example.com/{i}", f"Text 😀 {i}", 8) for i in range(6)}, 7: (None, "", 0)}


def page(i, body, share="Share this with friends"):
    return f"<html><body><div><span>{share}</span></div><div><p>{body} {i}</p><p>Same closing words</p></div><div><p>Site notice for all</p></div></body></html>"


def test_template_subtrees_go_per_host(spark):
    rows = [(i, "https://a.example.com/p", page(i, "Body of page")) for i in range(8)] + [(99, "https://b.example.com/p", page(99, "Alone"))]
    got = dict(texts(spark, rows))
    # blocks that recur are template; on a host with one page nothing recurs
    assert got[3] == "Body of page 3"
    assert got[99] == "Share this with friends\nAlone 99\nSame closing words\nSite notice for all"
    article = [(i, "http://c.example.com", f"<article><p>Start {i}</p><div>Follow us</div><p>Often said</p></article>") for i in range(8)]
    assert dict(texts(spark, article))[2] == "Start 2\nOften said"


def test_templates_are_counted_on_pages_with_articles(spark):
    # recurring promos, unnamed boxes and an article teaser go, besides and within articles
    body = "<article><p>Story {0} is long enough to be the text of its page</p><div>Box</div></article><article><p>Teaser</p></article><div><p>Promo</p></div>"
    rows = [(i, f"http://a.example.com/{i}", body.format(i)) for i in range(8)]
    assert dict(texts(spark, rows))[3] == "Story 3 is long enough to be the text of its page"
    assert any(b.around for b in html_text.read("<article><p>x</p></article>")) and html_text.read("<nav>x</nav>")[0].around


def test_rules_never_take_the_article():
    only = lambda h: [t for t, _ in parse(h)]
    assert only("<div><p>The whole text of the page</p></div><article>Teaser</article>") == ["The whole text of the page", "Teaser"]
    assert only("<div class='has-sidebar'><div class=sidebar>s</div><article><p>Text</p></article></div>") == ["Text"]
    assert only("<form><div class='with-banner'><h1>T</h1><p>Text</p></div></form><footer>f</footer>") == ["T", "Text"]
    assert only("<div class=ad>A long advert without a heading</div><article><p>Short</p></article>") == ["Short"]


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, f"https://a.example.com/{i}", page(0, "The same page")) for i in range(20)]
    assert dict(texts(spark, rows))[5].startswith("Share this with friends\nThe same page 0")


def test_rotating_template_on_a_large_host(spark):
    # each of 100 banners is on one page in a hundred
    rows = [(i, f"https://a.example.com/{i}", f"<div><p>Body of page {i}</p></div><div><p>Rotation {i % 100}</p></div>") for i in range(1000)]
    assert {t for _, t in texts(spark, rows)} == {f"Body of page {i}" for i in range(1000)}


def test_messy_pages(spark):
    long = "<p>" + "word &amp; " * 100_000 + "</p>" + "<div>" * 3000 + "deep"
    rows = [(1, None, "<p>x</p>"), (1, None, "<p>x</p>"), (2, "no url", None), (None, "http://h", ""), (3, "http://h", long), (4, "HTTP://User@H:80/x", "<p>y")]
    got = texts(spark, rows)
    assert [t for i, t in got if i == 1] == ["x", "x"] and dict(got)[2] == "" and dict(got)[None] == "" and dict(got)[4] == "y"
    assert dict(got)[3].startswith("word & word &") and dict(got)[3].endswith("\ndeep")
    assert texts(spark, []) == []

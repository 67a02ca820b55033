import html
import random
import re
import time

from hyperweave.llm import htmlextract as hx

PAGE = """<!DOCTYPE html><html><head><title>T &lt;</title><style>p{}</style><script>var a="</p>";</script></head><body class="content">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies.</div>
<aside>Side bar text</aside><article><h1>Title &amp; more</h1><p>First\n  para <b>bold</b>&nbsp;x.<br>next<p>Second &#233; one<p><ul><li>item</ul>
<div class="advert">Buy now.</div><form><label>Name</label><input><button>Send</button></form><p>Short.</p><div class="comments"><p>Nice one!</p></div></article>
<footer>&copy; me</footer>"""


def model():
    return hx.train([PAGE] * 3)


def test_page():
    assert model().text(PAGE) == "Title & more\nFirst para bold x. next\nSecond é one\nitem\nShort."


def test_odd_pages():
    m = model()
    for page in (None, "", "   ", "<!--", "<script>", "</p></p>", "<nav>x</nav>"):
        assert m.text(page) == ""
    assert [b.text for b in hx.blocks_of("a < b <p")] == ["a < b <p"]
    assert m.text("<article><p>a &lt;b&gt; &#x41;&bogus;</p></article>") == "a <b> A&bogus;"
    long = "<article>" + "<p>Some text here.</p>" * 20_000 + "</article>"
    assert m.text(long).count("\n") == 19_999
    deep = "<div>" * 3000 + "<article><p>Deep text.</p></article>"
    assert m.text(deep) == "Deep text."


# The given pages' shape: what names nothing is learned from their text and elements.
MARKED = (
    "<html><head><title>t</title></head><body><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>"
    "<div class=ad>Buy this, it is cheap.</div><article><h1>A title of it</h1><p>A long paragraph, with much text in it. It goes on.</p>"
    "<p>Short one.</p><p>Another long paragraph, with much text in it, and commas. It goes on.</p></article><footer>&copy; me</footer></body></html>"
)
UNMARKED = (
    "<body><div><a href=/>Home</a> <a href=/b>News</a></div><ul><li><a href=a>One thing</a><li><a href=b>Two</a></ul><div><h1>The title of it</h1>"
    "<div>This is a long paragraph, with much text in it. It goes on and on, as articles do.</div><div>So it goes</div>"
    "<div>Another long paragraph, with much text in it. It goes on and on, as articles do.</div></div><div><a href=/c>Contact</a></div></body>"
)


def test_the_cut_decides_about_a_short_line_among_paragraphs():
    m = hx.train([MARKED] * 5)
    blocks = hx.blocks_of(UNMARKED)
    alone, cut = [g > 0 for g in m.gains(blocks)], m.keep(blocks)
    assert [b.text for b, a, c in zip(blocks, alone, cut) if a != c] == ["So it goes"]
    assert [b.text[:9] for b, c in zip(blocks, cut) if c] == ["The title", "This is a", "So it goe", "Another l"]


def test_names_within_an_article():
    page = (
        "<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>First paragraph of it, with text.</p><div class='ad-slot'><p>Buy this now. It is good.</p></div>"
        "<p>Second paragraph, with text.</p><section id='related-work'><p>Energy <math>E</math>, <object>o</object> <svg><text>t</text></svg> so.</p></section>"
        "<div class='comments'><p>I like it, very much so. Me too.</p></div></article>"
    )
    assert hx.train([MARKED] * 5).text(page).split("\n") == [
        "Title", "First paragraph of it, with text.", "Second paragraph, with text.", "Energy E, o t so."
    ]


def test_hostile_pages_take_linear_time():
    for page in (
        "<a '" * 250_000, "<b>" * 8000 + "</i>" * 200_000, "<div><i>" * 30_000 + "</b>" * 100_000, "<!" * 500_000, "<" * 1_000_000, "&" * 1_000_000,
        "<div>" + "<i>" * 8000 + "<div></div>" * 60_000, "<ul>" + "<blockquote>" * 30_000 + "<li></li>" * 60_000, '<a b="' * 200_000, "</p>" * 250_000,
    ):
        start = time.process_time()
        hx.blocks_of(page)
        assert time.process_time() - start < 4, page[:12]


def test_minimum_cut_equals_enumeration():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 8)
        s, t = [r.random() * 3 for _ in range(n)], [r.random() * 3 for _ in range(n)]
        edges = [(i, j, r.random() * 2) for i in range(n) for j in range(i + 1, n) if r.random() < 0.4]
        cost = lambda side: sum(t[i] if side[i] else s[i] for i in range(n)) + sum(c for a, b, c in edges if side[a] != side[b])
        best = min(cost([k >> i & 1 for i in range(n)]) for k in range(1 << n))
        assert abs(cost(hx.minimum_cut(s, t, edges)) - best) < 1e-6


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in hx.extracted(pages, hx.fit(pages)).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [re.sub(r"</?b>", "", b).replace("<br>", " ") for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[p.page_id] == "\n".join(x for b in parts if (x := " ".join(html.unescape(b).split())))


def test_odd_tables(spark):
    kind = "page_id long, url string, html string, text string"
    rows = spark.createDataFrame([(1, None, None, "clash"), (2, "u", "", None), (2, "u", "", None), (None, "u", PAGE, None)], kind)
    got = sorted((r.page_id or -1, r.text, r.n_chars) for r in hx.extracted(rows, hx.fit(rows)).collect())
    assert [g[0] for g in got] == [-1, 1, 2, 2] and got[1][1:] == ("", 0)
    none = spark.createDataFrame([], kind)
    assert hx.extracted(none, hx.fit(none)).count() == 0

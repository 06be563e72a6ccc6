import math
import re
import xml.etree.ElementTree as ElementTree
from html import unescape

from sheaf.llm import html_text, queries

PAGE = """<!doctype html><html><head><title>T</title><script>var a="<p>x</p>";</script></head><body class="no-sidebar">
<header><a href="/">Home</a></header><nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, please agree to all of them now.</div>
<div id="content"><div class="post"><h1>A  title &amp; more</h1><p>First paragraph of the article, with <a href="x">a link</a>
and <b>bold</b> words.<p>Second one, which is unclosed and rather long, so that it counts.<br>Next line.
<ul><li>An item of some length</li><li>Another item of some length</li></ul><!-- comment <p>no</p> -->
<form><input name=q><button>Send</button></form></div>
<div id="comments"><div class="comment">I am a reader and I write a very long comment here, longer than many paragraphs are.</div></div></div>
<aside>Related things</aside><footer>&copy; me</footer></body></html>"""


def test_article_only():
    want = ["A title & more", "First paragraph of the article, with a link and bold words.", "Second one, which is unclosed and rather long, so that it counts. Next line.", "An item of some length", "Another item of some length"]
    assert html_text.main_text(PAGE).split("\n") == want


def test_pages_without_links():
    long = [f"Paragraph {i} of the article goes on for quite a while, " + "with many more words than any item has, " * 8 + "and ends." for i in range(4)]
    article = "<div><div>" + "".join(f"<p>{p}</p>" for p in long) + "</div></div>"
    items = "".join(f"<li>Item {i}</li>" for i in range(40))
    cells = "".join(f"<tr><td>{i}</td><td>cell {i}</td></tr>" for i in range(40))
    side = "<div><p>Some words at the side that are longer than a tenth of nothing.</p></div>"
    for page in (f"<body><ul>{items}</ul>{article}</body>", f"<body>{article}<table>{cells}</table></body>", f"<body>{article}{side}{side}{side}</body>"):
        assert html_text.main_text(page).split("\n") == [p.strip() for p in long]


def test_names_are_no_verdict():
    text = "A paragraph of the article, of some length, so that it is the main text of the page and not what is around it."
    for name in ("content has-sidebar", "no-sidebar", "with-comments", "page-with-toc", "widget"):
        assert html_text.main_text(f"<body><div class='{name}'><div><p>{text}</p><p>{text}</p></div></div><div class=footer>Foot</div></body>").split("\n") == [text] * 2
    inner = f"<h1>T</h1><p class='notice'>{text}</p><h2 id='related-work'>Work</h2><section id='discussion'><p>{text}</p></section><div class='cookie-notice'>Cookies</div>"
    assert html_text.main_text(f"<body><article>{inner}<div class='share-buttons'>Share</div></article></body>").split("\n") == ["T", text, "Work", text]
    assert html_text.main_text(f"<body><form id=f><nav>One</nav><div><p>{text}</p><p>{text}</p></div><form><button>Go</button></form></form></body>").split("\n") == [text] * 2
    assert html_text.main_text(f"<body><p>{text}</p><div id='comments'><article class='comment'>{text * 3}</article></div></body>") == text


def test_density_as_by_its_formula():
    """Densities of a page's nodes against the formula, computed from the markup by ElementTree."""
    markup = "<body><div><a>One</a><a>Two two</a></div><div><p>Some words <a>linked</a> here</p><p>More words than before, and no link</p></div><ul><li>x</li><li>yy <b>z</b></li></ul></body>"
    body = ElementTree.fromstring(markup)
    trim = lambda t: len(re.sub(r"\s+", " ", t or "").strip())
    below = lambda e: [x for x in e.iter() if x is not e]

    def chars(e):
        return trim(e.text) + sum(chars(k) + trim(k.tail) for k in e)

    def links(e):
        return chars(e) if e.tag == "a" else sum(links(k) for k in e)

    share = links(body) / chars(body)

    def density(e):
        c, lc = chars(e), links(e)
        inner_links = lc if e.tag == "a" else sum(chars(x) for x in below(e) if x.tag == "a")
        t, lt = max(1, len(below(e))), max(1, sum(x.tag == "a" for x in below(e)))
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        return c / t * math.log(max(1.0, c / max(1, inner_links) * t / lt)) / max(1.0, math.log(base)) if c else 0.0

    root = html_text.parse(markup)
    nodes = html_text.measure(root)
    nodes = nodes[[n.tag for n in nodes].index("body") :]
    order = [body]
    for e in order:
        order += list(e)
    assert [n.tag for n in nodes] == [e.tag for e in order]
    for n, e in zip(nodes, order, strict=True):
        assert math.isclose(n.density, density(e), abs_tol=1e-12), e.tag
        assert math.isclose(n.total, sum(map(density, e)) if len(e) else density(e), abs_tol=1e-12)


def test_density_alone_finds_the_text(spark):
    """The table's pages with neutral class names and no article element: nothing but density tells the text."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    right = 0
    for page in pages:
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
        bare = page.replace('class="ad"', 'class="zq"').replace("article>", "div>")
        right += html_text.main_text(bare) == "\n".join(b for b in blocks if b)
    assert right > 0.95 * len(pages)


def test_odd_pages(spark):
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("just text &lt; here") == "just text < here"
    assert html_text.main_text("<p>one<p>two") == "one\ntwo"
    assert html_text.main_text("<") == "<" and html_text.main_text("<nav>a</nav>") == ""
    deep = "<div>" * 20_000 + "deep text" + "</div>" * 20_000
    assert html_text.main_text(deep) == "deep text"
    assert len(html_text.main_text("<article>" + "<p>word word</p>" * 20_000 + "</article>").split("\n")) == 20_000
    rows = [(1, None, None, "x"), (2, "u", "<p>same", "y"), (2, "u", "<p>same", "y"), (None, "u", "", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    got = html_text.extract_text(df).collect()
    assert sorted(r["text"] for r in got) == ["", "", "same", "same"] and sorted(r["n_chars"] for r in got) == [0, 0, 4, 4]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_query_on_articles(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op3_html_text(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])

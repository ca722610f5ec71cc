import html
import random
import re
import time

import numpy as np

from millrace.llm.html_text import extract, lines_of, main_text, smooth
from millrace.llm.queries import QUERIES

PAGE = """<html><head><title>T</title></head><body class="no-sidebar"><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>
<div id="cookie-notice">We use cookies to follow you wherever you go.</div><div class="wrap"><div class="sidebar"><p>Words beside the text, many of them, all idle.</p></div>
<div class="content"><h2>The title</h2><p>First   paragraph&nbsp;with &lt;b&gt;, <b>bo</b>ld and a <a href="x">link</a>.<br>New line</p><p>Ok.<ul><li>one<li>two</ul>
<table><tr><td>cell a<td>cell b</table><script>var p = "</p>";</script><form>Your name <input></form><!-- no --></div>
<section class="comments"><p>I liked this very much indeed, thank you.</p></section></div><footer>&copy; all</footer></body></html>"""


def test_a_page_without_article_element():
    assert main_text(PAGE) == "The title First paragraph with <b>, bold and a link. New line Ok. one two cell a cell b"


def test_small_pages():
    for x in (None, "", " ", "<p>", "<script>x", "<div class=ad>buy</div><nav>a</nav>"[:0]):
        assert main_text(x) == ""
    assert main_text("just &amp; text") == "just & text"
    assert main_text("<p>" * 5000 + "deep") == "deep"
    assert main_text("<article><h1>A</h1><p>B</article>" + "<p>outside it</p>") == "A B"
    assert len(main_text("<article>" + "<p>word</p>" * 20000 + "</article>")) == 20000 * 5 - 1


def test_smoothing():
    assert np.allclose(smooth(np.ones(5)), 1) and np.allclose(smooth(np.ones(1)), 1)
    x = smooth(np.array([0, 0, 9.0, 0, 0]))
    assert x.argmax() == 2 and x[1] == x[3]


def test_articles_of_the_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    found = {r.page_id: r for r in QUERIES["op4_html_text"](spark, sf_dir).collect()}
    assert len(found) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*)</article>", p.html, re.S).group(1)
        text = " ".join(html.unescape(re.sub(r"</?(p|h1|br)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert found[p.page_id].text == text and found[p.page_id].n_chars == len(text)


def test_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>a b</p>", "x"), (2, "u", "<p>é😀</p>", "x"), (2, "u", "<p>é😀</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(pages).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("a b", 3), ("é😀", 2), ("é😀", 2)]
    assert extract(pages.limit(0)).columns == ["page_id", "url", "text", "n_chars"]
    assert extract(pages.limit(0)).count() == 0


def soup(rng, teasers=6):
    """A page of bare divs: a menu of links, short notes, an article in two divs, a list of short lines; and the article."""
    words = lambda a, b: " ".join(rng.choice(["salt", "river", "of", "morning", "the", "glass"]) for _ in range(rng.randrange(a, b)))
    links = lambda n: "".join(f"<a href='/{i}'>{words(1, 3)}</a> | " for i in range(n))
    paragraphs = [words(60, 160) + "." for _ in range(5)]
    notes = "".join(f"<div><b>{words(1, 3)}</b><br><i>{words(2, 4)}</i> <u>{words(1, 2)}</u></div>" for _ in range(teasers))
    html = (
        f"<html><body><div>{links(12)}</div><div><ul>{''.join(f'<li>{links(1)}' for _ in range(9))}</ul></div>{notes}"
        f"<div><h2>About {words(2, 4)}</h2><p>{paragraphs[0]}<p>{paragraphs[1]} <a href=x>{words(2, 3)}</a></p><p><a href=y>{words(4, 8)}</a></p></div>"
        f"<div>{''.join(f'<p>{p}</p>' for p in paragraphs[2:])}</div>{notes}<div>{links(8)}</div></body></html>"
    )
    body = html[html.index("<h2>") : html.index(notes, html.index("<h2>"))]
    return html, " ".join(re.sub("<[^>]*>", " ", body).split())


def test_the_threshold_decides_on_pages_without_article_element():
    pages = [soup(random.Random(i)) for i in range(40)]
    assert [main_text(h) for h, _ in pages] == [t for _, t in pages]
    # Without it, all that isn't unwanted by its name would be taken.
    flat = [" ".join(x.text for x in lines_of(h) if not x.unwanted) for h, _ in pages]
    assert all(a != t for a, (_, t) in zip(flat, pages))


def test_the_threshold_decides_among_articles():
    long = "<p>" + "many words of the story told at length " * 12 + "</p>"
    cards = "".join(f"<article><a href=/{i}><b>Read</b> <i>on</i></a> <u>now</u></article>" for i in range(6))
    assert main_text(f"<body>{cards}<article><h1>Title</h1>{long * 3}</article>{cards}") == " ".join(("Title " + "many words of the story told at length " * 36).split())


def test_names_of_elements():
    for name in ("post tag-social", "related-work", "share-price", "no-sidebar", "search-of-lost-time", "noticeboard"):
        assert main_text(f'<article class="{name}"><p>kept <section class="{name}">too</section></article>') == "kept too"
    assert main_text('<article class="ad notice comment">kept</article>') == "kept"
    for name in ("ad", "comment-list", "main-nav", "cookie-banner", "site_footer", "share-buttons wide", "post-comments"):
        assert main_text(f'<article>kept <div class="{name}">gone</div></article>') == "kept"
    assert main_text('<article>a story <article class="comment">well done</article></article>') == "a story"


def test_wrappers_do_not_take_the_article():
    page = "<h1>Title</h1><p>" + "words of the text " * 20 + "</p>"
    whole = " ".join(("Title " + "words of the text " * 20).split())
    assert main_text(f"<body><form action=x>{page}</form></body>") == whole
    assert main_text(f'<div class="social"><p>tag line</p><article>{page}</article></div>') == whole
    assert main_text(f'<p>tag line</p><div id="notice"><main>{page}</main></div>') == whole
    assert main_text(f'{page}<div class="comments"><article class="comment">{page}</article></div>') == whole
    assert main_text(f"<article>{page}<form>Your name<input></form></article>") == whole


def test_malformed_markup():
    cases = {
        "<p>hello <![foo[bar]]> world</p>": "hello world", "<![ x ]>": "", "a<!b": "a", "x<![CDATA[y]]>z": "xz", "<!-- open": "", "a</": "a", "a<b c='": "a", "<p a='b>text</p>": "text",
        "<script>x": "", "&#xD800;&bogus;&amp": "�&bogus;&", "</p></div>a": "a", "<": "<", "1 < 2 <3": "1 < 2 <3", "<style><p>x</style>y": "y",
    }
    assert {x: main_text(x) for x in cases} == cases
    rng = random.Random(3)
    bits = "< > / ! [ ] - -- & # x \" ' = p div article script style CDATA \x00 a </p> <p> <table> <td> <li> <form> ? é 😀".split(" ") + [" "]
    for _ in range(4000):
        main_text("".join(rng.choice(bits) for _ in range(rng.randrange(40))))


def test_time_grows_with_the_length():
    for x in ("<div><b>", "</i></span>", "<!--", "<a b=", "<p ", "<![x", "<p><td><b>", "<hr>x", "<a b=\"", "</", "&#", "<li><ul>"):
        times = []
        for n in (4000, 16000):
            began = time.perf_counter()
            main_text("<p><td>" + "<b>" * n + x * n + "</b></x>" * n)
            times.append(time.perf_counter() - began)
        assert times[1] < 10 * times[0] + 0.2, (x, times)

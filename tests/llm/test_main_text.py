import html
import re
import time

import pytest

from stratasift.llm import main_text as mt
from stratasift.llm.common import read_table
from stratasift.llm.queries import QUERIES


def expected(source):
    body = source[source.index("<article>") + 9 : source.index("</article>")]
    blocks = re.split(r"</?(?:h1|p)>", body.replace("<br>", " "))
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_query(spark, sf):
    pages = {r["page_id"]: r for r in read_table(spark, sf, "pages").collect()}
    rows = QUERIES["op4_main_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == expected(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])
        assert r["url"] == pages[r["page_id"]]["url"]


PAGE = """<html><body class=x><div id=top-menu><p>menu</div><div class="post post-{n}"><h2>Ti&amp;tle</h2>
<p>One <i>two</i>\n three<p>four &lt;b&gt; <a href="/l">link</a><ul><li>five<li>six</ul>
<form>no</form><div class="cookie-notice">no</div><script>var a = "<p>no</p>";</script></div>
<section class="comments"><p>{long}</section><aside>no</aside></body>"""


def test_noise_and_unclosed_tags():
    page = mt.Page(PAGE.format(n=1, long="long comment " * 50))
    assert page.text(None) == "Ti&tle\nOne two three\nfour <b> link\nfive\nsix"
    assert page.votes()[0][0].endswith("div.post")


def test_the_host_decides(spark):
    short = "<body><div class=main{n}>tiny</div><div class=box>{box}</div></body>"
    rows = [(i, "http://a.b/x", short.format(n=i, box="").replace("tiny", "long text " * 9)) for i in range(5)]
    rows.append((9, "http://A.b:80/y", short.format(n=7, box="a box that is longer than the text")))
    rows.append((10, "http://c.d/y", "<body><div class=box>only this</div></body>"))
    got = {r["page_id"]: r["text"] for r in mt.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "tiny" and got[10] == "only this"


def test_salted_join_gives_the_same(spark, sf, monkeypatch):
    pages = read_table(spark, sf, "pages")
    whole = {tuple(r) for r in mt.extract_main_text(pages).collect()}
    monkeypatch.setattr(mt, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in mt.extract_main_text(pages).collect()} == whole


def test_odd_rows(spark):
    rows = [(1, None, None, "z"), (1, None, None, "z"), (None, "http://a.b/c", "<p>x", "q"), (2, "no url", "<" * 2000 + "<a \"" * 500, "h")]
    got = mt.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 4
    assert got.where("page_id = 1").select("text").distinct().collect()[0]["text"] == ""
    assert mt.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert mt.Page(deep).text(None) == "deep"


def test_names_of_themes_and_headings_are_no_noise():
    body = "<h2 id='related-work'>Related work</h2><p class=social-policy>text of a policy</p><p>more text</p>"
    whole = "Related work\ntext of a policy\nmore text"
    for page in (
        f"<body class='home has-sidebar'><article>{body}</article></body>",
        f"<body><div id=content class=with-sidebar><div class=x>{body}</div></div><div class=sidebar><p>no</div></body>",
        f"<body><div class='widget page'><article class=search>{body}</article></div><div class='cookie-notice'>no</div></body>",
        f"<body><div class=banner>{body}</div></body>",
    ):
        assert mt.Page(page).text(None) == whole
    notice = "<body><div class=post><h1>T</h1><p>short</p></div><div class=cookie-notice><p>" + "we use cookies " * 20 + "</div></body>"
    assert mt.Page(notice).text(None) == "T\nshort"
    section = "<body><article><p>before " + "text " * 9 + "</p><section id=search-algorithms><p>inside</p></section><section id=comments>no</section></article></body>"
    assert len(mt.Page(section).blocks) == 2


def test_title_and_lead_outside_the_inner_container(spark):
    body = "<p>" + "long text of the page " * 20 + "</p>"
    pages = [
        f"<body><article><h1>T</h1><p>lead</p><div class=content>{body}</div></article><div class=x>no</div></body>",
        f"<body><main><div class=lead>lead</div><div class=body>{body}</div></main><div class=x>no</div></body>",
        f"<body><div class=post><h1>T</h1><p>lead</p><div class=content>{body}</div></div><div class=x>no</div></body>",
        f"<body><article><section><p>one</p></section><p>between</p><section>{body}</section></article></body>",
    ]
    long = ("long text of the page " * 20).strip()
    want = [f"T\nlead\n{long}", f"lead\n{long}", f"T\nlead\n{long}", f"one\nbetween\n{long}"]
    rows = [(10 * i + j, f"http://h{i}/x", p) for i, p in enumerate(pages) for j in range(3)]
    got = mt.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r["text"] == want[r["page_id"] // 10] for r in got)


ARTICLE = "<html><body><nav><a href=x>Home</a></nav><article{}>{}</article><footer>end</footer></body></html>"
TEXT = "<p>" + "A sentence of the story that goes on for a while. " * 5 + "</p>"


def read(page):
    p = mt.Page(page)
    best = p.votes()
    return p.text(best[0][0] if best else None)


@pytest.mark.parametrize("attributes", [
    ' data-title="Hidden truths"', ' data-hidden="false"', ' class=post title="the hidden valley"', " class='a' onclick=\"x('hidden')\"",
    ' data-role="navigation"', ' data-class="sidebar ad"',
])
def test_words_inside_other_attributes_hide_nothing(attributes):
    assert read(ARTICLE.format(attributes, TEXT)).startswith("A sentence")
    div = ARTICLE.replace("article", "div").format(attributes, TEXT)
    assert read(div).startswith("A sentence")


@pytest.mark.parametrize("part", [
    '<div class="related-work">kept</div>', '<section class="search-algorithms">kept</section>', '<table class="alert-levels"><tr><td>kept</td></tr></table>',
    '<div class="entry-header"><h1>kept</h1></div>', '<div id="cookie-recipes">kept</div>',
])
def test_parts_of_an_article_with_names_of_subjects_stay(part):
    assert "kept" in read(ARTICLE.format("", part + TEXT))


@pytest.mark.parametrize("part", [
    '<div class="cookie-notice">gone</div>', '<div class="related-posts">gone</div>', '<div class="ad">gone</div>', "<div hidden>gone</div>",
    '<div id="comments"><p>gone</p></div>', '<div class="comment-list"><h2>gone</h2></div>', '<div aria-hidden="true">gone</div>', '<div class="ad-slot-3">gone</div>',
])
def test_noise_inside_an_article_goes(part):
    assert "gone" not in read(ARTICLE.format("", TEXT + part))


@pytest.mark.parametrize("unit", ["<a ", "<!--", "<div ", "<!x", '<a "', "<figure>", "<div>", "</p><div>", "<script>", "<li><p>", "</div ", "<"])
def test_broken_pages_take_linear_time(unit):
    page = TEXT + unit * (1_000_000 // len(unit))
    began = time.process_time()
    mt.Page(page).text(None)
    assert time.process_time() - began < 12

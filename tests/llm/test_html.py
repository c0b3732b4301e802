from html.parser import HTMLParser

import pytest

from corvata.llm import html_main
from corvata.llm.html_main import Page

CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<article><h1>A&nbsp;title</h1><p>One <b>t</b>wo<br>three\n\n four<p>five &lt;b&gt; &#233;&#x41;</article><footer>f</footer>", "A title One two three four five <b> éA"),
    ("<nav>m<ul><li>x</ul></nav><div class='ad'>buy</div><main><p>body</p></main><aside>s</aside>", "body"),
    ("<body><header>site</header><article><header><h1>T</h1></header><p>x</p><div class='comments'><p>nice</p></div></article></body>", "T x"),
    ("<div id=content class='has-sidebar'><p>long enough text here</p><form><input>q</form><script>var a='</p>'</script><style>p{}</style></div>", "long enough text here"),
    ("<article><p>a < b and c > d</p><!-- no <p>x</p> --></article>", "a < b and c > d"),
    ("<article><p>cut off <a href='x", "cut off"),
    ("<div class=cookie-notice>we use</div><div><p>" + "words " * 30 + "</p></div>", " ".join(["words"] * 30)),
    ("<nav>only menu</nav>", ""),
    ('<div class="main-search-results"><p>Body of the page</p></div>', "Body of the page"),
    ('<article><p>One.</p><div class="notice-of-change"><p>Two.</p></div><div class="review-comment-policy">Three.</div></article>', "One. Two. Three."),
    ("<article><a title=don't>link</a> It isn't over.</article>", "link It isn't over."),
    ('<article><p title="a > b">x</p><img alt=\'>\' src=y>z</article>', "x z"),
    ("<div class=comment><p>" + "the only text of the page " * 9 + "</p></div><div class=ad>buy</div>", " ".join(["the only text of the page"] * 9)),
    ("<form id=aspnetForm><div><p>" + "a page inside a form " * 9 + "</p></div></form>", " ".join(["a page inside a form"] * 9)),
    ("<article><p>text</p><p class=ad>buy<p>more</article>", "text more"),
    ("<article><ul><li>one<li class=ad>buy<li>two</ul></article>", "one two"),
    ("<article><p>text</p><div class='post-extra-related-box'><a href=x>some link</a> <a href=y>other link</a></div></article>", "text"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_pages(html, text):
    assert Page(html or "").main(None) == text


LONG = "long text " * 20
BESIDE = [
    (f"<main><p>the lead</p><div class=body><p>{LONG}</p></div></main>", f"the lead {LONG}"),
    (f"<body><h1>Title</h1><p>the lead</p><div><p>{LONG}</p></div></body>", f"Title the lead {LONG}"),
    (f"<body><div class=top><h1>Title</h1></div><div><p>{LONG}</p></div></body>", f"Title {LONG}"),
    ("<main><p>a lead nearly as long</p><div class=body><p>as the inner text is</p></div></main>", "a lead nearly as long as the inner text is"),
    (f"<main><div class=intro><p>the lead</p></div><div class=x><p>{LONG}</p></div></main>", f"the lead {LONG}"),
    (f"<body><div class=top>Site</div><div class='article-body'><div class=a>the lead</div><div class=b>{LONG}</div><div class=c><a href=x>a long list of links</a></div></div></body>", f"the lead {LONG}a long list of links"),
    (f"<main><section class=a><p>first part</p></section><section class=b><p>{LONG}</p></section></main>", f"first part {LONG}"),
]


@pytest.mark.parametrize(("html", "text"), BESIDE)
def test_text_beside_the_largest_container_stays(html, text):
    """Also where other pages of the host vote for the inner container."""
    page = Page(html)
    assert page.main(None) == text.strip()
    largest = max(page.kids[page.best()], key=lambda k: page.chars[k])
    assert Page(html).main([page.path(largest)]) == text.strip()


def test_lists_of_links_beside_the_text_go():
    """Also in a container named as the main one; elsewhere what stands beside most of the text goes."""
    assert Page(f"<main><div class=x><p>{LONG}</p></div><div class=y><a href=x>one link</a> <a href=y>two links</a></div></main>").main(None) == LONG.strip()
    assert Page(f"<div class=wrap><div class=x><p>{LONG}</p></div><div class=y>short</div></div>").main(None) == LONG.strip()


def test_hosts_vote(spark):
    body = "<div class='wrap'><div class='story{}'><p>{}</p></div><div class='box'><p>{}</p></div></div>"
    rows = [(i, f"https://a.example/{i}", body.format("", "real text " * 20, "short"), "z") for i in range(9)]
    rows += [(9, "https://a.example/9", body.format("", "brief", "a teaser that is longer than the story on this page"), "z"), (10, None, "<p>alone</p>", "z"), (11, "nonsense", None, "z"), (12, "https://b.example/", "<article>x &copy;</article>", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.row.page_id: r for r in html_main.extract(df).collect()}
    assert got[9].text == "brief" and got[0].text == ("real text " * 20).strip()
    assert (got[10].text, got[11].text, got[11].n_chars, got[12].text) == ("alone", "", 0, "x ©")
    assert got[1].row.text == "z" and all(r.n_chars == len(r.text) for r in got.values())
    assert html_main.extract(df.limit(0)).count() == 0


def test_host_decides_on_suspects(spark):
    """Comments that outweigh one article go, since they go on other pages of the host; a suspect that holds most text on most pages stays."""
    a, b = "<article><p>{}</p></article><div class=comments><p>{}</p></div>", "<div class=menu><p>{}</p></div><div class=x><p>{}</p></div>"
    rows = [(i, "https://a.example/", a.format("long article " * 20, "nice")) for i in range(5)] + [(5, "https://a.example/", a.format("brief", "very long comment " * 20))]
    rows += [(10 + i, "https://b.example/", b.format("today's dishes " * 20, "x")) for i in range(5)] + [(15, "https://b.example/", b.format("one dish", "closed on a day"))]
    got = {r.row.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), carry=["page_id"]).collect()}
    assert got[5] == "brief" and got[0] == ("long article " * 20).strip()
    assert "one dish" in got[15] and got[10].startswith("today's dishes")


class Tree(HTMLParser):
    """A second reading of a page, as a tree: text of the one article, blocks apart, without what is left out."""

    INLINE = {"b", "i", "a", "em", "span"}
    OUT = {"script", "style", "nav", "footer", "aside", "head", "title"}

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.open, self.text = [], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.text.append(" ")
        if tag not in ("br", "meta", "img", "input", "hr", "link", "p", "b", "li"):
            self.open.append((tag, dict(attrs).get("class") in ("ad", "ads", "comments")))

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.text.append(" ")
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(t in self.OUT or bad for t, bad in self.open):
            self.text.append(data)


def test_against_a_second_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = html_main.extract(pages).select("row.html", "text", "n_chars").collect()
    assert len(got) > 200
    for r in got:
        want = " ".join("".join(Tree(r.html or "").text).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_deep_and_wide_pages_are_quick():
    import time

    began = time.time()
    deep = Page("<div class=a>" * 20_000 + "text" + "</div>" * 20_000)
    assert deep.main([deep.path(deep.best())]) == "text"
    wide = Page("<main>" + "<div class=post><p>x</p></div>" * 20_000 + "</main>")
    assert wide.main(["html>main>div.post"]) == " ".join("x" * 20_000)
    assert Page("<p " * 5_000).main(None) == "" and Page('<a href="' * 3_000).main(None) is not None
    assert time.time() - began < 20

from html.parser import HTMLParser

import pytest
from hypothesis import given, settings, strategies as st

from pressmill.html import css, xpath
from pressmill.html.dom import parse
from pressmill.html.markdown import to_markdown

PAGE = """<!doctype html><html lang="en"><head><title>T</title><meta name="a" content="x &amp; y"></head>
<body><header><h1 class="title main">Headline &amp; more</h1><span class=byline><a rel="author" href="/ann">Ann</a>, <a rel="author" href="/bob">Bob</a></span>
<time datetime="2024-01-15T10:00:00Z">January</time></header>
<div class="body" id="b1"><p>First <b>bold</b> text<p class="mark">Second<ul><li>one<li>two</ul><br><img src=x.png alt="A b"></div>
<script>if (a < b) document.write("</p>");</script>
<div class="related"><p>Also</p><a href="https://x.example/q">Q</a></div><aside><a rel="author">Not me</a></aside></body></html>"""


@pytest.fixture(scope="module")
def tree():
    return parse(PAGE)


@pytest.mark.parametrize(
    ("selector", "texts"),
    [
        ("h1", ["Headline & more"]),
        (".title.main", ["Headline & more"]),
        ("#b1 > p", ["Firstboldtext", "Second"]),
        ("div.body li:nth-child(2)", ["two"]),
        ("li:first-child, li:last-child", ["one", "two"]),
        ("[datetime]", ["January"]),
        ("a[rel='author']", ["Ann", "Bob", "Not me"]),
        ("a[href^='https'], a[href$='bob']", ["Bob", "Q"]),
        ("a[href*=nn]", ["Ann"]),
        ("p[class~='mark']", ["Second"]),
        ("p + ul li", ["one", "two"]),
        ("p ~ ul", ["onetwo"]),
        ("a[rel]:not([href])", ["Not me"]),
        ("nothing", []),
        ("header :is(a, time)", ["Ann", "Bob", "January"]),
    ],
)
def test_css(tree, selector, texts):
    assert [n.text() for n in css.select(tree, selector)] == texts


@pytest.mark.parametrize("broken", ["", "div >", "p:unknown", "[a", "..x", "p:nth-child(x)", ", p"])
def test_broken_css(tree, broken):
    with pytest.raises(css.SelectorError):
        css.select(tree, broken)


@pytest.mark.parametrize(
    ("expression", "texts"),
    [
        ("//h1", ["Headline & more"]),
        ("//div[@class='body']/p[1]", ["First bold text"]),
        ("//p[contains(@class,'mark')]", ["Second"]),
        ("//p[1]", ["First bold text", "Also"]),
        ("(//p)[2]", ["Second"]),
        ("//a[@rel='author'][not(@href)]", ["Not me"]),
        ("//header//a[@rel='author' and starts-with(@href, '/b')]", ["Bob"]),
        ("//li[normalize-space(.)='two']", ["two"]),
        ("//p[translate(text(), 'SECOND', 'second')='second']", ["Second"]),
        ("//li[1]/following-sibling::li", ["two"]),
        ("//li[last()]", ["two"]),
        ("//li[text()='one']/../..", ["First bold text" + "Second" + "one" + "two"]),
        ("//*[@id='b1']//li", ["one", "two"]),
        ("//a/@href", []),
        ("//p/text()", []),
        ("//ul/preceding-sibling::p[1]", ["Second"]),
        ("//div[count(p) = 2]/p[position() > 1]", ["Second"]),
    ],
)
def test_xpath(tree, expression, texts):
    assert [n.content().strip() for n in xpath.select(tree, expression)] == texts


def test_xpath_values(tree):
    assert [a.value for a in xpath.evaluate(tree, "//a/@href")] == ["/ann", "/bob", "https://x.example/q"]
    for broken in ("//p[", "///", "//div[@a='x", "//p[foo()]", "unknown::p"):
        with pytest.raises(ValueError):
            xpath.select(tree, broken)


def test_markdown(tree):
    lines = to_markdown(tree.find("body")).split("\n")
    assert lines[0] == "# Headline & more" and "[Ann](/ann), [Bob](/bob)" in lines[1]
    for line in ("First **bold** text", "Second", "- one", "- two", "![A b](x.png)", "Also"):
        assert line in lines
    assert "document.write" not in "".join(lines)
    page = parse("<h2> A  b </h2><p>x<br>y</p><ol><li>k<ul><li>n</ul><li>l</ol><pre> a\n  b</pre><blockquote><p>q</p></blockquote><table><tr><th>h<th>i<tr><td>1<td>2</table>")
    assert to_markdown(page) == "## A b\nx\ny\n1. k\n- n\n2. l\n```\na\nb\n```\n> q\n| h | i |\n| --- | --- |\n| 1 | 2 |"


class _Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.out.append(data.strip())


def test_text_equals_the_standard_parser():
    other = _Words()
    other.feed(PAGE.split("</head>")[1])
    assert " ".join(parse(PAGE).find("body").text(" ").split()) == " ".join(" ".join(other.out).split())


@settings(max_examples=150)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=a>", "</div>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "<br/>", "x ", "&amp;", "<", "<!-- c", "-->", "<script>", "</script>", "<body>", "<html>", "</html>"]), max_size=30).map("".join))
def test_any_page_gives_a_tree_that_is_read_again_alike(page):
    once = parse(page)
    assert once.tag == "html" and once.find("body") is not None
    again = parse(once.to_html())
    if "<script>" not in page and "<table>" not in page:
        assert "".join(once.text().split()) == "".join(again.text().split())

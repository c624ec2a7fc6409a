import json
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pressmill.operators import articles, chunking, metadata
from pressmill.operators.extract import extract, field_values, first, selector_report
from pressmill.html.dom import parse
from pressmill.sources import configs as C

PAGE = """<html lang="en-GB"><head><title>Not used</title>
<meta property="og:title" content="OG title"><meta name="description" content="Meta text"><meta name="keywords" content="a, b,,c"><meta property="og:locale" content="en_US">
<meta property="article:published_time" content="2023-01-01T12:00:00Z"><meta property="article:section" content="Markets"><meta property="og:url" content="https://news.example/a">
<meta property="og:image" content="https://x/y.PNG"><meta name="author" content="Meta Author"><meta name="author" content="Last Author">
<link rel="alternate" type="application/rss+xml" href="/feed"><script type="application/ld+json">{"@type":"NewsArticle","headline":"no","articleSection":["Crypto","Tech"]}</script><script type="application/ld+json">{bad</script></head>
<body><header>Top</header><nav>Menu</nav><main><article><h1>Head</h1><div class="meta"><a rel="author" href="/u/ann">Ann</a> <a rel="author" href="/u/bob">Bob</a> <time datetime="2024-01-15T10:00:00Z">then</time></div>
<div class="body"><p>First <b>paragraph</b>.</p><p class="highlight">Second one.</p><div class="ad">Buy</div></div><div class="tags"><a rel="tag">x</a><a rel="tag">y</a></div></article></main>
<aside><a href="https://other.example/z">Z</a><a href="https://www.news.example/in">I</a><a href="/rel">R</a><a href="/rel">R</a></aside><footer>Foot</footer></body></html>"""
URL = "https://www.news.example/x/1"


def value(query, base=None, **spec):
    return field_values(parse(PAGE), C.read_field({"selector": query, **spec}), base)


@pytest.mark.parametrize(
    ("query", "spec", "out"),
    [
        ("div.body", {"type": "html", "cleanup": [".ad"]}, ['<div class="body"><p>First <b>paragraph</b>.</p><p class="highlight">Second one.</p></div>']),
        ("time", {"attribute": "datetime"}, ["2024-01-15T10:00:00Z"]),
        ("//time", {"attribute": "datetime"}, ["2024-01-15T10:00:00Z"]),
        ([{"query": "a", "parent": ".meta", "attribute": "href"}], {"all": True}, ["/u/ann", "/u/bob"]),
        ([".none", "//p[", "//h1", "h2"], {}, ["Head"]),
        (["meta[name='author']", "h1"], {}, []),
        ("//div[@class='body']//p[1]", {}, ["First paragraph."]),
        (".highlight", {}, ["Second one."]),
        ("div.body p", {}, ["Firstparagraph."]),
        ("//a[@rel='author']", {"all": True}, ["Ann", "Bob"]),
        ([{"query": ".//a[@rel='author']", "selector_type": "xpath", "parent": "//div[@class='meta']"}], {"all": True}, ["Ann", "Bob"]),
        ("//p[contains(@class,'high')]", {}, ["Second one."]),
        ("//a/@href", {}, []),
        ("//p/text()", {}, []),
        (["#none", {"query": "//h1", "selector_type": "xpath"}], {}, ["Head"]),
    ],
)
def test_selectors(query, spec, out):
    assert value(query, **spec) == out


def test_links_become_absolute():
    assert value("a[rel='author']", base=URL, attribute="href") == ["https://www.news.example/u/ann"]


def test_configs(tmp_path, spark):
    raw = {"domain": "news.example", "lang": "en", "title": "h1", "content": {"css_selector": ".body", "type": "html"}, "sitemaps": ["s1"], "sitemap_url": "s2", "rss_url": "r", "cleanup": [".ad"]}
    (tmp_path / "en" / "n").mkdir(parents=True)
    (tmp_path / "en" / "n" / "news.example.json").write_text(json.dumps(raw))
    (tmp_path / "broken.json").write_text("{")
    loaded = C.load_configs(tmp_path)
    config = C.config_for(loaded, "WWW.news.example")
    assert config.sitemaps == ("s1", "s2") and config.rss_feeds == ("r",) and config.field("content").type == "html" and C.config_for(loaded, "x") is None
    assert C.migrate_config(raw)["content"] == {"selector": ".body"}
    assert C.selector_kind("(//x)[1]") == "css" and C.selector_kind(" //x") == "xpath" and C.selector_kind("x", "XPath") == "xpath"
    assert C.read_config(C.starter_config("x")).field("title")
    with pytest.raises(ValueError):
        C.read_field({"selector": "a", "type": "odd"})
    (tmp_path / "fixture.json").write_text(json.dumps({"url": URL, "domain": "news.example", "raw_html": None}))
    assert C.read_fixtures(spark, str(tmp_path / "fixture.json")).first().url == URL


def pages(spark):
    rows = [(1, URL, PAGE), (2, URL, None), (3, URL, " \n"), (4, None, "<p>bare text"), (5, "https://b.example", "<html><head></head></html>"), (6, URL, PAGE), (None, URL, "<body>" + "<p>word</p>" * 50_000)]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, raw_html string, text string, key string")


def test_extract(spark):
    config = C.read_config({"domain": "news.example", "title": "h1", "authors": {"selector": "a[rel='author']", "all": True}, "content": {"selector": ".body", "type": "html"}, "follow_urls": "aside a", "cleanup": [".ad"]})
    rows = {r.page_id: r for r in extract(pages(spark), configs={"news.example": config}).collect()}
    r = rows[1]
    assert r.status == "ok" and r.lang == "en-GB" and r.meta["author"] == "Last Author" and len(r.json_ld) == 2 and r.feeds == ["https://www.news.example/feed"]
    assert r.fields.title == ["Head"] and r.fields.authors == ["Ann", "Bob"] and r.fields.content == ["First **paragraph**.\nSecond one."]
    assert r.links == ["https://www.news.example/in", "https://www.news.example/rel"]
    assert r.text.startswith("Head Ann Bob then First paragraph . Second one.") and "Foot" not in r.text
    assert [rows[k].status for k in (2, 3, 4, 5)] == ["error", "error", "ok", "ok"] and rows[4].text == "bare text" and rows[5].text == ""
    plain = extract(pages(spark), configs={"news.example": config}, output_format="html", parts=("fields",)).where("page_id = 1").first()
    assert plain.fields.content == ["First paragraph . Second one."]
    assert extract(pages(spark), default=None, parts=("fields",)).where("page_id = 1").first().fields is None
    assert extract(pages(spark).limit(0)).count() == 0
    report = selector_report(pages(spark), {"t": ["h9", "h1"]}).collect()
    assert {(r.selector, r.pages, r.elements, r.wins) for r in report} == {("h9", 0, 0, 0), ("h1", 2, 2, 2)}


def test_metadata(spark):
    rows = extract(pages(spark), parts=("meta", "json_ld", "lang")).where("page_id = 1")
    m = rows.select(metadata.page_metadata(F.col("meta"), F.col("json_ld"), F.col("lang")).alias("m")).first().m
    assert (m.title, m.description, m.author, m.canonical, m.language, m.locale) == ("OG title", "Meta text", "Last Author", "https://news.example/a", "en-GB", "en_US")
    assert m.tags == ["a", "b", "c"] and m.topics == ["Markets"] and m.image.url == "https://x/y.PNG" and m.image.type == "image/png" and m.twitter is None
    assert m.date_published == datetime(2023, 1, 1, 12) and m.date_modified is None


@pytest.mark.parametrize(
    ("texts", "topics", "sections"),
    [
        ([{"@type": "NewsArticle", "articleSection": ["A", "B"]}], ["A", "B"], ["A", "B"]),
        ([{"@type": "NewsArticle", "articleSection": "A"}], [], ["A"]),
        ([{"@type": ["WebPage", "x"], "articleSection": ["A"]}], ["A"], ["A"]),
        ([{"@type": "BreadcrumbList", "itemListElement": [{"name": "Home"}, {"item": {"name": "News"}}, {"name": "Home"}, *({"name": f"n{k}"} for k in range(6))]}], ["Home", "News", "n0", "n1", "n2"], []),
        ([{"@graph": [{"@type": "Article", "articleSection": ["G"]}]}], [], ["G"]),
        ([[{"@type": "Article", "articleSection": ["L"]}, 5]], ["L"], ["L"]),
        (["{bad"], [], []),
        ([], [], []),
        ([{"@type": "Recipe", "articleSection": ["A"]}], [], ["A"]),
    ],
)
def test_json_ld(spark, texts, topics, sections):
    rows = spark.createDataFrame([([t if isinstance(t, str) else json.dumps(t) for t in texts],)], "ld array<string>")
    r = rows.select(metadata.ld_topics(F.col("ld")).alias("t"), metadata.graph_sections(F.col("ld")).alias("s")).first()
    assert (r.t, r.s) == (topics, sections)


def test_small_metadata(spark):
    rows = spark.createDataFrame([(["Home", "a", "b", "c", "d", "e", "f"], {"twitter:card": "x", "og:title": "y"}, {"twitter:title": "z"}, '{"@context":"https://schema.org","@type":"Article"}')], "t array<string>, m map<string,string>, n map<string,string>, j string")
    node = F.try_parse_json(F.col("j"))
    r = rows.select(metadata.clean_topics(F.col("t")), metadata.twitter_card(F.col("m")), metadata.twitter_card(F.col("n")), metadata.has_context(node), metadata.ld_type(node), metadata.to_json_ld(node)).first()
    assert r[0] == ["a", "b", "c", "d", "e"] and r[1] == {"twitter:card": "x"} and r[2] is None and r[3] and r[4] == "Article" and json.loads(r[5])["@type"] == "Article"
    assert metadata.meta_key("published_time", "article") == "article:published_time" and metadata.meta_key("date_created", "", camel=True) == "dateCreated"


def test_assembly(spark):
    config = C.read_config({"domain": "news.example", "content": ".body", "authors": "a[rel='author']", "main_points": ".highlight", "date_published": "time"})
    rows = {r.page_id: r for r in articles.assemble(pages(spark), configs={"news.example": config}).collect()}
    a = rows[1].article
    assert a.id == str(uuid.uuid5(uuid.NAMESPACE_URL, URL)) and a.title == "OG title" and a.provenance.domain == "www.news.example"
    assert [x.name for x in a.authors] == ["Ann"] and a.metadata.main_points == ["Second one."] and a.metadata.topics == ["Crypto", "Tech"]
    assert a.metadata.published_at == datetime(2023, 1, 1, 12) and rows[1].warnings == ["unreadable date_published"]
    assert a.content == "Firstparagraph.Second one.Buy" and a.metadata.word_count == 4
    assert [(rows[k].status, rows[k].error) for k in (2, 4, 5)] == [("error", "empty page"), ("error", "no valid address"), ("error", "no content")]
    bare = articles.assemble(pages(spark).where("page_id = 1"), default=None).first().article
    assert bare.content.startswith("Head Ann Bob then") and bare.authors[0].name == "Last Author"
    with pytest.raises(ValueError):
        articles.assemble(pages(spark), output_format="pdf")
    got = articles.fallback_articles(pages(spark)).where("page_id = 1").first()
    assert got.language == "en-GB" and got.domain == "www.news.example" and got.reading_time_minutes == round(got.word_count / 220, 2)


def test_projections(spark):
    df = chunking.article_chunks(spark.createDataFrame([("i1", "T", "u", "d", "T body text"), ("i2", None, "u", "d", None)], "id string, title string, source_url string, domain string, content string"))
    docs = articles.rag_documents(df).collect()
    assert [(d.id, d.text, d.meta.article_id, d.meta["index"]) for d in docs] == [("i1-chunk-0", "body text", "i1", 0)]
    assert {(s.id, s.word_count, s.chunks) for s in articles.summaries(df).collect()} == {("i1", 3, 1), ("i2", 0, 0)}
    assert "updated_at" in articles.touch(df).columns
    assert spark.createDataFrame([(["a"],), ([],)], "x array<string>").select(first(F.col("x"))).collect()[1][0] is None


def test_no_page_stops_a_job(spark):
    from pressmill.operators import extract as X

    pages = [
        (1, "https://a.example/x", "<html><head><link rel='canonical' href='http://[bad'><link type='application/rss+xml' href='http://[worse'></head><body><h1>T</h1><a href='http://[bad'>x</a><p>Text</p></body></html>"),
        (2, "https://a.example/x", "<html><body><article>" + "<div>" * 3000 + "deep text" + "</div>" * 3000 + "</article></body></html>"),
        (3, "http://[", "<p>x</p>"),
        (4, None, "<ul>" * 800 + "<li>y"),
    ]
    rows = {r.page_id: r for r in X.extract(spark.createDataFrame(pages, "page_id long, url string, raw_html string")).collect()}
    assert len(rows) == 4 and rows[1].status == "ok" and rows[1].canonical == "http://[bad" and rows[1].feeds == ["http://[worse"]
    assert rows[2].status == "ok" and "deep text" in rows[2].fields.content[0]


def test_a_failing_page_is_a_row(spark, monkeypatch):
    from pressmill.html.dom import parse
    from pressmill.html.markdown import to_markdown

    assert to_markdown(parse("<div>" * 2000 + "<b>x</b> y" + "</div>" * 2000)) == "x y"

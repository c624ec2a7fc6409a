import json

from pyspark.sql import functions as F

from pressmill import schemas
from pressmill.operators import metadata
from pressmill.operators.extract import extract
from pressmill.operators.frontier import Frontier
from pressmill.operators.results import ResultStore
from pressmill.operators.vectors import VectorStore
from pressmill.plans import pipelines
from pressmill.sources.configs import read_config
from pressmill.sources.fetch import Fetched, fetch_pages, with_retry
from pressmill.sources.settings import Settings

HTML = "<html><head><title> A  title</title><link rel=canonical href=/c><meta name=Author content=Ann></head><body><article><h1>{0}</h1><p>{0} body text. More of it here.</p><a href='/b'>b</a></article></body></html>"


def pages(spark):
    rows = [(k, f"https://n.example/{k}", HTML.format(k)) for k in "abc"] + [("d", "https://n.example/d", None)]
    return spark.createDataFrame([(i, u, h) for i, (_, u, h) in enumerate(rows)], "page_id long, url string, raw_html string")


def test_runs(spark, tmp_path):
    run = pipelines.scrape(pages(spark))
    assert run.articles.count() == 3 and run.outcomes.where("ok").count() == 3 and run.outcomes.count() == 4
    assert pipelines.single_page(pages(spark).where("page_id = 0")).first().word_count > 5
    store = ResultStore(spark, str(tmp_path / "r"))
    stats = pipelines.scrape_for_user("t", pages(spark), store).first()
    assert (stats.total_urls, stats.fail_count) == (4, 1) and store.articles("t").count() == 3
    vectors, frontier = VectorStore(spark, str(tmp_path / "v"), 64), Frontier(spark, str(tmp_path / "f"))
    assert pipelines.scrape_for_retrieval(pages(spark), vectors, frontier) == {"articles": 3, "chunks": 3}
    assert pipelines.scrape_for_retrieval(pages(spark), vectors, frontier) == {"articles": 0, "chunks": 0}
    config = read_config({"domain": "n.example", "follow_urls": "a"})
    assert [r.url for r in pipelines.linked_pages(pages(spark).where("page_id = 0"), pages(spark), config).collect()] == ["https://n.example/b"]
    sitemap = b"<urlset><url><loc>https://n.example/a</loc></url></urlset>"
    files = spark.createDataFrame([("s", bytearray(sitemap)), ("s2", bytearray(sitemap))], "url string, content binary")
    assert [r.url for r in pipelines.bulk_urls(files, files.limit(0)).collect()] == ["https://n.example/a"]


def test_fetching(spark):
    def answer(url, settings):
        if "bad" in url:
            raise OSError("no route")
        return Fetched(url + "/final", 404 if "missing" in url else 200, b"<p>x")

    urls = spark.createDataFrame([("https://a",), ("https://missing",), ("https://bad",), (None,)], "url string")
    got = {r.requested_url: r for r in fetch_pages(urls, settings=Settings(fetch_retries=1), fetch=answer).collect()}
    assert got["https://a"].url == "https://a/final" and bytes(got["https://a"].content) == b"<p>x" and got["https://a"].error is None
    assert got["https://missing"].status == 404 and got["https://missing"].content is None and "no route" in got["https://bad"].error and len(got) == 3
    tries, waits = [], []

    def flaky(url, settings):
        tries.append(url)
        if len(tries) < 3:
            raise OSError("later")
        return Fetched(url, 200, b"")

    assert with_retry("u", Settings(), flaky, waits.append)[2] == 200 and waits == [2.0, 2.0]


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("PRESSMILL_CHUNK_TOKENS", "99")
    spark.conf.set("spark.pressmill.vector_metric", "euclidean")
    s = Settings.load(spark)
    assert s.chunk_tokens == 99 and s.vector_metric == "euclidean" and s.fetch_retries == 3
    spark.conf.unset("spark.pressmill.vector_metric")


def test_helpers_and_records(spark):
    r = extract(pages(spark), parts=("title", "canonical", "meta")).where("page_id = 0")
    assert r.select("title", "canonical", metadata.meta_value(F.col("meta"), "x", "author")).first()[:] == ("A title", "https://n.example/c", "Ann")
    ld = [json.dumps(x) for x in ({"@type": "Article", "headline": "Old"}, {"@type": "NewsArticle", "headline": "New", "author": [{"name": "B"}], "datePublished": "2024-01-02", "articleSection": ["New", "Tech"]}, {"@type": "ImageObject", "url": "i"})]
    s = spark.createDataFrame([(ld, "The new thing")], "ld array<string>, t string").select(metadata.schema_summary(F.col("ld"), F.col("t")).alias("s")).first().s
    assert (s.title, s.author, s.image, s.topics) == ("New", "B", "i", ["Tech"]) and str(s.date_published) == "2024-01-02 00:00:00"
    rows = spark.createDataFrame([("1", "T", "c")], "id string, title string, content string")
    back = schemas.to_json(rows).select(schemas.from_json(F.col("json")).alias("a"))
    assert back.first().a.title == "T" and not back.select(schemas.valid_article(F.col("a"))).first()[0]
    full = spark.createDataFrame([('{"title":"T","content":"c","provenance":{"source_url":"u"},"quality":{"content_quality":2}}',), ('{"title":"T","content":"c","provenance":{"source_url":"u"}}',)], "j string")
    assert [r[0] for r in full.select(schemas.valid_article(schemas.from_json(F.col("j")))).collect()] == [False, True]


def test_requests(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "r"))
    load = lambda urls: pages(spark).join(urls, "url", "left_semi")
    read = lambda url: spark.createDataFrame([(url, bytearray(b"<urlset><url><loc>https://n.example/a</loc></url><url><loc>https://n.example/d</loc></url></urlset>"))], "url string, content binary")
    ask = lambda **r: pipelines.handle(r, read, load, store, "s", "s")
    assert pipelines.handle({"url": "u"}, read, load, store, "s", "x") == {"code": 403}
    assert ask(url="u", mode="odd") == {"code": 422} and ask(url="https://n.example/none") == {"code": 404}
    assert ask(url="https://n.example/a")["article"]["source_url"] == "https://n.example/a"
    made = ask(url="https://n.example/s.xml", mode="sitemap")
    status = pipelines.task_status(store, made["task_id"])
    assert made["code"] == 202 and status["status"] == "done" and status["result"]["total_urls"] == 2
    assert pipelines.task_status(store, "none")["status"] == "unknown"
    assert ask(url="https://n.example/s.xml", mode="rss")["code"] == 202
    from pressmill.operators.articles import assemble

    row = pipelines.worker_rows(assemble(pages(spark), keep_html=False)).first()
    assert row.content_format == "markdown" and row.stats.word_count == row.metadata.word_count and row.raw_html is None

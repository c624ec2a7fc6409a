import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmill.operators import discovery as D, frontier, results, vectors as V
from pressmill.plans.sql import register
from pressmill.sources import configs as C
from pressmill.streaming.ingest import crawl_counts, dedup_to_table, dedup_within, page_stream

SITEMAP = b"""<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://i" xmlns:news="http://n">
<url><loc> https://a/1 </loc><lastmod>2024-01-01</lastmod><image:image><image:loc>https://a/p.png</image:loc></image:image></url>
<url><loc>https://a/2</loc><news:news><news:title>N</news:title><news:publication_date>2024-01-02</news:publication_date></news:news></url></urlset>"""
RSS = b"""<rss version="2.0" xmlns:media="http://m"><channel><link>https://site</link><item><title>A</title><link>https://a/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0700</pubDate>
<description>&lt;p&gt;&lt;a href="x"&gt;more&lt;/a&gt;&lt;/p&gt;&lt;p&gt;Text&lt;/p&gt;&lt;img src="i.png"&gt;</description><category>c1</category><category>c2</category></item><item><title>B</title></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link rel="self" href="https://e/1"/><updated>2024-01-01T00:00:00Z</updated></entry></feed>"""


def files(spark):
    rows = [("plain", SITEMAP), ("zip", gzip.compress(SITEMAP)), ("bad", b"<urlset><url>"), ("none", None), ("badzip", b"\x1f\x8bxx"), ("rss", RSS), ("atom", ATOM)]
    return spark.createDataFrame([(u, None if c is None else bytearray(c), "clash") for u, c in rows], "url string, content binary, loc string")


def test_sitemaps_and_feeds(spark):
    assert {(r.url, r.position, r.loc) for r in D.parse_sitemaps(files(spark)).collect()} == {(u, k, f"https://a/{k + 1}") for u in ("plain", "zip") for k in (0, 1)}
    items = {r.loc: r for r in D.parse_sitemap_items(files(spark)).where("url = 'zip'").collect()}
    assert items["https://a/1"].lastmod == "2024-01-01" and items["https://a/2"].lastmod == "2024-01-02" and items["https://a/2"].is_news and not items["https://a/1"].is_news
    assert {(r.url, r.link) for r in D.parse_feeds(files(spark)).collect()} == {("rss", "https://a/1"), ("atom", "https://e/1")}
    feed = {r.title: r for r in D.parse_feed_items(files(spark)).collect()}
    assert feed["A"].is_valid and feed["A"].description == "Text" and feed["A"].image == "i.png" and feed["A"].categories == ["c1", "c2"] and str(feed["A"].published_at) == "2024-01-01 20:04:05"
    assert not feed["B"].is_valid and feed["E"].is_valid


def test_robots(spark):
    df = spark.createDataFrame([("a.example", "User-agent: *\r\nSITEMAP: https://a.example/s.xml\n sitemap:/t.xml\nsitemap:\n"), ("b", None), ("c", "")], "domain string, robots string")
    assert [(r.domain, r.sitemap) for r in D.robots_sitemaps(df).orderBy("line_no").collect()] == [("a.example", "https://a.example/s.xml"), ("a.example", "https://a.example/t.xml")]


def test_discovery(spark):
    manual = spark.createDataFrame([("a", "u1"), ("a", "u1"), ("a", None)], "domain string, url string")
    found = spark.createDataFrame([("a", "u2"), ("b", "u3"), ("b", "u3")], "domain string, url string")
    assert {tuple(r) for r in D.discover(manual, found).collect()} == {("a", "u1"), ("b", "u3")}
    links = spark.createDataFrame([("a", ["x", "y", "x", "z"]), ("b", None)], "domain string, links array<string>")
    assert [tuple(r) for r in D.follow_urls(links, most=2).collect()] == [("a", 0, "x"), ("a", 1, "y")]


def test_frontier(spark, tmp_path):
    f = frontier.Frontier(spark, str(tmp_path / "f"))
    urls = spark.createDataFrame([("u1",), ("u2",), ("u1",), (None,)], "url string")
    assert len(f) == 0 and f.add(urls) == 2 and f.add(urls) == 0 and len(f) == 2 and f.has("u1") and not f.has("u9")
    f.mark_seen(spark.createDataFrame([("u3",)], "url string"))
    assert f.add(spark.createDataFrame([("u3",), ("u4",)], "url string")) == 1
    drained = [r.url for r in f.drain(2).collect()] + [r.url for r in f.drain(5).collect()]
    assert sorted(drained) == ["u1", "u2", "u4"] and len(f) == 0 and f.drain(1).count() == 0
    f.clear()
    assert not f.has("u1")
    log = frontier.url_log(spark.createDataFrame([("t", 3, "c"), ("t", 1, "a"), ("t", 2, "a")], "task string, k int, url string"), "task", "k")
    assert [(r.pos, r.url) for r in frontier.log_slice(log, 1, 5).orderBy("pos").collect()] == [(1, "a"), (2, "c")]
    hot = spark.range(3000).selectExpr("if(id % 3 = 0, concat('t', id), if(id % 7 = 0, null, 'hot')) as task", "(id * 7919) % 3000 as k", "'clash' as pos2").repartition(7)
    got = frontier.url_log(hot, "task", "k").collect()
    assert len(got) == 3000
    for task in ("hot", None):
        own = sorted((r.k, r.pos) for r in got if r.task == task)
        assert [p for _, p in own] == list(range(len(own)))
    assert all(r.pos == 0 for r in got if (r.task or "").startswith("t"))


def test_results(spark, tmp_path):
    store = results.ResultStore(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([(f"a{i}", f"t{i}", "u", "d", i) for i in range(7)], "id string, title string, source_url string, domain string, word_count int")
    store.save("t1", rows)
    store.save("old", rows, ttl_days=-1)
    assert store.articles("none") is None and store.articles("old").count() == 0
    assert [r.id for r in store.page("t1", 3, 3).collect()] == ["a3", "a4", "a5"] and results.next_offset(7, 3, 3) == 6 and results.next_offset(7, 3, 6) is None
    assert store.article("a2").count() == 1 and results.compact(store.articles("t1")).columns[-1] == "format"
    for bad in ((0, 0), (51, 0), (5, -1)):
        with pytest.raises(ValueError):
            store.page("t1", *bad)
    with pytest.raises(KeyError):
        store.page("none")
    outcomes = spark.createDataFrame([("t1", "u1", True, None, 200), ("t1", "u2", False, "timeout", 0), ("t1", "u3", None, None, None)], "task_id string, url string, ok boolean, error string, status int")
    store.save_stats("t1", results.task_stats(outcomes).drop("task_id"))
    store.save_failures("t1", results.failures(outcomes).drop("task_id"))
    s = store.stats("t1").first()
    assert (s.total_urls, s.success_count, s.fail_count) == (3, 1, 2) and {x.url for x in store.failures("t1").collect()} == {"u2", "u3"}
    assert store.delete("t1") and not store.delete("t1") and store.articles("t1") is None


@pytest.mark.parametrize("metric", V.METRICS)
def test_search_equals_brute_force(spark, metric, monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(60, 8)).astype(np.float32)
    data[7] = data[9]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(data)] + [(900, None, 0), (901, [1.0], 0), (902, [0.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    every = np.vstack([data, np.zeros((1, 8), np.float32)]).astype(float)
    ids = [*range(60), 902]
    q = data[7].astype(float)
    dot, norm = every @ q, np.linalg.norm(every, axis=1) * np.linalg.norm(q)
    want = {"cosine": np.where(norm > 0, dot / np.where(norm > 0, norm, 1), 0), "dot_product": dot, "euclidean": 1 / (1 + ((every - q) ** 2).sum(1))}[metric]
    best = [ids[k] for k in np.lexsort((ids, -np.round(want, 9)))[:5]]
    got = V.search(df, q.tolist(), 5, metric).collect()
    assert [r.vec_id for r in got] == best
    batch = V.batch_search(df, df.where("vec_id in (7, 20)"), 4, metric).collect()
    assert [r.vec_id for r in sorted((r for r in batch if r.query_id == 7), key=lambda r: r["rank"])] == [k for k in [ids[k] for k in np.lexsort((ids, -np.round(want, 9)))] if k != 7][:4]
    monkeypatch.setattr(V, "QUERY_SET", 3)
    every_query = df.where("vec_id < 12")
    several = {(r.query_id, r["rank"], r.vec_id) for r in V.batch_search(df, every_query, 3, metric).collect()}
    monkeypatch.undo()
    assert several == {(r.query_id, r["rank"], r.vec_id) for r in V.batch_search(df, every_query, 3, metric).collect()} and len(several) == 36
    assert V.batch_search(df, df.limit(0), 4).count() == 0 and V.batch_search(df.limit(0), df.where("vec_id = 7"), 4).count() == 0


def test_vector_store(spark, tmp_path):
    store = V.VectorStore(spark, str(tmp_path / "v"), 32, "odd")
    meta = "struct<title:string,source_url:string,domain:string>"
    docs = spark.createDataFrame([("a", "interest rates rise", ("t", "u", "d")), ("b", "football match tonight", ("t", "u", "d")), ("c", None, None)], f"id string, text string, meta {meta}")
    assert store.metric == "cosine" and store.count() == 0 and store.upsert(docs.limit(0)) == {"status": "noop", "count": 0}
    assert store.upsert(docs)["count"] == 3 and store.count() == 3
    store.upsert(spark.createDataFrame([("b", "central bank interest", ("t2", "u", "d"))], f"id string, text string, meta {meta}"))
    assert store.count() == 3 and store.get("b").first().title == "t2"
    assert {r._id for r in V.dispatch(store, {"operation": "search", "query": "interest rates", "limit": 2}).collect()} == {"a", "b"}
    assert store.delete([]) == 0 and store.delete(["b", "zz"]) == 1 and store.count() == 2
    store.compact()
    assert store.count() == 2 and store.get("b").count() == 0
    store.clear()
    assert store.count() == 0
    with pytest.raises(ValueError):
        store.search([1.0])
    with pytest.raises(ValueError):
        V.dispatch(store, {"operation": "x"})


def test_config_join_and_schedule(spark):
    pages = spark.createDataFrame([(1, "www.a.example"), (2, "b.example"), (3, None)], "page_id int, host string")
    configs = spark.createDataFrame([("a.example", "A", ["s"], None), ("b.example", "B", [], ["f"]), ("c.example", "C", None, None)], "domain string, name string, sitemaps array<string>, rss_feeds array<string>")
    assert {(r.page_id, r.config_name) for r in C.join_configs(pages, configs.select("domain", "name"), F.col("host")).collect()} == {(1, "A"), (2, "B"), (3, None)}
    assert {(r.domain, r.mode, r.period_minutes) for r in C.schedule(configs).collect()} == {("a.example", "sitemap", 360), ("b.example", "rss", 15), ("c.example", "links", 30)}


def test_streams(spark, tmp_path):
    rng = random.Random(1)
    for k in range(3):
        rows = [(f"u{rng.randrange(12)}", f"2024-01-0{k + 1} 00:0{i % 10}:00", "d") for i in range(20)] + [(None, None, None)]
        spark.createDataFrame(rows, "url string, at string, domain string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    want = {r.url for r in spark.read.parquet(str(tmp_path / "in")).select("url").distinct().collect()} - {None}
    for _ in range(2):  # a second run finds nothing new
        dedup_to_table(page_stream(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "out"), str(tmp_path / "seen"), str(tmp_path / "cp")).awaitTermination()
    urls = [r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(urls) == sorted(want)
    for made, name in ((dedup_within(page_stream(spark, str(tmp_path / "in"), schema), "at"), "within"), (crawl_counts(page_stream(spark, str(tmp_path / "in"), schema), "at"), "counts")):
        made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).count() > 0


def test_sql_functions(spark):
    names = register(spark)
    assert {"count_words", "article_id", "chunk_by_tokens", "parse_sitemap"} <= set(names)
    r = spark.sql("select count_words('a b_1 c') as w, estimate_tokens('a b c') as t, article_id('https://example.com/article/1') as i, cache_key('x') as k, html_to_markdown('<h2>T</h2>') as m").first()
    assert tuple(r) == (3, 4, "3a7f5f88-e1fe-5f14-9710-c340efb03bfc", "9dd4e461268c8034f5c8564e155c67a6", "## T")
    assert [x.content for x in spark.sql("select * from chunk_by_char('abcdefghij', 4, 1)").collect()] == ["abcd", "defg", "ghij", "j"]
    assert spark.sql("select * from chunk_by_tokens('One two. Three four. Five six.', 3, 0)").count() == 3


def test_stores_are_opened_again(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, f"text {i}", ("t", "u", "d")) for i in ids], "id string, text string, meta struct<title:string,source_url:string,domain:string>")
    store = lambda: V.VectorStore(spark, str(tmp_path / "v"), 16)
    assert store().count() == 0
    store().upsert(rows("a", "b"))
    store().upsert(rows("b", "c"))
    assert store().delete(["a", "z"]) == 1 and store().count() == 2 and store().get("b").count() == 1
    store().compact()
    assert store().count() == 2 and len(store()._parts) == 1
    store().upsert(rows("a"))
    assert sorted(r._id for r in store().rows().collect()) == ["a", "b", "c"]
    store().clear()
    assert store().count() == 0


def test_a_frontier_goes_on_where_the_last_one_was(spark, tmp_path):
    opened = lambda: frontier.Frontier(spark, str(tmp_path / "f"))
    urls = spark.createDataFrame([(f"u{i}",) for i in range(6)], "url string")
    assert opened().add(urls) == 6
    one = [r.url for r in opened().drain(2).collect()]
    two = [r.url for r in opened().drain().collect()]
    assert len(one) == 2 and sorted(one + two) == [f"u{i}" for i in range(6)] and len(opened()) == 0
    # an add that was cut off between its two writes: its keys are marked when the frontier is opened
    spark.createDataFrame([(100, "late", "k")], "seq long, url string, url_key string").write.mode("append").parquet(str(tmp_path / "f" / "queue"))
    assert opened().seen().where("url_key = 'k'").count() == 1


def test_a_site_is_scheduled_by_each_of_its_modes(spark):
    rows = [("both", ["s"], ["r"]), ("map", ["s"], None), ("feed", [], ["r"]), ("none", None, [])]
    got = C.schedule(spark.createDataFrame(rows, "domain string, sitemaps array<string>, rss_feeds array<string>")).collect()
    assert sorted((r.domain, r.mode, r.period_minutes) for r in got) == [("both", "rss", 15), ("both", "sitemap", 360), ("feed", "rss", 15), ("map", "sitemap", 360), ("none", "links", 30)]

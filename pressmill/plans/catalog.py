"""Queries of the core operators and the SQL they are held against.

A query without SQL is one whose result SQL cannot express, such as the walk over an HTML tree; tests hold those
against brute force on small inputs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressmill.functions import ids, text as T, urls as U
from pressmill.operators import articles, chunking, discovery, frontier, metadata, results, vectors
from pressmill.operators.extract import extract, first, selector_report
from pressmill.operators.timestamps import normalize_timestamps
from pressmill.session import keep, shared_dir
from pressmill.sources import configs as C
from pressmill.sources.sites import load_sites
from pressmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# The same character classes in the dialect of the SQL engine.
_WS = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIP = f"'^[{_WS}]+|[{_WS}]+$', '', 'g'"
_WORDS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {_STRIP})"


def content_sql(x: str) -> str:
    flat = rf"replace(regexp_replace(coalesce({x}, ''), '[\r\n\t]+', ' ', 'g'), chr(160), ' ')"
    return strip_sql(f"regexp_replace({flat}, ' {{2,}}', ' ', 'g')")


def words_sql(x: str) -> str:
    return _WORDS.format(x)


def tokens_sql(x: str) -> str:
    return f"ceil({words_sql(x)} * 1.33::DOUBLE)::INT"


_AUTHORITY = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"
_HOST = r"nullif(lower(regexp_replace(regexp_replace(" + _AUTHORITY + r", '^.*@', ''), ':\d*$', '')), '')"


@query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap, Open Graph and JSON-LD dates as instants in UTC."""
    items, metas = table(spark, sf_dir, "sitemap_items"), table(spark, sf_dir, "article_meta")
    parts = [(items, "lastmod", "item_id", F.coalesce("loc", "sitemap_url")), (metas, "published_time", "meta_id", F.col("url")), (metas, "date_published", "meta_id", F.col("url"))]
    values = None
    for df, name, key, url in parts:
        part = df.select(F.lit(name).alias("field_name"), F.col(key).alias("rec_id"), F.col(name).alias("value"), "domain", url.alias("url"))
        values = part if values is None else values.unionByName(part)
    return normalize_timestamps(values, load_sites(table(spark, sf_dir, "parser_configs"))).drop("zone_version")


# ---- scalars


@query(f"select doc_id, {words_sql('text')}::INT as words, {tokens_sql('text')} as tokens, round({words_sql('text')} / 220::DOUBLE, 2) as minutes from documents")
def word_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.count_words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("words"), T.estimate_tokens(F.col("text")).alias("tokens"), T.reading_minutes(w).alias("minutes"))


@query(f"select chunk_id, case when coalesce(word_count, 0) = 0 then {words_sql('content')} else word_count end::INT as words from article_chunks")
def stated_or_own_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "article_chunks").select("chunk_id", T.word_count_or_own(F.col("word_count"), F.col("content")).alias("words"))


@query(f"select doc_id, md5({content_sql('text')}) as content_md5, length({content_sql('text')})::INT as chars from documents")
def normalize_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.normalize_content(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(c).alias("content_md5"), F.char_length(c).alias("chars"))


_TITLE = strip_sql("regexp_replace(coalesce(title, ''), ' {2,}', ' ', 'g')")


@query(f"select doc_id, {_TITLE} as title from documents")
def normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_str(F.col("title")).alias("title"))


_KEYWORD = strip_sql("regexp_replace(coalesce(k, ''), ' {2,}', ' ', 'g')")


@query(f"""
    select meta_id, array_to_string(list_filter(list_transform(coalesce(keywords, []), lambda k: {_KEYWORD}), lambda k: k <> ''), '|') as keywords,
      array_to_string(list_filter(list_transform(coalesce(regexp_split_to_array(article_section, '[\\r\\n\\t,]+'), []), lambda k: {_KEYWORD}), lambda k: k <> '' and lower(k) not in ('home', 'homepage', 'trang')), '|') as sections
    from article_meta""")
def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "article_meta").select(
        "meta_id", F.array_join(T.normalize_list(F.col("keywords")), "|").alias("keywords"), F.array_join(T.split_list(F.col("article_section"), ("home", "homepage", "trang")), "|").alias("sections")
    )


_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ](?:[01]\d|2[0-3]):\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)?)?$"


@query(rf"""
    with v as (select meta_id, regexp_replace({strip_sql('published_time')}, '([+-]\d{{2}})(\d{{2}})$', '\1:\2') as s from article_meta),
    w as (select meta_id, case when regexp_matches(s, '{_ISO}') then replace(s, ',', '.') end as s from v),
    x as (select meta_id, regexp_replace(regexp_replace(s, '(\.\d{{6}})\d+', '\1'), '(Z|[+-]\d\d:\d\d)$', '') as wall, regexp_extract(s, '([+-]\d\d:\d\d)$', 1) as zone, length(s) > 10 as timed from w)
    select meta_id, (epoch_us(try_cast(wall as timestamp)) - case when timed and zone <> '' then (case when zone[1] = '-' then -1 else 1 end) * (zone[2:3]::BIGINT * 3600 + zone[5:6]::BIGINT * 60) * 1000000 else 0 end)::BIGINT as us
    from x""")
def iso_datetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "article_meta").select("meta_id", F.unix_micros(T.normalize_datetime(F.col("published_time"))).alias("us"))


@query("""
    with h as (select page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) as h from raw_pages)
    select page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || lower(to_hex((('0x' || h[17:18])::INT & 63) | 128)) || h[19:20] || '-' || h[21:32] as id from h""")
def article_id_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_pages").select("page_id", ids.article_id(None, F.col("url")).alias("id"))


@query("select page_id, md5(url) as k_md5, sha1(url) as k_sha1, sha256(url) as k_sha256 from raw_pages")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "raw_pages").select("page_id", ids.cache_key(u).alias("k_md5"), ids.cache_key(u, "sha1").alias("k_sha1"), ids.cache_key(u, "sha256").alias("k_sha256"))


@query(f"select doc_id, {_AUTHORITY.format('source_url')} as authority, {_HOST.format('source_url')} as host, regexp_replace({_HOST.format('source_url')}, '^www\\.', '') as domain from documents")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("source_url")
    return table(spark, sf_dir, "documents").select("doc_id", U.authority(u).alias("authority"), U.host(u).alias("host"), U.without_www(U.host(u)).alias("domain"))


@query(f"select {_HOST.format('url')} as host, count(*) as pages, count(distinct url) as urls from raw_pages group by 1")
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("url").alias("urls"))


@query(rf"""
    with p as (select doc_id, source_url as u, lower(regexp_extract(source_url, '^(?i)(https?)://', 1)) as s, lower({_AUTHORITY.format('source_url')}) as a, regexp_extract(source_url, '^[A-Za-z]+://[^/?#]*(.*)$', 1) as r from documents)
    select doc_id, s || '://' || regexp_replace(a, case when s = 'http' then ':80$' else ':443$' end, '') || case when r like '/%' then r else '/' || r end as url from p""")
def http_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", U.normalize_http_url(F.col("source_url")).alias("url"))


# ---- chunks


_STARTS = """list_concat(list_transform(range(0, case when n <= {m} then 1 else ceil((n - {m}) / {s}::DOUBLE)::INT + 1 end), lambda k: k * {s}),
    case when n - {o} > (case when n <= {m} then 0 else ceil((n - {m}) / {s}::DOUBLE)::INT end) * {s} then [n - {o}] else [] end)"""
_WINDOWS = f"""
    with d as (select doc_id, text as t, length(text) as n from documents where length(text) > 0),
    w as (select doc_id, list_filter(list_transform({_STARTS.format(m=2000, o=200, s=1800)}, lambda a: {strip_sql("substr(t, a::INT + 1, 2000)")}), lambda c: c <> '') as c from d),
    x as (select doc_id, unnest(c) as content, generate_subscripts(c, 1) - 1 as i from w)"""


@query(_WINDOWS + f" select doc_id, i::INT as index, md5(content) as content_md5, length(content)::INT as char_length, {words_sql('content')}::INT as word_count, {tokens_sql('content')} as token_estimate from x")
def chunks_by_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.explode_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), chunking.describe(chunking.char_chunks(F.col("text"))))
    return rows.select("doc_id", "index", F.md5("content").alias("content_md5"), "char_length", "word_count", "token_estimate")


@query(_WINDOWS + " select doc_id, count(*)::INT as chunks from x group by doc_id")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(chunking.char_chunks(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("chunks")).where("chunks > 0")


@query(rf"""
    with s as (select doc_id, unnest(string_split(regexp_replace({strip_sql('text')}, '([.?!])[{_WS}]+([A-Z0-9"''“‘])', '\1' || chr(1) || '\2', 'g'), chr(1))) as s from documents where text is not null)
    select doc_id, count(*) as sentences, sum({words_sql('s')})::BIGINT as words, sum({tokens_sql('s')})::BIGINT as tokens from s group by doc_id""")
def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(chunking.sentences(F.col("text"))).alias("s")).where("s is not null")
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(T.count_words(F.col("s"))).alias("words"), F.sum(T.estimate_tokens(F.col("s"))).alias("tokens"))


def _fold_sql(most: int, carried: int) -> str:
    """The fold over sentences as a reduction with a struct as its state."""
    words = rf"regexp_extract_all(a.buf, '[^{_WS}]+')"
    led = f"array_to_string(list_slice({words}, greatest(1, len({words}) - {carried - 1}), len({words})), ' ')"
    return rf"""
    with s as (select doc_id, string_split(regexp_replace({strip_sql('text')}, '([.?!])[{_WS}]+([A-Z0-9"''“‘])', '\1' || chr(1) || '\2', 'g'), chr(1)) as l from documents where {strip_sql('text')} <> ''),
    r as (select doc_id, list_reduce(l, lambda a, x: case when a.has and a.cur + {tokens_sql('x')} > {most}
        then {{'chunks': list_append(a.chunks, {strip_sql('a.buf')}), 'buf': {led} || ' ' || x, 'has': true, 'cur': {tokens_sql(led)} + {tokens_sql('x')}}}
        else {{'chunks': a.chunks, 'buf': case when a.has then a.buf || ' ' || x else x end, 'has': true, 'cur': a.cur + {tokens_sql('x')}}} end,
        {{'chunks': []::VARCHAR[], 'buf': '', 'has': false, 'cur': 0::INT}}) as a from s),
    c as (select doc_id, list_append(a.chunks, {strip_sql('a.buf')}) as c from r),
    x as (select doc_id, unnest(c) as content, generate_subscripts(c, 1) - 1 as i from c)
    select doc_id, i::INT as index, content, length(content)::INT as char_length, {words_sql('content')}::INT as word_count, {tokens_sql('content')} as token_estimate from x"""


@query(_fold_sql(512, 37))
def chunks_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production chunk size: 512 estimated tokens, 50 of overlap."""
    return chunking.token_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 512, 50)


@query()
def chunks_by_tokens_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.token_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 128, 16, split_oversize=True)


def _document_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "id", "title", "source_url", "domain", T.normalize_content(F.col("text")).alias("content"))
    return chunking.article_chunks(d)


@query(f"""
    with d as (select doc_id, id, title, source_url, domain, {content_sql('text')} as content from documents),
    b as (select *, case when title is not null and title <> '' and starts_with(content, title) then {strip_sql('substr(content, length(title) + 1)')} else content end as t from d),
    n as (select *, length(t) as n from b),
    w as (select *, case when n = 0 then [] else list_transform({_STARTS.format(m=2000, o=200, s=1800)}, lambda a: {strip_sql("substr(t, a::INT + 1, 2000)")}) end as c from n),
    x as (select *, case when list_position(c, '') > 0 then c[1:list_position(c, '') - 1] else c end as k from w),
    y as (select id, title, source_url, domain, unnest(k) as text, generate_subscripts(k, 1) - 1 as i from x)
    select id || '-chunk-' || i as id, md5(text) as text_md5, id as article_id, title, source_url, i::INT as index, domain from y""")
def rag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = articles.rag_documents(_document_articles(spark, sf_dir))
    return r.select("id", F.md5("text").alias("text_md5"), "meta.*")


@query(f"""
    with d as (select doc_id, id, title, source_url, domain, {content_sql('text')} as content from documents),
    b as (select *, case when title is not null and title <> '' and starts_with(content, title) then {strip_sql('substr(content, length(title) + 1)')} else content end as t from d),
    n as (select *, length(t) as n from b)
    select id, title, domain, source_url as url, {words_sql('content')}::INT as word_count, {tokens_sql('content')} as tokens_est, (case when n = 0 then 0 else len({_STARTS.format(m=2000, o=200, s=1800)}) end)::INT as chunks from n""")
def article_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.summaries(_document_articles(spark, sf_dir))


# ---- pages


@query()
def article_text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: pages to articles without configuration."""
    return articles.fallback_articles(table(spark, sf_dir, "raw_pages"))


@query()
def article_generic_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the general configuration for every page."""
    rows = extract(table(spark, sf_dir, "raw_pages"), parts=("fields",))
    return rows.select("page_id", "status", first(F.col("fields.title")).alias("title"), F.array_join("fields.authors", "|").alias("authors"), F.array_join("fields.tags", "|").alias("tags"), T.normalize_content(first(F.col("fields.content"))).alias("content"))


@query()
def article_site_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields under each site's own configuration, whose cleanup selectors stand in ``parser_configs``."""
    rows = table(spark, sf_dir, "parser_configs").select("domain", "lang", "cleanup").limit(C.MAX_CONFIGS + 1).collect()
    if len(rows) > C.MAX_CONFIGS:
        raise ValueError(f"more than {C.MAX_CONFIGS} configurations")
    own = {r["domain"]: C.ParserConfig(r["domain"], r["lang"] or "en", fields=C.GENERIC.fields, cleanup=tuple(r["cleanup"] or ())) for r in rows}
    made = extract(table(spark, sf_dir, "raw_pages"), configs=own, parts=("fields",))
    return made.select("page_id", "status", first(F.col("fields.title")).alias("title"), F.char_length(first(F.col("fields.content"))).alias("chars"))


@query()
def article_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles.assemble(table(spark, sf_dir, "raw_pages"))
    a = F.col("article")
    return rows.select("page_id", "status", "error", a["id"].alias("id"), a["title"].alias("title"), a["provenance"]["domain"].alias("domain"), a["metadata"]["language"].alias("language"), a["metadata"]["word_count"].alias("word_count"), F.md5(a["content"]).alias("content_md5"))


@query(r"""
    with p as (select page_id, raw_html as h from raw_pages where raw_html is not null and trim(raw_html, chr(9) || chr(10) || chr(13) || ' ') <> '')
    select page_id, coalesce(nullif(regexp_extract(h, '(?i)<html[^>]*\slang="?([A-Za-z-]+)', 1), ''), nullif(split_part(regexp_extract(h, '(?i)<meta property="og:locale" content="([^"]*)"', 1), '_', 1), '')) as language,
      nullif(regexp_extract(h, '(?i)<meta property="og:locale" content="([^"]*)"', 1), '') as locale from p""")
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract(table(spark, sf_dir, "raw_pages"), parts=("meta", "json_ld", "lang")).where("status = 'ok'")
    m = metadata.page_metadata(F.col("meta"), F.col("json_ld"), F.col("lang"))
    return rows.select("page_id", m.alias("m")).select("page_id", "m.language", "m.locale")


@query(r"select count(*) filter (where regexp_matches(raw_html, '(?i)<h1[\s>]')) as pages, sum(len(regexp_extract_all(raw_html, '(?i)<h1[\s>]')))::BIGINT as elements from raw_pages")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selector_report(table(spark, sf_dir, "raw_pages"), {"title": ["h1"]}).select("pages", "elements")


@query()
def selector_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which selectors of the general configuration match how many pages."""
    return selector_report(table(spark, sf_dir, "raw_pages"), {name: [q.query for q in spec.chain] for name, spec in C.GENERIC.fields})


@query()
def follow_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = C.read_config({"domain": "*", "follow_urls": {"selector": "a", "attribute": "href", "all": True}})
    rows = extract(table(spark, sf_dir, "raw_pages"), default=config, parts=("links",)).where("status = 'ok'")
    return rows.select("page_id", F.posexplode("links").alias("position", "link"))


@query()
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of the pages' article elements."""
    config = C.read_config({"domain": "*", "content": {"selector": ["article", "body"], "type": "html"}, "cleanup": ["script", "style"]})
    rows = extract(table(spark, sf_dir, "raw_pages"), default=config, parts=("fields",)).where("status = 'ok'")
    return rows.select("page_id", first(F.col("fields.content")).alias("markdown"))



@query("select meta_id, case when meta_id % 2 = 0 then article_section else '' end as topics, article_section as sections from article_meta where article_section is not null and article_section <> ''")
def jsonld_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of JSON-LD texts, made here of the section column: those of articles count, those of a web site do not."""
    m = table(spark, sf_dir, "article_meta").where("article_section <> ''")
    kind = F.when(F.col("meta_id") % 2 == 0, "NewsArticle").otherwise("WebSite")
    text = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), kind.alias("@type"), F.array("article_section").alias("articleSection")))
    ld = F.array(text, F.lit("{no json"))
    return m.select("meta_id", F.array_join(metadata.ld_topics(ld), "|").alias("topics"), F.array_join(metadata.graph_sections(ld), "|").alias("sections"))


# ---- discovery


def _escaped(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@query("select item_id, trim(loc) as loc, nullif(trim(lastmod, chr(9) || chr(10) || chr(13) || chr(160) || ' '), '') as lastmod from sitemap_items where trim(loc) <> ''")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap documents, made here one per entry, parsed back."""
    items = table(spark, sf_dir, "sitemap_items").where("loc is not null")
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), _escaped(F.col("loc")), F.lit("</loc><lastmod>"), _escaped(F.coalesce("lastmod", F.lit(""))), F.lit("</lastmod></url></urlset>"))
    made = discovery.parse_sitemap_items(items.select(F.col("item_id").cast("string").alias("url"), xml.alias("content")))
    return made.select(F.col("url").cast("long").alias("item_id"), "loc", "lastmod")


@query("select domain, unnest(sitemaps) as sitemap from parser_configs")
def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = table(spark, sf_dir, "parser_configs")
    lines = F.transform(F.coalesce("sitemaps", F.array().cast("array<string>")), lambda s: F.concat(F.lit("Sitemap: "), s))
    robots = configs.select("domain", F.concat(F.lit("User-agent: *\nDisallow: /x\n"), F.array_join(lines, "\r\n")).alias("robots"))
    return discovery.robots_sitemaps(robots).select("domain", "sitemap")


@query("select meta_id, title, url as link, title is not null and title <> '' and url is not null as is_valid from article_meta where url is not null")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds, made here one per page of metadata with the date of its fetch, parsed back."""
    m = table(spark, sf_dir, "article_meta").where("url is not null")
    date = F.date_format("fetched_at", "EEE, dd MMM yyyy HH:mm:ss Z")
    date = F.coalesce(date, F.lit("Mon, 01 Jan 2024 00:00:00 +0000"))
    xml = F.concat(F.lit('<rss version="2.0"><channel><item><title>'), _escaped(F.coalesce("title", F.lit(""))), F.lit("</title><link>"), _escaped(F.col("url")), F.lit("</link><pubDate>"), date, F.lit("</pubDate></item></channel></rss>"))
    made = discovery.parse_feed_items(m.select(F.col("meta_id").cast("string").alias("url"), xml.alias("content")))
    return made.select(F.col("url").cast("long").alias("meta_id"), "title", "link", "is_valid")


_MANUAL = "select domain, unnest(sitemaps) as url from parser_configs union select domain, unnest(rss_feeds) from parser_configs"


@query(f"with m as ({_MANUAL}), h as (select distinct domain from m) select * from m union select distinct domain, loc from sitemap_items where domain is not null and loc is not null and domain not in (select domain from h)")
def discovered_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "parser_configs")
    manual = c.select("domain", F.explode("sitemaps").alias("url")).unionByName(c.select("domain", F.explode("rss_feeds").alias("url")))
    found = table(spark, sf_dir, "sitemap_items").where("domain is not null").select("domain", F.col("loc").alias("url"))
    return discovery.discover(manual, found)


# ---- frontier and results


@query("select distinct md5(loc) as url_key, loc as url from sitemap_items where loc is not null and loc not in (select url from raw_pages where url is not null)")
def seen_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "raw_pages").select(ids.cache_key(F.col("url")).alias("url_key"))
    return frontier.unseen(table(spark, sf_dir, "sitemap_items").select(F.col("loc").alias("url")), seen).select("url_key", "url")


@query("select count(*) as rows, count(loc) as urls, count(distinct loc) as distinct_urls from sitemap_items")
def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sitemap_items").select(F.col("loc").alias("url"))
    fresh = frontier.unseen(s, spark.createDataFrame([], "url_key string"))
    one = lambda c: F.lit(c).cast("long")
    counted = s.select(one(1).alias("rows"), F.col("url").isNotNull().cast("long").alias("urls"), one(0).alias("distinct_urls")).unionByName(fresh.select(one(0).alias("rows"), one(0).alias("urls"), one(1).alias("distinct_urls")))
    return counted.agg(*[F.sum(c).alias(c) for c in ("rows", "urls", "distinct_urls")])


@query("select page_id, array_to_string(list_distinct_ordered, '|') as urls from (select doc_id as page_id, [source_url, domain, source_url] as l, case when domain is null then [source_url] else [source_url, domain] end as list_distinct_ordered from documents)")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("page_id"), F.array_join(discovery.ordered_distinct(F.array("source_url", "domain", "source_url")), "|").alias("urls"))


@query("select domain, pos, page_id, url from (select domain, page_id, url, row_number() over (partition by domain order by page_id) - 1 as pos from raw_pages where domain is not null) where pos >= 5 and pos < 25")
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of every task's URL log; a task is a site's crawl here."""
    log = frontier.url_log(table(spark, sf_dir, "raw_pages").where("domain is not null").select("domain", "page_id", "url"), "domain", "page_id")
    return frontier.log_slice(log, 5, 20).select("domain", "pos", "page_id", "url")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as the outcome of its site's crawl: an empty page is a failure."""
    ok = F.col("raw_html").isNotNull() & (F.trim("raw_html") != "")
    return table(spark, sf_dir, "raw_pages").select(F.col("domain").alias("task_id"), "url", ok.alias("ok"), F.when(~ok, "empty page").alias("error"), F.lit(200).alias("status"))


_OK = "raw_html is not null and trim(raw_html) <> ''"


@query(f"select domain as task_id, count(*) as total_urls, count(*) filter (where {_OK}) as success_count, count(*) filter (where not ({_OK})) as fail_count from raw_pages group by 1")
def task_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.task_stats(_outcomes(spark, sf_dir))


@query(f"select domain as task_id, url, 'empty page' as error, 200 as status from raw_pages where not ({_OK})")
def task_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.failures(_outcomes(spark, sf_dir))


@query("select page_id, url from raw_pages where fetched_at + interval 7 day > timestamp '2024-01-15 00:00:00'")
def ttl_live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose week of keeping has not passed at a fixed time."""
    pages = results.with_expiry(table(spark, sf_dir, "raw_pages").where("fetched_at is not null"), 7, F.col("fetched_at"))
    return results.live(pages, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("page_id", "url")


@query("""
    select page_id, p.domain, coalesce(a.site_name, b.site_name) as site_name, coalesce(a.og_locale, b.og_locale) as og_locale
    from (select page_id, regexp_extract(lower(url), '://([^/?#]*)', 1) as domain from raw_pages) p
    left join parser_configs a on a.domain = p.domain left join parser_configs b on b.domain = regexp_replace(p.domain, '^www\\.', '')""")
def config_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "raw_pages").select("page_id", U.host(F.col("url")).alias("domain"))
    configs = table(spark, sf_dir, "parser_configs").select("domain", "site_name", "og_locale")
    return C.join_configs(pages, configs, F.col("domain")).select("page_id", "domain", F.col("config_site_name").alias("site_name"), F.col("config_og_locale").alias("og_locale"))


@query("""
    select domain, 'sitemap' as mode, '0 */6 * * *' as cron, 360 as period_minutes from parser_configs where len(sitemaps) > 0
    union all select domain, 'rss', '*/15 * * * *', 15 from parser_configs where len(rss_feeds) > 0
    union all select domain, 'links', '*/30 * * * *', 30 from parser_configs where coalesce(len(sitemaps), 0) = 0 and coalesce(len(rss_feeds), 0) = 0""")
def crawl_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.schedule(table(spark, sf_dir, "parser_configs"))


@query("select og_locale, domain, count(*) as pages, count(distinct url) as urls from raw_pages join parser_configs using (domain) group by rollup (og_locale, domain)")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and URLs by locale and site, with subtotals."""
    rows = table(spark, sf_dir, "raw_pages").join(table(spark, sf_dir, "parser_configs").select("domain", "og_locale"), "domain")
    return rows.rollup("og_locale", "domain").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("url").alias("urls"))


# ---- vectors


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"])


_V = "(select embedding::DOUBLE[] as q from embeddings order by vec_id limit 1)"
_DOTS = "list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * q[i]))"


def _topk_sql(value: str) -> str:
    return f"select vec_id, round(s, 9) as score from (select vec_id, {value} as s from (select vec_id, embedding::DOUBLE[] as v, q from embeddings, {_V})) order by round(s, 9) desc, vec_id limit 10"


def _topk(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    return vectors.search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, metric).select("vec_id", F.round("score", 9).alias("score"))


@query(_topk_sql(f"{_DOTS} / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x))))"))
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, "cosine")


@query(_topk_sql(_DOTS))
def vector_topk_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, "dot_product")


@query(_topk_sql("1 / (1 + list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - q[i]) * (v[i] - q[i]))))"))
def vector_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, "euclidean")


@query("""
    with q as (select vec_id as query_id, embedding::DOUBLE[64] as q from embeddings where vec_id % 20 = 0),
    s as (select query_id, vec_id, array_cosine_similarity(q, embedding::DOUBLE[64]) as s from q, embeddings where vec_id <> query_id)
    select query_id, vec_id, round(s, 6) as score, r::INT as rank from (select *, row_number() over (partition by query_id order by s desc, vec_id) as r from s) where r <= 10""")
def vector_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 20, among all."""
    e = table(spark, sf_dir, "embeddings")
    return vectors.batch_search(e, e.where("vec_id % 20 = 0"), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("select id, arg_max(doc_id, (batch_no, doc_id)) as doc_id, max(batch_no) as batch_no from documents group by id")
def vector_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows of one id the newest counts."""
    d = table(spark, sf_dir, "documents").select("id", "doc_id", "batch_no", F.struct("batch_no", "doc_id").alias("order"))
    return vectors.latest(d, "id", "order").select("id", "doc_id", "batch_no")


@query("select count(distinct id) as rows_left from documents where id not in (select id from documents where domain is null)")
def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    gone = d.where("domain is null").select("id")
    return d.select("id").join(gone, "id", "left_anti").agg(F.countDistinct("id").alias("rows_left"))


@query()
def retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks embedded and searched with a text query."""
    chunks = articles.rag_documents(_document_articles(spark, sf_dir))
    embedder = vectors.HashingEmbedder(64)
    rows = chunks.select("id", "text", vectors.embed_column(embedder)(F.col("text")).alias("vector"))
    return vectors.search(rows, embedder.embed(["market service loan fund"])[0].tolist(), 10, key="id", column="vector").select("id", F.round("score", 9).alias("score"))


# ---- streams


@query("select md5(url) as url_key, url from raw_pages where url is not null group by url")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a stream; each URL comes out once."""
    from pressmill.streaming.ingest import dedup_to_table

    base = f"{shared_dir(spark)}/pressmill-stream-{uuid.uuid4().hex}"
    keep(spark, base)
    pages = table(spark, sf_dir, "raw_pages").select("page_id", "url")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/raw_pages.parquet*")
    dedup_to_table(stream, f"{base}/out", f"{base}/seen", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("url_key", "url")


# ---- selectors, each held against what it must give on a fixed page

_PAGE = """<html lang="en"><head><title>Site</title><link rel="canonical" href="http://[broken"></head><body>
<header><h1>Old mill runs again</h1></header>
<div class="meta"><time datetime="2023-05-06T07:08:09Z">6 May</time><span class="by"><a rel="author" href="/who/ann">Ann Reed</a> and <a rel="author" href="/who/bo">Bo Lind</a></span></div>
<article class="story body"><p class="lede key">First paragraph.</p><p>Second <b>one</b>.</p><p class="last">Third.</p><script>var a = 1;</script></article>
<ul class="tags"><li>mills</li><li>rivers</li><li></li></ul><aside class="more"><a href="/x">Other</a></aside><a class="odd" href="http://[bad">odd</a></body></html>"""
_CASES: list[tuple[str, C.Field, list[str]]] = [
    ("css text", C.Field((C.Query("header h1", "css"),)), ["Old mill runs again"]),
    ("css attribute", C.Field((C.Query("time", "css", "datetime"),)), ["2023-05-06T07:08:09Z"]),
    ("css all", C.Field((C.Query(".tags li", "css"),), all=True), ["mills", "rivers"]),
    ("css html", C.Field((C.Query("p.last", "css"),), type="html"), ['<p class="last">Third.</p>']),
    ("xpath attribute", C.Field((C.Query("//time", "xpath", "datetime"),)), ["2023-05-06T07:08:09Z"]),
    ("xpath position", C.Field((C.Query("//article/p[2]", "xpath"),)), ["Second one."]),
    ("xpath equal, all", C.Field((C.Query("//a[@rel='author']", "xpath"),), all=True), ["Ann Reed", "Bo Lind"]),
    ("xpath contains", C.Field((C.Query("//p[contains(@class, 'key')]", "xpath"),)), ["First paragraph."]),
    ("xpath attribute node is no match", C.Field((C.Query("//time/@datetime", "xpath"), C.Query("h1", "css"))), ["Old mill runs again"]),
    ("css in parent", C.Field((C.Query("a", "css", "href", ".by"),), all=True), ["https://mill.example/who/ann", "https://mill.example/who/bo"]),
    ("xpath in parent", C.Field((C.Query(".//a", "xpath", None, "//span[@class='by']"),), all=True), ["Ann Reed", "Bo Lind"]),
    ("fallback css to xpath", C.Field((C.Query(".missing", "css"), C.Query("//h1", "xpath"))), ["Old mill runs again"]),
    ("fallback xpath to css", C.Field((C.Query("//nav", "xpath"), C.Query("p.lede", "css"))), ["First paragraph."]),
    ("broken selector falls back", C.Field((C.Query("//p[", "xpath"), C.Query("p.last", "css"))), ["Third."]),
    ("first match ends the chain though empty", C.Field((C.Query(".tags li:nth-child(3)", "css"), C.Query("h1", "css"))), []),
    ("cleanup", C.Field((C.Query("article", "css"),), cleanup=("script", ".lede", "//p[@class='last']")), ["Secondone."]),
    ("unreadable link stays", C.Field((C.Query("a.odd", "css", "href"),)), ["http://[bad"]),
]


def _values_sql(rows: list[tuple[str, int, str]]) -> str:
    quoted = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in row) + ")" for row in rows)
    return f"select * from (values {quoted}) as t(case_name, pos, value)"


@query(_values_sql([(name, k, v) for name, _, values in _CASES for k, v in enumerate(values)]))
def selector_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every kind of selector on one page, a row for each value."""
    pages = spark.createDataFrame([(name, f"https://c{k}.example/a", _PAGE.replace("/who/", "https://mill.example/who/")) for k, (name, *_) in enumerate(_CASES)], "name string, url string, html string")
    own = {f"c{k}.example": C.ParserConfig(f"c{k}.example", fields=(("title", field),)) for k, (_, field, _) in enumerate(_CASES)}
    rows = extract(pages, "name", "url", "html", configs=own, parts=("fields", "canonical"))
    return rows.select(F.col("name").alias("case_name"), F.posexplode("fields.title").alias("pos", "value"))


# ---- stores, opened again between the steps


@query("""
    select doc_id::VARCHAR as id, case when doc_id % 2 = 0 then 'second' else 'first' end as title, length(text)::INT as chars
    from documents where text is not null and doc_id % 7 <> 0""")
def vector_store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection after an upsert of all documents, one of every other again, and deletes, each by a store opened anew."""
    base = f"{shared_dir(spark)}/pressmill-vectors-{uuid.uuid4().hex}"
    keep(spark, base)
    open_store = lambda: vectors.VectorStore(spark, base, 16)
    rows = table(spark, sf_dir, "documents").where("text is not null")
    shaped = lambda title: rows.select(F.col("doc_id").cast("string").alias("id"), "text", F.struct(F.lit(title).alias("title"), "source_url", "domain").alias("meta"), "doc_id")
    open_store().upsert(shaped("first"))
    open_store().upsert(shaped("second").where("doc_id % 2 = 0"))
    open_store().remove_rows(shaped("x").where("doc_id % 7 = 0").select(F.col("id").alias("_id")))
    return open_store().rows().select(F.col("_id").alias("id"), "title", F.char_length("text").alias("chars"))


@query("select count(distinct url)::BIGINT as queued, count(distinct url)::BIGINT as drained, 0::BIGINT as waiting from raw_pages")
def frontier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many URLs of the pages were queued, came out of two drains by frontiers opened anew, and still wait."""
    base = f"{shared_dir(spark)}/pressmill-frontier-{uuid.uuid4().hex}"
    keep(spark, base)
    queued = frontier.Frontier(spark, base).add(table(spark, sf_dir, "raw_pages"))
    some = frontier.Frontier(spark, base).drain(10)
    rest = frontier.Frontier(spark, base).drain()
    left = len(frontier.Frontier(spark, base))
    return some.unionByName(rest).agg(F.lit(queued).cast("long").alias("queued"), F.countDistinct("url").alias("drained"), F.lit(left).cast("long").alias("waiting"))


_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})$"


@query(rf"""
    with v as (select 'lastmod' as field_name, item_id as rec_id, lastmod as value from sitemap_items union all
               select 'published_time', meta_id, published_time from article_meta union all select 'date_published', meta_id, date_published from article_meta)
    select field_name, rec_id, epoch_us(try_cast(value as timestamptz)) as utc_us from v where regexp_matches(value, '{_ISO}') and try_cast(value as timestamptz) is not null""")
def iso_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instants of the values that are ISO 8601 with a zone."""
    items, metas = table(spark, sf_dir, "sitemap_items"), table(spark, sf_dir, "article_meta")
    parts = [df.select(F.lit(name).alias("field_name"), F.col(key).alias("rec_id"), F.col(name).alias("value"), "domain", F.lit(None).cast("string").alias("url")) for df, name, key in ((items, "lastmod", "item_id"), (metas, "published_time", "meta_id"), (metas, "date_published", "meta_id"))]
    values = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("value").rlike(_ISO))
    return normalize_timestamps(values, load_sites(table(spark, sf_dir, "parser_configs"))).drop("zone_version")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

"""Articles: extraction, metadata and content put together, and the projections made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressmill.functions.ids import article_id
from pressmill.functions.text import count_words, estimate_tokens, normalize_content, normalize_datetime, normalize_list, normalize_str, reading_minutes, strip
from pressmill.functions.urls import authority, normalize_http_url
from pressmill.operators.chunking import explode_chunks
from pressmill.operators.extract import extract, first
from pressmill.operators.metadata import graph_sections, page_metadata, schema_org
from pressmill.sources.configs import GENERIC, ParserConfig

NO_TITLE = "No title found"


def fallback_articles(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Articles without configuration: id, domain, language, content and its counts, of pages with content."""
    made = extract(pages, key=key, parts=("text", "lang", "meta"))
    content = normalize_content(F.col("text"))
    rows = made.where("status = 'ok'").select(key, "url", "lang", "meta", content.alias("content")).where("content <> ''")
    words = count_words(F.col("content"))
    language = F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.element_at(F.split(F.try_element_at("meta", F.lit("og:locale")), "_"), 1))
    return rows.select(
        key, article_id(None, F.col("url")).alias("id"), authority(F.col("url")).alias("domain"), language.alias("language"), "content", words.alias("word_count"),
        estimate_tokens(F.col("content")).alias("token_estimate"), reading_minutes(words).alias("reading_time_minutes"),
    )


def assemble(
    pages: DataFrame, key: str = "page_id", configs: dict[str, ParserConfig] | None = None, default: ParserConfig | None = GENERIC, output_format: str = "markdown", keep_html: bool = False
) -> DataFrame:
    """Full articles of pages, one row per page with status and error.

    A page with neither content nor an address is an error row with a null article. A scalar where a list is due
    becomes a list of one; dates that cannot be read are null and noted in ``warnings``.
    """
    if output_format not in ("markdown", "html"):
        raise ValueError("output_format must be markdown or html")
    made = extract(pages, key=key, configs=configs, default=default, parts=("fields", "meta", "json_ld", "text", "lang"), output_format=output_format)
    rows = made.withColumn("m", page_metadata(F.col("meta"), F.col("json_ld"), F.col("lang")))
    f = lambda name: F.col(f"fields.{name}")
    markdown = first(f("content"))
    content = normalize_content(F.when(F.col("fields").isNull(), F.col("text")).otherwise(F.coalesce(markdown, F.lit(""))))
    source = normalize_http_url(F.col("url"))
    names = F.filter(F.transform(F.coalesce(f("authors"), F.array().cast("array<string>")), strip), lambda a: a != "")
    names = F.when(F.size(names) > 0, names).when(F.col("m.author").isNotNull(), F.array(F.col("m.author"))).otherwise(F.array().cast("array<string>"))
    person = lambda n: F.struct(n.alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("email", "profile_url", "affiliation")])
    sections = graph_sections(F.col("json_ld"))
    tags, topics = normalize_list(f("tags")), normalize_list(f("topics"))
    published, modified = first(f("date_published")), first(f("date_modified"))
    words = count_words(F.col("content"))
    rows = rows.select(
        "*", content.alias("content"), source.alias("source"), names.alias("names"), tags.alias("own_tags"), topics.alias("own_topics"), sections.alias("sections"), published.alias("published"), modified.alias("modified"),
        markdown.alias("content_markdown"),
    )
    error = (
        F.when(F.col("status") != "ok", F.col("error")).when(F.col("source").isNull(), F.lit("no valid address")).when(F.col("content") == "", F.lit("no content"))
        .when(F.col("m.canonical").isNotNull() & normalize_http_url(F.col("m.canonical")).isNull(), F.lit("invalid canonical address"))
    )
    rows = rows.withColumn("error", error)
    unread = lambda c, label: F.when(F.col(c).isNotNull() & normalize_datetime(F.col(c)).isNull(), F.lit(label))
    article = F.struct(
        article_id(None, F.col("source")).alias("id"),
        F.coalesce(F.col("m.title"), F.lit(NO_TITLE)).alias("title"),
        F.col("m.description").alias("description"),
        F.col("content").alias("content"),
        F.transform("names", person).alias("authors"),
        F.struct(F.col("source").alias("source_url"), authority(F.col("source")).alias("domain")).alias("provenance"),
        F.struct(
            F.col("m.language").alias("language"),
            F.when(F.size("own_tags") > 0, F.col("own_tags")).otherwise(F.col("m.tags")).alias("tags"),
            F.when(F.size("own_topics") > 0, F.col("own_topics")).when(F.size("sections") > 0, F.col("sections")).otherwise(F.col("m.topics")).alias("topics"),
            normalize_list(F.col("fields.main_points")).alias("main_points"),
            normalize_http_url(F.col("m.canonical")).alias("canonical_url"),
            words.alias("word_count"),
            reading_minutes(words).alias("reading_time_minutes"),
            F.coalesce(normalize_datetime(F.col("published")), F.col("m.date_published")).alias("published_at"),
            F.coalesce(normalize_datetime(F.col("modified")), F.col("m.date_modified")).alias("modified_at"),
            F.to_json(schema_org(F.col("json_ld"))).alias("schema_org"),
        ).alias("metadata"),
        estimate_tokens(F.col("content")).alias("computed_token_estimate"),
        F.current_timestamp().alias("created_at"),
    )
    parsed = F.struct(normalize_str(first(f("title"))).alias("title"), normalize_str(first(f("description"))).alias("description"), F.col("content_markdown"))
    return rows.select(
        key, "url", F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"), "error", F.when(F.col("error").isNull(), article).alias("article"), parsed.alias("parsed"),
        F.array_compact(F.array(unread("published", "unreadable date_published"), unread("modified", "unreadable date_modified"))).alias("warnings"),
        *([F.col("raw_html")] if keep_html and "raw_html" in rows.columns else []),
    )


def rag_documents(articles: DataFrame) -> DataFrame:
    """One row per chunk for retrieval: id ``<article>-chunk-<i>``, text and metadata. Needs id, title, source_url, domain and chunks."""
    rows = explode_chunks(articles.select("id", "title", "source_url", "domain", "chunks"), F.col("chunks"))
    return rows.select(
        F.concat_ws("-", "id", F.lit("chunk"), F.col("index").cast("string")).alias("id"), F.col("content").alias("text"),
        F.struct(F.col("id").alias("article_id"), "title", "source_url", F.col("index"), "domain").alias("meta"),
    )


def summaries(articles: DataFrame) -> DataFrame:
    """id, title, domain, url, word_count, tokens_est and chunks of articles with a chunks array."""
    return articles.select("id", "title", "domain", F.col("source_url").alias("url"), count_words(F.col("content")).alias("word_count"), estimate_tokens(F.col("content")).alias("tokens_est"), F.size("chunks").alias("chunks"))


def touch(articles: DataFrame) -> DataFrame:
    return articles.withColumn("updated_at", F.current_timestamp())


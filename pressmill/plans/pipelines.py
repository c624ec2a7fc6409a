"""Whole runs: pages of one request, of a site, or of links, to articles, chunks and vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pressmill.functions.text import strip
from pressmill.operators import articles, chunking, discovery
from pressmill.operators.extract import extract
from pressmill.operators.frontier import Frontier
from pressmill.operators.results import ResultStore, failures, task_stats
from pressmill.operators.vectors import VectorStore
from pressmill.session import materialize
from pressmill.sources.configs import GENERIC, ParserConfig
from pressmill.sources.settings import Settings

#: Columns of the flat article rows that stores and projections take.
FLAT = ("id", "title", "source_url", "domain", "content", "word_count")


@dataclass
class Run:
    """What a run leaves: flat articles and outcomes by page, both written tables."""

    articles: DataFrame
    outcomes: DataFrame


def flat(assembled: DataFrame) -> DataFrame:
    """Flat rows of the articles that could be made."""
    a = F.col("article")
    return assembled.where("status = 'ok'").select(
        a["id"].alias("id"), a["title"].alias("title"), a["provenance"]["source_url"].alias("source_url"), a["provenance"]["domain"].alias("domain"), a["content"].alias("content"), a["metadata"]["word_count"].alias("word_count")
    )


def scrape(pages: DataFrame, configs: dict[str, ParserConfig] | None = None, default: ParserConfig | None = GENERIC, output_format: str = "markdown") -> Run:
    """Pages (page_id, url, raw_html) to articles. Every page is a success or a failure."""
    made = materialize(articles.assemble(pages, configs=configs, default=default, output_format=output_format), "articles")
    outcomes = made.select("url", (F.col("status") == "ok").alias("ok"), "error", F.lit(None).cast("int").alias("status"))
    return Run(flat(made), outcomes)


def single_page(page: DataFrame, configs: dict[str, ParserConfig] | None = None, output_format: str = "markdown") -> DataFrame:
    """The article of one page, as a request for a single page gets it."""
    return flat(articles.assemble(page, configs=configs, output_format=output_format))


def scrape_for_user(task_id: str, pages: DataFrame, store: ResultStore, configs: dict[str, ParserConfig] | None = None, settings: Settings | None = None) -> DataFrame:
    """Articles, statistics and failures of a task, kept for a while; returns the statistics."""
    settings = settings or Settings.load(pages.sparkSession)
    run = scrape(pages, configs)
    store.save(task_id, run.articles, settings.result_ttl_days)
    outcomes = run.outcomes.withColumn("task_id", F.lit(task_id))
    stats = task_stats(outcomes)
    store.save_stats(task_id, stats.drop("task_id"), settings.result_ttl_days)
    store.save_failures(task_id, failures(outcomes).drop("task_id"), settings.result_ttl_days)
    return stats


def scrape_for_retrieval(pages: DataFrame, vectors: VectorStore, frontier: Frontier | None = None, configs: dict[str, ParserConfig] | None = None, settings: Settings | None = None) -> dict:
    """Unseen pages to chunks in a vector store; returns counts of articles and chunks."""
    settings = settings or Settings.load(pages.sparkSession)
    if frontier is not None:
        frontier.add(pages)
        pages = pages.join(frontier.drain().select("url"), "url", "left_semi")
    run = scrape(pages, configs)
    chunks = chunking.token_chunks(run.articles, "id", "content", settings.chunk_tokens, settings.chunk_overlap_tokens)
    names = run.articles.select("id", "title", "source_url", "domain").dropDuplicates(["id"])
    documents = chunks.join(names, "id").select(
        F.concat_ws("-", "id", F.lit("chunk"), F.col("index").cast("string")).alias("id"), F.col("content").alias("text"), F.struct("title", "source_url", "domain").alias("meta")
    )
    return {"articles": run.articles.count(), "chunks": vectors.upsert(documents)["count"]}


def linked_pages(start: DataFrame, pages: DataFrame, config: ParserConfig, settings: Settings | None = None) -> DataFrame:
    """The pages that the start pages' links lead to; at most ``follow_urls_max`` links of each start page."""
    settings = settings or Settings.load(pages.sparkSession)
    links = extract(start, default=config, parts=("links",), follow_most=None).select(F.lit("").alias("domain"), "links")
    urls = discovery.follow_urls(links, most=settings.follow_urls_max).select("url").distinct()
    return pages.join(urls, "url", "left_semi")


def bulk_urls(sitemaps: DataFrame, feeds: DataFrame) -> DataFrame:
    """URLs of sitemap and feed files (url, content), each once."""
    found = discovery.parse_sitemaps(sitemaps).select(F.col("loc").alias("url")).unionByName(discovery.parse_feeds(feeds).select(F.col("link").alias("url")))
    return found.select(strip(F.col("url")).alias("url")).where("url <> ''").distinct()


def worker_rows(assembled: DataFrame, content_format: str = "markdown") -> DataFrame:
    """What a worker hands on of each article: id, title, content and its format, provenance, metadata and stats.

    ``raw_html`` comes along where the articles were assembled with ``keep_html``, else it is null.
    """
    a = F.col("article")
    html = F.col("raw_html") if "raw_html" in assembled.columns else F.lit(None).cast("string")
    stats = F.struct(a["metadata"]["word_count"].alias("word_count"), a["metadata"]["reading_time_minutes"].alias("reading_time_minutes"))
    return assembled.where("status = 'ok'").select(
        a["id"].alias("id"), a["title"].alias("title"), a["content"].alias("content"), html.alias("raw_html"), F.lit(content_format).alias("content_format"), a["provenance"].alias("provenance"), a["metadata"].alias("metadata"), stats.alias("stats")
    )


def task_status(store: ResultStore, task_id: str) -> dict:
    """Whether a task is done or unknown, with its statistics and without its articles."""
    stats = store.stats(task_id)
    row = None if stats is None else stats.first()
    return {"task_id": task_id, "status": "unknown" if row is None else "done", "result": None if row is None else row.asDict(recursive=True)}


def handle(request: dict, read: Callable[[str], DataFrame], load: Callable[[DataFrame], DataFrame], store: ResultStore, secret: str | None = None, given: str | None = None) -> dict:
    """A request ``{"url", "mode": single_page, sitemap or rss, "output_format"}`` as a plain call.

    ``read`` gives a file (url, content) and ``load`` the pages (page_id, url, raw_html) of URLs. A single page is answered at
    once; the pages of a sitemap or feed become a task, whose id is answered. A wrong secret is refused with 403.
    """
    if secret and given != secret:
        return {"code": 403}
    url, mode, form = request.get("url"), request.get("mode", "single_page"), request.get("output_format", "markdown")
    if not url or mode not in ("single_page", "sitemap", "rss") or form not in ("markdown", "html"):
        return {"code": 422}
    spark = store.spark
    if mode == "single_page":
        row = single_page(load(spark.createDataFrame([(url,)], "url string")), output_format=form).first()
        return {"code": 200, "article": row.asDict(recursive=True)} if row else {"code": 404}
    file = read(url)
    urls = bulk_urls(file, file.limit(0)) if mode == "sitemap" else bulk_urls(file.limit(0), file)
    task_id = uuid.uuid4().hex
    scrape_for_user(task_id, load(urls), store)
    return {"code": 202, "task_id": task_id}

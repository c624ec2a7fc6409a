"""Parser configurations: what to take from a site's pages, read from JSON files or tables.

Configurations are small and held on the driver; they travel to the workers with the extraction stage.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fields of a configuration in the order they are extracted; content comes last.
FIELDS = ("title", "description", "authors", "date_published", "date_modified", "tags", "topics", "main_points", "follow_urls", "content")
KINDS = ("text", "html", "attribute")
#: Most configurations held in memory.
MAX_CONFIGS = 200_000


@dataclass(frozen=True)
class Query:
    """One selector of a chain."""

    query: str
    kind: str  # css or xpath
    attribute: str | None = None
    parent: str | None = None


@dataclass(frozen=True)
class Field:
    """A chain of selectors of which the first with an element wins."""

    chain: tuple[Query, ...]
    type: str = "text"
    attribute: str | None = None
    all: bool = False
    cleanup: tuple[str, ...] = ()


@dataclass(frozen=True)
class ParserConfig:
    domain: str
    lang: str = "en"
    type: str = "article"
    fields: tuple[tuple[str, Field], ...] = ()
    cleanup: tuple[str, ...] = ()
    sitemaps: tuple[str, ...] = ()
    rss_feeds: tuple[str, ...] = ()

    def field(self, name: str) -> Field | None:
        return dict(self.fields).get(name)


def selector_kind(query: str, stated: str | None = None) -> str:
    """css or xpath: as stated, else xpath if the stripped query begins with a slash."""
    if stated and stated.lower() in ("css", "xpath"):
        return stated.lower()
    return "xpath" if query.strip().startswith("/") else "css"


def _queries(value) -> tuple[Query, ...]:
    out = []
    for item in value if isinstance(value, list) else [value]:
        if isinstance(item, str) and item.strip():
            out.append(Query(item.strip(), selector_kind(item)))
        elif isinstance(item, dict) and (text := item.get("query") or item.get("selector")):
            out.append(Query(text.strip(), selector_kind(text, item.get("selector_type")), item.get("attribute"), item.get("parent")))
    return tuple(out)


def read_field(value) -> Field | None:
    """A field of a configuration: a query, a list of queries, or an object with ``selector``; null if it has none."""
    if isinstance(value, (str, list)):
        value = {"selector": value}
    if not isinstance(value, dict):
        return None
    chain = _queries(value.get("selector", value.get("css_selector")) or [])
    if not chain:
        return None
    kind = value.get("type") or "text"
    if kind not in KINDS:
        raise ValueError(f"unknown field type {kind!r}")
    return Field(chain, kind, value.get("attribute"), bool(value.get("all")), tuple(value.get("cleanup") or ()))


def read_config(raw: dict) -> ParserConfig:
    """A configuration of the JSON shape. ``sitemap_url`` and ``rss_url`` are taken along with the lists."""
    fields = tuple((name, f) for name in FIELDS if (f := read_field(raw.get(name))) is not None)

    def urls(many: str, one: str) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*(raw.get(many) or ()), *([raw[one]] if raw.get(one) else ())]))

    return ParserConfig(
        domain=(raw.get("domain") or "").strip().lower(), lang=raw.get("lang") or "en", type=raw.get("type") or "article", fields=fields,
        cleanup=tuple(raw.get("cleanup") or ()), sitemaps=urls("sitemaps", "sitemap_url"), rss_feeds=urls("rss_feeds", "rss_url"),
    )


def load_configs(folder: str | Path) -> dict[str, ParserConfig]:
    """All JSON files below a folder, by domain; also by file name where that differs. Files that are no JSON are left out."""
    out: dict[str, ParserConfig] = {}
    for path in sorted(Path(folder).rglob("*.json")):
        try:
            config = read_config(json.loads(path.read_text(encoding="utf-8")))
        except (ValueError, AttributeError):
            continue
        for key in (path.stem.lower(), config.domain):
            if key:
                out.setdefault(key, config)
    return out


def config_for(configs: dict[str, ParserConfig], domain: str | None) -> ParserConfig | None:
    """The configuration of a domain, or of the domain without www."""
    name = (domain or "").lower()
    return configs.get(name) or configs.get(name.removeprefix("www."))


def migrate_config(raw: dict, cleanup: Iterable[str] = ("script", "style")) -> dict:
    """An old configuration in the present shape: ``selector`` for ``css_selector``, no field types, a default cleanup."""
    out = {k: v for k, v in raw.items() if k not in FIELDS}
    for name in FIELDS:
        value = raw.get(name)
        if isinstance(value, dict):
            value = {("selector" if k == "css_selector" else k): v for k, v in value.items() if k != "type"}
        if value is not None:
            out[name] = value
    out.setdefault("cleanup", list(cleanup))
    return out


def starter_config(domain: str, lang: str = "en") -> dict:
    """A first configuration for a new site, to be refined by hand."""
    return {"domain": domain, "lang": lang, "type": "article", "title": {"selector": [q.query for q in GENERIC.field("title").chain]}, "content": {"selector": [q.query for q in GENERIC.field("content").chain]}, "cleanup": list(GENERIC.cleanup)}


def join_configs(pages: DataFrame, configs: DataFrame, domain: Column) -> DataFrame:
    """pages with the configuration row of their domain, exact or without www; unmatched pages keep nulls.

    The configurations are broadcast if there are no more than ``MAX_CONFIGS``, and joined by shuffle otherwise.
    """
    small = configs.limit(MAX_CONFIGS + 1).count() <= MAX_CONFIGS
    hint = F.broadcast if small else lambda x: x
    renamed = configs.select(*[F.col(c).alias(f"config_{c}") for c in configs.columns])
    exact = pages.withColumn("_at", F.lower(domain)).join(hint(renamed.withColumnRenamed("config_domain", "_at")), "_at", "left")
    bare = renamed.select(*[F.col(c).alias(f"_{c}") for c in renamed.columns]).withColumnRenamed("_config_domain", "_bare")
    both = exact.withColumn("_bare", F.regexp_replace("_at", r"^www\.", "")).join(hint(bare), "_bare", "left")
    names = [c for c in renamed.columns if c != "config_domain"]
    found = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in names]) if names else F.lit(None)
    return both.select(*[F.col(c) for c in pages.columns], *[F.when(found, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in names])


def schedule(configs: DataFrame) -> DataFrame:
    """When each site is crawled again, one row per site and mode: every 6 hours by its sitemaps, every 15 minutes by its
    feeds, and every 30 minutes by links where it has neither.

    A site with sitemaps and feeds has both rows. Arrays that are null or empty count as none.
    """
    have = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0

    def row(mode: str, cron: str, minutes: int) -> Column:
        return F.struct(F.lit(mode).alias("mode"), F.lit(cron).alias("cron"), F.lit(minutes).alias("period_minutes"))

    links = F.array(row("links", "*/30 * * * *", 30))
    both = F.array_compact(F.array(F.when(have("sitemaps"), row("sitemap", "0 */6 * * *", 360)), F.when(have("rss_feeds"), row("rss", "*/15 * * * *", 15))))
    return configs.select("domain", F.explode(F.when(F.size(both) > 0, both).otherwise(links)).alias("x")).select("domain", "x.*")


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Page fixtures ``{url, domain, raw_html}``, one JSON object a file, from a folder and those below."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema("url string, domain string, raw_html string").json(path)


def _field(*queries: str, **more) -> Field:
    return Field(tuple(Query(q, selector_kind(q), *([more["attr"]] if more.get("attr") else [])) for q in queries), all=bool(more.get("all")), type=more.get("type", "text"), attribute=more.get("attr"))


#: A configuration for sites without one of their own.
GENERIC = ParserConfig(
    domain="*",
    fields=(
        ("title", _field("article h1", "main h1", "h1[itemprop='headline']", "[itemprop='headline']", ".headline h1", ".article-title", ".post-title", ".entry-title", ".story-title", ".page-title", "h1", "article h2", "main h2", "title")),
        ("authors", _field("[rel='author']", "[itemprop='author'] [itemprop='name']", "[itemprop='author']", ".author-name", ".author a", ".author", ".byline a", ".byline", ".writer", ".contributor", ".post-author", ".entry-author", "address a", "a[href*='/author/']", all=True)),
        ("date_published", _field("time[itemprop='datePublished']", "time[pubdate]", "article time[datetime]", "header time[datetime]", "time[datetime]", "[itemprop='datePublished'][datetime]", ".published[datetime]", ".date[datetime]", attr="datetime")),
        ("date_modified", _field("time[itemprop='dateModified']", "time.updated[datetime]", "[itemprop='dateModified'][datetime]", ".modified[datetime]", attr="datetime")),
        ("tags", _field("a[rel='tag']", ".tags a", ".tag-list a", "[itemprop='keywords'] a", ".tag", all=True)),
        ("content", _field("[itemprop='articleBody']", "article .article-body", "article .body", "article", "main", ".article-body", ".article-content", ".post-content", ".entry-content", ".story-body", ".story", ".post", ".content", "#content", "#main", "body")),
    ),
    cleanup=("script", "style", "nav", "aside", "footer", "form", "iframe"),
)
#: A configuration for pages of the most common blog software.
WORDPRESS = ParserConfig(
    domain="*",
    fields=(
        ("title", _field("h1.entry-title", ".post-title", "h1")),
        ("authors", _field(".entry-meta .author", "a[rel='author']", all=True)),
        ("date_published", _field("time.entry-date", "time[datetime]", attr="datetime")),
        ("tags", _field("a[rel='tag']", all=True)),
        ("content", _field("div.entry-content", ".post-content", "article")),
    ),
    cleanup=("script", "style", ".sharedaddy", ".related-posts", ".comments"),
)
#: Removed from HTML content whatever the configuration says: what runs, what asks for something, what leads elsewhere.
SAFETY_CLEANUP = (
    "script", "style", "noscript", "template", "iframe", "object", "embed", "form", "button", "input", "select", "textarea", "nav", "aside", "footer", "dialog",
    "[class*='advert']", "[class*='share']", "[class*='newsletter']", "[class*='related']", "[class*='cookie']", "[role='navigation']", "[aria-hidden='true']",
)

"""URL discovery: robots files, sitemaps, feeds and links."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressmill.functions.text import normalize_datetime, rfc822_datetime, strip


def robots_sitemaps(robots: DataFrame, domain: str = "domain", text: str = "robots") -> DataFrame:
    """(domain, sitemap): addresses of the lines that begin with ``sitemap:``, in their order, made absolute.

    Null texts and lines without an address have no row.
    """
    lines = robots.select(F.col(domain).alias("domain"), F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line_no", "line"))
    at = strip(F.regexp_extract("line", r"(?i)^\s*sitemap:(.*)$", 1))
    absolute = F.when(at.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), at).when(at.startswith("//"), F.concat(F.lit("https:"), at)).otherwise(F.concat(F.lit("https://"), F.col("domain"), F.lit("/"), F.regexp_replace(at, "^/+", "")))
    return lines.where(at != "").select("domain", "line_no", absolute.alias("sitemap"))


def _unzipped(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _root(data: bytes | None) -> ET.Element | None:
    """The root of an XML document, gzipped or not; null for what is no XML."""
    if not data:
        return None
    try:
        return ET.fromstring(_unzipped(data))
    except (ET.ParseError, OSError, EOFError, ValueError):
        return None


def sitemap_locs(data: bytes | None) -> list[str]:
    """Addresses of a sitemap or sitemap index: ``loc`` in the namespace of the root, at any depth."""
    root = _root(data)
    if root is None:
        return []
    space = root.tag.rpartition("}")[0] + "}" if "}" in root.tag else ""
    return [t for e in root.iter(space + "loc") if (t := (e.text or "").strip())]


def sitemap_items(data: bytes | None) -> list[dict]:
    """Entries of a sitemap: loc, lastmod (of news entries their publication date where missing), title, news flag."""
    root = _root(data)
    if root is None:
        return []
    out = []
    for entry in root:
        if _local(entry.tag) not in ("url", "sitemap"):
            continue
        item = {"loc": None, "lastmod": None, "news_title": None, "news_publication_date": None}
        for e in entry:
            name, text = _local(e.tag), (e.text or "").strip()
            if name in ("loc", "lastmod") and text:
                item[name] = item[name] or text
            elif name == "news":
                for part in e:
                    if (key := "news_" + _local(part.tag)) in item and (part.text or "").strip():
                        item[key] = part.text.strip()
        if item["loc"]:
            out.append(item | {"lastmod": item["lastmod"] or item["news_publication_date"], "is_news": bool(item["news_title"] and item["news_publication_date"])})
    return out


def feed_links(data: bytes | None) -> list[str]:
    """Links of a feed: those of RSS items, then those of Atom entries."""
    root = _root(data)
    if root is None:
        return []
    out = []
    for holder in ("item", "entry"):
        for entry in root.iter():
            if _local(entry.tag) == holder:
                for e in entry:
                    if _local(e.tag) == "link" and (href := ((e.text or "").strip() or (e.get("href") or "").strip())):
                        out.append(href)
    return out


_TAGS = re.compile(r"<[^>]+>")


def feed_items(data: bytes | None) -> list[dict]:
    """Items of a feed with title, link, description (its first paragraph without a link), date text, image, categories, keywords."""
    from pressmill.html.css import select
    from pressmill.html.dom import parse

    root = _root(data)
    if root is None:
        return []
    out = []
    for entry in root.iter():
        if _local(entry.tag) not in ("item", "entry"):
            continue
        item: dict = {"title": None, "link": None, "description": None, "published": None, "image": None, "categories": [], "keywords": []}
        for e in entry:
            name, text = _local(e.tag).lower(), (e.text or "").strip()
            if name == "title" and item["title"] is None:
                item["title"] = text or None
            elif name == "link" and item["link"] is None:
                item["link"] = text or e.get("href")
            elif name in ("description", "summary", "encoded") and item["description"] is None and text:
                page = parse(text)
                paragraph = next((p for p in select(page, "p") if not select(p, "a")), None)
                item["description"] = paragraph.text() if paragraph is not None else _TAGS.sub("", text).strip() or None
                picture = page.find("img")
                item["image"] = item["image"] or (picture.get("src") if picture is not None else None)
            elif name in ("pubdate", "published", "updated", "date") and item["published"] is None:
                item["published"] = text or None
            elif name in ("content", "thumbnail", "enclosure") and e.get("url"):
                item["image"] = e.get("url")
            elif name == "category":
                item["categories"] += [c for c in [text or (e.get("term") or "")] if c]
            elif name == "keywords":
                item["keywords"] += [k.strip() for k in text.split(",") if k.strip()]
        out.append(item)
    return out


SITEMAP = "loc string, lastmod string, news_title string, news_publication_date string, is_news boolean"
FEED = "title string, link string, description string, published string, image string, categories array<string>, keywords array<string>"


def _parsed(files: DataFrame, url: str, content: str, reader, fields: str, wrap: str | None = None) -> DataFrame:
    arrow = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    pairs = [f.strip().split(" ", 1) for f in fields.split(",")]
    schema = pa.schema([("url", pa.string()), ("position", pa.int32()), *[(n, arrow[t]) for n, t in pairs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [{"url": at, "position": k} | ({wrap: x} if wrap else x) for k, x in enumerate(reader(data))]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select(F.col(url).alias("url"), F.col(content).cast("binary").alias("content")).mapInArrow(run, f"url string, position int, {fields}")


def parse_sitemaps(files: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    """(url, position, loc) of sitemap files; malformed ones have no row."""
    return _parsed(files, url, content, sitemap_locs, "loc string", "loc")


def parse_sitemap_items(files: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    return _parsed(files, url, content, sitemap_items, SITEMAP)


def parse_feeds(files: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    """(url, position, link) of feed files; malformed ones have no row."""
    return _parsed(files, url, content, feed_links, "link string", "link")


def parse_feed_items(files: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    """Items of feed files with ``published_at`` (ISO or RFC 822) and ``is_valid``: title, link and a readable date."""
    rows = _parsed(files, url, content, feed_items, FEED)
    published = F.coalesce(normalize_datetime(F.col("published")), rfc822_datetime(F.col("published")))
    valid = F.col("title").isNotNull() & F.col("link").isNotNull() & published.isNotNull()
    return rows.withColumn("published_at", published).withColumn("is_valid", valid)


def discover(manual: DataFrame, found: DataFrame) -> DataFrame:
    """(domain, url), each once: addresses from configured sources; those found on the site only where a domain has none of the former."""
    hits = manual.where("url is not null").select("domain", "url").distinct()
    rest = found.where("url is not null").join(hits.select("domain").distinct(), "domain", "left_anti").select("domain", "url").distinct()
    return hits.unionByName(rest)


def follow_urls(links: DataFrame, domain: str = "domain", urls: str = "links", most: int = 25) -> DataFrame:
    """(domain, position, url): the first ``most`` distinct links of each row's list."""
    each = F.slice(F.array_distinct(F.coalesce(F.col(urls), F.array().cast("array<string>"))), 1, most)
    return links.select(F.col(domain).alias("domain"), F.posexplode(each).alias("position", "url"))


def ordered_distinct(urls: Column) -> Column:
    """Each URL once, in the order of first places."""
    return F.array_distinct(urls)


def absolute(base: str, href: str) -> str:
    return urljoin(base, href)

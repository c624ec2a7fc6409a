"""Declarative extraction of fields from HTML: one Arrow stage, one parse per page.

A page is parsed once; all that needs the tree (fields of the configuration, meta tags, JSON-LD texts, container text,
links) comes out of that stage together. ``parts`` names what is wanted, since Spark cannot prune the inside of a
Python stage. All that follows is built of native expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressmill.html import css, xpath
from pressmill.html.dom import Node, parse
from pressmill.html.markdown import to_markdown
from pressmill.session import spread
from pressmill.sources.configs import FIELDS, GENERIC, SAFETY_CLEANUP, Field, ParserConfig, Query, config_for, selector_kind


def find(root: Node, query: str, kind: str, context: Node | None = None) -> list[Node]:
    """Elements of a selector; one that cannot be read matches nothing."""
    try:
        return xpath.select(root, query, context) if kind == "xpath" else css.select(context if context is not None else root, query)
    except (ValueError, RecursionError, KeyError, IndexError):
        return []


def _matches(root: Node, q: Query) -> list[Node]:
    if not q.parent:
        return find(root, q.query, q.kind)
    parents = find(root, q.parent, "xpath" if q.kind == "xpath" else selector_kind(q.parent))
    if not parents:
        return []
    if q.kind == "xpath":
        text = q.query
        text = text if text.startswith(".") else "." + text if text.startswith("/") else ".//" + text
        return find(root, text, "xpath", parents[0])
    return find(root, q.query, "css", parents[0])


def cleaned(node: Node, selectors: tuple[str, ...]) -> Node:
    """The element without what the selectors match; the element itself where nothing is to be removed."""
    for selector in selectors:
        for found in find(node, selector, selector_kind(selector)):
            if found is not node:
                found.remove()
    return node


def absolute(base: str, link: str | None) -> str:
    """A link made absolute; one that cannot be read is given back as it is."""
    try:
        return urljoin(base, link or "")
    except ValueError:
        return link or ""


def field_values(root: Node, spec: Field, base_url: str | None = None) -> list[str]:
    """Values of a field: the first selector with an element wins, even if its value turns out empty."""
    for q in spec.chain:
        nodes = _matches(root, q)
        if not nodes:
            continue
        nodes = nodes if spec.all else nodes[:1]
        out = []
        for node in nodes:
            if spec.cleanup:
                node = cleaned(node.copy(), spec.cleanup)
            name = q.attribute or spec.attribute
            if name:
                value = node.get(name.lower()) or ""
                if name.lower() == "href" and value and base_url:
                    value = absolute(base_url, value)
            elif spec.type == "html":
                value = node.to_html()
            else:
                value = node.content().strip() if q.kind == "xpath" else node.text()
            if value:
                out.append(value)
        return out
    return []


def meta_map(root: Node) -> dict[str, str]:
    """Meta tags by property or name; of equal keys the last counts."""
    out = {}
    for tag in root.walk():
        if tag.tag == "meta" and (key := tag.get("property") or tag.get("name")) and (content := tag.get("content")):
            out[key] = content
    return out


def json_ld(root: Node) -> list[str]:
    return [text for n in root.walk() if n.tag == "script" and (n.get("type") or "").strip().lower() == "application/ld+json" and (text := n.content().strip())]


def container_text(root: Node) -> str:
    """Text of the first main, else article, else body, its text nodes stripped and joined by one blank."""
    node = root.find("main") or root.find("article") or root.find("body")
    return node.text(" ") if node is not None else ""


def content_of(root: Node, values: list[str], output_format: str) -> str:
    """Content text; HTML among it is cleaned and turned into Markdown, or into plain text with output_format html."""
    text = values[0] if values else ""
    if "<" not in text and ">" not in text:
        return text
    node = cleaned(parse(text), SAFETY_CLEANUP)
    return to_markdown(node) if output_format == "markdown" else " ".join(node.text(" ").split())


def follow_links(root: Node, spec: Field | None, domain: str, most: int | None = 25, every_domain: bool = False) -> list[str]:
    """Links to pages of the same domain, or of all with ``every_domain``, made absolute, each once; at most ``most``, or all for null."""
    bare = domain.removeprefix("www.")
    out: dict[str, None] = {}
    for q in spec.chain if spec else ():
        for node in _matches(root, q):
            href = (node.get(q.attribute or spec.attribute or "href") or "").strip()
            if href.startswith("/") and not href.startswith("//"):
                href = f"https://{domain}{href}"
            elif "://" in href:
                host = href.split("://", 1)[1].split("/", 1)[0].split("?", 1)[0].lower()
                if not every_domain and host.removeprefix("www.") != bare:
                    continue
            elif href.startswith(("#", "mailto:", "javascript:", "//")) or not href:
                continue
            else:
                href = absolute(f"https://{domain}/", href)
            out.setdefault(href)
    return list(out)[:most]


PARTS = ("fields", "meta", "json_ld", "text", "lang", "links", "feeds", "title", "canonical")
_VALUES = "struct<" + ",".join(f"{f}:array<string>" for f in FIELDS) + ">"
_KINDS = {
    "fields": (_VALUES, pa.struct([(f, pa.list_(pa.string())) for f in FIELDS])),
    "meta": ("map<string,string>", pa.map_(pa.string(), pa.string())),
    "json_ld": ("array<string>", pa.list_(pa.string())),
    "text": ("string", pa.string()),
    "lang": ("string", pa.string()),
    "links": ("array<string>", pa.list_(pa.string())),
    "feeds": ("array<string>", pa.list_(pa.string())),
    "title": ("string", pa.string()),
    "canonical": ("string", pa.string()),
}
_FEED_TYPES = ("application/rss+xml", "application/atom+xml")


def extract(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "raw_html", configs: dict[str, ParserConfig] | None = None,
    default: ParserConfig | None = GENERIC, parts: tuple[str, ...] = PARTS, output_format: str = "markdown", batch_rows: int = 200,
    follow_most: int | None = 25, follow_every_domain: bool = False,
) -> DataFrame:
    """One row per page: key, url, status, error and the wanted parts.

    ``configs`` has configurations by domain; pages of other domains use ``default``, and without one their ``fields``
    stay null. Null, empty and blank pages come out with status error, and so does a page at which anything fails: no page
    stops a job. Pages with null keys or URLs are kept.
    """
    kind = pages.schema[key].dataType.simpleString()
    schema = f"`key` {kind}, url string, status string, error string" + "".join(f", {p} {_KINDS[p][0]}" for p in parts)
    shared = pages.sparkSession.sparkContext.broadcast(configs or {})

    def one(page: str | None, at: str | None) -> dict:
        try:
            return parts_of(page, at)
        except Exception as e:  # whatever a page does, it becomes a row
            return {"status": "error", "error": f"{type(e).__name__}: {e}"[:300]}

    def parts_of(page: str | None, at: str | None) -> dict:
        row: dict = {"status": "ok", "error": None}
        if not page or not page.strip():
            return row | {"status": "error", "error": "empty page"}
        root = parse(page)
        base = at or ""
        domain = base.split("://", 1)[-1].split("/", 1)[0].lower()
        if "lang" in parts:
            row["lang"] = root.get("lang")
        if "meta" in parts:
            row["meta"] = list(meta_map(root).items())
        if "json_ld" in parts:
            row["json_ld"] = json_ld(root)
        if "text" in parts:
            row["text"] = container_text(root)
        if "title" in parts and (head := root.find("title")) is not None:
            row["title"] = " ".join(head.content().split()) or None
        if "canonical" in parts:
            row["canonical"] = next((absolute(base, n.get("href")) for n in root.walk() if n.tag == "link" and "canonical" in (n.get("rel") or "").lower().split() and n.get("href")), None)
        if "feeds" in parts:
            row["feeds"] = [absolute(base, n.get("href")) for n in root.walk() if n.tag == "link" and (n.get("type") or "").lower() in _FEED_TYPES and n.get("href")]
        config = config_for(shared.value, domain) or default
        if config and "links" in parts:
            row["links"] = follow_links(root, config.field("follow_urls"), domain, follow_most, follow_every_domain)
        if config and "fields" in parts:
            cleaned(root, config.cleanup)
            values = {name: field_values(root, spec, base) for name, spec in config.fields}
            if "content" in values:
                values["content"] = [c] if (c := content_of(root, values["content"], output_format)) else []
            row["fields"] = values
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                urls = batch.column(1).to_pylist()
                rows = [one(page, at) for page, at in zip(batch.column(2).to_pylist(), urls)]
                columns = [batch.column(0), batch.column(1), pa.array([r["status"] for r in rows]), pa.array([r["error"] for r in rows], pa.string())]
                columns += [pa.array([r.get(p) for r in rows], _KINDS[p][1]) for p in parts]
                yield pa.RecordBatch.from_arrays(columns, ["key", "url", "status", "error", *parts])

    made = spread(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")), "key").mapInArrow(run, schema)
    return made.withColumnRenamed("key", key)


def first(values: Column) -> Column:
    """The first value of a field; null without one."""
    return F.get(values, F.lit(0))


def selector_report(pages: DataFrame, candidates: dict[str, list[str]], key: str = "page_id", html: str = "raw_html") -> DataFrame:
    """For each category of selectors and each selector: how many pages it matches and how many elements in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column(0).to_pylist():
                root = parse(page)
                for category, selectors in candidates.items():
                    first_hit = True
                    for selector in selectors:
                        n = len(find(root, selector, selector_kind(selector)))
                        rows.append((category, selector, n, bool(n) and first_hit))
                        first_hit = first_hit and not n
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.bool_()))], ["category", "selector", "elements", "wins"])

    counts = pages.where(F.col(html).isNotNull()).select(html).mapInArrow(run, "category string, selector string, elements long, wins boolean")
    return counts.groupBy("category", "selector").agg(F.count_if(F.col("elements") > 0).alias("pages"), F.sum("elements").alias("elements"), F.count_if("wins").alias("wins"))

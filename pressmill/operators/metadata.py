"""Page metadata as expressions over the meta-tag map and the JSON-LD texts of a page."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pressmill.functions.text import image_type, normalize_datetime, split_list

ARTICLE_TYPES = ("Article", "NewsArticle", "WebPage")
KNOWN_TYPES = ("Article", "NewsArticle", "ImageObject", "Person", "Organization", "BreadcrumbList", "ListItem", "WebPage", "WebSite", "ListItemElement")
MOST_TOPICS, MOST_TAGS = 5, 10
#: Twitter card tags that a card may have; one with any other is rejected as a whole.
TWITTER_KEYS = ("twitter:card", "twitter:site", "twitter:creator", "twitter:image", "twitter:description")


def _text(meta: Column, *keys: str) -> Column:
    """The first non-empty value of the keys."""
    return F.coalesce(*[F.nullif(F.try_element_at(meta, F.lit(k)), F.lit("")) for k in keys])


def image(meta: Column) -> Column:
    """Open Graph image with its type, size and alternative text, else the one of the Twitter card."""
    url = _text(meta, "og:image")
    full = F.struct(
        url.alias("url"), F.coalesce(_text(meta, "og:image:type"), image_type(url)).alias("type"), _text(meta, "og:image:width").try_cast("int").alias("width"),
        _text(meta, "og:image:height").try_cast("int").alias("height"), _text(meta, "og:image:alt").alias("alt"),
    )
    other = _text(meta, "twitter:image")
    bare = F.struct(other.alias("url"), image_type(other).alias("type"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("string").alias("alt"))
    return F.when(url.isNotNull(), full).when(other.isNotNull(), bare)


def twitter_card(meta: Column) -> Column:
    """The Twitter tags; null without any, and if one of them is unknown."""
    card = F.map_filter(meta, lambda k, v: k.startswith("twitter:"))
    known = F.forall(F.map_keys(card), lambda k: k.isin(*TWITTER_KEYS))
    return F.when((F.size(card) > 0) & known, card)


def clean_topics(values: Column) -> Column:
    """At most five topics, without those that name a home page."""
    return F.slice(F.filter(values, lambda x: ~F.lower(x).isin("home", "homepage", "trang chủ", "trang")), 1, MOST_TOPICS)


def clean_tags(values: Column) -> Column:
    return F.slice(values, 1, MOST_TAGS)


def ld_nodes(json_ld: Column) -> Column:
    """Variants of all JSON-LD texts that are JSON; a list counts as its members."""
    parsed = F.filter(F.transform(F.coalesce(json_ld, F.array().cast("array<string>")), F.try_parse_json), lambda v: v.isNotNull())
    return F.flatten(F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))


def ld_type(node: Column) -> Column:
    """The type of a node, of several the first."""
    return F.coalesce(F.try_variant_get(node, "$['@type'][0]", "string"), F.try_variant_get(node, "$['@type']", "string"))


def has_context(node: Column, wanted: str = "schema.org") -> Column:
    context = F.coalesce(F.try_variant_get(node, "$['@context']", "string"), F.try_variant_get(node, "$['@context'][0]", "string"))
    return F.coalesce(context.contains(wanted), F.lit(False))


def breadcrumb_topics(node: Column) -> Column:
    """Names of a breadcrumb list's items, each once, at most five."""
    items = F.coalesce(F.try_variant_get(node, "$.itemListElement", "array<variant>"), F.array().cast("array<variant>"))
    names = F.transform(items, lambda i: F.coalesce(F.nullif(F.try_variant_get(i, "$.name", "string"), F.lit("")), F.try_variant_get(i, "$.item.name", "string")))
    return F.slice(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != ""))), 1, MOST_TOPICS)


def _sections(node: Column, strings: bool) -> Column:
    """articleSection of a node: a list of strings, and with ``strings`` a single one too."""
    many = F.try_variant_get(node, "$.articleSection", "array<string>")
    one = F.try_variant_get(node, "$.articleSection", "string")
    empty = F.array().cast("array<string>")
    single = F.when(F.lit(strings) & one.isNotNull() & ~one.startswith("["), F.array(one)).otherwise(empty)
    return F.filter(F.coalesce(many, single), lambda s: s.isNotNull())


def ld_topics(json_ld: Column) -> Column:
    """Topics of breadcrumb lists and of the sections of articles and pages."""
    empty = F.array().cast("array<string>")
    per_node = F.transform(
        ld_nodes(json_ld),
        lambda n: F.when(ld_type(n) == "BreadcrumbList", breadcrumb_topics(n)).when(ld_type(n).isin(*ARTICLE_TYPES), _sections(n, False)).otherwise(empty),
    )
    return F.flatten(per_node)


def graph_sections(json_ld: Column) -> Column:
    """Sections anywhere the page states them: in the graph of a single text, else in its nodes."""
    nodes = ld_nodes(json_ld)
    lone = F.try_variant_get(F.try_element_at(nodes, F.lit(1)), "$['@graph']", "array<variant>")
    where = F.when((F.size(nodes) == 1) & lone.isNotNull(), lone).otherwise(nodes)
    return F.flatten(F.transform(where, lambda n: _sections(n, True)))


def schema_org(json_ld: Column) -> Column:
    """The first JSON object among the page's nodes, as a variant."""
    objects = F.filter(ld_nodes(json_ld), lambda n: F.schema_of_variant(n).startswith("OBJECT"))
    return F.try_element_at(objects, F.lit(1))


def page_metadata(meta: Column, json_ld: Column, lang: Column) -> Column:
    """Struct of a page's metadata. ``<title>``, canonical links and JSON-LD headlines are not consulted."""
    section = split_list(_text(meta, "article:section"))
    keywords = split_list(_text(meta, "keywords"))
    locale = _text(meta, "og:locale")
    return F.struct(
        _text(meta, "author").alias("author"),
        _text(meta, "og:url", "canonical").alias("canonical"),
        _text(meta, "description", "og:description").alias("description"),
        _text(meta, "og:title", "twitter:title", "title").alias("title"),
        locale.alias("locale"),
        F.coalesce(F.nullif(lang, F.lit("")), F.element_at(F.split(locale, "_"), 1)).alias("language"),
        normalize_datetime(_text(meta, "article:published_time")).alias("date_published"),
        normalize_datetime(_text(meta, "article:modified_time")).alias("date_modified"),
        F.when(F.size(keywords) > 0, keywords).otherwise(split_list(_text(meta, "news_keywords"))).alias("tags"),
        F.when(F.size(section) > 0, section).otherwise(ld_topics(json_ld)).alias("topics"),
        image(meta).alias("image"),
        twitter_card(meta).alias("twitter"),
    )


def helper_topics(json_ld: Column, title: Column) -> Column:
    """Topics of the richer helper: those of the page without any that the title contains."""
    return F.filter(ld_topics(json_ld), lambda t: ~F.coalesce(F.lower(title).contains(F.lower(t)), F.lit(False)))


def last_node(nodes: Column, *types: str) -> Column:
    """The last node of the first of the types that occurs."""

    def of(kind: str) -> Column:
        return F.try_element_at(F.filter(nodes, lambda n: ld_type(n) == kind), F.lit(-1))

    return F.coalesce(*map(of, types))


def schema_summary(json_ld: Column, title: Column) -> Column:
    """What a page's JSON-LD says of its article, of several kinds the most specific: headline, author, dates, image, topics."""
    nodes = ld_nodes(json_ld)
    article = last_node(nodes, "NewsArticle", "Article", "WebPage")
    text = lambda path: F.try_variant_get(article, path, "string")
    return F.struct(
        F.coalesce(text("$.headline"), text("$.name")).alias("title"),
        F.coalesce(text("$.author.name"), text("$.author[0].name"), F.try_variant_get(last_node(nodes, "Person"), "$.name", "string")).alias("author"),
        normalize_datetime(text("$.datePublished")).alias("date_published"),
        normalize_datetime(text("$.dateModified")).alias("date_modified"),
        F.coalesce(text("$.image.url"), text("$.image[0].url"), F.try_variant_get(last_node(nodes, "ImageObject"), "$.url", "string")).alias("image"),
        text("$.inLanguage").alias("locale"),
        helper_topics(json_ld, title).alias("topics"),
    )


def meta_value(meta: Column, *names: str) -> Column:
    """The first non-empty value of the names, whatever their case; entries are searched, as keys may differ in case only."""
    entries = F.map_entries(meta)

    def of(name: str) -> Column:
        return F.nullif(F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == name.lower()), F.lit(-1))["value"], F.lit(""))

    return F.coalesce(*map(of, names))


def to_json_ld(node: Column) -> Column:
    """JSON text of a node."""
    return F.to_json(node)


def meta_key(name: str, prefix: str = "", separator: str = ":", camel: bool = False) -> str:
    """Name of a meta tag for a field name: prefix, separator and the name, in camel case if wanted."""
    parts = name.split("_")
    text = parts[0] + "".join(p.capitalize() for p in parts[1:]) if camel else name
    return f"{prefix}{separator}{text}" if prefix else text

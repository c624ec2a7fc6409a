"""URL scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pressmill.functions.text import strip


def authority(url: Column) -> Column:
    """Host with port and user information, as written; "" where there is none, null for null."""
    return F.when(url.isNotNull(), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def host(url: Column) -> Column:
    """Host in lower case, without port and user information; null where there is none."""
    h = F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", "")
    return F.nullif(F.lower(h), F.lit(""))


def without_www(domain: Column) -> Column:
    return F.regexp_replace(domain, r"^www\.", "")


def normalize_url(url: Column) -> Column:
    """Stripped, with the scheme https where there is none."""
    s = strip(url)
    return F.when(s.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), s).when(s.startswith("//"), F.concat(F.lit("https:"), s)).otherwise(F.concat(F.lit("https:///"), s))


def normalize_http_url(url: Column) -> Column:
    """An http(s) URL with lower-case scheme and host, a slash after a bare host and no default port; null for others."""
    s = strip(url)
    scheme = F.lower(F.regexp_extract(s, r"^(?i)(https?)://", 1))
    at = F.lower(authority(s))
    at = F.when(scheme == "http", F.regexp_replace(at, ":80$", "")).otherwise(F.regexp_replace(at, ":443$", ""))
    rest = F.regexp_extract(s, r"^[A-Za-z]+://[^/?#]*(.*)$", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when((scheme != "") & (at != ""), F.concat(scheme, F.lit("://"), at, rest))


def fixture_path(url: Column, lang: Column) -> Column:
    """Where a fixture or config of a site is kept: language, first letter, domain."""
    domain = without_www(host(url))
    return F.concat_ws("/", lang, F.substring(domain, 1, 1), F.concat(domain, F.lit(".json")))

import hashlib
import hmac
import math
import re
import uuid

import pytest
from pyspark.sql import functions as F

from pressmill.functions import ids, text as T, urls as U

TEXTS = ["", " ", "a b", "Xin chào các bạn_1 2 x", "a\r\n\tb   c ", "　full width ", "naïve é 日本語 ١٢٣", "x" * 300_000, None, "\x1c\x85z\x1f"]


def values(spark, rows, *columns):
    kind = "string" if not rows or isinstance(rows[0], (str, type(None))) else None
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, t {kind or 'array<string>'}")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_counts(spark):
    t = F.col("t")
    got = values(spark, TEXTS, T.count_words(t), T.estimate_tokens(t), T.reading_minutes(T.count_words(t)))
    for text, (words, tokens, minutes) in zip(TEXTS, got):
        n = len(re.findall(r"\w+", text or ""))
        assert (words, tokens, minutes) == (n, math.ceil(n * 1.33), round(n / 220, 2))


def test_normalisation(spark):
    got = values(spark, TEXTS, T.normalize_content(F.col("t")), T.normalize_str(F.col("t")), T.strip(F.col("t")))
    for text, (content, string, stripped) in zip(TEXTS, got):
        s = text or ""
        assert content == re.sub(" {2,}", " ", re.sub(r"[\r\n\t]+", " ", s).replace(" ", " ")).strip()
        assert string == re.sub(" {2,}", " ", s).strip()
        assert stripped == (None if text is None else s.strip())


def test_lists(spark):
    assert values(spark, ["a, b\n\n c ,,home", None, " , "], T.split_list(F.col("t"), ("home",))) == [(["a", "b", "c"],), ([],), ([],)]
    assert values(spark, [["x  y", None, " "], None, []], T.normalize_list(F.col("t"))) == [(["x y"],), ([],), ([],)]


@pytest.mark.parametrize(
    ("text", "iso"),
    [
        ("2023-01-01T12:00:00Z", "2023-01-01 12:00:00"), ("2023-01-01T12:00:00.123456+0700", "2023-01-01 05:00:00.123456"), (" 2024-02-29 ", "2024-02-29 00:00:00"),
        ("2023-02-29", None), ("January 15, 2024", None), ("2024", None), ("2024-1-5", None), ("", None), (None, None), ("2023-01-01T25:00:00", None), ("2023-06-01 10:20", "2023-06-01 10:20:00"),
    ],
)
def test_datetimes(spark, text, iso):
    got = values(spark, [text], T.normalize_datetime(F.col("t")).cast("string"))
    assert got == [(iso,)]


def test_feed_dates_and_numbers(spark):
    assert values(spark, ["Tue, 02 Jan 2024 03:04:05 +0700", "2 Jan 2024 03:04:05 GMT", "x"], T.rfc822_datetime(F.col("t")).cast("string")) == [("2024-01-01 20:04:05",), ("2024-01-02 03:04:05",), (None,)]
    assert values(spark, ["12", "3.9", "x", None], T.to_number(F.col("t"))) == [(12,), (3,), (None,), (None,)]
    assert values(spark, ["a.WEBP?x.png", "b.png", "c.jpeg", "d"], T.image_type(F.col("t"))) == [("image/webp",), ("image/png",), ("image/jpeg",), (None,)]
    assert values(spark, ["7", "0.5", "x"], T.ttl_seconds(F.col("t"))) == [(604800,), (43200,), (None,)]


def test_names(spark):
    assert values(spark, ["publishedTime", "og-title", "HTMLText"], T.snake_case(F.col("t")), T.camel_case(F.col("t")), T.pascal_case(F.col("t"))) == [
        ("published_time", "publishedTime", "PublishedTime"), ("og_title", "ogTitle", "OgTitle"), ("html_text", "htmlText", "HtmlText"),
    ]


def test_ids(spark):
    urls = ["https://example.com/article/1", "https://ví.dụ/á?q=1#x", "", None]
    got = values(spark, urls, ids.uuid5(F.col("t")), ids.cache_key(F.col("t")), ids.cache_key(F.col("t"), "sha1"), ids.cache_key(F.col("t"), "sha256"), ids.cache_key(F.col("t"), "hmac", "key"), ids.cache_key(F.col("t"), "other"))
    for url, row in zip(urls, got):
        if url is None:
            assert row == (None,) * 6
            continue
        b = url.encode()
        assert row == (str(uuid.uuid5(uuid.NAMESPACE_URL, url)), hashlib.md5(b).hexdigest(), hashlib.sha1(b).hexdigest(), hashlib.sha256(b).hexdigest(), hmac.new(b"key", b, hashlib.sha256).hexdigest(), hashlib.md5(b).hexdigest())
    with pytest.raises(ValueError):
        ids.cache_key(F.col("t"), "hmac")
    assert values(spark, ["x"], ids.hmac_sha256(F.col("t"), "k" * 100)) == [(hmac.new(b"k" * 100, b"x", hashlib.sha256).hexdigest(),)]


def test_urls(spark):
    t = F.col("t")
    got = values(spark, ["HTTPS://User@WWW.Example.com:443/a?b#c", "http://x.example:80", "ftp://x/", "no url", None], U.authority(t), U.host(t), U.normalize_http_url(t))
    assert got == [("User@WWW.Example.com:443", "www.example.com", "https://user@www.example.com/a?b#c"), ("x.example:80", "x.example", "http://x.example/"), ("x", "x", None), ("", None, None), (None, None, None)]
    assert values(spark, ["https://www.b.example/x"], U.fixture_path(t, F.lit("en"))) == [("en/b/b.example.json",)]
    assert values(spark, [" a.b/c ", "//x/y", "mailto:a"], U.normalize_url(t)) == [("https:///a.b/c",), ("https://x/y",), ("mailto:a",)]

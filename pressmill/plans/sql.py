"""Functions for use in SQL text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.types import StringType

from pressmill.operators.chunking import fold_by_tokens
from pressmill.operators.discovery import sitemap_locs


def register(spark: SparkSession) -> list[str]:
    """Register SQL functions and table functions; returns their names.

    The scalar ones are SQL functions over built-in expressions, so the optimiser sees through them.
    """
    word = r"'[\\p{L}\\p{N}_]+'"
    sql = {
        "count_words": f"(t STRING) RETURNS INT RETURN coalesce(regexp_count(t, {word}), 0)",
        "estimate_tokens": f"(t STRING) RETURNS INT RETURN cast(ceil(coalesce(regexp_count(t, {word}), 0) * 1.33D) AS INT)",
        "article_id": "(u STRING) RETURNS STRING RETURN (SELECT concat(substr(h,1,8),'-',substr(h,9,4),'-5',substr(h,14,3),'-',"
        "lower(hex(cast(conv(substr(h,17,2),16,10) AS INT) & 63 | 128)),substr(h,19,2),'-',substr(h,21,12)) FROM "
        "(SELECT sha1(concat(unhex('6ba7b8119dad11d180b400c04fd430c8'), encode(u,'UTF-8'))) AS h))",
        "cache_key": "(u STRING) RETURNS STRING RETURN md5(u)",
    }
    for name, body in sql.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")

    @F.udtf(returnType="chunk_index: int, content: string")
    class ChunkByTokens:
        def eval(self, text: str, most: int, overlap: int):
            yield from enumerate(fold_by_tokens(text, most, overlap))

    @F.udtf(returnType="chunk_index: int, content: string")
    class ChunkByChar:
        def eval(self, text: str, size: int, overlap: int):
            step = size - overlap if size > overlap else size
            start = index = 0
            while text and start < len(text):
                end = min(len(text), start + size)
                piece = text[start:end].strip()
                if piece:
                    yield index, piece
                    index += 1
                start = start + step if end < len(text) else (end - overlap if end - overlap > start else end)

    @F.udtf(returnType="position: int, loc: string")
    class ParseSitemap:
        def eval(self, data: bytes):
            yield from enumerate(sitemap_locs(bytes(data) if data else None))

    tables = {"chunk_by_tokens": ChunkByTokens, "chunk_by_char": ChunkByChar, "parse_sitemap": ParseSitemap}
    for name, function in tables.items():
        spark.udtf.register(name, function)

    @F.pandas_udf(StringType())
    def markdown(pages: pd.Series) -> pd.Series:
        from pressmill.html.dom import parse
        from pressmill.html.markdown import to_markdown

        return pages.map(lambda p: to_markdown(parse(p)) if isinstance(p, str) else None)

    spark.udf.register("html_to_markdown", markdown)
    return [*sql, *tables, "html_to_markdown"]

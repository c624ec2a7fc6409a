"""Record schemas, and records as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CHUNK = "struct<index:int,content:string,char_length:int,word_count:int,token_estimate:int,embedding:array<float>,metadata:map<string,string>>"
AUTHOR = "struct<name:string,email:string,profile_url:string,affiliation:string>"
CRAWLER = "struct<crawler_name:string,user_agent:string,ip:string,fetch_duration_ms:int,fetch_status:int,fetched_at:timestamp>"
PROVENANCE = f"struct<source_url:string,domain:string,original_html_saved:boolean,snapshot_path:string,tls_ja3:string,crawler:{CRAWLER}>"
METADATA = (
    "struct<language:string,tags:array<string>,topics:array<string>,main_points:array<string>,canonical_url:string,word_count:int,reading_time_minutes:double,"
    "published_at:timestamp,modified_at:timestamp,inferred_source:string,schema_org:string>"
)
ARTICLE = (
    f"id string, title string, description string, content string, authors array<{AUTHOR}>, provenance {PROVENANCE}, metadata {METADATA}, "
    "license struct<license:string,restricted:boolean,copyright_holder:string>, raw_html string, "
    f"extraction struct<extractor:string,version:string,steps:array<string>,confidence:double>, chunks array<{CHUNK}>, embedding array<float>, vector_id string, "
    "quality struct<extraction_confidence:double,duplicate_score:double,content_quality:double,notes:string>, extras map<string,string>, created_at timestamp, updated_at timestamp"
)
PAGE = "page_id long, url string, domain string, raw_html string, fetched_at timestamp"
VECTOR_DOCUMENT = "id string, text string, meta struct<title:string,source_url:string,domain:string>"


def to_json(rows: DataFrame) -> DataFrame:
    """One column ``json`` with every row as JSON text; null fields are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def from_json(text: Column, schema: str = ARTICLE) -> Column:
    """A record of JSON text; null for what is no JSON object."""
    return F.from_json(text, schema)


def valid_article(article: Column) -> Column:
    """Whether a record has what an article needs: title, content, an address, and confidences within 0 and 1."""
    within = lambda c: c.isNull() | c.between(0.0, 1.0)
    return (
        article["title"].isNotNull() & (F.trim(F.coalesce(article["content"], F.lit(""))) != "") & article["provenance"]["source_url"].isNotNull()
        & within(article["extraction"]["confidence"]) & within(article["quality"]["extraction_confidence"]) & within(article["quality"]["content_quality"])
    )

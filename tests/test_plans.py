"""Plans have the shape they are meant to have."""

import os

import pytest

import __spark_entry__ as entry

TABLES = os.environ.get("PRESSMILL_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


def plan(spark, name):
    return entry.queries()[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_query_pairs_everything_with_everything(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(("name", "columns"), [("word_token_stats", "doc_id:bigint,text:string"), ("article_id_uuid5", "page_id:bigint,url:string"), ("config_join", "page_id:bigint,url:string"), ("vector_upsert_latest", "doc_id:bigint,id:string,batch_no:int")])
def test_scans_read_only_what_is_used(spark, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(spark, name)


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(fetched_at)" in plan(spark, "ttl_live_rows")


def test_top_k_sorts_no_table(spark):
    for name in ("vector_topk_cosine", "vector_topk_dot", "vector_topk_l2", "retrieval"):
        assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", ["word_token_stats", "normalize_content", "chunks_by_char", "article_id_uuid5", "http_urls", "chunks_by_tokens", "article_text_fallback", "page_markdown"])
def test_row_wise_queries_shuffle_nothing(spark, name):
    # few large files are dealt over the cores by key, which is the only exchange allowed
    text = plan(spark, name)
    assert text.count("Exchange") == text.count("REPARTITION_BY_NUM")

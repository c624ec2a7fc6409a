"""The queries pN_... and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressmill.llm.history import duplicates
from pressmill.llm.language import RUNNING_WORDS, fit_model, identify
from pressmill.llm.leakage import leaked
from pressmill.llm.mainbody import closing_heads, document_body, main_texts, page_body
from pressmill.llm.models import fitted
from pressmill.llm.packing import document_parts, fill_containers
from pressmill.llm.readability import reading_levels
from pressmill.llm.sitelines import find_repeated, Repeated, repeated_lines, without_lines
from pressmill.llm.splitting import items_of, split_items
from pressmill.llm.tokens import count_tokens, estimate_tokens, fit, FIT_DOCS, HOLDOUT_DOCS, load_counter, token_budget
from pressmill.sources.sites import load_sites
from pressmill.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that repeats an earlier one, paired with the first of its story; the smaller id comes first."""
    sites = load_sites(table(spark, sf_dir, "parser_configs"))
    documents = table(spark, sf_dir, "documents")
    found = duplicates(documents, sites, find_repeated(documents, sites).collect_keys())
    return found.select(F.least("doc_id", "head").alias("doc_id_a"), F.greatest("doc_id", "head").alias("doc_id_b"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = load_sites(table(spark, sf_dir, "parser_configs"))
    return repeated_lines(table(spark, sf_dir, "documents"), sites).select("doc_id", "line_no")


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without their sites' repeated lines."""
    sites = load_sites(table(spark, sf_dir, "parser_configs"))
    documents = table(spark, sf_dir, "documents")
    return without_lines(documents, sites, find_repeated(documents, sites).collect_keys())


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language (line_no -1), and every line in another one, with a confidence."""
    documents = table(spark, sf_dir, "documents")
    return identify(documents, fit_model(documents))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose label is missing or wrong (line_no -1), and lines of running text in another language."""
    documents = table(spark, sf_dir, "documents")
    found = identify(documents.where(F.char_length("text") >= 40), fit_model(documents))
    wrong = (F.col("line_no") == -1) & ~F.col("label_ok") & F.col("lang").isNotNull()
    foreign = (F.col("line_no") >= 0) & (F.col("n_words") >= RUNNING_WORDS)
    return found.where(wrong | foreign).select("doc_id", "line_no", "lang")


def _page_noise(spark: SparkSession, sf_dir: str) -> Repeated:
    """What is told of the rest of a page by counting: lines and leads repeated on a site, and headings over other stories."""
    found = find_repeated(table(spark, sf_dir, "documents"), load_sites(table(spark, sf_dir, "parser_configs"))).collect()
    return replace(found, heads=closing_heads(table(spark, sf_dir, "raw_pages")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages and documents that are not the article's own."""
    sites, noise = load_sites(table(spark, sf_dir, "parser_configs")), _page_noise(spark, sf_dir)
    blocks = page_body(table(spark, sf_dir, "raw_pages"), sites, noise, emit_own=False).unionByName(document_body(table(spark, sf_dir, "documents"), sites, noise, emit_own=False))
    return blocks.select("item_kind", "item_id", "block_md5").distinct()


def p7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article's own text of every page and document."""
    sites = load_sites(table(spark, sf_dir, "parser_configs"))
    return main_texts(table(spark, sf_dir, "raw_pages"), table(spark, sf_dir, "documents"), sites, _page_noise(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    levels = reading_levels(documents, table(spark, sf_dir, "level_labels"), fit_model(documents))
    return levels.select("doc_id", "reading_level")


def p2_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens by source, language and site."""
    documents = table(spark, sf_dir, "documents")
    model = fit_model(documents)
    vocab = table(spark, sf_dir, "vocab_pieces")
    weights = fitted("tokens", lambda: fit(documents, load_counter(vocab), model=model), documents, vocab, fit_docs=FIT_DOCS, holdout_docs=HOLDOUT_DOCS)
    return token_budget(estimate_tokens(documents, weights, model))


def p2_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), load_counter(table(spark, sf_dir, "vocab_pieces")), "doc_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that come out in more than one piece."""
    items = items_of(table(spark, sf_dir, "article_chunks"), table(spark, sf_dir, "documents"))
    return split_items(items, only_long=True).where("piece_no = 1").select("item_kind", "item_id")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(items_of(table(spark, sf_dir, "article_chunks"), table(spark, sf_dir, "documents")))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, or their parts, with the container each goes to."""
    return fill_containers(document_parts(table(spark, sf_dir, "documents"), load_counter(table(spark, sf_dir, "vocab_pieces"))))


def p6_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every item's pieces: the characters they cover without overlaps, whether each is within the limit and as
    its bounds say, whether consecutive ones share exactly the overlap, and whether none could be saved but for boundaries."""
    pieces = p6_pieces(spark, sf_dir)
    size, order = F.col("end") - F.col("start"), F.sort_array(F.collect_list(F.struct("start", "end")))
    made = pieces.groupBy("item_kind", "item_id").agg(
        F.max("end").alias("chars"), F.bool_and((size <= 2000) & (F.char_length("piece") == size)).alias("within"), order.alias("x"), F.min("start").alias("first"), F.count(F.lit(1)).alias("n")
    )
    linked = F.expr("first = 0 and forall(sequence(1, size(x)), i -> i = size(x) or x[i - 1].end - x[i].start = 200)")
    least = F.greatest(F.lit(1), F.ceil((F.col("chars") - 200) / 1800))
    return made.select("item_kind", "item_id", "chars", "within", linked.alias("linked"), (F.col("n") <= least * 2).alias("few"))


def p8_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every document in containers: its tokens there, whether it is split, and whether its containers are within their length."""
    packed = p8_containers(spark, sf_dir)
    sums = packed.groupBy("container_id").agg(F.sum("tokens").alias("sum"), F.first("container_tokens").alias("said"), F.first("capacity").alias("capacity"))
    good = sums.select("container_id", ((F.col("sum") == F.col("said")) & (F.col("sum") <= F.col("capacity")) & (F.col("capacity") <= 2048)).alias("good"))
    return packed.join(good, "container_id").groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), (F.count(F.lit(1)) > 1).alias("split"), F.bool_and("good").alias("good"))


_QUERIES = [p6_cover, p8_cover, p2_token_budget, p2_document_tokens, p3_found, p4_found, p4_clean, p5_found, p5_languages, p6_found, p6_pieces, p7_found, p7_main_text, p8_containers, p9_found, p10_found]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_LINES = """
    with d as (select doc_id, text, c.domain as site from documents d join parser_configs c on regexp_extract(lower(d.source_url), '://([^/?#:]*)', 1) = c.domain or suffix(regexp_extract(lower(d.source_url), '://([^/?#:]*)', 1), '.' || c.domain)),
    t as (select site, count(*) as total from d group by site),
    s as (select doc_id, site, string_split(text, chr(10)) as l from d where text is not null),
    u as (select doc_id, site, unnest(l) as line, generate_subscripts(l, 1) - 1 as line_no from s),
    k as (select *, regexp_replace(replace(lower(nfc_normalize(line)), 'ß', 'ss'), '[^\\p{L}]', '', 'g') as key from u),
    r as (select site, key from k join t using (site) where key <> '' group by site, key, total having count(distinct doc_id) >= 4 and count(distinct doc_id) >= 0.02 * total)"""


_TOKENS = r"""
with recursive w as (select doc_id, unnest(regexp_split_to_array(lower(text), '[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) as word from documents where text is not null),
v as (select piece, length(piece) as n from vocab_pieces where piece <> ''),
t(word, p, tokens) as (
  select distinct word, 1::BIGINT, 0::BIGINT from w where word <> ''
  union all
  select word, p + coalesce(max(v.n), 1), tokens + case when max(v.n) is null then octet_length(encode(substr(word, p, 1))) else 1 end
  from (select word, p, tokens, unnest(range(1, (select max(n) + 1 from v))) as n from t where p <= length(word)) x left join v on v.n = x.n and v.piece = substr(x.word, x.p, x.n)
  group by word, p, tokens),
c as (select word, tokens from t where p > length(word))
select d.doc_id, coalesce(sum(c.tokens), 0)::BIGINT as tokens from documents d left join w using (doc_id) left join c using (word) group by d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_document_tokens": _TOKENS,
        "p4_found": _LINES + " select doc_id, line_no::INT as line_no from k semi join r using (site, key)",
        "p4_clean": _LINES + """, m as (select k.*, r.key is not null as gone from k left join r using (site, key)),
            c as (select doc_id, string_agg(line, chr(10) order by line_no) filter (where not gone) as kept, count(*) filter (where gone) as removed from m group by doc_id)
            select doc_id, case when text is null then null when c.doc_id is null then text else coalesce(kept, '') end as text, coalesce(removed, 0)::INT as removed from documents left join c using (doc_id)""",
        "p8_cover": f"select doc_id, tokens, tokens > 2048 as split, true as good from ({_TOKENS}) where tokens > 0",
        "p6_cover": """
            select item_kind, item_id, length(t)::INT as chars, true as within, true as linked, true as few from (
              select 'chunk' as item_kind, chunk_id as item_id, content as t from article_chunks union all select 'document', doc_id, text from documents)
            where length(t) > 0""",
        "p6_found": """
            select 'chunk' as item_kind, chunk_id as item_id from article_chunks where length(content) > 2000
            union all
            select 'document', doc_id from documents where length(text) > 2000
        """,
    }

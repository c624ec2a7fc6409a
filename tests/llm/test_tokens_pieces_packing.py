import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pressmill.llm.packing import document_parts, fill_containers, pack, parts_of
from pressmill.llm.splitting import piece_bounds, split_items
from pressmill.llm.tokens import PieceCounter, count_tokens, estimate_tokens, fit, token_budget

PIECES = ["market", "mark", "et", "loan", "s", "a", "b", "c", "d", "e", "the", "ngân", "hàng"]
COUNTER = PieceCounter(PIECES)


def slow_count(text):
    total = 0
    for word in text.lower().split():
        while word:
            best = max((p for p in PIECES if word.startswith(p)), key=len, default=None)
            total += 1 if best else len(word[0].encode())
            word = word[len(best or word[0]) :]
    return total


@given(st.text(alphabet="abcdemrktlons ngânhà\n\té日😀", max_size=80))
def test_counts_equal_brute_force(text):
    assert COUNTER.count(text) == slow_count(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n日é́", max_size=900), st.integers(5, 60), st.integers(0, 4))
def test_pieces_round_trip(text, limit, overlap):
    bounds = piece_bounds(text, limit, overlap)
    assert all(0 < e - s <= limit for s, e in bounds)
    if len(text) <= limit:
        assert bounds == ([(0, len(text))] if text else [])
        return
    assert bounds[0][0] == 0 and bounds[-1][1] == len(text)
    assert all(b[0] == a[1] - overlap for a, b in zip(bounds, bounds[1:]))
    assert text[: bounds[0][1]] + "".join(text[s + overlap : e] for s, e in bounds[1:]) == text


def test_cuts_are_at_natural_places_and_pieces_balanced():
    rng = random.Random(1)
    paragraphs = [" ".join(" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(9)) + "." for _ in range(6)) for _ in range(30)]
    text = "\n\n".join(paragraphs)
    bounds = piece_bounds(text)
    assert len(bounds) == -(-(len(text) - 200) // 1800)
    assert all(text[e - 1] == "\n" for _, e in bounds[:-1])
    blank = piece_bounds("x" * 7001)
    assert len(blank) == 4 and max(e - s for s, e in blank) - min(e - s for s, e in blank) < 60
    with pytest.raises(ValueError):
        piece_bounds("x", 10, 10)


def test_split_items(spark):
    long = "word and word. " * 40_000
    rows = [("document", 1, "short"), ("document", 2, None), ("chunk", 3, ""), ("chunk", 4, long), ("chunk", 4, "y" * 2001), (None, None, "z" * 2500)]
    items = spark.createDataFrame([(*r, 7) for r in rows], "item_kind string, item_id long, text string, piece int")
    got = split_items(items).collect()
    assert {(r.item_kind, r.item_id) for r in got} == {("document", 1), ("chunk", 4), (None, None)}
    assert all(len(r.piece) <= 2000 and r.end - r.start == len(r.piece) for r in got)
    assert split_items(items, only_long=True).where("item_id = 1").count() == 0
    assert split_items(items.limit(0)).count() == 0


def documents(spark, n=300):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        words = [rng.choice(["market", "loans", "the", "abc", "ngân", "hàng", "日本", "2024", "Zeta,"]) for _ in range(rng.randrange(5, 120))]
        rows.append((i, " ".join(words), rng.choice(["en", "EN", "english", "vi-VN", None, "und"]), rng.choice(["A", "B", None]), rng.choice(["www.x.example", "x.example", None]), "https://m.x.example/a"))
    rows += [(n, None, "en", "A", None, None), (n + 1, "", "en", "A", None, "no url"), (n + 2, "market " * 50_000, "en", "B", "x.example", None)]
    return spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, lang string, source string, domain string, source_url string, tokens int")


def test_exact_counts(spark):
    docs = documents(spark)
    got = {r.doc_id: r.tokens for r in count_tokens(docs, COUNTER, "doc_id").collect()}
    assert got == {r.doc_id: COUNTER.count(r.text or "") for r in docs.collect()}
    assert count_tokens(docs.limit(0), COUNTER, "doc_id").count() == 0


def test_estimates_are_close_and_add_up(spark):
    docs = documents(spark, 1500).where("doc_id < 1500")
    estimates = estimate_tokens(docs, fit(docs, COUNTER, 700, 700))
    total = estimates.groupBy().sum("est_tokens").first()[0]
    exact = count_tokens(docs, COUNTER, "doc_id").groupBy().sum("tokens").first()[0]
    assert abs(total - exact) < 0.02 * exact
    budget = token_budget(estimates).collect()
    for dimension in ("source", "language", "site"):
        own = [r for r in budget if r.dimension == dimension]
        assert sum(r.documents for r in own) == 1500 and abs(sum(r.est_tokens for r in own) - total) <= len(own)
    assert {r.value for r in budget if r.dimension == "language"} == {"en", "vi", "und"}
    assert {r.value for r in budget if r.dimension == "site"} == {"x.example"}
    assert {r.value for r in budget if r.dimension == "source"} == {"A", "B", None}


def test_languages_of_the_text_over_those_of_labels(spark):
    from pressmill.llm.language import LanguageModel

    model = LanguageModel.fit([("market loans the abc", "en")] * 20 + [("ngân hàng chợ", "vi")] * 20)
    docs = spark.createDataFrame([(1, "the market", "vi"), (2, "ngân hàng", None), (3, "12", "fr"), (4, None, "en")], "doc_id long, text string, lang string").selectExpr("*", "'s' as source", "null as domain", "null as source_url", "'x' as label")
    got = {r.doc_id: (r.language, r.est_tokens > 0) for r in estimate_tokens(docs, fit(docs, COUNTER, model=model), model).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "vi", 3: "fr", 4: "en"} and not got[4][1]


def test_estimates_without_training_rows(spark):
    docs = documents(spark, 3).limit(0)
    assert token_budget(estimate_tokens(docs, fit(docs, COUNTER))).count() == 0


@given(st.lists(st.integers(1, 64), max_size=200))
def test_packing_holds_every_item_once(sizes):
    at, lengths = pack(np.array(sizes, np.int64), (16, 32, 64))
    assert len(at) == len(sizes)
    content = np.bincount(at, weights=sizes, minlength=len(lengths)) if sizes else np.zeros(0)
    assert all(c <= n for c, n in zip(content, lengths)) and all(c > 0 for c in content)
    assert all(n == min(x for x in (16, 32, 64) if x >= c) for c, n in zip(content, lengths))


def test_packing_leaves_little_space():
    sizes = np.random.default_rng(1).integers(5, 900, 5000)
    at, lengths = pack(sizes)
    assert sizes.sum() / lengths.sum() > 0.99


@settings(deadline=None)
@given(st.text(alphabet="abc market日\n ", max_size=400), st.integers(8, 40))
def test_parts_cover_the_text(text, capacity):
    parts = parts_of(text, COUNTER, capacity)
    assert all(0 < n <= capacity and COUNTER.count(text[s:e]) == n for s, e, n in parts)
    assert sum(n for *_, n in parts) == COUNTER.count(text)
    if parts:
        assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert len(parts) == 1 or COUNTER.count(text) > capacity


def test_containers(spark):
    docs = documents(spark)
    parts = document_parts(docs, COUNTER)
    rows = fill_containers(parts, shard_items=100).collect()
    assert sum(r.tokens for r in rows) == sum(COUNTER.count(r.text or "") for r in docs.collect())
    by = {}
    for r in rows:
        by.setdefault(r.container_id, []).append(r)
    for own in by.values():
        assert sum(r.tokens for r in own) == own[0].container_tokens <= own[0].capacity <= 2048
    assert len({(r.doc_id, r.part_no) for r in rows}) == len(rows)
    assert fill_containers(document_parts(docs.limit(0), COUNTER)).count() == 0

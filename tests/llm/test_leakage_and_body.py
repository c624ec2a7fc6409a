import random

import numpy as np
import pytest

from pressmill.llm.leakage import SeedIndex, align, leaked, words_of
from pressmill.llm.sitelines import find_repeated, lead_hash, Repeated
from pressmill.llm.mainbody import Block, closing_heads, document_body, main_texts, own_blocks, page_blocks, page_body
from pressmill.sources.sites import SiteRegistry

RNG = random.Random(11)
VOCABULARY = [a + b for a in ("kra", "lum", "vex", "tor", "pel", "qui", "dor", "mez") for b in ("sol", "gra", "nix", "ith", "hol", "vax", "jun", "ral", "bri")]


def text(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


PASSAGES = {i: text(60) for i in range(12)}


def changed(passage, every):
    words = passage.split()
    return " ".join("changed" if k % every == every - 1 else w for k, w in enumerate(words))


def cases():
    rows, want = [], set()
    for i, p in PASSAGES.items():
        half = " ".join(p.split()[10:42])
        for k, (inside, hit) in enumerate([(p, True), (p.upper().replace(" ", ",\n"), True), (changed(p, 8), True), (half, True), (" ".join(p.split()[20:38]), False)]):
            doc = i * 10 + k
            rows.append((doc, f"{text(40)}. {inside}. {text(40)}"))
            if hit:
                want.add((doc, i))
    rows += [(900, None), (901, ""), (902, text(30)), (903, text(200_000) + " " + PASSAGES[3]), (None, PASSAGES[4])]
    return rows, want | {(903, 3), (None, 4)}


def test_passages_are_found_edited_and_in_part(spark):
    rows, want = cases()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, item_id int, passage string")
    items = spark.createDataFrame([*PASSAGES.items(), (50, None), (51, ""), (52, "two words"), (53, PASSAGES[0])], "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leaked(docs, items).collect()}
    assert got == want | {(d, 53) for d, i in want if i == 0}
    assert leaked(docs, items.limit(0)).count() == 0 and leaked(docs.limit(0), items).count() == 0


def test_alignment_against_a_plain_table():
    rng = np.random.default_rng(3)
    for _ in range(40):
        p, t = rng.integers(0, 6, rng.integers(3, 15)), rng.integers(0, 6, rng.integers(3, 25))
        h = np.zeros((len(p) + 1, len(t) + 1), int)
        for i in range(1, len(p) + 1):
            for j in range(1, len(t) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if p[i - 1] == t[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        cover, equal = align(p, t)
        assert 0 <= cover <= 1 and 0 <= equal <= 1
        assert (h.max() == 0) == (cover == 0)
    assert align(np.arange(10), np.arange(10)) == (1.0, 1.0)


def test_words_and_common_trigrams():
    assert words_of("Ｈello, WORLD-13.1 日本") == ["hello", "world", "13", "1", "日", "本"]
    index = SeedIndex.build([(i, f"the same three words {text(20)}") for i in range(100)])
    assert not index.search("the same three words".split())


def test_variants_of_one_passage_keep_their_seeds():
    rng = random.Random(12)
    base = text(60, rng).split()
    variants = [" ".join(f"own{i}" if k == i else w for k, w in enumerate(base)) for i in range(20)]
    index = SeedIndex.build(list(enumerate(variants + [text(60, rng) for _ in range(40)])))
    half = " ".join(variants[7].split()[20:55])
    for inside in (variants[7], half, changed(variants[7], 8)):
        found = {i for p, *_ in index.search(f"{text(40, rng)} {inside} {text(40, rng)}".split()) for i in index.item_ids[p]}
        assert found == set(range(20))


SITES = SiteRegistry({"news.example": {"site_name": "News Herald"}})
OWN = ["The bank opened a new office in the valley on Monday morning", "The bank said that the office will serve all customers of the valley. It opened at noon.", "Outlook", "Nobody knows what comes next, said the mayor of the town. We will see."]
OTHER = ["Home | Markets | Opinion | Contact", "We use cookies on news.example to remember you.", "By Ann Bell, News Herald staff", "12 reads, 4 shares", "Tags: Alpha Bank, Beta Labs", "You may also like", "Another story about a loan that nobody repaid: Gamma", "reader77: I do not believe a word of it. Really.", "© News Herald. All rights reserved."]
ORDER = [OTHER[0], OTHER[1], OWN[0], OTHER[2], OTHER[3], OWN[1], OWN[2], OWN[3], *OTHER[4:]]


def kept(blocks, title=None):
    flags = own_blocks(blocks, [False] * len(blocks), ("news herald", "news.example"), title)
    return [b.text for b, own in zip(blocks, flags) if own]


def test_lines_of_a_document():
    assert kept([Block(x) for x in ORDER], OWN[0]) == OWN
    assert kept([Block(x) for x in ORDER]) == OWN
    assert kept([]) == []


def test_blocks_of_a_page():
    page = f"""<!doctype html><html><head><title>x</title><script>var a='<p>no</p>';</script></head><body><ul><li><a href=/>Home</a><li><a href=/m>Markets</a></ul>
    <div><h1>{OWN[0]}</h1><p>{OWN[1].replace('bank', '<b>bank</b>')}<p>{OWN[3].replace('We', '<a href="/x">W</a>e')}</div><!-- <p>hidden</p> -->
    <h3>You may also like</h3><p><a href=/y>Another story about a loan</a></p><style>p {{}}</style><footer>© News&nbsp;Herald &amp; Co</footer>"""
    blocks = page_blocks(page)
    assert [b.text for b in blocks] == ["Home", "Markets", OWN[0], OWN[1], OWN[3], "You may also like", "Another story about a loan", "© News Herald & Co"]
    assert blocks[0].link == 1.0 and blocks[3].link == 0.0 and 0 < blocks[4].link < 0.2
    assert kept(blocks) == [OWN[0], OWN[1], OWN[3]]


@pytest.mark.parametrize("page", ["", "<", "<p", "<!-- open", "<script>never closed", "plain", "</div></p>", "<body>"])
def test_broken_pages_do_no_harm(page):
    page_blocks(page)


def test_tables(spark):
    none = Repeated(np.zeros(0, np.uint64))
    pages = spark.createDataFrame([(1, "https://news.example/a", f"<body><h1>{OWN[0]}</h1><p>{OWN[1]}</p><p>© News Herald</p>"), (2, None, None), (3, "u", ""), (None, None, "<p>x</p>" * 20000)], "page_id long, url string, raw_html string").selectExpr("*", "'t' as title", "1 as block")
    rows = page_body(pages, SITES, none, keep_text=True).collect()
    assert [r.block for r in rows if r.item_id == 1 and not r.own] == ["© News Herald"]
    docs = spark.createDataFrame([(1, "https://www.news.example/a", "\r\n".join(ORDER), OWN[0]), (2, None, None, None), (3, "u", "", ""), (4, "u", "x " * 100_000, None)], "doc_id long, source_url string, text string, title string").selectExpr("*", "'u' as url")
    found = document_body(docs, SITES, none, keep_text=True).where("item_id = 1 and not own").collect()
    assert sorted(r.block for r in found) == sorted(OTHER)
    assert page_body(pages.limit(0), SITES, none).count() == 0
    texts = {(r.item_kind, r.item_id): (r.blocks, r.text) for r in main_texts(pages, docs, SITES, none).collect()}
    assert texts["document", 1] == (4, "\n".join(OWN)) and texts["page", 1] == (2, "\n".join(OWN[:2])) and texts["page", 3] == (0, "") and ("document", 2) not in texts


PARAGRAPH = "The council agreed on a new plan for the river road, after long talks with neighbours who had asked for a bridge since the floods. "


def test_notices_that_stand_once_are_outside_surge_and_dive():
    blocks = [Block("We use cookies to make this page work better for you."), *(Block(t, link=1) for t in ("Home", "News", "Sport")), Block(PARAGRAPH * 2), Block(PARAGRAPH * 3)]
    blocks += [*(Block(t, link=1) for t in ("12", "Next", "Top")), Block("This page was made with care in our small office by the sea.")]
    assert own_blocks(blocks, [False] * len(blocks), (), None) == [False] * 4 + [True] * 2 + [False] * 4
    # an advertisement between paragraphs does not end the text
    blocks = [Block(PARAGRAPH * 2), *(Block(t, link=1) for t in "abc"), Block(PARAGRAPH * 2), Block(PARAGRAPH)]
    assert own_blocks(blocks, [False] * 6, (), None) == [True] + [False] * 3 + [True] * 2


def test_leads_and_closing_heads_are_counted(spark):
    rows = [(i, "https://news.example/", f"{PARAGRAPH}{i} more words.\nTuhle quor: Story {'abcdefgh'[i]} of the day\nSay: once {i}" if i != 3 else PARAGRAPH) for i in range(8)]
    documents = spark.createDataFrame(rows, "doc_id long, source_url string, text string")
    found = find_repeated(documents, SITES).collect()
    assert lead_hash("tuhle QUOR: other") in found.leads.tolist() and lead_hash("Nothing: here") not in found.leads.tolist()
    pages = [(i, "https://news.example/", f"<h1>T</h1><p>{PARAGRAPH}</p><h2>Why {i}</h2><p>{PARAGRAPH}</p><h2>Next</h2><p>{PARAGRAPH}</p><h3>Zonk lim</h3><p>Teaser.</p>") for i in range(5)] + [(9, None, None), (10, None, "")]
    heads = closing_heads(spark.createDataFrame(pages, "page_id long, url string, raw_html string"))
    assert len(heads) == 1
    page = page_body(spark.createDataFrame(pages, "page_id long, url string, raw_html string"), SITES, Repeated(np.zeros(0, np.uint64), heads=heads), keep_text=True)
    assert {r.block for r in page.where("item_id = 1 and not own").collect()} == {"Zonk lim", "Teaser."}

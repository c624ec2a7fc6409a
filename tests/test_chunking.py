import random

import pytest
from pyspark.sql import functions as F

from pressmill.operators import chunking as C


def walk(text, size, overlap, until_blank=False):
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        piece = text[start:end].strip()
        if not piece and until_blank:
            break
        if piece:
            out.append(piece)
        following = end - overlap
        start = following if following > start else end
    return out


def texts():
    rng = random.Random(2)
    return ["", " ", "x", *("".join(rng.choice("ab cd. Eé日\n") for _ in range(n)) for n in (5, 17, 40, 41, 60, 99, 100)), " " * 30 + "x"]


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (10, 0), (7, 7), (5, 9), (1, 0), (200, 20)])
def test_windows_equal_a_walk(spark, size, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, t string")
    got = {r.i: r.c for r in df.select("i", C.char_chunks(F.col("t"), size, overlap).alias("c")).collect()}
    assert got == {i: walk(t, size, overlap) for i, t in enumerate(texts())}


def test_article_chunks(spark):
    rows = [(1, "Title here. body body body", "Title"), (2, None, "x"), (3, "ab" + " " * 40 + "cd", None), (4, "same", "same"), (5, "y" * 95, "")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "i int, content string, title string, text string, index int")
    got = {r.i: [c.content for c in r.chunks] for r in C.article_chunks(df, 20, 5).collect()}
    assert got == {1: walk("here. body body body", 20, 5, True), 2: [], 3: ["ab"], 4: [], 5: walk("y" * 95, 20, 5, True)}
    first = C.article_chunks(df, 20, 5).where("i = 1").first().chunks[0]
    assert (first["index"], first.char_length, first.word_count, first.token_estimate) == (0, 20, 4, 6)


def fold(text, most, overlap, split):
    """The same rules written with an explicit cut instead of a buffer."""
    text = (text or "").strip()
    items = C._GAP.split(text) if text else []
    chunks, led, own, tokens = [], [], [], 0
    for item in items:
        n = C.estimate(item)
        if split and n > most:
            if led or own:
                chunks.append(" ".join(led + own))
            led, own, tokens = [], [], 0
            w = max(1, int(most * len(item) / n))
            chunks.extend(item[k : k + w] for k in range(0, len(item), w))
            continue
        if (led or own) and tokens + n > most:
            chunks.append(" ".join(led + own))
            k = int(overlap / 1.33) if overlap > 0 else 0
            led = " ".join(led + own).split()[-k:] if k else []
            own, tokens = [], C.estimate(" ".join(led))
        own.append(item)
        tokens += n
    if led or own:
        chunks.append(" ".join(led + own))
    return [c.strip() if not split else c for c in chunks if c.strip()]


@pytest.mark.parametrize("split", [False, True])
def test_token_chunks(spark, split):
    rng = random.Random(5)
    many = [" ".join(" ".join(rng.choice(["Alpha", "beta", "gamma,", "1"]) for _ in range(rng.randrange(1, 30))) + rng.choice([". ", "? ", " ", "! "]) for _ in range(20)) for _ in range(15)]
    rows = [*many, None, "", "   ", "One. Two? \"Three\" four. Étion is no start.", "word " * 500]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "k long, body string, index int")
    got = {}
    for r in C.token_chunks(df, "k", "body", 30, 8, split_oversize=split).orderBy("k", "index").collect():
        got.setdefault(r.k, []).append(r.content)
    assert got == {i: c for i, t in enumerate(rows) if (c := fold(t, 30, 8, split))}
    assert C.fold_by_tokens("a b c d", 2, 0, by_sentence=False) == ["a", "b", "c", "d"]


def test_sentences(spark):
    text = 'He said. "No" way? 5 times! yes. Étion waits. “Well”'
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.sentences(F.col("t"))).first()[0] == C._GAP.split(text)

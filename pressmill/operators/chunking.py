"""Chunking: sliding character windows as expressions, and folds over sentences by estimated tokens."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressmill.functions.text import SENTENCE_GAP, TOKENS_PER_WORD, count_words, strip, tokens_of_words
from pressmill.session import spread

CHUNK = "struct<index:int,content:string,char_length:int,word_count:int,token_estimate:int>"
_WORD = re.compile(r"\w+")
_GAP = re.compile("(?<=[.?!])\\s+(?=[A-Z0-9\"'“‘])")


def window_starts(length: Column, size: int, overlap: int) -> Column:
    """Starts of the windows over ``length`` characters; an empty array for 0.

    A window ends ``overlap`` characters after the next one's start; when the last full window leaves less than the
    overlap, the walk still makes one step to the last ``overlap`` characters.
    """
    step = size - overlap if size > overlap else size
    last = F.when(length <= size, F.lit(0)).otherwise(F.ceil((length - size) / F.lit(float(step))).cast("int"))
    starts = F.transform(F.sequence(F.lit(0), last), lambda k: (k * F.lit(step)).cast("int"))
    tail = (length - F.lit(overlap)).cast("int")
    extra = F.when((F.lit(overlap) > 0) & (tail > last * F.lit(step)), F.array(tail)).otherwise(F.array().cast("array<int>"))
    return F.when(length > 0, F.concat(starts, extra)).otherwise(F.array().cast("array<int>"))


def _window(text: Column, start: Column, size: int) -> Column:
    return strip(text.substr(start + F.lit(1), F.lit(size)))


def char_chunks(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Array of stripped windows without blank ones. ``text`` should be a plain column: it is read once a window."""
    return F.filter(_windows(text, size, overlap), lambda c: c != "")


def _windows(text: Column, size: int, overlap: int) -> Column:
    return F.transform(window_starts(F.char_length(text), size, overlap), lambda s: _window(text, s, size))


def article_chunks(rows: DataFrame, size: int = 2000, overlap: int = 200, content: str = "content", title: str = "title") -> DataFrame:
    """rows with ``chunks``: windows over the content, its own title cut off the front; the first blank window ends the walk.

    Each step is a column of its own, so that no text is prepared more than once.
    """
    text, head = strip(F.coalesce(F.col(content), F.lit(""))), F.col(title)
    leads = head.isNotNull() & (head != "") & F.startswith(F.col("_text"), head)
    cut = F.when(leads, strip(F.col("_text").substr(F.char_length(head) + F.lit(1), F.char_length(F.col("_text"))))).otherwise(F.col("_text"))
    stepped = rows.withColumn("_text", text).withColumn("_text", cut).withColumn("_all", _windows(F.col("_text"), size, overlap))
    blank = F.array_position("_all", F.lit(""))
    pieces = F.when(blank > 0, F.slice(F.col("_all"), F.lit(1), (blank - 1).cast("int"))).otherwise(F.col("_all"))
    return stepped.withColumn("_all", pieces).withColumn("chunks", describe(F.col("_all"))).drop("_text", "_all")


def describe(pieces: Column) -> Column:
    """Chunk structs of an array of texts, numbered from 0."""
    counted = F.transform(pieces, lambda c: F.struct(c.alias("c"), count_words(c).alias("n")))
    return F.transform(
        counted,
        lambda x, i: F.struct(
            i.cast("int").alias("index"), x["c"].alias("content"), F.char_length(x["c"]).alias("char_length"), x["n"].alias("word_count"), tokens_of_words(x["n"]).alias("token_estimate")
        ),
    )


def explode_chunks(rows: DataFrame, chunks: Column) -> DataFrame:
    """One row per chunk beside the columns of ``rows``.

    The outer form is filtered afterwards: for the inner one the optimiser would infer a filter on the array's size and
    push it, with all that makes the array, below every projection, so each text would be chunked twice.
    """
    return rows.select("*", F.inline_outer(chunks)).where(F.col("index").isNotNull())


def sentences(text: Column) -> Column:
    """Sentences of a stripped text."""
    return F.split(strip(text), SENTENCE_GAP)


def estimate(text: str) -> int:
    n = len(_WORD.findall(text)) if text else 0
    return math.ceil(n * TOKENS_PER_WORD) if n else 0


def fold_by_tokens(text: str | None, most: int = 800, overlap: int = 64, by_sentence: bool = True, split_oversize: bool = False) -> list[str]:
    """Sentences (or words) gathered up to ``most`` estimated tokens, each next chunk led by the last words of the one before.

    An item above ``most`` stays whole, or with ``split_oversize`` is cut by characters without overlap.
    """
    text = (text or "").strip()
    if not text:
        return []
    carried = int(overlap / TOKENS_PER_WORD) if overlap > 0 else 0
    chunks: list[str] = []
    held: list[str] = []
    tokens = 0
    for item in _GAP.split(text) if by_sentence else text.split():
        n = estimate(item)
        if split_oversize and n > most:
            chunks += [joined] if (joined := " ".join(held).strip()) else []
            held, tokens = [], 0
            width = max(1, int(most * len(item) / n))
            chunks += [item[k : k + width] for k in range(0, len(item), width)]
            continue
        if held and tokens + n > most:
            chunks += [joined] if (joined := " ".join(held).strip()) else []
            held = " ".join(held).split()[-carried:] if carried else []
            tokens = estimate(" ".join(held))
        held.append(item)
        tokens += n
    chunks += [joined] if (joined := " ".join(held).strip()) else []
    return chunks


def token_chunks(rows: DataFrame, key: str, text: str, most: int = 800, overlap: int = 64, by_sentence: bool = True, split_oversize: bool = False) -> DataFrame:
    """One row per chunk: the key, index, content, char_length, word_count and token_estimate.

    Null and blank texts have no chunk. Rows move nowhere.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, index, content = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                pieces = fold_by_tokens(t, most, overlap, by_sentence, split_oversize)
                keys += [i] * len(pieces)
                index += range(len(pieces))
                content += pieces
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int32())), pa.array(index, pa.int32()), pa.array(content, pa.string())], ["key", "index", "content"])

    made = spread(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), "key").mapInArrow(run, f"key {kind}, index int, content string")
    counted = made.withColumn("word_count", count_words(F.col("content")))
    return counted.select(F.col("key").alias(key), "index", "content", F.char_length("content").alias("char_length"), "word_count", tokens_of_words(F.col("word_count")).alias("token_estimate"))

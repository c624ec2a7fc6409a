"""Splitting oversized items at natural boundaries (problem 6).

The least number of pieces that can hold a text gives equal-length targets. Each target moves to the nearest boundary
of the strongest kind in reach: end of a paragraph, of a line, of a sentence, of a word; where there is none, it
moves off the middle of a composed character. If a piece then breaks the limit, one piece is added and the targets are
set anew. Consecutive pieces share exactly ``overlap`` characters, so cutting these off gives back the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressmill.llm.lettering import slices, small_batches
from pressmill.session import spread

LIMIT, OVERLAP = 2000, 200
#: How far a target may move, as a share of the room a piece has beside its overlap.
REACH = 0.25

# strongest first; a boundary is where the match ends
_BOUNDARIES = [
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"[.?!…][\"'”’»)\]]*\s+|[。！？]+[」』）]*"),
    re.compile(r"\s+|[、，；｜]"),
]


def _boundary(text: str, low: int, target: int, high: int) -> int:
    """The best place to cut in [low, high], near the target."""
    window = text[max(0, low - 1) : high]
    base = max(0, low - 1)
    for kind in _BOUNDARIES:
        best = None
        for m in kind.finditer(window):
            at = base + m.end()
            if low <= at <= high and (best is None or abs(at - target) < abs(best - target)):
                best = at
        if best is not None:
            return best
    at = target
    while at > low and at < len(text) and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at


def piece_bounds(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Starts and ends of the pieces of a text, in characters; one piece for a text within the limit, none for an empty one."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    count = -(-(n - overlap) // (limit - overlap))
    while True:
        out = _bounds(text, n, count, limit, overlap)
        if out is not None:
            return out
        count += 1


def _bounds(text: str, n: int, count: int, limit: int, overlap: int) -> list[tuple[int, int]] | None:
    step = (n - overlap) / count
    reach = max(1, int(REACH * min(step, limit - overlap)))
    start, out = 0, []
    for k in range(1, count):
        target = min(round(overlap + k * step), start + limit)
        low, high = max(start + overlap + 1, target - reach), min(start + limit, target + reach, n - 1)
        if low > high:
            return None
        end = _boundary(text, low, min(max(target, low), high), high)
        out.append((start, end))
        start = end - overlap
    if n - start > limit:
        return None
    return [*out, (start, n)]


SCHEMA = "item_kind string, item_id long, piece_no int, start int, end int, piece string"


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, only_long: bool = False) -> DataFrame:
    """One row per piece: item_kind, item_id, piece_no from 0, start and end in the item, and the piece.

    items has item_kind, item_id and text. Null and empty texts have no pieces; an item within the limit is one piece
    and is left out with ``only_long``. Items move nowhere: the operator is one narrow stage.
    """
    long = F.char_length("text") > limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            kinds, ids, texts = (batch.column(c).to_pylist() for c in ("item_kind", "item_id", "text"))
            for a, b in slices([len(t) for t in texts]):
                rows = [(kinds[i], ids[i], k, s, e, texts[i][s:e]) for i in range(a, b) for k, (s, e) in enumerate(piece_bounds(texts[i], limit, overlap))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(_TYPES)], _NAMES)

    pieces = spread(items.where(long).select("item_kind", F.col("item_id").cast("long").alias("item_id"), "text"), "item_id").mapInArrow(run, SCHEMA)
    if only_long:
        return pieces
    whole = items.where(~long & (F.char_length("text") > 0))
    zero: Column = F.lit(0)
    return pieces.unionByName(whole.select("item_kind", F.col("item_id").cast("long"), zero.alias("piece_no"), zero.alias("start"), F.char_length("text").alias("end"), F.col("text").alias("piece")))


_NAMES = ["item_kind", "item_id", "piece_no", "start", "end", "piece"]
_TYPES = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())


def items_of(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk contents and document texts as items."""
    return chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.col("content").alias("text")).unionByName(
        documents.select(F.lit("document").alias("item_kind"), F.col("doc_id").alias("item_id"), "text")
    )

"""Evaluation passages inside training documents (problem 9).

Passages are cut into word trigrams. Trigrams that stand in many passages say little and are dropped; the rare ones
are seeds. Rare is told over all passages. Variants of one passage have few rare trigrams: a passage that would be left
with less than ``LEAST_RARE`` of its trigrams keeps them all. A document with enough seeds of one passage in reach of each other is aligned with the passage by
Smith-Waterman over words, which bridges changed, missing and added words.

The passages are a stated query set: they are bounded by ``MAX_ITEMS`` and go to every task. Documents never move: the
whole search is one narrow stage.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pressmill.llm.lettering import slices, small_batches
from pressmill.session import spread

#: Most test items held in memory; more are refused.
MAX_ITEMS = 200_000
GRAM = 3
#: A trigram in more than this share of the passages (and in more than three) is no seed.
COMMON_SHARE = 0.05
#: Least share of a passage's trigrams that must be left, for half the passage with every eighth word changed to show
#: enough seeds wherever it is cut.
LEAST_RARE = 0.85
#: Seeds of one passage that a stretch of a document must show before it is aligned: this many, and this share of its
#: words. Half a passage with every eighth word changed still shows a quarter.
MIN_SEEDS, SEED_SHARE = 3, 0.1
#: Stretches longer than this many passages are aligned in windows of that length which overlap by two passages.
LONGEST = 6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of a passage's words that the aligned stretch covers, and of the stretch's words that are equal.
MIN_COVER, MIN_EQUAL = 0.5, 0.75

_WORD = re.compile(r"[぀-ヿ一-鿿]|[^\W_぀-ヿ一-鿿]+")


def words_of(text: str) -> list[str]:
    """Words without case, punctuation and compatibility differences; of scripts without blanks, single letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.casefold())


@dataclass
class SeedIndex:
    """Passages: their words as numbers, and their seeds in sorted order."""

    vocabulary: dict[str, int]
    passages: list[np.ndarray]
    item_ids: list[list[int]]  # of each distinct passage
    seed_codes: np.ndarray
    seed_passage: np.ndarray
    seed_at: np.ndarray

    @staticmethod
    def build(items: list[tuple[int, str]]) -> SeedIndex:
        """Passages with the same words are one; those without words, or under three, are left out."""
        vocabulary: dict[str, int] = {}
        groups: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item_id, passage in items:
            ids = tuple(vocabulary.setdefault(w, len(vocabulary)) for w in words_of(passage or ""))
            if len(ids) >= GRAM:
                groups[ids].append(item_id)
        passages = [np.array(k, np.int64) for k in groups]
        codes, owner, at = [], [], []
        for i, p in enumerate(passages):
            c = gram_codes(p, len(vocabulary))
            codes.append(c)
            owner.append(np.full(len(c), i))
            at.append(np.arange(len(c)))
        none = np.zeros(0, np.int64)
        code, own, pos = (np.concatenate(x) if x else none for x in (codes, owner, at))
        order = np.argsort(code, kind="stable")
        code, own, pos = code[order], own[order], pos[order]
        if len(code):
            distinct = np.unique(np.stack((code, own)), axis=1)[0]
            value, n = np.unique(distinct, return_counts=True)
            common = value[n > max(3, COMMON_SHARE * len(passages))]
            keep = ~np.isin(code, common)
            left, whole = (np.bincount(x, minlength=len(passages)) for x in (own[keep], own))
            keep |= (left < LEAST_RARE * whole)[own]
            code, own, pos = code[keep], own[keep], pos[keep]
        return SeedIndex(vocabulary, passages, list(groups.values()), code, own, pos)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Passages with enough seeds in a text of word numbers (-1: no word of any passage), with the places of the seeds."""
        if len(ids) < GRAM or not len(self.seed_codes):
            return
        codes = gram_codes(ids, len(self.vocabulary))
        low = np.searchsorted(self.seed_codes, codes, "left")
        found = np.flatnonzero((low < len(self.seed_codes)) & (codes >= 0))
        found = found[self.seed_codes[low[found]] == codes[found]]
        if not len(found):
            return
        high = np.searchsorted(self.seed_codes, codes[found], "right")
        by: dict[int, list[int]] = defaultdict(list)
        for at, a, b in zip(found.tolist(), low[found].tolist(), high.tolist()):
            for p in self.seed_passage[a:b].tolist():
                by[p].append(at)
        for p, places in by.items():
            if len(places) >= seeds_needed(len(self.passages[p])):
                yield p, np.array(places)

    def search(self, words: list[str]) -> list[tuple[int, float, float]]:
        """(passage, share of it covered, share of equal words) of the passages found in a text's words."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        out = []
        for p, places in self.hits(ids):
            passage = self.passages[p]
            best = (0.0, 0.0)
            for a, b in stretches(places, len(passage)):
                low, high, n = max(0, a - len(passage)), b + len(passage) + GRAM, len(passage)
                for start in range(low, max(low + 1, high - 2 * n), (LONGEST - 2) * n):
                    cover, equal = align(passage, ids[start : min(high, start + LONGEST * n)])
                    if equal >= MIN_EQUAL:
                        best = max(best, (cover, equal))
            if best[0] >= MIN_COVER:
                out.append((p, *best))
        return out


def seeds_needed(n: int) -> float:
    """Seeds that a stretch must show for a passage of ``n`` words; of a short one, those its half can have."""
    return max(1, min(MIN_SEEDS, n // 2 - GRAM + 1), SEED_SHARE * n)


def gram_codes(ids: np.ndarray, size: int) -> np.ndarray:
    """Trigrams of word numbers as single numbers; negative where a word is unknown."""
    if len(ids) < GRAM:
        return np.zeros(0, np.int64)
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    return np.where((a < 0) | (b < 0) | (c < 0), -1, (a * size + b) * size + c)


def stretches(places: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Ranges of places no further apart than half a passage is long, with enough seeds each."""
    cut = np.flatnonzero(np.diff(places) > reach / 2) + 1
    return [(int(x[0]), int(x[-1])) for x in np.split(places, cut) if len(x) >= seeds_needed(reach)]


def align(passage: np.ndarray, text: np.ndarray) -> tuple[float, float]:
    """Smith-Waterman: share of the passage in the best local alignment, and share of equal words in it."""
    n, m = len(passage), len(text)
    table = np.zeros((n + 1, m + 1), np.int32)
    steps = np.arange(m) * GAP
    for i in range(1, n + 1):
        equal = np.where(text == passage[i - 1], MATCH, MISMATCH)
        row = np.maximum(np.maximum(table[i - 1, :-1] + equal, table[i - 1, 1:] + GAP), 0)
        table[i, 1:] = np.maximum(np.maximum.accumulate(row - steps) + steps, 0)
    i, j = np.unravel_index(table.argmax(), table.shape)
    i, j = int(i), int(j)
    end, same = i, 0
    while i and j and table[i, j] > 0:
        hit = text[j - 1] == passage[i - 1]
        if table[i, j] == table[i - 1, j - 1] + (MATCH if hit else MISMATCH):
            same += int(hit)
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    span = end - i
    return (span / n, same / span) if span else (0.0, 0.0)


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, cover, equal): one row per document and item whose passage stands in it to one half at least.

    documents needs doc_id and text, items item_id and passage. Null and empty texts and passages match nothing; items
    with the same passage come out each. An empty table of either kind gives no rows.
    """
    rows = items.select("item_id", "passage").where("passage is not null").limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} test items: split them into several runs")
    every = sorted((r["item_id"], r["passage"]) for r in rows)
    shared = documents.sparkSession.sparkContext.broadcast(SeedIndex.build(every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices([len(t) for t in texts]):
                found = []
                for doc_id, text in zip(ids[a:b], texts[a:b]):
                    words = words_of(text)
                    for p, cover, equal in shared.value.search(words):
                        found += [(doc_id, item, cover, equal) for item in shared.value.item_ids[p]]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["doc_id", "item_id", "cover", "equal"])

    return spread(documents.select("doc_id", "text").where("text is not null"), "doc_id").mapInArrow(run, "doc_id long, item_id long, cover double, equal double")

"""Vectorised letter streams: texts as arrays of folded letters, hashed by line and by content-defined chunk.

Case, blanks, punctuation, symbols and digits are dropped, canonically equivalent spellings fall together, and line
feeds are kept as line ends.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LINE_END = 1
_TOP = 0x30000
#: Letters in the window of the rolling hash, and the bits of it that must be zero where a chunk ends.
WINDOW, CUT_BITS = 12, 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Characters handled at once; bounds the memory of a batch.
SLICE_CHARS = 600_000
SLICE_BYTES = 1_000_000


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point -> folded letter; 0 for all that is no letter, 1 for a line feed."""
    table = np.zeros(_TOP + 1, np.uint32)
    for i in range(_TOP):
        c = chr(i)
        if c.isalpha():
            low = unicodedata.normalize("NFKC", c).lower()
            table[i] = ord(low) if len(low) == 1 else i
    table[10] = LINE_END
    return table


@lru_cache(maxsize=1)
def mix_table() -> np.ndarray:
    """Folded letter -> 64 random-looking bits, fixed for all runs."""
    with np.errstate(over="ignore"):
        x = np.arange(_TOP + 1, dtype=np.uint64) * _ODD + np.uint64(0x632BE59BD9B4E019)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 4096) * 2, _ODD, np.uint64))))
    return _POWERS


def composed(text: str) -> str:
    """NFC; the number of lines stays."""
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def canonical(text: str) -> str:
    """NFC, and sharp s as two letters, so that upper-cased lines meet their originals."""
    text = composed(text)
    return text if text.isascii() or "ß" not in text else text.replace("ß", "ss")


def slices(sizes: list[int], most: int = SLICE_CHARS):
    """Ranges of consecutive rows with about ``most`` characters each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes of text, so that a worker holds few texts as objects at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for a, b in slices(sizes, most):
            yield batch.slice(a, b - a)


@dataclass
class Letters:
    """Lines of several texts. Only lines with a letter have an entry in the ``line_*`` arrays."""

    line_doc: np.ndarray  # which text
    line_no: np.ndarray  # number of the line in its text
    line_hash: np.ndarray  # uint64
    line_len: np.ndarray  # letters
    chunk_start: np.ndarray  # first chunk of each line, one more entry at the end
    chunk_hash: np.ndarray  # uint64


def letters_of(texts: list[str], chunks: bool = True) -> Letters:
    """Hash the lines, and their content-defined chunks, of a few texts at once."""
    joined = "\n".join([canonical(t) for t in texts])
    codes = fold_table()[np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), _TOP)]
    ends = codes == LINE_END
    per_text = np.array([t.count("\n") + 1 for t in texts], np.int64)
    first_line = np.concatenate(([0], np.cumsum(per_text)))
    line_at = np.cumsum(ends)
    keep = codes > LINE_END
    codes, line_at = codes[keep], line_at[keep]
    if not len(codes):
        none = np.zeros(0, np.int64)
        return Letters(none, none, none.astype(np.uint64), none, np.zeros(1, np.int64), none.astype(np.uint64))
    fresh = np.concatenate(([True], line_at[1:] != line_at[:-1]))
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, len(codes)))
    at = np.arange(len(codes)) - np.repeat(start, size)
    mixed = mix_table()[codes]
    with np.errstate(over="ignore"):
        line_hash = np.add.reduceat(mixed * powers(int(size.max()) + 1)[at], start)
        line = line_at[start]
        doc = np.searchsorted(first_line, line, "right") - 1
        if chunks:
            roll = np.zeros(len(codes), np.uint64)
            for k in range(min(WINDOW, len(mixed))):
                roll[k:] += mixed[: len(mixed) - k] << np.uint64(k)
            cut = ((roll >> np.uint64(WINDOW + 8)) & np.uint64((1 << CUT_BITS) - 1) == 0) & (at >= WINDOW)
            begins = fresh.copy()
            begins[1:] |= cut[:-1]
            c_start = np.flatnonzero(begins)
            c_size = np.diff(np.append(c_start, len(codes)))
            c_at = np.arange(len(codes)) - np.repeat(c_start, c_size)
            chunk_hash = np.add.reduceat(mixed * powers(int(c_size.max()) + 1)[c_at], c_start)
            chunk_start = np.append(np.searchsorted(c_start, start), len(c_start))
        else:
            chunk_start, chunk_hash = np.zeros(len(start) + 1, np.int64), np.zeros(0, np.uint64)
    return Letters(doc, line - first_line[doc], line_hash, size, chunk_start, chunk_hash)

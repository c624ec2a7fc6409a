"""Filling fixed-capacity containers with documents (problem 8).

Documents are counted exactly; one larger than a container is first cut into parts at word ends, inside a word only
where the word alone is too large. Parts are dealt by hash to shards of about ``SHARD_ITEMS`` and every shard is
packed on its own, largest first: into the open container with the least sufficient room, or else into a new one. All
permitted lengths are weighed for that one together: each is filled, on trial, with the largest items still to come that
fit, and the length that costs least for each token it would hold is opened. A long container is worth its price only if
its room can be filled. In the end every container shrinks to the least permitted length that holds its content. A shard's waste is a few containers whatever its size, so sharding
costs next to nothing, and no task ever holds more than a shard of numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressmill.llm.lettering import slices, small_batches
from pressmill.llm.tokens import PieceCounter
from pressmill.session import materialize, spread

CAPACITY = 2048
#: Permitted lengths of a container; the greatest is the capacity.
LENGTHS = (256, 512, 1024, CAPACITY)
#: Price of opening a container, in tokens, and of every token of its length that is to be attended by all others: a
#: container costs OPENING + length * (1 + length / ATTENDED).
OPENING, ATTENDED = 4, 2_000_000
SHARD_ITEMS = 50_000

_WORD = re.compile(r"\S+")


def parts_of(text: str, counter: PieceCounter, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the parts of a text, in characters; one part if it fits, none if it has no tokens."""
    total = counter.count(text)
    if total <= capacity:
        return [(0, len(text), total)] if total else []
    out, start, used = [], 0, 0
    for m in _WORD.finditer(text):
        n = counter.count(m.group())
        if used + n <= capacity:
            used += n
            continue
        if used:
            out.append((start, m.start(), used))
            start, used = m.start(), 0
        if n <= capacity:
            used = n
            continue
        at = m.start()
        low = m.group().lower()
        steps = counter.word_pieces(low) if len(low) == len(m.group()) else [(1, counter.count(c)) for c in m.group()]
        for chars, tokens in steps:
            if used + tokens > capacity:
                out.append((start, at, used))
                start, used = at, 0
            at += chars
            used += tokens
    if used:
        out.append((start, len(text), used))
    return out


PARTS = "doc_id long, part_no int, start int, end int, tokens int"


def document_parts(documents: DataFrame, counter: PieceCounter, capacity: int = CAPACITY) -> DataFrame:
    """One row per part: doc_id, part_no, start, end, tokens. Null and empty texts have no part."""
    shared = documents.sparkSession.sparkContext.broadcast(counter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small_batches(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices([len(t) for t in texts]):
                rows = [(ids[i], k, *p) for i in range(a, b) for k, p in enumerate(parts_of(texts[i], own, capacity))]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["doc_id", "part_no", "start", "end", "tokens"])

    return spread(documents.where("text is not null").select("doc_id", "text"), "doc_id").mapInArrow(run, PARTS)


def _expected(size: int, length: int, left: int, counts: np.ndarray) -> int:
    """Tokens in a container of a length opened for an item, filled with the largest items left that fit; bit s of left: some item of size s is left."""
    room, taken = length - size, {}
    while room:
        fits = left & ((2 << room) - 1)
        while fits:
            s = fits.bit_length() - 1
            n = min(room // s, int(counts[s]) - taken.get(s, 0))
            if n:
                break
            fits &= ~(1 << s)
        else:
            break
        taken[s] = taken.get(s, 0) + n
        room -= n * s
    return length - room


def _price(length: int) -> float:
    return OPENING + length * (1 + length / ATTENDED)


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item, and the length of each container. Every size must be within the greatest length."""
    lengths = tuple(sorted(lengths))
    order = np.argsort(-sizes, kind="stable")
    counts = np.bincount(sizes, minlength=lengths[-1] + 1)  # items left by size
    left = 0
    for s in np.flatnonzero(counts).tolist():
        left |= 1 << s
    bins: list[int] = []  # length, then room left
    room: list[int] = []
    by_room: dict[int, list[int]] = {}
    present = 0  # bit r: some open container has room r
    out = np.empty(len(sizes), np.int64)
    for i in order.tolist():
        size = int(sizes[i])
        counts[size] -= 1
        if not counts[size]:
            left &= ~(1 << size)
        fitting = present >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            at = by_room[r].pop()
            if not by_room[r]:
                present &= ~(1 << r)
        else:
            length = min((x for x in lengths if x >= size), key=lambda x: (_price(x) / _expected(size, x, left, counts), x))
            at = len(bins)
            bins.append(length)
            room.append(length)
            r = length
        r -= size
        room[at] = r
        if r:
            by_room.setdefault(r, []).append(at)
            present |= 1 << r
        out[i] = at
    content = np.array(bins, np.int64) - np.array(room, np.int64)
    ladder = np.array(lengths, np.int64)
    return out, ladder[np.searchsorted(ladder, content)] if len(bins) else content


PACKED = "doc_id long, part_no int, start int, end int, tokens int, container_id long, capacity int, container_tokens int"


def fill_containers(parts: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """parts with container_id, the container's capacity and its tokens. Parts above the greatest length raise an error."""
    parts = materialize(parts, "parts")
    shards = max(1, -(-parts.count() // shard_items))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(shards)))

    def run(group: pa.Table) -> pa.Table:
        sizes = group.column("tokens").to_numpy().astype(np.int64)
        if len(sizes) and int(sizes.max()) > max(lengths):
            raise ValueError("a part is larger than the greatest container")
        at, capacity = pack(sizes, lengths)
        shard = group.column("shard")[0].as_py()
        content = np.bincount(at, weights=sizes, minlength=len(capacity)).astype(np.int32)
        columns = [group.column(c) for c in ("doc_id", "part_no", "start", "end", "tokens")]
        return pa.table([*columns, pa.array((shard << 32) + at), pa.array(capacity[at].astype(np.int32)), pa.array(content[at])], ["doc_id", "part_no", "start", "end", "tokens", "container_id", "capacity", "container_tokens"])

    return dealt.groupBy("shard").applyInArrow(run, PACKED)

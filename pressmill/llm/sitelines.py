"""Lines repeated across the documents of one site (problem 4).

Each text becomes a stream of folded letters. A rolling hash over twelve letters cuts the stream into
content-defined chunks; a line end also ends a chunk, so that a chunk depends on its own line alone. What a line begins
with, up to a colon or the like, is one more chunk. Documents are
counted per site and chunk. Chunks that stand in enough documents of a site are its repeated chunks; a line that
begins and ends with one is a candidate, and candidates are then checked by the hash of the whole line.

The number of repeated chunks is bounded: those of a site stand in at least a share ``min_share`` of its documents,
so there are at most (chunks per document / min_share) of them, whatever the size of the site.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pressmill.llm.lettering import letters_of, slices, small_batches
from pressmill.session import materialize, release, spread
from pressmill.sources.sites import SiteRegistry

#: Rows up to which a table of repeated chunks or lines is broadcast; above it the join shuffles.
BROADCAST_ROWS = 400_000

#: Most repeated lines held in memory by operators that drop them.
MAX_KEYS = 3_000_000

#: What a line begins with, up to a mark that leads over to something else: at most five words.
_LEAD = re.compile(r"^\W*((?:[^\W\d_]+[ '’-]+){0,4}[^\W\d_]+)\s*(?:[:：»›>]|[—–]\s|-\s)\s*\w")


def lead_hash(line: str) -> int | None:
    """The hash of a line's lead without case; null for a line without one."""
    m = _LEAD.match(line)
    return _lead_key(unicodedata.normalize("NFC", m.group(1)).casefold()) if m else None


#: The low byte of all hashes of leads, by which they are told from chunks.
LEAD_MARK = 0xA5


@lru_cache(maxsize=50_000)
def _lead_key(lead: str) -> int:
    return ((xxhash.xxh64_intdigest(lead) & ~0xFF) | LEAD_MARK) - (1 << 63)


@dataclass
class Repeated:
    """Sorted keys of repeated lines (see ``line_keys``), hashes of the leads repeated on any site, and of headings over other stories."""

    lines: np.ndarray
    leads: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    heads: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


LINES_SCHEMA = "doc_id long, site string, line_no int, line_hash long, line_first boolean, head long, tail long, fresh array<long>"


def _first_of_doc(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True where a value occurs for the first time in its document."""
    order = np.lexsort((np.arange(len(doc)), value, doc))
    d, v = doc[order], value[order]
    first = np.ones(len(doc), bool)
    first[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    out = np.empty(len(doc), bool)
    out[order] = first
    return out


def line_table(documents: DataFrame, sites: SiteRegistry) -> DataFrame:
    """One row per line with letters, and one with line_no -1 per document (it counts the documents of a site)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            urls = batch.column("source_url").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices([len(t) for t in texts]):
                x = letters_of(texts[a:b])
                site = [sites.of_url(u) for u in urls[a:b]]
                chunk_doc = np.repeat(x.line_doc, np.diff(x.chunk_start))
                fresh = _first_of_doc(chunk_doc, x.chunk_hash)
                fresh_start = np.concatenate(([0], np.cumsum(fresh)))[x.chunk_start]
                pad = np.full(b - a, 0, np.int32)
                rows = np.concatenate((x.line_doc, np.arange(b - a)))
                # a document's own row has the leads of its lines
                lead = [{h for line in t.split("\n") if (h := lead_hash(line)) is not None} for t in texts[a:b]]
                ends = fresh_start[-1] + np.cumsum([len(h) for h in lead])
                values = np.concatenate((x.chunk_hash[fresh].astype(np.int64), np.array([v for h in lead for v in h], np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[a:b][rows], pa.int64()),
                        pa.array(site, pa.string()).take(pa.array(rows)),
                        pa.array(np.concatenate((x.line_no, pad - 1)).astype(np.int32)),
                        pa.array(np.concatenate((x.line_hash.astype(np.int64), pad.astype(np.int64)))),
                        pa.array(np.concatenate((_first_of_doc(x.line_doc, x.line_hash), pad.astype(bool)))),
                        pa.array(np.concatenate((x.chunk_hash[x.chunk_start[:-1]].astype(np.int64), pad))),
                        pa.array(np.concatenate((x.chunk_hash[x.chunk_start[1:] - 1].astype(np.int64), pad))),
                        pa.ListArray.from_arrays(pa.array(np.concatenate((fresh_start, ends)).astype(np.int32)), pa.array(values)),
                    ],
                    ["doc_id", "site", "line_no", "line_hash", "line_first", "head", "tail", "fresh"],
                )

    return spread(documents.where("doc_id is not null").select("doc_id", "source_url", "text"), "doc_id").mapInArrow(run, LINES_SCHEMA)


def _frequent(counts: DataFrame, totals: DataFrame, min_docs: int, min_share: float, tag: str) -> tuple[DataFrame, bool]:
    """What stands in enough documents of its site, and whether it may be broadcast."""
    kept = materialize(
        counts.where(F.col("docs") >= min_docs).join(F.broadcast(totals), "site").where(F.col("docs") >= min_share * F.col("total")).drop("total"), tag
    )
    return kept, kept.count() <= BROADCAST_ROWS


@dataclass
class RepeatedLines:
    """candidates: places (doc_id, site, line_no, line_hash); hashes: the repeated lines (site, line_hash, docs)."""

    candidates: DataFrame
    hashes: DataFrame
    small: bool
    written: DataFrame
    chunks: DataFrame

    def places(self) -> DataFrame:
        return self.candidates.join(F.broadcast(self.hashes) if self.small else self.hashes, ["site", "line_hash"])

    def collect_keys(self) -> np.ndarray:
        """Sorted keys of the repeated lines, see ``line_keys``. The written table of lines is removed.

        A site has at most (lines per document / min_share) repeated lines however many documents it has, so their
        number follows the registry; above ``MAX_KEYS`` they are refused.
        """
        rows = self.hashes.select("site", "line_hash").limit(MAX_KEYS + 1).toPandas()
        if len(rows) > MAX_KEYS:
            raise ValueError(f"more than {MAX_KEYS} repeated lines")
        release(self.written)
        hashes = rows["line_hash"].to_numpy(np.int64).astype(np.uint64)
        return np.unique(line_keys(rows["site"].tolist(), hashes))


    def collect(self) -> Repeated:
        """Keys of the repeated lines, and the leads that are repeated on any site; bounded like the lines."""
        rows = self.chunks.where(F.col("chunk").bitwiseAND(F.lit(0xFF)) == LEAD_MARK).select("chunk").distinct().limit(MAX_KEYS + 1).toPandas()
        if len(rows) > MAX_KEYS:
            raise ValueError(f"more than {MAX_KEYS} repeated leads")
        return Repeated(self.collect_keys(), np.unique(rows["chunk"].to_numpy(np.int64)))


def line_keys(sites: list[str | None], hashes: np.ndarray) -> np.ndarray:
    """One number for a site and a line hash."""
    seed = {s: xxhash.xxh64_intdigest(s or "") for s in set(sites)}
    return hashes ^ np.array([seed[s] for s in sites], np.uint64)


def find_repeated(documents: DataFrame, sites: SiteRegistry, min_docs: int = 4, min_share: float = 0.02) -> RepeatedLines:
    """Lines repeated over a site's documents.

    documents needs doc_id, source_url and text; other columns are ignored, and so are rows without a doc_id. A null or empty text has no lines with
    letters but counts as a document; a document of no known site is left out; of a line that stands twice in one
    document both places come out, counted as one document. An empty table gives no rows.
    """
    lines = written = materialize(line_table(documents, sites).where("site is not null"), "lines")
    # one row per site: bounded by the registry, which is checked when it is loaded
    totals = lines.where("line_no = -1").groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    chunks = lines.select("site", F.explode("fresh").alias("chunk")).groupBy("site", "chunk").agg(F.count(F.lit(1)).alias("docs"))
    frequent, small = _frequent(chunks, totals, min_docs, min_share, "chunks")
    frequent = frequent.drop("docs")
    hint = F.broadcast if small else lambda x: x
    lines = lines.where("line_no >= 0").drop("fresh")
    for name in ("head", "tail"):
        lines = lines.join(hint(frequent.withColumnRenamed("chunk", name)), ["site", name], "left_semi")
    candidates = lines.select("doc_id", "site", "line_no", "line_hash", "line_first")
    whole = candidates.groupBy("site", "line_hash").agg(F.count_if("line_first").alias("docs"))
    kept, small = _frequent(whole, totals, min_docs, min_share, "wholelines")
    return RepeatedLines(candidates.drop("line_first"), kept, small, written, frequent)


def repeated_lines(documents: DataFrame, sites: SiteRegistry, min_docs: int = 4, min_share: float = 0.02) -> DataFrame:
    """(doc_id, line_no, site, line_hash, docs) of the places of ``find_repeated``."""
    return find_repeated(documents, sites, min_docs, min_share).places()


def without_lines(documents: DataFrame, sites: SiteRegistry, keys: np.ndarray) -> DataFrame:
    """(doc_id, text, removed): texts without the lines whose keys are given, and how many lines that were.

    A null text stays null; a text without such lines comes back as it is.
    """
    shared = documents.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            urls, texts = batch.column("source_url").to_pylist(), batch.column("text").to_pylist()
            x = letters_of([t or "" for t in texts], chunks=False)
            site = [sites.of_url(u) for u in urls]
            gone: dict[int, set[int]] = {}
            if len(shared.value) and len(x.line_no):
                key = line_keys([site[d] for d in x.line_doc.tolist()], x.line_hash)
                hit = shared.value[np.minimum(np.searchsorted(shared.value, key), len(shared.value) - 1)] == key
                for d, k in zip(x.line_doc[hit].tolist(), x.line_no[hit].tolist()):
                    gone.setdefault(d, set()).add(k)
            for d, lines in gone.items():
                texts[d] = "\n".join(line for k, line in enumerate(texts[d].split("\n")) if k not in lines)
            removed = [len(gone.get(d, ())) for d in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["doc_id", "text", "removed"])

    return spread(documents.select("doc_id", "source_url", "text"), "doc_id").mapInArrow(run, "doc_id long, text string, removed int")


def repeated_numbers(texts: list[str], site: list[str | None], keys: np.ndarray) -> np.ndarray:
    """Numbers, over all the texts, of the lines that are repeated on their sites."""
    x = letters_of(texts, chunks=False)
    if not len(keys) or not len(x.line_no):
        return np.zeros(0, np.int64)
    key = line_keys([site[d] for d in x.line_doc.tolist()], x.line_hash)
    hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
    offset = np.concatenate(([0], np.cumsum([t.count("\n") + 1 for t in texts])))
    return (offset[x.line_doc] + x.line_no)[hit]

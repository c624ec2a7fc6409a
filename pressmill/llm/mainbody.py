"""Main text of pages and documents, and the blocks that are none (problem 7).

Markup is stripped to blocks: runs of text that no tag but an inline one interrupts; of plain documents, the lines.
Every block weighs its length, unless something speaks against it: it is repeated across its site, names the site,
is mostly links, or begins like a reader's comment. Sums of weights over sliding windows of blocks, held against the usual
paragraph of the same page, rise steeply where the article begins (surge) and fall where it ends (dive); it goes on only
where they rise again. Inside, what stands between headline and first paragraph is taken out, and lines that begin, up to a
colon or the like, as lines in many documents of a site do: tag lists and lines that lead to other stories. A heading
that is the last one on nearly all pages that have it stands over other stories and ends the article. Which beginnings and
headings these are is counted, not listed.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pressmill.llm.lettering import letters_of, slices, small_batches
from pressmill.llm.sitelines import lead_hash, line_keys, Repeated
from pressmill.session import spread
from pressmill.sources.sites import SiteRegistry

#: Blocks in a sliding window; the shares of the page's usual paragraph that a window sums up to at a surge, and under which
#: the text dives; and the least sum at a surge.
WINDOW, SURGE_SHARE, DIVE_SHARE, SURGE = 3, 0.6, 0.2, 40
#: A block this long is a paragraph even without a sentence end.
PARAGRAPH = 160
#: Blocks up to this length are searched for the names of all sites, since copies carry the lines of their first site.
SHORT = 250
#: Most words and characters of a head over related stories.
HEAD_WORDS, HEAD_CHARS = 6, 60

_HANDLE = re.compile(r"^\W*[a-z_.]+\d+\s*[:：]\s")
_END = re.compile(r"[.?!…。！？][\"'”’»)」]*\s*$")
_LETTERS = re.compile(r"[^\W\d_]+")
_HOST = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_CUT = re.compile(r"[|·｜•]|\s[>»›]\s")

_DROP = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|head)\b.*?(?:</\1\s*>|$)", re.I | re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>|<[!?/][^>]*>")
INLINE = {"a", "b", "i", "em", "strong", "span", "sup"}


@dataclass
class Block:
    text: str
    link: float = 0.0
    tag: str = ""


def squeeze(text: str) -> str:
    return " ".join(text.split())


def page_blocks(page: str) -> list[Block]:
    """Blocks of a page's body with the share of their letters inside links and the tag they stand in."""
    start = re.search(r"<body\b[^>]*>", page, re.I)
    body = _DROP.sub(lambda m: "" if m.group(0).startswith("<!--") else " ", page[start.end() :] if start else page)
    out: list[Block] = []
    parts: list[str] = []
    linked = depth = at = 0
    tag = ""

    def close() -> None:
        nonlocal linked
        text = squeeze(html.unescape("".join(parts)))
        if text:
            out.append(Block(text, min(1.0, linked / len(text)), tag))
        parts.clear()
        linked = 0

    for m in _TAG.finditer(body):
        if m.start() > at:
            piece = body[at : m.start()]
            parts.append(piece)
            linked += len(squeeze(html.unescape(piece))) if depth else 0
        at = m.end()
        name = (m.group(2) or "").lower()
        if name == "a":
            depth = 0 if m.group(1) else 1
        if name and name not in INLINE:
            close()
            depth = 0
            tag = "" if m.group(1) else name
    parts.append(body[at:])
    close()
    return out


def is_paragraph(text: str) -> bool:
    return bool(_END.search(text)) or len(text) >= PARAGRAPH


def _width(text: str) -> int:
    """Characters, wide ones twice."""
    return len(text) if text.isascii() else len(text) + sum(1 for c in text if c >= "぀" and c < "豈")


def is_data(text: str) -> bool:
    """Digests, encoded data, rows of numbers: long, and hardly any words."""
    if len(text) < 40:
        return False
    letters = sum(c.isalpha() for c in text)
    return (" " not in text and text.isascii()) or (letters < 0.35 * len(text) and any(c.isdigit() for c in text))


class SiteNames:
    """Finds names and hosts of sites in a text."""

    def __init__(self, sites: SiteRegistry) -> None:
        self.sites = sites
        self.names = {tuple(_LETTERS.findall(name.casefold())) for v in sites.sites.values() if (name := v.get("site_name"))} - {()}
        self.sizes = sorted({len(n) for n in self.names})

    def within(self, folded: str) -> bool:
        """Whether a short, case-folded text names any site."""
        words = _LETTERS.findall(folded)
        return any(tuple(words[i : i + n]) in self.names for n in self.sizes for i in range(len(words) - n + 1)) or ("." in folded and any(self.sites.of_host(h) for h in _HOST.findall(folded)))


def own_blocks(blocks: list[Block], repeated: list[bool], names: tuple[str, ...], title: str | None, every: SiteNames | None = None, lead: list[bool] | None = None, closing: list[bool] | None = None) -> list[bool]:
    """Which blocks are the article's own.

    ``names`` are those of its site, ``every`` knows the names of all sites, ``lead`` tells which blocks begin as lines in
    many documents do, ``closing`` which are headings over other stories.
    """
    n = len(blocks)
    lead, closing = lead or [False] * n, closing or [False] * n
    texts = [b.text if b.text.isascii() else unicodedata.normalize("NFC", b.text) for b in blocks]
    folded = [t.casefold() for t in texts]
    headline = unicodedata.normalize("NFC", squeeze(title or "")).casefold()
    data = [is_data(t) for t in texts]
    named = [any(x in folded[i] for x in names) or (every is not None and len(texts[i]) <= SHORT and every.within(folded[i])) for i in range(n)]
    foreign = [repeated[i] or blocks[i].link > 0.6 or named[i] or bool(_HANDLE.match(texts[i])) or closing[i] or (len(_CUT.findall(texts[i])) > 1 and not data[i]) for i in range(n)]
    heading = [blocks[i].tag == "h1" or (headline != "" and folded[i] == headline) for i in range(n)]
    weight = [0 if (foreign[i] or data[i]) and not heading[i] else _width(texts[i]) for i in range(n)]
    paragraph = [weight[i] > 0 and is_paragraph(texts[i]) for i in range(n)]
    usual = sorted(weight[i] for i in range(n) if paragraph[i])
    usual = usual[len(usual) // 2] if usual else 0
    surge, dive = max(SURGE, SURGE_SHARE * usual), DIVE_SHARE * usual
    mass = [weight[i] if paragraph[i] else 0 for i in range(n)]
    window = [sum(mass[i : i + WINDOW]) for i in range(n)]
    # surge: the first weighty block whose window rises over the threshold
    begin = next((i for i in range(n) if heading[i]), None)
    if begin is None:
        begin = next((i for i in range(n) if weight[i] >= SURGE and window[i] >= surge or (paragraph[i] and window[i] >= surge)), None)
    if begin is None:
        begin = next((i for i in range(n) if weight[i] >= SURGE), None)
    if begin is None:
        return [not f for f in foreign]
    if not heading[begin]:  # a headline may be too short for a surge
        begin = next((i for i in range(begin) if weight[i] and (len(texts[i].split()) >= 4 or _width(texts[i]) >= SURGE // 2) and not paragraph[i]), begin)
    first = next((i for i in range(begin + 1, n) if paragraph[i]), n)
    # a repeated head over other stories ends the article; a repeated short line before a paragraph is a subhead
    stop = n
    for i in range(first + 1, n):
        short = len(texts[i].split()) <= HEAD_WORDS and len(texts[i]) <= HEAD_CHARS and not _END.search(texts[i]) and not _CUT.search(texts[i])
        if not short or any(c in ",:：" or c.isdigit() for c in texts[i]) or named[i]:
            continue
        if closing[i] or (repeated[i] and not (i + 1 < n and paragraph[i + 1])):
            stop = i
            break
        weight[i] = _width(texts[i])
    # dive: the window falls; after it the article goes on only from a new surge
    own = [False] * n
    end, fallen = begin, False
    gap: list[int] = []
    for i in range(first, stop):
        if fallen:
            if not (paragraph[i] and window[i] >= surge):
                gap.append(i)
                continue
            fallen = False
        if paragraph[i]:
            end = i
        elif sum(weight[i : i + WINDOW]) < dive or not any(mass[i:stop]):
            fallen = True
            gap.append(i)
    skipped = set(gap)
    for i in range(begin, end + 1):
        if heading[i] and i == begin:
            own[i] = True
        elif not weight[i] or begin < i < first:
            own[i] = bool(weight[i]) and len(texts[i]) >= PARAGRAPH
        else:
            own[i] = i not in skipped and (not lead[i] or bool(_END.search(texts[i])))
    own[begin] = True
    for i in range(begin, stop):
        own[i] = own[i] or (data[i] and not foreign[i])
    return own


def _digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


SCHEMA = "item_kind string, item_id long, block_no int, own boolean, block_md5 string, block string"


def _run(kind: str, id_name: str, body: str, sites: SiteRegistry, keys: Repeated, keep_text: bool, emit_own: bool, whole: bool = False):
    every = SiteNames(sites)
    leads, heads = frozenset(keys.leads.tolist()), frozenset(keys.heads.tolist())
    words = {s: tuple(x for x in ((v.get("site_name") or "").casefold(), s) if x) for s, v in sites.sites.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, body):
            ids, urls = batch.column(id_name).to_pylist(), batch.column("url").to_pylist()
            texts, titles = batch.column(body).to_pylist(), batch.column("title").to_pylist()
            for a, b in slices([len(t) for t in texts]):
                made = [page_blocks(t) if kind == "page" else [Block(s) for line in t.split("\n") if (s := squeeze(line))] for t in texts[a:b]]
                site = [sites.of_url(u) for u in urls[a:b]]
                flags = _repeated(made, site, keys.lines)
                out: list[tuple] = []
                for k, blocks in enumerate(made):
                    own = own_blocks(blocks, flags[k], words.get(site[k], ()), titles[a + k], every, [lead_hash(b.text) in leads for b in blocks], [len(b.text) <= HEAD_CHARS and head_hash(b.text) in heads for b in blocks])
                    if whole:
                        out.append((kind, ids[a + k], sum(own), True, None, "\n".join(b.text for b, o in zip(blocks, own) if o)))
                        continue
                    for i, block in enumerate(blocks):
                        if emit_own or not own[i]:
                            out.append((kind, ids[a + k], i, own[i], _digest(block.text), block.text if keep_text else None))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string()))],
                        ["item_kind", "item_id", "block_no", "own", "block_md5", "block"],
                    )

    return run


def _repeated(made: list[list[Block]], site: list[str | None], keys: np.ndarray) -> list[list[bool]]:
    flags = [[False] * len(blocks) for blocks in made]
    if not any(made) or not len(keys):
        return flags
    x = letters_of(["\n".join(b.text for b in blocks) for blocks in made], chunks=False)
    key = line_keys([site[d] for d in x.line_doc.tolist()], x.line_hash)
    hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
    for d, i in zip(x.line_doc[hit].tolist(), x.line_no[hit].tolist()):
        flags[d][i] = True
    return flags


def main_texts(pages: DataFrame, documents: DataFrame, sites: SiteRegistry, repeated: Repeated) -> DataFrame:
    """(item_kind, item_id, blocks, text): the article's own blocks of every page and document, one a line.

    Null pages and texts have no row; of one without own blocks the text is empty.
    """
    made = [spread(rows, key).mapInArrow(_run(kind, key, body, sites, repeated, True, True, True), SCHEMA) for kind, key, body, rows in (("page", "page_id", "raw_html", _pages(pages)), ("document", "doc_id", "text", _documents(documents)))]
    return made[0].unionByName(made[1]).select("item_kind", "item_id", F.col("block_no").alias("blocks"), F.col("block").alias("text"))


def head_hash(text: str) -> int:
    """The hash of a heading without case, digits and signs."""
    return xxhash.xxh64_intdigest(" ".join(_LETTERS.findall(unicodedata.normalize("NFC", text).casefold()))) - (1 << 63)


def closing_heads(pages: DataFrame, least: int = 4, share: float = 0.001, last: float = 0.9) -> np.ndarray:
    """Sorted hashes of the headings that are the last of a page on a share ``last`` of the pages that have them.

    Only headings of ``least`` pages and of a share ``share`` of all pages count, so there are at most (headings of a page /
    share) of them. pages needs page_id and raw_html; null and empty pages have no headings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "raw_html"):
            found: list[tuple[int, bool]] = []
            for page in batch.column("raw_html").to_pylist():
                heads = [b.text for b in page_blocks(page) if b.tag in ("h2", "h3", "h4", "h5", "h6") and len(b.text) <= HEAD_CHARS]
                at = {head_hash(t): k == len(heads) - 1 for k, t in enumerate(heads)}
                found += at.items()
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.bool_())], ["head", "closes"])

    rows = spread(_pages(pages), "page_id").mapInArrow(run, "head long, closes boolean").groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.count_if("closes").alias("k"))
    bound = max(least, int(share * pages.count()))
    return np.sort(rows.where((F.col("n") >= bound) & (F.col("k") >= last * F.col("n"))).select("head").toPandas()["head"].to_numpy(np.int64))


def _pages(pages: DataFrame) -> DataFrame:
    return pages.where("raw_html is not null").select("page_id", "url", "raw_html", F.lit(None).cast("string").alias("title"))


def _documents(documents: DataFrame) -> DataFrame:
    return documents.where("text is not null").select("doc_id", F.col("source_url").alias("url"), "text", "title")


def page_body(pages: DataFrame, sites: SiteRegistry, repeated: Repeated, keep_text: bool = False, emit_own: bool = True) -> DataFrame:
    """One row per block of a page: block_no, own, block_md5 and, with keep_text, the block.

    pages needs page_id, url and raw_html. Null and empty pages, and pages without text, have no rows. ``repeated``
    has the keys of the lines repeated across sites.
    """
    return spread(_pages(pages), "page_id").mapInArrow(_run("page", "page_id", "raw_html", sites, repeated, keep_text, emit_own), SCHEMA)


def document_body(documents: DataFrame, sites: SiteRegistry, repeated: Repeated, keep_text: bool = False, emit_own: bool = True) -> DataFrame:
    """As ``page_body`` for the lines of documents (doc_id, source_url, title, text)."""
    return spread(_documents(documents), "doc_id").mapInArrow(_run("document", "doc_id", "text", sites, repeated, keep_text, emit_own), SCHEMA)

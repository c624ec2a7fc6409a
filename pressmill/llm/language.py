"""Language of documents and of lines in another language (problem 5).

A word known from the fit is scored by its log frequency in each language. An unseen word falls back to its longest
known character n-grams, from four letters down to one. Scores of a line's words add up; the lines' languages, weighted
by their letters, decide the document.

The model is fitted on a bounded sample of labelled documents (``fit_docs``). Labels are partly wrong, so the fit
runs twice: the second time each line counts for the language the first model gives it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressmill.llm.lettering import composed, slices, small_batches
from pressmill.llm.models import fitted
from pressmill.session import spread

LANGS = ("en", "vi", "es", "pt", "fr", "de", "ja")
JA = LANGS.index("ja")
WIDE = re.compile("[぀-ヿ一-鿿]")
#: A run of letters that touches no digit, so that digests and encoded data give few words.
WORD = re.compile(r"\b[^\W\d_]+\b|[぀-ヿ一-鿿]+")
#: Most labelled documents the model is fitted on.
FIT_DOCS = 6_000
MAX_GRAM = 4
#: Words and n-grams seen less often than this are not kept.
MIN_COUNT = 3
#: Added to every relative frequency: what a language has not shown counts alike in all of them.
FLOOR = 1e-6
#: Words whose scores a worker remembers before its memory is emptied.
REMEMBERED = 150_000

# Names, codes and country codes by which labels name a language.
LABELS = {
    "en": "en eng english us usa gb uk au nz ie in sg",
    "vi": "vi vie vn vnm vietnamese tiếng",
    "es": "es spa esp spanish español espanol castellano mx ar co cl pe",
    "pt": "pt por prt portuguese português portugues br bra",
    "fr": "fr fra fre french français francais",
    "de": "de deu ger german deutsch at aut",
    "ja": "ja jpn jp japanese 日本語 nihongo",
}
_BY_NAME = {name: lang for lang, names in LABELS.items() for name in names.split()}


def label_language(label: str | None) -> str | None:
    """The language a label names: by its first part, as in ``en-US``, ``en GB``, ``vietnamese``; null if it names none of ours."""
    parts = re.split(r"[\s_\-]+", (label or "").strip().casefold())
    return _BY_NAME.get(parts[0])


def _grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class LanguageModel:
    """words and grams[n]: text -> row of ``table`` (log frequencies in order of LANGS)."""

    words: dict[str, int]
    grams: list[dict[str, int]]
    table: np.ndarray
    floor: np.ndarray
    _memory: dict[str, int] = field(default_factory=dict, repr=False)
    _rows: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"words": self.words, "grams": self.grams, "table": self.table, "floor": self.floor, "_memory": {}, "_rows": None}

    @staticmethod
    def fit(lines: Iterable[tuple[str, str]]) -> LanguageModel:
        """From (line, language) pairs. Words and n-grams share one floor for what a language has never shown."""
        words = {lang: Counter() for lang in LANGS}
        for line, lang in lines:
            words[lang].update(WORD.findall(line.lower()))
        rows: list[list[float]] = []

        def table(counts: dict[str, Counter]) -> dict[str, int]:
            every = Counter()
            for c in counts.values():
                every.update(c)
            kept = [w for w, n in every.items() if n >= MIN_COUNT]
            total = {lang: sum(c.values()) for lang, c in counts.items()}
            index = {}
            for w in kept:
                index[w] = len(rows)
                rows.append([math.log(counts[lang][w] / max(total[lang], 1) + FLOOR) for lang in LANGS])
            return index

        known = table(words)
        grams = []
        for n in range(1, MAX_GRAM + 1):
            by = {lang: Counter() for lang in LANGS}
            for lang, c in words.items():
                for w, k in c.items():
                    for g in _grams(w, n):
                        by[lang][g] += k
            grams.append(table(by))
        return LanguageModel(known, grams, np.array(rows, np.float32).reshape(-1, len(LANGS)), np.full(len(LANGS), math.log(FLOOR), np.float32))

    def _unseen(self, word: str) -> np.ndarray:
        """Mean score of the longest known n-grams: from each place the longest that is known."""
        padded = f" {word} "
        total, n = np.zeros(len(LANGS), np.float32), 0
        for i in range(len(padded) - 1):
            for size in range(MAX_GRAM, 0, -1):
                g = padded[i : i + size]
                if len(g) == size and g != " " and (row := self.grams[size - 1].get(g)) is not None:
                    total += self.table[row]
                    n += 1
                    break
        return total / n if n else self.floor

    def ids(self, words: list[str]) -> list[int]:
        """Rows of ``scores`` for words; unseen ones get a row of their own in a bounded memory."""
        if self._rows is None:
            self._rows = np.concatenate((self.table, np.zeros((REMEMBERED, len(LANGS)), np.float32)))
            self._memory = dict(self.words)
            self._fill = len(self.table)
        get, out = self._memory.get, []
        for w in words:
            row = get(w)
            if row is None:
                row = self._fill
                self._rows[row] = self._unseen(w)
                self._memory[w] = row
                self._fill += 1
            out.append(row)
        return out

    def room(self) -> None:
        """Empties the memory when the next slice might overflow it. To be called between slices only."""
        if self._rows is not None and self._fill + REMEMBERED // 2 > len(self._rows):
            self._memory, self._fill = dict(self.words), len(self.table)

    def score(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores (lines x languages), numbers of words, and how many of them the model knows.

        Of a line that comes out as Japanese, two wide letters count as a known word.
        """
        self.room()
        flat: list[int] = []
        sizes, known = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
        for i, line in enumerate(lines):
            if words := WORD.findall(line.lower()):
                flat += self.ids(words)
                sizes[i] = len(words)
        out = np.zeros((len(lines), len(LANGS)), np.float32)
        if flat:
            some = np.flatnonzero(sizes)
            starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            rows = np.array(flat)
            out[some] = np.add.reduceat(self._rows[rows], starts)
            known[some] = np.add.reduceat((rows < len(self.words)).astype(np.int64), starts)
            for i in np.flatnonzero((out.argmax(1) == JA) & (sizes > 0)):
                known[i] = max(known[i], len(WIDE.findall(lines[i])) // 2)
        return out, sizes, known


def sample_labelled(documents: DataFrame, bound: int = FIT_DOCS) -> list[tuple[str, str]]:
    """(text, language of the label) of at most about ``bound`` documents, chosen by a hash of doc_id."""
    total = documents.count()
    rate = min(1.0, bound / max(total, 1))
    rows = (
        documents.where("text is not null and lang is not null")
        .where((F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1))) < int(rate * (1 << 40)))
        .select("text", "lang")
        .limit(2 * bound)
        .collect()
    )
    return [(r["text"], lang) for r in rows if (lang := label_language(r["lang"]))]


def fit_model(documents: DataFrame, bound: int = FIT_DOCS) -> LanguageModel:
    """The model of a table's documents, fitted once (see ``fitted``)."""
    return fitted("language", lambda: _fit_twice(documents, bound), documents, bound=bound, grams=MAX_GRAM, least=MIN_COUNT, floor=FLOOR)


def _fit_twice(documents: DataFrame, bound: int) -> LanguageModel:
    """Fit on labelled documents, then once more with each line under the language the first model gives it."""
    pairs = [(line, lang) for text, lang in sample_labelled(documents, bound) for line in composed(text).split("\n") if line.strip()]
    first = LanguageModel.fit(pairs)
    again: list[tuple[str, str]] = []
    for a in range(0, len(pairs), 2000):
        part = [line for line, _ in pairs[a : a + 2000]]
        scores, words, _ = first.score(part)
        best = scores.argmax(1)
        two = np.sort(scores, 1)
        sure = (words >= 4) & (two[:, -1] - two[:, -2] > 4)
        again += [(line, LANGS[b]) for line, b, ok in zip(part, best, sure) if ok]
    return LanguageModel.fit(again or pairs)


#: Least lead in log probability of a line's language over the document's, and the least lead per word.
LINE_LEAD, LINE_LEAD_PER_WORD = 8.0, 0.5
#: Least share of a line's words that the model knows.
LINE_KNOWN = 0.3
RUNNING_WORDS = 5
#: Words with a small first letter that running text has at least.
LEAST_SMALL = 3

SCHEMA = "doc_id long, line_no int, lang string, confidence double, label_ok boolean, n_words int"


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document (line_no -1) and one per line in another language than the document.

    documents needs doc_id, text and lang. A null or empty text, or one without letters, gives a document row with a
    null language and confidence 0. label_ok tells whether the label names the language found; it is null for lines.
    n_words is 0 for a line that is a list of names rather than running text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids = batch.column("doc_id").to_pylist()
            labels = batch.column("lang").to_pylist()
            texts = [composed(t) if t else "" for t in batch.column("text").to_pylist()]
            for a, b in slices([len(t) for t in texts]):
                yield pa.RecordBatch.from_pylist(_rows(model, ids[a:b], labels[a:b], texts[a:b]), _ARROW)

    return spread(documents.select("doc_id", "text", "lang"), "doc_id").mapInArrow(run, SCHEMA)


_ARROW = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("label_ok", pa.bool_()), ("n_words", pa.int32())])


def document_languages(scores: np.ndarray, words: np.ndarray, known: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index of the language of most known words, lines voting, for documents that begin at line ``first``; -1 without words.

    Strings that are no words (digests, encoded data) have no known words and so no vote, unless there is nothing else.
    """
    votes = np.zeros((len(words), len(LANGS)), np.float64)
    votes[np.arange(len(words)), scores.argmax(1)] = known + 1e-3 * words
    total = np.add.reduceat(votes, first) if len(first) else votes
    whole = np.add.reduceat(scores.astype(np.float64), first) if len(first) else scores
    main = (total + 1e-9 * (whole - whole.max(1, keepdims=True))).argmax(1)
    return np.where(total.sum(1) > 0, main, -1)


def _rows(model: LanguageModel, ids: list, labels: list, texts: list[str]) -> list[dict]:
    split = [t.split("\n") for t in texts]
    lines = [line for part in split for line in part]
    scores, words, known = model.score(lines)
    first = np.concatenate(([0], np.cumsum([len(x) for x in split])[:-1])).astype(np.int64)
    main = document_languages(scores, words, known, first)
    out = []
    n_lines = np.array([len(x) for x in split])
    owner = np.repeat(np.arange(len(split)), n_lines)
    best = scores.argmax(1)
    lead = scores.max(1) - scores[np.arange(len(lines)), np.maximum(main[owner], 0)]
    odd = np.flatnonzero((main[owner] >= 0) & (best != main[owner]) & (lead >= LINE_LEAD) & (lead >= LINE_LEAD_PER_WORD * words) & (known >= LINE_KNOWN * words))
    total = np.add.reduceat(scores, first) if len(first) else scores
    doc_words = np.add.reduceat(words, first) if len(first) else words
    for i, doc_id in enumerate(ids):
        if main[i] < 0:
            out.append({"doc_id": doc_id, "line_no": -1, "lang": None, "confidence": 0.0, "label_ok": False, "n_words": 0})
            continue
        lang = LANGS[main[i]]
        out.append({"doc_id": doc_id, "line_no": -1, "lang": lang, "confidence": _confidence(total[i], main[i], doc_words[i]), "label_ok": label_language(labels[i]) == lang, "n_words": int(doc_words[i])})
    for j in odd:
        n = int(max(words[j], known[j])) if best[j] == JA or _runs(lines[j]) else 0
        out.append({"doc_id": ids[owner[j]], "line_no": int(j - first[owner[j]]), "lang": LANGS[best[j]], "confidence": _confidence(scores[j], best[j], words[j]), "label_ok": None, "n_words": n})
    return out


def _runs(line: str) -> bool:
    """Whether a line has words that begin small, as a list of names has not; one all in capitals may be text."""
    return line.isupper() or sum(w[0].islower() for w in WORD.findall(line)) >= LEAST_SMALL


def _confidence(scores: np.ndarray, at: int, words: int) -> float:
    """Posterior of a language, with the evidence of many words tempered to that of twenty."""
    x = (scores - scores[at]).astype(np.float64) * min(1.0, 20 / max(int(words), 1))
    return float(1 / np.exp(np.minimum(x, 50)).sum())

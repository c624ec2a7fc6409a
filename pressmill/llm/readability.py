"""Reading level of documents (problem 10).

Several classic formulas grade each document: reading ease grade, fog index, automated readability and the letter index
for English; for Vietnamese, whose written words are syllables, the formulas that go by sentence length and word length.
Each formula's grade is its mean over the sentences, weighted by their words, and the median of the formulas' grades is
the document's. Grades become levels by cut points fitted on a bounded number of labels.

Syllables are counted by rules in the manner of hyphenation: groups of vowels, with patterns that open a group between
two vowels, patterns that silence an e, and exceptions. A text without sentence ends is cut where a word stands with a
capital that the text has without one elsewhere.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressmill.llm.language import LANGS, LanguageModel, document_languages
from pressmill.llm.lettering import composed, slices, small_batches
from pressmill.session import materialize, spread

#: Most label rows the cut points are fitted on.
FIT_LABELS = 20_000
#: Cut points used for a language without labels.
DEFAULT_CUTS = {"en": (6.0, 12.0, 20.0), "vi": (3.5, 7.5, 13.5)}
MIN_CHARS, MIN_WORDS = 40, 60

_END = re.compile(r"[.?!…]+[\"'”’)]*(?=\s|$)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_VOWELS = re.compile("[aeiouy]+")
#: Where a syllable ends between two vowels, as in sci-ence, cre-ate, be-ing, usu-al, vide-o, po-et, loy-al, fly-ing.
_OPEN = re.compile(
    """(?<=[^aeiouctsgxq]i)a|(?<=[aeo]ci)a(?=t)|(?<=[^aeiouctsgxl]i)[ou]|(?<=[^l]li)[ou]|(?<=sci)e|(?<=soci)e(?=t)|(?<=qui)e(?=t)|(?<=[^aeioucstf]i)e(?=t$|ts$|ty$|t[^aeiouy]|nc|nts?$|r$|rs$)|(?<=cre)a(?!m|k|s|tur)|(?<=[^aeiou]e)a(?=[lt]?i[tz]|$)
    |(?<=are)a|(?<=[lh]e)a(?=t[er]+s?$)|(?<=re)a(?=ct)|(?<=ine)a(?=r)|(?<=cle)a(?=r$)|(?<=[^aeioupj]e)o|(?<=[^aeiouqg]u)a|(?<=[^aeiouqgb]u)i(?=[dnt][aeiouy$]|d$|n$|ng)|(?<=[^aeiouq]u)o
    |(?<=[fdrnl]u)e(?=l$|ls$|n[ct])|(?<=[^aeiou]e)i(?=ng|t[yei]|s[tm])|(?<=o)i(?=ng|c$|st|cal)|(?<=[^aeiousht]o)e(?=[mt])|(?<=[aeou]y)[aeo]|(?<=[^aeiou]y)i|(?<=e)i(?=ng)|(?<=a)o(?=s$|tic|rt)""",
    re.X,
)
#: A silent e before a common ending, as in state-ment and some-thing.
_SILENT = re.compile("(?<=[aeiouy][^aeiouywx])e(?=ments?$|ful$|fully$|less$|ness$|ly$|works?$|things?$|times?$|where$|one$|body$)")
# Words that the rules miscount.
_COUNTS = {"business": 2, "businesses": 3, "every": 2, "everything": 3, "people": 2, "eye": 1, "eyes": 1, "queue": 1, "colonel": 2, "rhythm": 2, "wednesday": 2, "really": 2, "real": 1, "once": 1, "friend": 1, "view": 1}


@lru_cache(maxsize=200_000)
def syllables(word: str) -> int:
    """Syllables of an English word, at least one."""
    w = word.lower()
    if not w.isascii():  # marks go, but a diaeresis begins a syllable
        marked = unicodedata.normalize("NFD", w)
        return max(1, sum(map(syllables, filter(None, "".join(c for c in re.sub("([aeiou]\u0308)", r" \1", marked) if not unicodedata.combining(c)).split()))))
    if w in _COUNTS:
        return _COUNTS[w]
    n = len(_VOWELS.findall(w))
    if n > 1:
        if w.endswith("e") and not w.endswith("ee") and not (w.endswith("le") and w[-3:-2] not in "aeiouy"):
            n -= w[-2] not in "aeiouy"
        elif w.endswith("ed") and w[-3] not in "tdaeiouy":
            n -= 1
        elif w.endswith("es") and w[-3] not in "aeiouy" and not w.endswith(("ses", "ces", "xes", "zes", "ges", "shes", "ches", "les")):
            n -= 1
    return max(n + len(_OPEN.findall(w)) - len(_SILENT.findall(w)), 1)


def sentences(line: str) -> list[str]:
    """Sentences of a line of running text; none for a line without a sentence end."""
    parts = _END.split(line)
    return parts if len(parts) > 1 else []


def unmarked_sentences(lines: list[str]) -> list[str]:
    """Sentences of lines without sentence ends: a capital begins one if the same lines have the word with a small letter as well."""
    small = {w for line in lines for w in _WORD.findall(line) if w[0].islower()}
    out = []
    for line in lines:
        start = 0
        for m in _WORD.finditer(line):
            if m.start() > start and m.group()[0].isupper() and m.group().lower() in small:
                out.append(line[start : m.start()])
                start = m.start()
        out.append(line[start:])
    return out


#: Words that sentences with an end must have, as a share of all words, for the others to be left out.
MARKED_SHARE = 0.2


def sentence_counts(lines: list[str], lang: str) -> list[tuple[int, int, int, int, int]]:
    """(words, words that are no names, their letters, their syllables, those of three syllables or more) by sentence.

    A capital inside a sentence marks a name. Sentences under three words are left out. Where few words stand in sentences
    with an end, the text is cut by ``unmarked_sentences``, and one without any cut is one sentence.
    """
    running = [line for line in lines if line.count(" ") >= 4]
    marked = _counts([x for line in running for x in sentences(line)], lang)
    total = sum(len(_WORD.findall(line)) for line in lines)
    if sum(c[0] for c in marked) >= MARKED_SHARE * total and marked:
        return marked
    return _counts(unmarked_sentences(running or lines), lang) or _counts([" ".join(lines)], lang)


def _counts(parts: list[str], lang: str) -> list[tuple[int, int, int, int, int]]:
    out = []
    for sentence in parts:
        words = _WORD.findall(sentence)
        if len(words) < 3:
            continue
        plain = [w for i, w in enumerate(words) if not i or not w[0].isupper()]
        letters = sum(map(len, plain))
        if lang == "en":
            each = [syllables(w) for w in plain]
            out.append((len(words), len(plain), letters, sum(each), sum(n > 2 for n in each)))
        else:
            out.append((len(words), len(plain), letters, len(plain), 0))
    return out


def sentence_grades(counts: np.ndarray, lang: str) -> np.ndarray:
    """Grade estimates (formulas x sentences)."""
    words, plain, letters, beats, long = counts.T.astype(np.float64)
    size = letters / plain
    machine = 4.71 * size + 0.5 * words - 21.43
    if lang == "en":
        ease = 0.39 * words + 11.8 * beats / plain - 15.59
        fog = 0.4 * (words + 100 * long / plain)
        return np.stack([ease, fog, machine, 5.88 * size - 29.6 / words - 15.8])
    return np.stack([2 * size + 0.2 * words - 6, 0.4 * words, machine])


def document_grade(lines: list[str], lang: str) -> float | None:
    """Grade of a document: the median of its grades by all formulas; null without three words."""
    counts = np.array(sentence_counts(lines, lang), np.int64).reshape(-1, 5)
    if not len(counts):
        return None
    return float(np.median(np.average(sentence_grades(counts, lang), axis=1, weights=counts[:, 0])))


def grades(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang, grade) of the documents that are mostly English or Vietnamese and long enough.

    documents needs doc_id and text. Null, empty and short texts, and texts without three words in a row, have no row.
    """
    graded = {LANGS.index(lang): lang for lang in DEFAULT_CUTS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids, texts = batch.column("doc_id").to_pylist(), [composed(t) for t in batch.column("text").to_pylist()]
            for a, b in slices([len(t) for t in texts]):
                split = [t.split("\n") for t in texts[a:b]]
                lines = [x for part in split for x in part]
                scores, words, known = model.score(lines)
                first = np.concatenate(([0], np.cumsum([len(x) for x in split])[:-1])).astype(np.int64)
                main, best = document_languages(scores, words, known, first), scores.argmax(1)
                rows = []
                for i, part in enumerate(split):
                    if (lang := graded.get(int(main[i]))) and len(texts[a + i].split()) >= MIN_WORDS:
                        own = best[first[i] : first[i] + len(part)] == main[i]
                        grade = document_grade([x for x, ok in zip(part, own) if ok], lang)
                        if grade is not None:
                            rows.append((ids[a + i], lang, grade))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.float64()))], ["doc_id", "lang", "grade"])

    long = documents.select("doc_id", "text").where(F.char_length("text") >= MIN_CHARS)
    return spread(long, "doc_id").mapInArrow(run, "doc_id long, lang string, grade double")


def fit_cuts(pairs: list[tuple[str, float, int]]) -> dict[str, tuple[float, ...]]:
    """Cut points by language from (language, grade, level): each splits its levels with the fewest errors."""
    cuts = dict(DEFAULT_CUTS)
    for lang in DEFAULT_CUTS:
        own = sorted((g, y) for code, g, y in pairs if code == lang)
        if len(own) < 20:
            continue
        g, y = np.array([x[0] for x in own]), np.array([x[1] for x in own])
        found = []
        for level in (1, 2, 3):
            right = np.concatenate(([0], np.cumsum(y <= level))) + np.concatenate((np.cumsum((y > level)[::-1])[::-1], [0]))
            at = np.flatnonzero(right == right.max())
            at = int(at[len(at) // 2])
            found.append(float((g[max(at - 1, 0)] + g[min(at, len(g) - 1)]) / 2))
        cuts[lang] = tuple(np.maximum.accumulate(found))
    return cuts


def reading_levels(documents: DataFrame, labels: DataFrame, model: LanguageModel, bound: int = FIT_LABELS) -> DataFrame:
    """(doc_id, lang, grade, reading_level). labels needs label_id, doc_id and reading_level; null levels are left out."""
    graded = materialize(grades(documents, model), "grades")
    total = labels.count()
    rate = min(1.0, bound / max(total, 1))
    some = labels.where("reading_level between 1 and 4").where(F.xxhash64("label_id").bitwiseAND(F.lit((1 << 40) - 1)) < int(rate * (1 << 40))).select("doc_id", "reading_level")
    rows = graded.join(some, "doc_id").select("lang", "grade", "reading_level").limit(2 * bound).collect()
    cuts = fit_cuts([tuple(r) for r in rows])
    level = F.lit(1)
    for k in range(3):
        at = F.when(F.col("lang") == "en", cuts["en"][k]).otherwise(cuts["vi"][k])
        level = level + (F.col("grade") >= at).cast("int")
    return graded.withColumn("reading_level", level)

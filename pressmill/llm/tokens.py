"""Token counts and token budgets (problem 2).

The tokenizer is a vocabulary of pieces: lower case, cut at white space, in each word the longest listed piece at the
left again and again, and a byte count for characters that begin no piece. Counting every text that way is exact and
slow. The estimate fits, per language, a linear regression of tokens on features the JVM counts without leaving
generated code: bytes, words, letters, digits, punctuation, white space, accented and wide letters. A second tokenized
sample, the holdout, corrects the bias per language. Both samples are bounded; the estimate covers every document.
A document's language is the one its words show, since labels are missing or wrong in places; the label decides only
for texts without words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressmill.llm.language import LANGS, LanguageModel, document_languages
from pressmill.llm.lettering import composed, slices, small_batches
from pressmill.session import spread

#: Most documents tokenized to fit the regressions, and to correct their bias.
FIT_DOCS, HOLDOUT_DOCS = 4_000, 4_000
#: Words remembered by a worker before its memory is emptied.
REMEMBERED = 300_000
#: Most pieces of a vocabulary held in memory.
MAX_PIECES = 1_000_000

_SPACE = re.compile(r"\s+")


class PieceCounter:
    """Counts the tokens of texts under a vocabulary of pieces."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = {p for p in pieces if p}
        self.longest = max(map(len, self.pieces), default=0)
        self._memory: dict[str, int] = {}

    def __getstate__(self):
        return {"pieces": self.pieces, "longest": self.longest, "_memory": {}}

    def word_pieces(self, word: str) -> list[tuple[int, int]]:
        """(characters, tokens) of the pieces of a lower-case word: greedy from the left; an unlisted character counts its bytes."""
        out, i, n = [], 0, len(word)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                if word[i:j] in self.pieces:
                    out.append((j - i, 1))
                    i = j
                    break
            else:
                out.append((1, len(word[i].encode("utf-8", "surrogatepass"))))
                i += 1
        return out

    def _count_word(self, word: str) -> int:
        return sum(n for _, n in self.word_pieces(word))

    def count(self, text: str) -> int:
        """Tokens of a text; 0 for an empty one."""
        memory, total = self._memory, 0
        if len(memory) > REMEMBERED:
            memory.clear()
        for word in text.lower().split():
            n = memory.get(word)
            if n is None:
                n = self._count_word(word)
                if len(word) <= 64:
                    memory[word] = n
            total += n
        return total


def load_counter(vocab: DataFrame) -> PieceCounter:
    """The tokenizer of a ``vocab_pieces`` table, which must be a bounded vocabulary."""
    rows = vocab.select("piece").where("piece is not null").limit(MAX_PIECES + 1).collect()
    if len(rows) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    return PieceCounter([r["piece"] for r in rows])


def _from_text(rows: DataFrame, columns: tuple[str, ...], name: str, kind: tuple[str, pa.DataType], make) -> DataFrame:
    """``columns`` of rows and a new one made of each batch's texts; the texts themselves do not come back."""
    fields = [f for f in rows.schema if f.name in columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"{name} {kind[0]}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column("text").to_pylist()
            for a, b in slices([len(t or "") for t in texts]):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(make(texts[a:b]), kind[1])], [*(f.name for f in fields), name])

    return rows.select(*[f.name for f in fields], *([] if "text" in columns else ["text"])).mapInArrow(run, schema)


def count_tokens(documents: DataFrame, counter: PieceCounter, *columns: str) -> DataFrame:
    """Exact counts: ``columns`` of documents and ``tokens``; null and empty texts have 0."""
    shared = documents.sparkSession.sparkContext.broadcast(counter)
    return _from_text(documents, columns, "tokens", ("long", pa.int64()), lambda texts: [shared.value.count(t) if t else 0 for t in texts])


def found_languages(texts: list[str | None], model: LanguageModel) -> list[str | None]:
    """The language of most words of each text; null without words."""
    split = [composed(t or "").split("\n") for t in texts]
    scores, words, known = model.score([line for part in split for line in part])
    first = np.concatenate(([0], np.cumsum([len(x) for x in split])[:-1])).astype(np.int64)
    return [LANGS[k] if k >= 0 else None for k in document_languages(scores, words, known, first)]


def with_language(rows: DataFrame, model: LanguageModel | None, *columns: str) -> DataFrame:
    """``columns`` of rows, which have text and label, and ``language``: found in the text, or else the label's."""
    if model is None:
        return rows.withColumn("language", F.col("label")).select(*columns, "language")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    found = _from_text(rows, (*columns, "label"), "language", ("string", pa.string()), lambda texts: found_languages(texts, shared.value))
    return found.withColumn("language", F.coalesce("language", "label")).select(*columns, "language")


def features(text: Column) -> dict[str, Column]:
    """Numbers the regression goes by; all are built-in expressions."""
    marked = F.regexp_count(text, F.lit(r"[À-ỿ]"))
    return {
        "bytes": F.octet_length(text),
        "chars": F.char_length(text),
        "words": F.regexp_count(text, F.lit(r"\S+")),
        "digits": F.regexp_count(text, F.lit("[0-9]")),
        "signs": F.regexp_count(text, F.lit(r"\p{Punct}")),
        "capitals": F.regexp_count(text, F.lit("[A-Z]")),
        "marked": marked,
        "wide": F.regexp_count(text, F.lit(r"[぀-ヿ一-鿿]")),
    }


NAMES = ("bytes", "chars", "words", "digits", "signs", "capitals", "marked", "wide")

# ISO 639-2 and English names of languages by their two-letter code, for labels in many spellings.
LABEL_CODES = {
    "eng": "en", "english": "en", "vie": "vi", "vietnamese": "vi", "vn": "vi", "spa": "es", "spanish": "es", "por": "pt", "portuguese": "pt",
    "fra": "fr", "fre": "fr", "french": "fr", "deu": "de", "ger": "de", "german": "de", "jpn": "ja", "japanese": "ja",
}
UNKNOWN = ("", "und", "unknown", "xx", "null", "none")


def language_key(label: Column) -> Column:
    """One code for the spellings of a language label; ``und`` for null, empty and labels that name none."""
    first = F.element_at(F.split(F.lower(F.trim(label)), r"[\s_-]+"), 1)
    table = F.create_map(*[F.lit(x) for pair in LABEL_CODES.items() for x in pair])
    return F.when(first.isNull() | first.isin(*UNKNOWN), F.lit("und")).otherwise(F.coalesce(table[first], first))


def site_key(domain: Column, url: Column) -> Column:
    """The site of a host as crawled, or of the URL's host: lower case, without www., m. and amp. prefixes."""
    host = F.coalesce(F.nullif(F.lower(F.trim(domain)), F.lit("")), F.lower(F.try_parse_url(url, F.lit("HOST"))))
    return F.regexp_replace(host, r"^(?:www\d?|m|amp|mobile)\.", "")


def _sampled(part: int, parts: int, rate: float) -> Column:
    """A fixed share ``rate`` of documents; different parts share none."""
    h = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 40) - 1))
    low = (1 << 40) * part // parts
    return (h >= low) & (h < low + int(rate * (1 << 40)))


def fit(documents: DataFrame, counter: PieceCounter, fit_docs: int = FIT_DOCS, holdout_docs: int = HOLDOUT_DOCS, model: LanguageModel | None = None) -> dict[str, np.ndarray]:
    """Coefficients by language, the intercept last; ``*`` for languages with few documents."""
    total = max(documents.count(), 1)
    # both samples, chosen by a hash of the key, come from one scan; they are tokenized where they are, and only numbers
    # come to the driver
    part = F.when(_sampled(0, 2, min(0.5, fit_docs / total)), 0).when(_sampled(1, 2, min(0.5, holdout_docs / total)), 1)
    some = documents.where("text is not null").select("doc_id", "text", language_key(F.col("lang")).alias("label"), part.cast("double").alias("part")).where("part is not null")
    measured = spread(some, "doc_id").select("label", "text", "part", *[c.cast("double").alias(k) for k, c in features(F.col("text")).items()])
    rows = with_language(count_tokens(measured, counter, "label", "text", "part", *NAMES), model, "part", *NAMES, "tokens").toPandas()
    return _regress(rows[rows["part"] == 0], rows[rows["part"] == 1])


def _regress(fitted, holdout, least: int = 40, ridge: float = 1e-3) -> dict[str, np.ndarray]:
    def design(frame) -> np.ndarray:
        return np.column_stack([frame[list(NAMES)].to_numpy(float), np.ones(len(frame))])

    def solve(frame) -> np.ndarray:
        x, y = design(frame), frame["tokens"].to_numpy(float)
        scale = np.maximum(np.abs(x).mean(0), 1e-9)
        a = x / scale
        return np.linalg.solve(a.T @ a + ridge * len(a) * np.eye(a.shape[1]) * 1e-3, a.T @ y) / scale

    zero = np.zeros(len(NAMES) + 1)
    out = {"*": solve(fitted) if len(fitted) else zero}
    for language, frame in fitted.groupby("language"):
        if len(frame) >= least:
            out[str(language)] = solve(frame)
    for language, weights in list(out.items()):
        frame = holdout if language == "*" else holdout[holdout["language"] == language]
        estimate = (design(frame) @ weights).sum() if len(frame) else 0.0
        if len(frame) >= least and estimate > 0:
            out[language] = weights * (frame["tokens"].sum() / estimate)
    return out


def estimate_tokens(documents: DataFrame, weights: dict[str, np.ndarray], model: LanguageModel | None = None) -> DataFrame:
    """doc_id, source, language, site and ``est_tokens``, one row per document; null and empty texts have 0.

    Without a model the language is the label's. documents needs doc_id, text, lang, source, domain and source_url.
    """
    text = F.col("text")
    table = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.array(*[F.lit(float(v)) for v in w]))])
    blank = F.coalesce(F.char_length(F.trim("text")), F.lit(0)) == 0
    keys = documents.select("doc_id", "source", language_key(F.col("lang")).alias("label"), site_key(F.col("domain"), F.col("source_url")).alias("site"), "text", blank.alias("blank"), *[c.cast("double").alias(k) for k, c in features(text).items()])
    rows = with_language(spread(keys, "doc_id") if model else keys, model, "doc_id", "source", "site", "blank", *NAMES).withColumn("w", F.coalesce(table[F.col("language")], table[F.lit("*")]))
    total = F.element_at("w", len(NAMES) + 1)
    for k, name in enumerate(NAMES):
        total = total + F.element_at("w", k + 1) * F.col(name)
    return rows.select("doc_id", "source", "language", "site", F.when(F.col("blank"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), total)).alias("est_tokens"))


def token_budget(estimates: DataFrame) -> DataFrame:
    """Totals by source, by language and by site: dimension, value, documents, est_tokens. A missing value is a group of its own."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("source", "language", "site")]))
    return estimates.select("est_tokens", pairs.alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum("est_tokens")).cast("long").alias("est_tokens"))

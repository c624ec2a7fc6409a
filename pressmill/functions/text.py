"""Text scalars as Column expressions: counts, estimates, normalisation and dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space that is stripped from the ends of a text; a regular expression class.
SPACE = r"\u0009-\u000d\u001c-\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word: a run of letters, digits of any script and underscores.
WORD = r"[\p{L}\p{N}_]+"
#: End of a sentence: white space after a stop and before a capital, a digit or an opening quote.
SENTENCE_GAP = "(?<=[.?!])[" + SPACE + "]+(?=[A-Z0-9\"'“‘])"
TOKENS_PER_WORD = 1.33
WORDS_PER_MINUTE = 220.0


#: The characters of ``SPACE``.
SPACES = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end; looks at the ends only."""
    return F.trim(text, F.lit(SPACES))


def count_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("int")


def tokens_of_words(words: Column, per_word: float = TOKENS_PER_WORD) -> Column:
    """Words times a factor in double precision, rounded up."""
    return F.ceil(words.cast("double") * F.lit(float(per_word))).cast("int")


def estimate_tokens(text: Column, per_word: float = TOKENS_PER_WORD) -> Column:
    """Estimated tokens of a text; 0 for null and empty ones."""
    return tokens_of_words(count_words(text), per_word)


def reading_minutes(words: Column) -> Column:
    return F.round(words.cast("double") / F.lit(WORDS_PER_MINUTE), 2)


def word_count_or_own(stated: Column, text: Column) -> Column:
    """The stated word count unless it is null or 0, else the text's own."""
    return F.coalesce(F.nullif(stated.cast("int"), F.lit(0)), count_words(text))


def normalize_content(text: Column) -> Column:
    """Line ends, tabs and no-break spaces to blanks, runs of blanks to one, ends stripped; "" for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\r\n\t\u00a0", "    ")
    return strip(F.regexp_replace(flat, " {2,}", " "))


def normalize_str(text: Column) -> Column:
    """Runs of blanks to one and ends stripped; line ends inside stay; "" for null."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), " {2,}", " "))


def normalize_list(values: Column, rejected: tuple[str, ...] = ()) -> Column:
    """Every string normalised, without blank ones and those in ``rejected`` (compared in lower case)."""
    clean = F.transform(F.coalesce(values, F.array().cast("array<string>")), normalize_str)
    keep = F.filter(clean, lambda x: F.char_length(x) > 0)
    if rejected:
        keep = F.filter(keep, lambda x: ~F.lower(x).isin(*rejected))
    return keep


def split_list(text: Column, rejected: tuple[str, ...] = ()) -> Column:
    """A text cut at commas, tabs and line ends, as ``normalize_list``; an empty list for null."""
    return normalize_list(F.split(text, r"[\r\n\t,]+"), rejected)


_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)?)?$"


def normalize_datetime(text: Column) -> Column:
    """ISO dates and times as timestamps, those without zone in the session's zone; null for all else."""
    s = F.regexp_replace(strip(text), r"([+-]\d{2})(\d{2})$", "$1:$2")
    s = F.when(s.rlike(_ISO), F.regexp_replace(s, ",", "."))
    return F.try_to_timestamp(s)


def rfc822_datetime(text: Column) -> Column:
    """Dates of feeds, as in ``Tue, 02 Jan 2024 03:04:05 +0700``; null for all else."""
    s = F.regexp_replace(strip(text), r"^[A-Za-z]{3},\s*", "")
    s = F.regexp_replace(s, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    return F.when(s.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss Z")))


def to_number(text: Column) -> Column:
    """A whole number, of a decimal its whole part; null otherwise."""
    return F.coalesce(text.try_cast("int"), text.try_cast("double").try_cast("int"))


def image_type(url: Column) -> Column:
    """MIME type by what the URL contains, in the order webp, png, jpg, jpeg."""
    low = F.lower(url)
    return (
        F.when(low.contains("webp"), F.lit("image/webp")).when(low.contains("png"), F.lit("image/png")).when(low.contains("jpg") | low.contains("jpeg"), F.lit("image/jpeg"))
    )


def ttl_seconds(days: Column) -> Column:
    """Days as whole seconds; null for what is no number."""
    return (days.try_cast("double") * F.lit(86400.0)).try_cast("long")


def snake_case(text: Column) -> Column:
    """``camelCase``, ``PascalCase`` and ``kebab-case`` names in snake case."""
    s = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(s, r"[^A-Za-z0-9]+", "_"))


def pascal_case(text: Column) -> Column:
    parts = F.split(snake_case(text), "_")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.char_length(p)))), "")


def camel_case(text: Column) -> Column:
    p = pascal_case(text)
    return F.concat(F.lower(F.substring(p, 1, 1)), p.substr(F.lit(2), F.char_length(p)))

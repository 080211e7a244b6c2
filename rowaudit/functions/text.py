"""Text column builders: cleaning, tokens, pattern checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns used by the text checks.
URL_PATTERN = r"https?://"
HTML_TAG_PATTERN = r"<[a-zA-Z/!][^>]*>"
TOKEN_PATTERN = r"(?U)\w{2,}"  # maximal runs of 2+ word characters
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4_PATTERN = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
PHONE_PATTERN = r"\+?[0-9][0-9 ().-]{8,}[0-9]"
LINK_PATTERN, OTHER_PATTERN, GAP_PATTERN = r"http\S+", r"[^a-zA-Z0-9 ]", r"\s+"  # of clean_text
CARD_PATTERN = r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_count(c) -> Column:
    """Number of whitespace-separated runs (``str.split()`` length)."""
    return F.coalesce(F.regexp_count(_col(c), F.lit(r"\S+")), F.lit(0))


def clean_text(c) -> Column:
    """lower, drop links, non-alphanumerics to space, collapse spaces, strip."""
    x = F.lower(F.coalesce(_col(c), F.lit("")))
    x = F.regexp_replace(x, LINK_PATTERN, "")
    x = F.regexp_replace(x, OTHER_PATTERN, " ")
    x = F.regexp_replace(x, GAP_PATTERN, " ")
    return F.trim(x)


def tokens(c) -> Column:
    """Lower-cased tokens of two or more word characters (Unicode aware)."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN_PATTERN), 0)


def has_url(c) -> Column:
    return _col(c).rlike(URL_PATTERN)


def has_html(c) -> Column:
    return _col(c).rlike(HTML_TAG_PATTERN)


def pii_kind(c) -> Column:
    """First personal-data kind found: email, card, ipv4, phone; null if none."""
    x = _col(c)
    return F.coalesce(
        F.when(x.rlike(EMAIL_PATTERN), F.lit("email")),
        F.when(x.rlike(CARD_PATTERN), F.lit("card")),
        F.when(x.rlike(IPV4_PATTERN), F.lit("ipv4")),
        F.when(x.rlike(PHONE_PATTERN), F.lit("phone")),
    )


# Frequent function words by language, for texts without a language column.
FUNCTION_WORDS = {
    "de": ["als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu", "zum"],
    "en": ["and", "are", "as", "at", "by", "for", "from", "have", "is", "not", "of", "on", "that", "the", "this", "to", "was", "with"],
    "es": ["al", "como", "con", "del", "el", "en", "es", "las", "los", "no", "para", "por", "que", "se", "su", "una", "un", "la"],
    "fr": ["au", "avec", "ce", "dans", "des", "du", "est", "et", "la", "le", "les", "ne", "pas", "pour", "que", "qui", "sur", "une"],
}


def function_word_counts(c, words: dict[str, list[str]] | None = None) -> Column:
    """Array of (hits, lang): how many of the text's tokens are function words of each language."""
    toks = tokens(c)

    def hits(some: list[str]) -> Column:
        return F.size(F.filter(toks, lambda t: t.isin(some)))

    return F.array(*[F.struct(hits(some).alias("hits"), F.lit(lang).alias("lang")) for lang, some in sorted((words or FUNCTION_WORDS).items())])


def likely_language(c, words: dict[str, list[str]] | None = None) -> Column:
    """The language with most function words in the text, of equals the first by name; null without any."""
    best = F.reduce(function_word_counts(c, words), F.struct(F.lit(0).alias("hits"), F.lit(None).cast("string").alias("lang")),
                    lambda a, x: F.when(x["hits"] > a["hits"], x).otherwise(a))
    return best["lang"]

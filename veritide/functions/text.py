"""Tokenizers T1-T7, sentences and other text columns; words are runs of letters, digits and underscores of any script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

#: Stop words of the metric tokenizer, those that the claim tokenizers add, and those of the keyword tokenizer.
STOP = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "are", "was", "were", "it", "its",
    "we", "our", "us", "this", "that", "be", "been", "has", "have", "had",
)
STOP_CLAIMS = (*STOP, "will", "would", "could", "should", "these", "those", "their")
STOP_KEYWORDS = (
    "the", "and", "for", "are", "with", "this", "that", "from", "have",
    "has", "been", "will", "would", "could", "should", "about", "into",
    "through", "over", "after", "before", "between", "under", "also",
)


def words(c: Column) -> Column:
    """T1: lower-cased words."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def metric_words(c: Column, stop=STOP) -> Column:
    """T2 (T3 with STOP_CLAIMS): words of more than two characters that are no stop words, with repeats."""
    return F.filter(words(c), lambda t: (F.char_length(t) > 2) & ~t.isin(*stop))


def source_words(c: Column) -> Column:
    """T4: distinct words of four characters and more without the claim stop words."""
    return F.array_distinct(F.filter(words(c), lambda t: (F.char_length(t) >= 4) & ~t.isin(*STOP_CLAIMS)))


def long_words(c: Column, least: int) -> Column:
    """T5 (least 3) and T6 (least 4): distinct words of at least ``least`` characters."""
    return F.array_distinct(F.filter(words(c), lambda t: F.char_length(t) >= least))


def keywords(c: Column, least: int = 4) -> Column:
    """T7: white-space words, checked before punctuation is stripped; the empty word may stay."""
    parts = F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), " "), lambda t: F.char_length(t) >= least)
    kept = F.filter(parts, lambda t: ~t.isin(*STOP_KEYWORDS))
    return F.array_distinct(F.transform(kept, lambda t: F.regexp_replace(t, r"^[.,!?:;\"'()\[\]{}]+|[.,!?:;\"'()\[\]{}]+$", "")))


def sentences(c: Column) -> Column:
    """Split behind . ! ? and white space; stripped, without empty ones."""
    parts = F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of ``a`` that ``b`` has; 0 where ``a`` is empty."""
    x = F.array_distinct(a)
    return F.size(F.array_intersect(x, b)) / F.greatest(F.size(x), F.lit(1))


def bucket(token: Column, dims: int) -> Column:
    """Stable hash bucket of a token: the first 8 hex digits of its MD5 modulo ``dims``."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dims).cast("int")


def sign(token: Column) -> Column:
    """1 or -1 from the ninth hex digit of a token's MD5."""
    return F.when(F.conv(F.substring(F.md5(token), 9, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def slug(c: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends; ``kpi`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "kpi").otherwise(s)

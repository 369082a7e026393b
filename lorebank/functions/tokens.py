"""The three tokenisers (they differ on purpose): chunk segments, index terms, overlap tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions.text import col_of

# One token with the blanks behind it, so that segments re-concatenate to the text. A word token (one
# ideograph or one run of letters, marks and digits) takes one directly following punctuation mark.
SEGMENT = (
    rf"(?:(?:[{K.CJK}]|[\p{{L}}\p{{M}}\p{{N}}]+)\p{{P}}?|[^{K.WS}\p{{L}}\p{{M}}\p{{N}}])[{K.WS}]*"
)
_BIGRAM = rf"(?=([{K.CJK}]{{2}}))"


def segments(c: Column | str) -> Column:
    return F.regexp_extract_all(col_of(c), F.lit(SEGMENT), F.lit(0))


def _bigrams(lowered: Column) -> Column:
    # looking for one pair is quicker than trying every place
    return F.when(lowered.rlike(f"[{K.CJK}]{{2}}"), F.regexp_extract_all(lowered, F.lit(_BIGRAM), F.lit(1))).otherwise(F.array().cast("array<string>"))


def search_terms(c: Column | str) -> Column:
    """Distinct index terms: ASCII word runs, then overlapping ideograph pairs, first-seen order."""
    text = F.lower(F.coalesce(col_of(c), F.lit("")))
    words = F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.concat(words, _bigrams(text)))


def overlap_tokens(c: Column | str) -> Column:
    """Tokens for overlap scores, duplicates kept: words longer than one character, ideograph pairs."""
    text = F.lower(F.coalesce(col_of(c), F.lit("")))
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1)
    return F.concat(words, _bigrams(text))

"""Text expressions for sentence preparation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split() treats as whitespace, as a
# regex class (same spelling works in Java regex and RE2).
WHITESPACE_RUN = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
# Sentence boundary: the two characters ". " (regex-escaped for split()).
SENTENCE_BOUNDARY = r"\. "
# Sentence length rule: MIN_LEN < length < MAX_LEN, in code points, after trimming.
MIN_LEN = 20
MAX_LEN = 300
# Preview widths: text characters and vector-literal characters.
TEXT_PREVIEW = 80
VECTOR_PREVIEW = 60


def collapse_whitespace(c: Column) -> Column:
    """``" ".join(text.split())``: runs of whitespace -> one space, trimmed."""
    return F.trim(F.regexp_replace(c, WHITESPACE_RUN, " "))


def split_sentences(c: Column) -> Column:
    """array of pieces between ". " boundaries, in order."""
    return F.split(c, SENTENCE_BOUNDARY, -1)


def length_ok(c: Column) -> Column:
    """Strict length window."""
    n = F.length(c)
    return (n > MIN_LEN) & (n < MAX_LEN)


def preview(c: Column, width: int = TEXT_PREVIEW) -> Column:
    return F.substring(c, 1, width)

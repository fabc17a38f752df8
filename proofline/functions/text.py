"""Column expressions over text: languages, words, headings, markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns below define what counts as a cue, a word and a heading.
CUE = r"\d{1,2}:\d{2}:\d{2}[,.]\d{3}\s+-->\s+\d{1,2}:\d{2}:\d{2}[,.]\d{3}"
CLOCK = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{3})"
WORD = r"(?U)\b[\w–—'-]+\b"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def normalize_language(col: Column) -> Column:
    return F.lower(F.translate(strip(F.coalesce(col, F.lit(""))), "_", "-"))


def language_matches(left: Column, right: Column) -> Column:
    """Both non-empty and equal, or sharing the primary subtag."""
    present = (F.coalesce(left, F.lit("")) != "") & (F.coalesce(right, F.lit("")) != "")
    same = (left == right) | (F.split_part(left, F.lit("-"), F.lit(1)) == F.split_part(right, F.lit("-"), F.lit(1)))
    return F.coalesce(present & same, F.lit(False))


def clock_ms(col: Column) -> Column:
    part = [F.regexp_extract(col, CLOCK, i).cast("bigint") for i in range(1, 5)]
    return part[0] * 3_600_000 + part[1] * 60_000 + part[2] * 1000 + part[3]


def lines(col: Column) -> Column:
    """Split on every character Python's ``splitlines`` treats as a line break."""
    return F.split(col, LINE_BREAK)


def word_count(col: Column) -> Column:
    return F.size(F.regexp_extract_all(col, F.lit(WORD), F.lit(0)))


def count_matches(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)).cast("bigint")

"""Repair of extracted text as column expressions; only entities and Unicode normalisation, which Spark lacks, run on Arrow batches."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters of typesetting and the plain ones that stand for them, characters without width, bullets, line ends.
QUOTES, PLAIN_QUOTES = "‘’“”–—−\u00a0", "''\"\"--- "
WIDTHLESS = "\u200b"
BULLETS = "[•●▪‣·]"
LINE_ENDS = r"\R|[\x1c-\x1e]"


def _folded(text: Column) -> Column:
    """Entities read, compatibility forms (ligatures, wide blanks) made plain."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: None if t is None else unicodedata.normalize("NFKC", html.unescape(t)))

    return run(text)


def cleaned(text: Column) -> Column:
    """Plain glyphs, single blanks, no more than one empty line, no blanks around lines, bullets at the head of their text; null stays null."""
    plain = F.translate(_folded(text), QUOTES + WIDTHLESS, PLAIN_QUOTES)
    steps = ((BULLETS, "\n- "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (LINE_ENDS, "\n"), (r"(?U)[^\S\n]*\n[^\S\n]*", "\n"), (r"(?U)^\s+|\s+$", ""), (r"(?m)^[-*]\s*\n+(?=\S)", "- "))
    for pattern, by in steps:
        plain = F.regexp_replace(plain, pattern, by)
    return F.regexp_replace(plain, r"(?U)^\s+|\s+$", "")

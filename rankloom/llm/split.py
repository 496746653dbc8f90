"""Problem 1: cut oversized texts into overlapping pieces at natural boundaries.

Recursive bisection: a span that is longer than ``limit - overlap`` is cut at the strongest boundary near
its middle, and both halves are treated alike. Then every piece but the first is extended to the left by
``overlap`` characters, so that neighbours share exactly that many and no piece exceeds ``limit``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 400, 40

#: Strength of a boundary and where it lies: the cut comes after the match.
_BOUNDARIES = (
    (7, re.compile(r"\n[^\S\n]*\n\s*")),
    (6, re.compile(r"\n")),
    (5, re.compile(r"(?:[.!?…]+[\"'»”’)\]]*\s+(?=[^\W_]|[\"'«“‘(\[¿¡-])|[。！？]+[」』”]?)")),
    (4, re.compile(r"(?:[;:|]\s*|\s[–—-]\s|[；：])")),
    (3, re.compile(r"(?:,\s+|[，、])")),
    (2, re.compile(r"\s+")),
    (1, re.compile(r"[-_/\\,.]+")),
)
#: A dot after one of these words (or after a single letter or a number) ends no sentence.
_ABBREVIATIONS = frozenset("approx ca dr e.g etc evtl i.e mr mrs ms no nr prof resp sr sra st usw vs z.b".split())


def _no_sentence(text: str, start: int) -> bool:
    """Whether the mark at ``start`` stands after an abbreviation or an initial."""
    if text[start] != ".":
        return False
    word = re.search(r"[\w.]*$", text[max(0, start - 12) : start]).group().lower()
    return word in _ABBREVIATIONS or (len(word) == 1 and word.isalpha())


def _strengths(text: str) -> dict[int, int]:
    """Cut position -> strength of the strongest boundary there."""
    at: dict[int, int] = {}
    for strength, pattern in reversed(_BOUNDARIES):
        for m in pattern.finditer(text):
            if strength == 5 and _no_sentence(text, m.start()):
                continue
            at[m.end()] = strength
    return at


def _whole(text: str, at: int) -> int:
    """The nearest position at or before ``at`` that parts no combined character (by at most 16)."""
    for back in range(16):
        i = at - back
        if i <= 0:
            break
        if not (unicodedata.combining(text[i]) or text[i] in "‍️" or text[i - 1] == "‍" or "\U0001f3fb" <= text[i] <= "\U0001f3ff"):
            return i
    return at


def cut_points(text: str, most: int, least: int) -> list[int]:
    """Inner cut positions of the recursive bisection; spans stay at or under ``most`` and at or above ``least``."""
    strengths = _strengths(text)
    places = sorted(strengths)
    cuts: list[int] = []
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        n = b - a
        if n <= most:
            continue
        # A span of fewer than two pieces leaves the middle as much freedom as the limit allows; a long one a quarter.
        lo, hi = (max(a + least, b - most), min(b - least, a + most)) if n <= 2 * most else (a + max(least, n // 4), b - max(least, n // 4))
        middle = (a + b) / 2
        best = None
        for p in _between(places, lo, hi):
            key = (strengths[p], -abs(p - middle), -p)
            if best is None or key > best[0]:
                best = (key, p)
        cut = best[1] if best else _whole(text, (a + b) // 2)
        cuts.append(cut)
        todo += [(a, cut), (cut, b)]
    return sorted(cuts)


def _between(places: list[int], lo: int, hi: int) -> list[int]:
    from bisect import bisect_left, bisect_right

    return places[bisect_left(places, lo) : bisect_right(places, hi)]


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans ``[start, end)`` of the pieces of a text, in order; none for null, one for a text within the limit."""
    if not 0 <= overlap < limit / 3:
        raise ValueError("the overlap must be less than a third of the limit")
    if text is None:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    cuts = cut_points(text, limit - overlap, max(1, overlap))
    return [(max(0, a - overlap), b) for a, b in zip([0, *cuts], [*cuts, len(text)])]


def split_oversized(df: DataFrame, keys: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every distinct text longer than ``limit`` after dropping spaces (U+0020) at both ends.

    Gives ``keys``, ``n_chars`` (of the text without those spaces), ``piece_no`` (from 0), ``start``, ``end`` and
    ``piece``. Texts within the limit, empty and null ones have no rows; repeated rows count once; null keys stay
    null; other columns are left out, so their names can't clash. Only oversized rows are shuffled and reach Python.
    """
    long = (
        df.select(*keys, F.trim(text).alias("__text"))
        .where(F.length("__text") > limit)
        .distinct()
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False, name=None):
                whole = row[-1]
                for i, (a, b) in enumerate(split_text(whole, limit, overlap)):
                    rows.append((*row[:-1], len(whole), i, a, b, whole[a:b]))
            out = pd.DataFrame(rows, columns=[*keys, "n_chars", "piece_no", "start", "end", "piece"], dtype=object)
            yield out

    return long.mapInPandas(pieces, f"{schema}, n_chars int, piece_no int, start int, end int, piece string")

"""Problem 5: values entered freely -> entries of a canonical list, or none.

The distinct values are normalised, candidates come from an inverted index of character n-grams over the list and its known
other spellings, each candidate gets a cosine with weights that favour rare n-grams, and the best is accepted if its cosine reaches the threshold and
exceeds that of the next entry by the margin. A word-by-word check only takes entries out. The list is a fixed table; its size is checked before
it's sent to the executors.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.edits import edits
from rankloom.session import per_worker, spread

#: A list beyond this many rows is refused, as it is held by every executor.
MOST_TERMS = 200_000
#: Least cosine of an entry that is accepted, and how much more than that of the next entry it has to be.
THRESHOLD, MARGIN = 0.15, 0.02
#: The word check: entries that differ more than this, or by so much more than the closest one, aren't meant however alike their n-grams.
WORST, SLACK = 0.34, 0.1

# Words that say how well or where something is mastered, not what.
_LEVELS = frozenset(
    "adv advanced basic basics beginner certified etc exp experience experienced expert expertise familiar familiarity fluent good intermediate"
    " knowledge level mos months plus proficiency proficient self skill skills solid some strong suite taught tool tools very working year years yr yrs".split()
)
_LINKS = frozenset("of in with and the for to on a an using und et y".split())
#: Misreadings of letter groups by scanners.
_READ_AS = (("rn", "m"), ("ii", "u"), ("cl", "d"), ("0", "o"), ("1", "l"), ("5", "s"))


def words_of(value: str) -> list[str]:
    """Lower-case words without remarks in brackets, bullets, versions, years, levels and linking words."""
    s = unicodedata.normalize("NFKC", value).lower()
    s = re.sub(r"\([^)]*\)?|\[[^\]]*\]?", " ", s)
    s = re.sub(r"\s[-–—]\s*\d+\+?\s*\w+\s*$", " ", s)
    s = re.sub(r"(?:^|(?<=[\s,]))v?\d+(?:\.\d+)*\+?(?=$|[\s,;.*])", " ", s)
    words = re.findall(r"[^\W_]+", s)
    kept = [w for w in words if w not in _LEVELS and w not in _LINKS]
    return kept or [w for w in words if w not in _LINKS]


def grams(words: list[str]) -> Counter:
    """2- and 3-grams of the words, each with its ends marked, and of the whole without gaps."""
    out: Counter = Counter()
    for w in {*words, "".join(words)}:
        marked = f"^{w}$"
        for n in (2, 3):
            for i in range(len(marked) - n + 1):
                out[marked[i : i + n]] += 1
    return out


def shortened(short: str, word: str) -> bool:
    """Whether ``short`` abbreviates ``word``: its letters in order from the first on, at most two thirds of them."""
    for s in {short, short[:-1] if short.endswith("s") else short}:
        if 3 <= len(s) <= max(3, len(word) * 2 // 3 + 1) and s[0] == word[0] and s != word:
            it = iter(word)
            if all(c in it for c in s):
                return True
    return False


def _allowed(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2 if len(word) < 12 else 3


def _word_cost(entered: str, word: str) -> float | None:
    """0 for equal words, rising with the edits; None if ``entered`` can't stand for ``word``."""
    if entered == word:
        return 0.0
    most = _allowed(word)
    d = min(edits(x, word, most) for x in _readings(entered))
    if d <= most and (d < 2 or entered[0] == word[0] or entered[-1] == word[-1]):
        return d / max(len(word), 4)
    if entered in (word + "s", word + "es"):
        return 0.05
    return 0.12 if shortened(entered, word) else None


def _readings(word: str) -> set[str]:
    out = {word}
    for a, b in _READ_AS:
        if a in word:
            out |= {w.replace(a, b) for w in out}
    return out


class Index:
    """Inverted n-gram index over (term, canonical entry) pairs."""

    def __init__(self, terms: list[tuple[str, str]]):
        self.terms = sorted({(tuple(words_of(t)) or (t.lower(),), c) for t, c in terms})
        self.alike: dict[tuple[str, ...], str] = {w: c for w, c in self.terms}
        self._learn_heads()
        n = len(self.terms)
        bags = [grams(list(w)) for w, _ in self.terms]
        df = Counter(g for b in bags for g in b)
        self.idf = {g: math.log(1 + n / k) for g, k in df.items()}
        self.rare = math.log(1 + n)
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, b in enumerate(bags):
            norm = math.sqrt(sum((k * self.idf[g]) ** 2 for g, k in b.items()))
            for g, k in b.items():
                self.postings[g].append((i, k * self.idf[g] / norm))

    def _learn_heads(self) -> None:
        """Other spellings that replace the head of some entries replace it in the other entries, too."""
        canon = {tuple(words_of(c)): c for _, c in self.terms}
        heads: dict[tuple[str, ...], Counter] = defaultdict(Counter)
        for w, c in self.terms:
            cw = tuple(words_of(c))
            if len(w) > 1 and len(cw) > 1 and w != cw and w[-1] == cw[-1] and len(cw) == 2:
                heads[w[:-1]][cw[:-1]] += 1
        more = []
        for alias, targets in heads.items():
            head, _ = targets.most_common(1)[0]
            for cw, c in canon.items():
                if len(cw) == 2 and cw[:-1] == head and (alias + cw[-1:]) not in self.alike:
                    more.append((alias + cw[-1:], c))
        self.terms = sorted({*self.terms, *more})
        self.alike |= dict(more)

    def cosines(self, words: list[str]) -> list[tuple[float, int]]:
        """Candidates that share a rare enough n-gram, best first."""
        bag = grams(words)
        weights = {g: k * self.idf.get(g, self.rare) for g, k in bag.items()}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        score: dict[int, float] = defaultdict(float)
        for g, w in weights.items():
            for i, v in self.postings.get(g, ()):
                score[i] += w * v
        return sorted(((s / norm, i) for i, s in score.items()), key=lambda x: (-x[0], x[1]))

    def cost(self, words: list[str], term: tuple[str, ...]) -> float | None:
        """How far the words are from a term: word by word in any order, or run together; None if too far."""
        whole, joined = "".join(term), "".join(words)
        best = None
        most = min(3, sum(_allowed(w) for w in term))
        d = min(edits(x, whole, most) for x in _readings(joined))
        if len(whole) < 6 and d:
            d = most + 1
        if d <= most and (len(term) == 1 or d <= 2):
            best = d / max(len(whole), 4)
        if len(term) > 1 and len(words) >= len(term):
            total, left = 0.0, list(words)
            for w in sorted(term, key=len, reverse=True):
                costs = [(c, i) for i, x in enumerate(left) if (c := _word_cost(x, w)) is not None]
                if not costs:
                    break
                c, i = min(costs)
                total += c
                left.pop(i)
            else:
                total = total / len(term) + 0.2 * len(left)
                best = total if best is None else min(best, total)
        return best

    def match(self, value: str) -> tuple[str, float]:
        """(entry, cosine); the entry is empty if none is meant."""
        words = words_of(value)
        if not words:
            return "", 0.0
        if (exact := self.alike.get(tuple(words))) is not None:
            return exact, 1.0
        near = []
        ranked = self.cosines(words)
        for s, i in ranked:
            if s < THRESHOLD:
                break
            term, entry = self.terms[i]
            c = self.cost(words, term)
            if c is not None and c <= WORST:
                near.append((s, c, entry))
        least = min((c for _, c, _ in near), default=0.0)
        by_entry: dict[str, float] = {}
        for s, c, entry in near:
            if c <= least + SLACK:
                by_entry[entry] = max(by_entry.get(entry, 0.0), s)
        best = sorted(((s, e) for e, s in by_entry.items()), key=lambda x: (-x[0], x[1]))
        if not best or (len(best) > 1 and best[0][0] - best[1][0] < MARGIN):
            return "", ranked[0][0] if ranked else 0.0
        return best[0][1], best[0][0]


def match_values(values: DataFrame, terms: DataFrame, value: str = "entered") -> DataFrame:
    """(``value``, match, score) for each distinct non-blank value; match is '' where no entry is meant.

    ``terms`` has (term, canon): the entries themselves and other spellings of them. Null and blank values have no row; repeated values
    have one; very long ones are compared whole. An empty list matches nothing; an empty table gives an empty one.
    """
    rows = terms.where("term is not null and canon is not null").select("term", "canon").distinct().limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"the canonical list has more than {MOST_TERMS} terms")
    sent = values.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])
    # Repeated values are put together first; short as they are, the planner would give all of them to one task.
    distinct = spread(values.select(value).where(F.col(value).rlike(r"(?U)[^\s\p{Z}]")).distinct())
    mark = f"canon {uuid.uuid4()}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = per_worker(mark, lambda: Index(sent.value))
        for batch in batches:
            found = [index.match(v) for v in batch[value]]
            yield pd.DataFrame({value: batch[value], "match": [m for m, _ in found], "score": [s for _, s in found]})

    return distinct.mapInPandas(run, f"`{value}` string, match string, score double")

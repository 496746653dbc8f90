"""Problem 6: repairing text from scanned pages.

A symmetric-delete index over the words of the corpus proposes what a doubtful word may be; an edit distance in which
misreadings of scanners (letters that look alike) cost little, the words beside it and the frequencies pick the repair. Words whose
difference isn't made of such misreadings (slips of typing, names) stay. Page numbers and running headers are told by their form, their order
and their repetition; words broken over lines by the line they go on in.

Nothing of the corpus is gathered: the texts are read for the counts of words and pairs and for the words that are in doubt in a scan, both
sides of the index are joined, and each scan then gets what the corpus knows of its own doubtful words.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from rankloom.functions.edits import edits
from rankloom.llm.personal import _EMAIL
from rankloom.session import if_small, spread, stored

#: A word belongs to the lexicon from this number of texts on, whatever the size of the corpus.
LEAST = 2
#: A word counts as doubtful if its repair is this many times as frequent; without a pair of words that speaks for it, CLEAR times.
RATIO, CLEAR = 8, 20
#: Different words and pairs that are counted together before they are handed on.
FLUSH = 400_000

# What is read -> what stands there.
_MISREAD = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("5", "s"), ("9", "g"), ("+", "t"), ("@", "a"), ("c", "e"), ("b", "h"), ("$", "s"), ("8", "b"), ("6", "b"), ("!", "l"), ("!", "i"), ("3", "e"), ("4", "a"), ("7", "t"),
    ("l", "i"), ("i", "l"), ("rn", "m"), ("ii", "u"), ("11", "u"), ("1i", "u"), ("i1", "u"), ("li", "u"), ("cl", "d"), ("c|", "d"), ("c1", "d"), ("vv", "w"), ("m", "rn"), ("d", "cl"), ("w", "vv"), ("h", "li"), ("in", "m"), ("ni", "m"), ("nn", "rm"), ("q", "g"), ("e", "c"), ("o", "c"), ("h", "b"), ("u", "ii"),
)
#: Read and meant are both letters that are easily confounded by people as well; these alone need a frequent word.
_COST, _PLAIN = 0.25, 1.0
_SYMBOLS = {"0": "o", "5": "s", "9": "g", "+": "t", "@": "a", "$": "s", "8": "b"}
_HYPHENS = "-‐‑¬­~"
_LINKS = frozenset("and or und oder et ou y o to bis as bzw nor but".split())
_SKILLS = ("skills", "technical skills", "tools", "core skills", "key skills", "competencies", "technologies", "expertise")
_SECTIONS = (
    "experience", "work experience", "work history", "employment", "education", "projects", "selected projects", "summary", "profile", "professional profile", "about me", "references",
    "certifications", "languages", "interests", "publications", "awards", "contact",
)
_WORD = re.compile(r"\p{L}[\p{L}\p{M}'’]*")
_TOKEN = re.compile(r"[^\s,;:()\"“”«»/]+")
_PAGE = re.compile(
    r"^(?:[\[(]\s*(?P<a>[\dlIO|]{1,3})\s*[\])]|[-–—]\s*(?P<b>[\dlIO|]{1,3})\s*[-–—]|(?:p\.?|pg\.?|page|seite|s\.|página|pág\.|p[aá@][gq9][ec])\s*(?P<c>[\dlIO|]{1,3})(?:\s*(?:of|von|de|sur|/|0f|ot)\s*[\dlIO|]{1,3})?|(?P<d>[\dlIO|]{1,3})\s*(?:/|of|von|de)\s*[\dlIO|]{1,3}|(?P<e>\d{1,2}|[lI|])|(?P<f>[ivxl]{1,6}))$",
    re.I,
)
_PAGE_INSIDE = re.compile(r"(?:^|[\s|·•–—-])(?:page|seite|página|p\.|p[aá@][gq9][ec])\s*[\dlIO|]{1,3}(?:\s*(?:of|von|de|/)\s*[\dlIO|]{1,3})?\s*$", re.I)


_ODD, _LETTER, _SYMBOL = re.compile(r"[^\p{L}\p{M}'’]"), re.compile(r"\p{L}"), re.compile(r"[\d@+|$!]")
_PIECE = re.compile(rf"[^{_HYPHENS}–—•*]+")
_CAPITALS = re.compile(r"[\p{Lu}l]+")
_NUMBER = re.compile(r"[\d.,%]+|\d+[a-z]?|\p{L}\d\p{L}|\d\p{L}|\p{L}{0,3}\d[\d\p{Lu}-]*")
_DIGITS, _BLANKS, _C_BAR = re.compile(r"\d+"), re.compile(r"\s+"), re.compile(r"c[1|]")
_BROKEN = re.compile(rf"([\p{{L}}\p{{N}}@+|]+)[{_HYPHENS}]$")
_HEAD = re.compile(rf"([^\s,;:()\-‐]+)[{_HYPHENS}]$")
_TAIL = re.compile(r"\s*([^\s,;:()\-‐]+)")
_AT = re.compile(r"[\[({]\s?at\s?[\])}]", re.I)
_JOINED = re.compile(rf"[{_HYPHENS}]\s*\n\s*")
_BEGIN = re.compile(r"\s*([\p{L}\p{N}@+|]+)")
_ROMAN = {"i": 1, "l": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12, "xiii": 13, "xiv": 14, "xv": 15}


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _squeezed(line: str) -> str:
    return _DIGITS.sub("#", _BLANKS.sub(" ", line.strip())).lower()


def page_lines(lines: list[str]) -> set[int]:
    """Indices of lines that give the page number. A bare number has to go on counting from the page before, or start at 1."""
    hits = []
    for i, line in enumerate(lines):
        text = line.strip()
        m = _PAGE.match(text)
        if m is None:
            continue
        if m.lastgroup in ("e", "f") and text.lower() in _ROMAN:
            hits.append((i, _ROMAN[text.lower()], True))
        elif m.lastgroup != "f":
            number = next(g for g in m.groups() if g)
            hits.append((i, int(re.sub("[lI|]", "1", re.sub("O", "0", number, flags=re.I), flags=re.I)), m.lastgroup == "e"))
    out, last = set(), 0
    for i, n, bare in hits:
        if not bare:
            out.add(i)
            last = max(last, n)
        elif n == last + 1:
            out.add(i)
            last = n
    return out


def header_lines(lines: list[str]) -> set[int]:
    """Indices of the lines that repeat the first line of the text, the first included; glyph errors are put up with."""
    filled = [i for i, line in enumerate(lines) if line.strip()]
    if not filled:
        return set()
    first = _squeezed(lines[filled[0]])
    if len(first) < 4:
        return set()
    most = max(1, min(6, len(first) // 8))
    same = [i for i in filled if abs(len(s := _squeezed(lines[i])) - len(first)) <= most and edits(s, first, most) <= most]
    return set(same) if len(same) > 1 else set()


def _heading(s: str) -> str:
    """'skills' for the heading of a skill list, 'other' for that of another section, '' for neither; glyph errors are put up with."""
    kind = _headings.get(s)
    if kind is None:
        if len(_headings) > 100_000:
            _headings.clear()
        plain = "".join(_SYMBOLS.get(c, "l" if c in "1|" else c) for c in s)
        near = lambda k, most: abs(len(plain) - len(k)) <= most and edits(plain, k, most) <= most
        kind = "skills" if any(near(k, 2 if len(k) > 6 else 1) for k in _SKILLS) else "other" if any(near(k, 2) for k in _SECTIONS) else ""
        _headings[s] = kind
    return kind


_headings: dict[str, str] = {}


def skill_lines(lines: list[str], pages: set[int], heads: set[int]) -> set[int]:
    """Indices of the lines of a skill list: those after its heading up to the next heading."""
    out, inside = set(), False
    for i, line in enumerate(lines):
        if i in pages or i in heads:
            continue
        s = line.strip().rstrip(":").lower()
        kind = _heading(s) if s and len(s) < 25 and len(s.split()) < 4 else ""
        if kind == "skills":
            inside = True
            continue
        if kind == "other":
            inside = False
        if inside:
            out.add(i)
    return out


def deletes(word: str) -> set[str]:
    """A word and what is left of it without up to two letters, of short words without one."""
    out, now = {word}, {word}
    for _ in range(2 if len(word) > 4 else 1):
        now = {w[:i] + w[i + 1 :] for w in now for i in range(len(w))}
        out |= now
    return out


def distance(read: str, meant: str, most: float = 0.99) -> float:
    """Edit distance in which misreadings cost a quarter of other edits; above ``most`` it isn't exact."""
    rows = [[math.inf] * (len(meant) + 1) for _ in range(len(read) + 1)]
    rows[0][0] = 0.0
    for i in range(len(read) + 1):
        for j in range(len(meant) + 1):
            v = rows[i][j]
            if v > most:
                continue
            if i < len(read) and j < len(meant):
                c = v + (0.0 if read[i] == meant[j] else _PLAIN)
                if c < rows[i + 1][j + 1]:
                    rows[i + 1][j + 1] = c
            for a, b in _BY_FIRST.get(read[i : i + 1], ()):
                if read.startswith(a, i) and meant.startswith(b, j) and v + _COST < rows[i + len(a)][j + len(b)]:
                    rows[i + len(a)][j + len(b)] = v + _COST
    return rows[-1][-1]


def forms(word: str) -> set[str]:
    """The word with symbols read as letters, and letter groups as the letters they look like."""
    base = "".join(_SYMBOLS.get(c, c) for c in _C_BAR.sub("d", word))
    out = {base.replace("1", a).replace("|", a).replace("!", a) for a in "li"}
    for f in list(out):
        out |= {f.replace(a, b) for a, b in (("rn", "m"), ("ii", "u"), ("cl", "d"), ("vv", "w")) if a in f}
    return out


def skeleton(word: Column) -> Column:
    """What a word and all its misreadings have in common: letters that are taken for one another as one, runs of strokes as one stroke."""
    wide = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "w", "vv"), "d", "cl"), "[mhbu86]", "l")
    return F.regexp_replace(F.translate(wide, "0ce3" + "1i|!rn" + "5$" + "9q" + "+7" + "@4", "oooo" + "llllll" + "ss" + "gg" + "tt" + "aa"), "l+", "l")


def _strange(word: str) -> bool:
    return _ODD.search(word) is not None


def _askable(word: str) -> bool:
    """Whether a word could be a misreading at all."""
    strange = _strange(word)
    if len(word) < 3 and not strange or len(word) > 30 or not _LETTER.search(word) or strange and len(_SYMBOL.findall(word)) * 2 > len(word):
        return False
    return strange or any(a in word for a, _ in _LETTER_PAIRS)


class Lexicon:
    """What the corpus knows of the words of one text.

    counts: in how many other texts a word stands; near: words that a word may be a misreading of, with distance and number of texts; pairs: in
    how many texts two words are neighbours.
    """

    def __init__(self, counts: dict[str, int], near: dict[str, list[tuple[str, float, int]]], pairs: dict[tuple[str, str], int]):
        self.counts, self.near, self.pairs = counts, near, pairs

    def repair(self, word: str, before: str, after: str, extra: Counter) -> str | None:
        """What a doubtful lower-case word most likely stands for, or None if it may stay. ``extra``: the words of the text itself."""
        near = self.near.get(word)
        if near is None and not _ODD.search(word) or not _askable(word):
            return None
        strange, near = _strange(word), near or []
        own = 0 if strange else self.counts.get(word, 0)
        if not strange and extra[word] > 1 and own == 0:
            return None
        if strange:
            known = {c for c, _, _ in near}
            near = near + [(f, distance(word, f), 1) for f in sorted(forms(word)) if f not in known and extra[f]]
        best = None
        for c, d, n in near:
            if not strange and n < RATIO * max(own, 1):
                continue
            context = self.pairs.get((before, c), 0) + self.pairs.get((c, after), 0)
            if not strange and not context and n < CLEAR * max(own, 1):
                continue
            key = (-d + 0.03 * math.log1p(context) + 0.06 * math.log1p(n), n, c)
            if best is None or key > best[0]:
                best = (key, c)
        return best[1] if best else None

    def asks(self, word: str) -> None:
        """Called for words whose count decides."""

    def goes_on(self, a: str, b: str) -> bool:
        """Whether a line's last word goes on in a word that could stand alone, as after a hyphen that parts 'pre- and post-'."""
        return self.counts.get(a + b, 0) > 0 and self.pairs.get((a, b), 0) < self.counts[a + b]

    def compound(self, a: str, b: str) -> bool:
        """Whether two words are neighbours elsewhere and never one word, so that the hyphen between them stays."""
        return self.pairs.get((a, b), 0) > 0 and self.counts.get(a + b, 0) == 0


class Asked(Lexicon):
    """Takes down what a text would ask a lexicon, and answers nothing."""

    def __init__(self, assume: bool):
        super().__init__({}, {}, {})
        self.assume, self.doubts, self.wholes, self.links = assume, set(), set(), set()

    def repair(self, word: str, before: str, after: str, extra: Counter) -> None:
        if _askable(word):
            self.doubts.add((word, before, after))

    def asks(self, word: str) -> None:
        self.wholes.add(word)

    def goes_on(self, a: str, b: str) -> bool:
        self.compound(a, b)
        self.open = True
        return self.assume

    def compound(self, a: str, b: str) -> bool:
        self.links.add((a, b))
        self.wholes.add(a + b)
        return False


def asked(text: str) -> tuple[set, set, set]:
    """(doubts (word, before, after), words whose count decides, pairs) of one scan."""
    out = (set(), set(), set())
    for assume in (False, True):
        lexicon = Asked(assume)
        lexicon.open = False
        Page(text, lexicon).paragraphs(lexicon)
        for have, new in zip(out, (lexicon.doubts, lexicon.wholes, lexicon.links)):
            have.update(new)
        if not lexicon.open:
            break
    return out


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _a, _b in _MISREAD:
    _BY_FIRST.setdefault(_a[0], []).append((_a, _b))
_LETTER_PAIRS = [(a, b) for a, b in _MISREAD if a.isalpha() and a not in ("h", "u", "e", "o", "i", "l", "q", "w", "d")] + [("h", "li"), ("m", "rn"), ("d", "cl")]


def _pieces(token: str) -> list[tuple[int, str, str, bool]]:
    """(offset, piece, lower case, whether it could be a misreading) of a token's parts between hyphens; remembered, as tokens come again and again."""
    found = _known.get(token)
    if found is None:
        if len(_known) > 200_000:
            _known.clear()
        found = _known[token] = []
        for p in _PIECE.finditer(token):
            s = p.group().strip(".?…'’*•")
            if s:
                # A small l among capitals is a misread I.
                low = s.replace("l", "1").lower() if "l" in s and s[:2] != s[:2].lower() and _CAPITALS.fullmatch(s) and sum(c.isupper() for c in s) > 2 else s.lower()
                found.append((p.start() + p.group().index(s), s, low, _askable(low)))
    return found


_known: dict[str, list[tuple[int, str, str, bool]]] = {}


class Page:
    """One text taken apart into lines with their kinds of noise and repairs."""

    def __init__(self, text: str, lexicon: Lexicon):
        self.lines = [line.rstrip("\r") for line in text.split("\n")]
        self.pages = page_lines(self.lines)
        self.heads = header_lines(self.lines)
        self.pages |= {i for i in self.heads if _PAGE_INSIDE.search(self.lines[i].strip())}
        skills = skill_lines(self.lines, self.pages, self.heads)
        body = [i for i, line in enumerate(self.lines) if line.strip() and i not in self.pages and i not in self.heads]
        self.next = dict(zip(body, body[1:]))
        self.hyphen = {i for i in body if self._goes_on(i, lexicon)}
        self.repairs: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
        extra = Counter(words(text))
        self.prior = {n: i for i, n in self.next.items()}
        after_hyphen = {self.next[i] for i in self.hyphen}
        for i, line in enumerate(self.lines):
            if i in skills or not line.strip():
                continue
            if i in self.pages and i not in self.heads and not re.search(r"\p{L}{3}", line):
                continue
            self._words(i, line, lexicon, extra, i in after_hyphen)

    def _goes_on(self, i: int, lex: Lexicon) -> bool:
        line = self.lines[i].rstrip()
        m = _BROKEN.search(line) if line[-1:] in _HYPHENS else None
        if i not in self.next or m is None or not _LETTER.search(line[-4:]):
            return False
        follow = _BEGIN.match(self.lines[self.next[i]])
        if follow is None:
            return False
        a, b = m.group(1).lower(), follow.group(1).lower()
        return b not in _LINKS or lex.goes_on(a, b)

    def _words(self, i: int, line: str, lex: Lexicon, extra: Counter, continued: bool) -> None:
        body = line.rstrip()
        broken = i in self.hyphen
        if broken:
            body = body[:-1]
        tokens = []
        mail = [m.span() for m in _EMAIL.finditer(body)] if "@" in body or _AT.search(body) else ()
        for m in _TOKEN.finditer(body):
            at = m.start()
            if not mail or not any(a < m.end() and at < b for a, b in mail):
                tokens += [(at + n, *piece) for n, *piece in _pieces(m.group())]
        for k, (a, s, low, ask) in enumerate(tokens):
            first, last = k == 0 and continued, k == len(tokens) - 1 and broken and a + len(s) == len(body)
            if not (ask or first or last) or _NUMBER.fullmatch(s):
                continue
            before = tokens[k - 1][1].lower() if k else ""
            after = tokens[k + 1][1].lower() if k + 1 < len(tokens) else ""
            if last:
                rest = _TAIL.match(self.lines[self.next[i]])
                tail = rest.group(1).rstrip(".?…").lower() if rest else ""
                whole = lex.repair(low + tail, before, "", extra)
                lex.asks(low + tail)
                if low + tail not in lex.counts and whole and not whole.startswith(low):
                    self.repairs[i].append((a, a + len(s), self._part(lex, low, whole, True)))
                elif whole is None and low + tail not in lex.counts and (r := lex.repair(low, before, "", extra)):
                    self.repairs[i].append((a, a + len(s), r))
                continue
            if first:
                head = _HEAD.search(self.lines[self.prior[i]].rstrip())
                start = head.group(1).lower() if head else ""
                whole = lex.repair(start + low, "", after, extra)
                lex.asks(start + low)
                if start + low not in lex.counts and whole and not whole.endswith(low):
                    self.repairs[i].append((a, a + len(s), self._part(lex, low, whole, False)))
                elif whole is None and start + low not in lex.counts and (r := lex.repair(low, "", after, extra)):
                    self.repairs[i].append((a, a + len(s), r))
                continue
            r = lex.repair(low, before, after, extra)
            if r:
                self.repairs[i].append((a, a + len(s), r))

    @staticmethod
    def _part(lex: Lexicon, read: str, whole: str, head: bool) -> str:
        """The beginning (or end) of a word that fits what was read of it best."""
        parts = [whole[:n] if head else whole[-n:] for n in range(max(1, len(read) - 3), min(len(whole), len(read) + 2) + 1)]
        return min(parts, key=lambda p: (distance(read, p, 9.0), abs(len(p) - len(read))))

    def kinds(self) -> list[tuple[int, str]]:
        """(line from 1, kind) of the noise."""
        out = [(i + 1, "hyphen") for i in self.hyphen] + [(i + 1, "page") for i in self.pages] + [(i + 1, "header") for i in self.heads]
        return sorted(out + [(i + 1, "glyph") for i, r in self.repairs.items() if r])

    def _repaired(self, i: int) -> str:
        line = self.lines[i]
        for a, b, new in sorted(self.repairs.get(i, ()), reverse=True):
            old = line[a:b]
            line = line[:a] + (new.upper() if old.isupper() and len(old) > 1 else new.capitalize() if old[:1].isupper() else new) + line[b:]
        return line.rstrip()

    def paragraphs(self, lex: Lexicon) -> str:
        """Continuous text: no headers and page numbers, broken words joined, wrapped lines run on."""
        width = max((len(line.rstrip()) for line in self.lines), default=0)
        out: list[str] = []
        blank = True
        glue = None
        for i, line in enumerate(self.lines):
            if i in self.pages or i in self.heads:
                continue
            if not line.strip():
                if glue is None:
                    if not blank:
                        out.append("")
                    blank = True
                continue
            text = self._repaired(i).strip()
            if glue is not None:
                out[-1] += glue + text
            else:
                out.append(text)
            blank = False
            glue = None
            if i in self.hyphen:
                head, tail = words(out[-1][:-1]), words(self._repaired(self.next[i]))
                a, b = (head[-1] if head else ""), (tail[0] if tail else "")
                compound = lex.compound(a, b)
                out[-1] = out[-1] if compound and out[-1][-1] in "-‐‑" else out[-1][:-1] + ("-" if compound else "")
                glue = ""
            elif i in self.next and self._runs_on(i, width):
                glue = " "
        return "\n".join(out).strip()

    def _runs_on(self, i: int, width: int) -> bool:
        """Whether a line was wrapped: the next line's first word wouldn't have fit, and it starts no bullet or heading."""
        line, follow = self.lines[i].strip(), self.lines[self.next[i]].strip()
        if width > 110 or re.match(r"[•*–-]\s|\p{Lu}[^a-z]*$", follow) or any(not self.lines[k].strip() for k in range(i + 1, self.next[i]) if k not in self.pages | self.heads):
            return False
        first = follow.split()[0]
        return len(line) + 1 + len(first) > width - 3 and (follow[0].islower() or not re.search(r"[.!?:]$", line))


_DOUBTS = "array<struct<w: string, b: string, a: string>>"
_PART = f"a string, b string, n bigint, tid bigint, doubts {_DOUBTS}, wholes array<string>, links array<struct<a: string, b: string>>"


def _texts(candidates: DataFrame, key: str, text: str, kind: str, scanned: str) -> DataFrame:
    """(k, t, scan, tid) of each distinct row with a text, spread evenly and written once, as all later steps read it.

    Repeated rows are put together before they are shuffled, so a text or key that comes again and again isn't gathered.
    """
    rows = candidates.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.coalesce(F.col(kind), F.lit("")) == scanned).alias("scan")).where("t is not null")
    return stored(spread(rows.distinct()).withColumn("tid", F.xxhash64("k", "t")))


def _parts(texts: DataFrame) -> DataFrame:
    """Of one pass over the texts: partial numbers of texts with word a (b null) or with a and b as neighbours, and of each scan what it asks."""

    def counted(counts: Counter) -> pa.RecordBatch:
        a, b = zip(*counts) if counts else ((), ())
        rest = [pa.nulls(len(counts), f.type) for f in schema][3:]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(list(counts.values()), pa.int64()), *rest], schema=schema)

    def listed(sets: list[set], kind: pa.ListType) -> pa.ListArray:
        ends = np.zeros(len(sets) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in sets], out=ends[1:])
        flat = list(chain.from_iterable(sets))
        if pa.types.is_struct(kind.value_type):
            columns = zip(*flat) if flat else [()] * kind.value_type.num_fields
            values = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], fields=list(kind.value_type))
        else:
            values = pa.array(flat, pa.string())
        return pa.ListArray.from_arrays(pa.array(ends), values, type=kind)

    schema = to_arrow_schema(_parse_datatype_string(_PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            tids, asks = [], []
            for t, scan, tid in zip(*(batch.column(i).to_pylist() for i in range(3))):
                w = words(_JOINED.sub("\u0001", t))
                counts.update(set(zip(w, w[1:])))
                counts.update(zip(set(w), repeat(None)))
                if scan:
                    tids.append(tid)
                    asks.append(asked(t))
                if len(counts) > FLUSH:
                    yield counted(counts)
                    counts = Counter()
            if tids:
                none = [pa.nulls(len(tids), f.type) for f in schema][:3]
                yield pa.RecordBatch.from_arrays([*none, pa.array(tids, pa.int64()), *(listed([a[i] for a in asks], schema[4 + i].type) for i in range(3))], schema=schema)
        yield counted(counts)

    return texts.select("t", "scan", "tid").mapInArrow(run, _PART)


def near_words(doubts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(w, own, c, d, n): words c of the lexicon (a, n) that a doubtful word (w, own) may be a misreading of; own: other texts with w.

    Both sides leave out up to two letters and are joined by what is left. Only words with the skeleton of one that is frequent enough
    take part, so names and most other rare words are never taken apart.
    """

    def cut_up(readings):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, x) for i, w in enumerate(batch.column(0).to_pylist()) for x in {d for f in readings(w) for d in deletes(f)}]
                at, cut = zip(*rows) if rows else ((), ())
                taken = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()), *(c.take(taken) for c in batch.columns)], names=["del", *batch.schema.names])

        return run

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                d = distance(w, c)
                out.append(d if d <= (0.99 if _strange(w) else 0.5 + 0.25 * (len(w) > 8)) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "d"])

    least = F.when(F.col("w").rlike(r"[^\p{L}\p{M}'’]"), LEAST).otherwise(RATIO * F.greatest("own", F.lit(1)))
    doubts = doubts.withColumn("skel", skeleton(F.col("w"))).withColumn("least", least)
    lexicon = lexicon.where((F.col("n") >= LEAST) & (F.length("a") > 2)).select(F.col("a").alias("c"), "n", skeleton(F.col("a")).alias("skel"))
    most = lexicon.groupBy("skel").agg(F.max("n").alias("most"))
    doubts = stored(doubts.join(most, "skel").where("most >= least").select("w", "own", "skel", "least"))
    lexicon = lexicon.join(doubts.select("skel").distinct(), "skel", "left_semi")
    left = spread(doubts).mapInArrow(cut_up(forms), "del string, w string, own bigint, skel string, least bigint")
    right = lexicon.select("c", "n", "skel").mapInArrow(cut_up(lambda w: (w,)), "del string, c string, n bigint, skel string")
    met = left.join(right, ["del", "skel"]).where("n >= least and c <> w").select("w", "own", "c", "n").distinct()
    return met.mapInArrow(checked, "w string, own bigint, c string, n bigint, d double").where("d is not null").select("w", "own", "c", "d", "n")


def _answers(parts: DataFrame) -> DataFrame:
    """(tid, answers): what the corpus knows of the words each scan asks for; as many as the scan has words, at most."""
    lexicon = stored(parts.where("a is not null and b is null").groupBy("a").agg(F.sum("n").alias("n")))
    scans = parts.where("tid is not null")
    doubts = scans.select("tid", F.explode("doubts").alias("x")).select("tid", "x.w", "x.b", "x.a")
    others = F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0)).alias("own")
    words_asked = doubts.select("w").distinct().join(lexicon, F.col("w") == F.col("a"), "left").select("w", others)
    near = stored(near_words(words_asked, lexicon))
    listed = near.groupBy("w", "own").agg(F.collect_list(F.struct("c", "d", "n")).alias("near"))
    open_ = stored(doubts.join(if_small(near.select("w").distinct()), "w"))
    of_words = open_.select("tid", "w").distinct().join(listed, "w").select("tid", F.struct("w", F.lit(None).cast("string").alias("v"), F.col("own").alias("n"), "near").alias("x"))
    none = F.lit(None).cast("array<struct<c: string, d: double, n: bigint>>").alias("near")
    wholes = scans.select("tid", F.explode("wholes").alias("w")).join(lexicon.where(F.col("n") >= LEAST), F.col("w") == F.col("a"))
    of_wholes = wholes.select("tid", F.struct("w", F.lit(None).cast("string").alias("v"), (F.col("n") - 1).alias("n"), none).alias("x"))
    met = open_.join(near.select("w", "c"), "w")
    pairs = met.select("tid", F.col("b").alias("x"), F.col("c").alias("y")).unionByName(met.select("tid", F.col("c").alias("x"), F.col("a").alias("y"))).where("x <> '' and y <> ''")
    pairs = stored(pairs.unionByName(scans.select("tid", F.explode("links").alias("l")).select("tid", F.col("l.a").alias("x"), F.col("l.b").alias("y"))).distinct())
    wanted = pairs.select("x", "y").distinct()
    known = parts.where("b is not null").join(wanted, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).groupBy("x", "y").agg(F.sum("n").alias("n"))
    of_pairs = pairs.join(known, ["x", "y"]).select("tid", F.struct(F.col("x").alias("w"), F.col("y").alias("v"), "n", none).alias("x"))
    return of_words.unionByName(of_wholes).unionByName(of_pairs).groupBy("tid").agg(F.collect_list("x").alias("answers"))


def _lexicon_of(answers: list[dict] | None) -> Lexicon:
    counts, near, pairs = {}, {}, {}
    for x in answers or ():
        if x["v"] is not None:
            pairs[x["w"], x["v"]] = x["n"]
        else:
            if x["n"] > 0:
                counts[x["w"]] = x["n"]
            if x["near"] is not None:
                near[x["w"]] = [(y["c"], y["d"], y["n"]) for y in x["near"]]
    return Lexicon(counts, near, pairs)


def _each(texts: DataFrame, key: str, kind: str, out, schema: str, scans_only: bool) -> DataFrame:
    """Runs ``out(page, lexicon, key)`` over the scans; other texts are given as None for the page, if they are wanted."""
    answers = _answers(stored(_parts(texts)))
    rows = (texts.where("scan") if scans_only else texts).join(answers, "tid", "left").select("k", "t", "scan", "answers")
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k, t, scan, known in zip(*(batch.column(i).to_pylist() for i in range(4))):
                lexicon = _lexicon_of(known)
                made += out(Page(t, lexicon) if scan else None, lexicon, k, t)
            columns = zip(*made) if made else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def find_noise(candidates: DataFrame, key: str = "stem", text: str = "raw_text", kind: str = "source_format", scanned: str = "pdf") -> DataFrame:
    """(``key``, line_no int, kind) of the lines with scan noise of the rows whose ``kind`` is ``scanned``.

    The counts are those of all rows. Null and empty texts have no row; repeated rows count once; extra columns are left out; an
    empty table gives an empty one.
    """
    texts = _texts(candidates, key, text, kind, scanned)
    type_ = candidates.schema[key].dataType.simpleString()
    out = lambda page, lexicon, k, t: [(k, i, n) for i, n in page.kinds()]
    return _each(texts, key, kind, out, f"k {type_}, line_no int, kind string", True).distinct().withColumnRenamed("k", key)


def repair(candidates: DataFrame, key: str = "stem", text: str = "raw_text", kind: str = "source_format", scanned: str = "pdf") -> DataFrame:
    """(``key``, text): each scanned text as continuous paragraphs; other texts as they are. Null texts have no row."""
    texts = _texts(candidates, key, text, kind, scanned)
    type_ = candidates.schema[key].dataType.simpleString()
    out = lambda page, lexicon, k, t: [(k, t if page is None else page.paragraphs(lexicon))]
    return _each(texts, key, kind, out, f"k {type_}, text string", False).distinct().withColumnRenamed("k", key)

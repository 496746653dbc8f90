"""Problem 3: personal information inside free text, found and replaced.

Finding: formats for addresses of mail, telephones, identity numbers and streets; for names, given names (a fixed list and those
that many people of the table bear) beside capitalised words, titles, initials, and the record's own name.

Replacing: each item becomes a placeholder of its type that holds a surrogate made with a secret key. Names are replaced
token by token, so order, commas, initials and case stay, and a person keeps one surrogate under a nickname, in another order or in other
case; misspelled names and the initial of a nickname get others. The ending follows the gender of the given name, the letters its script. Digits
of numbers go through a keyed permutation that keeps the format, so distinct numbers stay distinct. Surrogates of name tokens, mail
addresses and streets are checked over the whole corpus and made anew until all are distinct.

One pass over the texts finds the items and makes the surrogates; what was found and the masked texts both come from it.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from rankloom.llm.names import _NICKNAMES, organisation, tokens_of
from rankloom.session import stored

KINDS = ("email", "phone", "id", "address", "name")
#: A token borne by this share of the names, and by this many, counts as a given name; so there are at most some hundreds.
GIVEN_SHARE, GIVEN_LEAST = 0.004, 5
#: If more collide, names get a syllable more, which makes collisions 85 times as rare; so what is sent to the executors is bounded.
MOST_COLLISIONS = 100_000

# Common given names, by gender; the ones borne often in the table are added to them.
_FEMALE = (
    "aleksandra alice amara amina ana anna anneke beatriz camille carla carmen chiara claire clara dalia deborah elena elizabeth emma esra eva farah fatima francesca"
    " gabriela greta guadalupe hannah helen hiroko ilse ingrid isabel ivana jana jennifer julia katherine laura lena lucia lucía maelle maëlle margaret maria marie marta"
    " mary mirela monika nadia noor olga patricia paula philippa priya rebecca renee renée rosa ruth saoirse sara sarah selma sofia sophie susan tanja ulrike valentina victoria"
    " wanjiru wilhelmina xiomara yara zeynep zofia eun-ji linh"
).split()
_MALE = (
    "ahmed alexander ali andreas andrew anthony antonio benjamin bjorn björn bogdan carlos charles christopher cormac daniel david diego dmitri edward emil erik fionn frederick"
    " geoffrey george goran gregory hamza hans henry ignacio inigo íñigo ivan james jan jean jens johannes john jonas jorge jose joseph juan jurgen jürgen karl kofi kwame lars leonard"
    " luca luis lukas marco mark martin mateo matthew michael miguel mohammed nicholas oliver omar oskar pablo paolo paul pedro peter pierre quentin ravi richard robert ronald samuel sergei soren søren"
    " stefan stephen tariq theodore thomas tomasz vikram viktor william yusuf"
).split()
_TITLE = r"(?:Dr|Prof|Mr|Mrs|Ms|Miss|Mx|Sir|Herr|Frau|Mme|Mlle|Sr|Sra|Señora?|Monsieur|Madame)\b\.?"
_NOT_NAMES = frozenset(
    "a after also an and as at avec before besides by con das dear der desde die documented during el en expanded for from he hello hi his her i if im in it junto kept la le led les maintained mit my of on our"
    " please reported resume seit she since so thanks the their then they through to under we when while with without you your ab und et y application name curriculum vitae page email tel phone mobile contact"
    " mr mrs ms miss dr prof sir herr frau references reference manager line deputy signed took".split()
)
_FIRM_WORDS = r"(?:Holdings|Bank|Freight|Foods|Labs|Power|Ceramics|Textiles|Logistics|Analytics|Instruments|Cooperative|Museums|Health|Trust|Group|College|University|School|Ltd|Limited|GmbH|Inc|LLC|PLC|Staffing|Recruitment|Talent)\b"

_FIRM, _FIRM_NEXT = regex.compile(_FIRM_WORDS), regex.compile(rf"\s{_FIRM_WORDS}")
_GAP, _LINE_GAP, _COMMA_GAP = regex.compile(r"\.?\s+"), regex.compile(r"\.?[^\S\n]+"), regex.compile(r",?[^\S\n]+")
_EMAIL = regex.compile(
    r"(?<![\w.+-])[\w][\w.+-]*(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?)[\w-]+(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)[\w-]+)+", regex.I
)
_PHONE = regex.compile(
    r"(?<![\w/.,+-])(?:"
    r"(?:\+|00)\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d(?:[ ./-]?\d){6,11}"
    r"|\(\d{3,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}"
    r"|0\d{2,4}[ /-]\d{3,5}[ -]?\d{3,4}"
    r"|0\d(?:[ .]\d{2}){4}"
    r"|(?:1[ .-])?\d{3}([-. ])\d{3}\1\d{4}"
    r"|1\d{10}"
    r")(?:\s?(?:ext\.?|x)\s?\d{1,5})?(?![\w/-]|[.,]\d)",
    regex.I,
)
_ID = regex.compile(
    r"(?<![\w/.,+-])(?:"
    r"[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z]"
    r"|[A-Z]{2}\d{6,8}"
    r"|[A-Z]{1,3}(?:-\d{2,4}){2,4}"
    r"|[A-Z]\d(?:\s\d{3,4}){2,3}"
    r"|\d{3}-\d{2}-\d{4}"
    r"|\d{2}/\d{3}/\d{5}"
    r"|\d{4}\s\d{4}\s\d{4}(?:\s\d{4})?"
    r")(?![\w/-]|[.,]\d)"
)
_LABELLED = regex.compile(
    r"\b(?i:passport|tax (?:ref|no|id)(?:erence)?|national id|identity (?:no|number|card)|personal no|soc(?:ial|\.)? sec(?:urity|\.)?(?: no| number)?|insurance (?:no|number)|id (?:no|number)|payroll record|permit no)"
    r"[.:#\s-]{0,4}(?P<n>[A-Z]{0,3}[ -]?\d[\d /-]{4,}\d[A-Z]?)(?![\w/-])"
)
_CAP = r"\p{Lu}[\p{L}'’-]+"
_CITY = r"\p{Lu}\p{Ll}[\p{L}'’]*(?:[ -](?:\p{Lu}\p{Ll}[\p{L}'’]*|sur|am|an|de|la|le))*"
_ADDRESS = regex.compile(
    r"(?<![\w.,/])(?:"
    r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\.? ?#?\d+\w?,? )?\d{1,5}[a-z]?,? (?:\p{Lu}[\p{L}'’.-]*\s){1,3}"
    r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Close|Boulevard|Blvd|Way|Place|Square|Sq|Terrace|Crescent|Row|Walk|Hill|Parade|Gardens|Grove|Mews|Alley|Quay)\b\.?(?:,? (?:Apt|Flat|Unit|Suite)\.? ?#?\d+\w?)?"
    r"|\d{1,5}(?: ?(?:bis|ter))?,? ?(?i:rue|avenue|chemin|place|boulevard|allée|impasse|quai|route|cours|square|passage)\s(?:(?:de|du|des|la|le|les|aux?|à|d['’]|l['’])\s?)*\p{Lu}?[\p{L}'’-]+(?:\s(?:(?:de|du|des|la|le)\s)?\p{Lu}[\p{L}'’-]+)*"
    r"|(?:(?:\p{Lu}[\p{L}-]*\s)?\p{Lu}[\p{L}-]*(?:straße|strasse|str\.|weg|allee|gasse|platz|ufer|damm|ring|steig|markt)|(?:Am|An der|An den|Im|In der|Auf der|Auf dem|Zum|Zur|Unter den|Alte|Neue|Große|Kleine)\s(?!Jahre?\s)\p{Lu}[\p{L}-]+)\s\d{1,3}(?!\d)\s?[a-z]?"
    r"|(?:Calle|C/|Plaza|Avda\.?|Avenida|Paseo|Camino|Carretera|Ronda|Travesía|Via|Viale|Piazza|Corso)\s(?:(?:de|del|la|las|los|el|di|della|dei)\s)*\p{Lu}?[\p{L}'’-]+(?:\s(?:(?:de|del|la|los|las)\s)?\p{Lu}[\p{L}'’-]+)*,?\s\d{1,4}(?:,\s\d{1,2}[ºª°]\s?\w?)?"
    rf")(?![\p{{L}}\d])(?:,?\s(?:\d{{5}}\s)?{_CITY},?\s\d{{5}}\b|,\s\d{{5}}\s{_CITY}|,\s{_CITY})?"
)
_TITLED = regex.compile(rf"(?<![\p{{L}}'’-])(?:{_TITLE}|M\.)\s+(?:\p{{Lu}}\.\s?)*{_CAP}(?:\s(?!{_FIRM_WORDS}){_CAP}){{0,2}}(?:,\s(?:\p{{Lu}}\.|{_CAP}(?!\s\p{{Lu}}|['’]s)))?")
_INITIAL = regex.compile(rf"(?<![\p{{L}}.'’-])(?:\p{{Lu}}\.[\s-]?){{1,3}}\p{{Lu}}[\p{{L}}'’-]{{2,}}(?!\p{{L}})")
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}'’-]*")
# Quick looks that spare most texts the patterns above; each holds wherever its patterns can match.
_CAPITALS = re.compile(r"\b[^\W\d_a-zß-öø-ÿ][^\W\d_]+(?:['’-][^\W\d_]+)*")
_MARKED = re.compile(r"\b(?:[^\W\d_a-zß-öø-ÿ]\.|(?:Dr|Prof|Mr|Mrs|Ms|Miss|Mx|Sir|Herr|Frau|Mme|Mlle|Sr|Sra|Señora?|Monsieur|Madame)\b\.?\s)")
_AT = re.compile(r"[\[({]\s?at\s?[\])}]", re.I)
_DIGIT = re.compile(r"\d")
_GIVEN, _MARK, _NUMBER, _SIGN, _WAY, _LABEL = 1, 2, 4, 8, 16, 32
# The shortest matches of _PHONE and _ID: nine digits, eight after a plus, six after letters, or four in groups after letters.
_DIGITS = re.compile(r"\d(?:[\s()./-]{0,3}\d){8}|\+\d(?:[ ()./-]{0,3}\d){7}|[A-Z][\s-]?\d(?:[\s-]?\d){5}|[A-Z]-\d{2,4}-\d{2}")
_LABELS = frozenset("passport tax national identity insurance soc social id payroll permit personal".split())
_STREET = re.compile(
    r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Close|Boulevard|Blvd|Way|Place|Square|Sq|Terrace|Crescent|Row|Walk|Hill|Parade|Gardens|Grove|Mews|Alley|Quay)\b"
    r"|(?:straße|strasse|str\.|weg|allee|gasse|platz|ufer|damm|ring|steig|markt)\s\d|\b(?:Am|An de[rn]|Im|In der|Auf de[rm]|Zum|Zur|Unter den|Alte|Neue|Große|Kleine)\s\w"
    r"|(?i:(?:\b|\d|bis|ter)(?:rue|avenue|chemin|place|boulevard|allée|impasse|quai|route|cours|square|passage)\s)|C/\s|(?:\bCalle|Plaza|Avda|Avenida|Paseo|Camino|Carretera|Ronda|Travesía|Via|Viale|Piazza|Corso)\b"
)
#: Tokens that begin a street of two words or more.
_STREET_FIRST = re.compile(r"\b(?:An|In|Auf|Unter)$")


def _lower(word: str) -> str:
    """Lower case without accents; remembered, as words come again and again."""
    low = _lowered.get(word)
    if low is None:
        if len(_lowered) > 100_000:
            _lowered.clear()
        s = unicodedata.normalize("NFKD", word.lower())
        low = _lowered[word] = "".join(c for c in s if not unicodedata.combining(c)).replace("ø", "o").replace("’", "'")
    return low


_lowered: dict[str, str] = {}


class Finder:
    """Finds items in one text. ``given``: lower-case given names without accents."""

    def __init__(self, given: set[str]):
        self.known: dict[str, bool] = {}
        self.bits: dict[str, int] = {}
        self.owners: dict[str, tuple | None] = {}
        self.given = given | {_lower(n) for n in (*_FEMALE, *_MALE, *_NICKNAMES)}

    def _parsed(self, name: str) -> tuple | None:
        """(name, longest part, single-spaced) of a person's own name in lower case; None for firms and mere words."""
        if name not in self.owners:
            if len(self.owners) > 100_000:
                self.owners.clear()
            parts, tokens = name.lower().split(), tokens_of(name)
            ok = parts and len(tokens) > 1 and not organisation(tokens)
            self.owners[name] = (name.strip(), max(parts, key=len), " ".join(parts)) if ok else None
        return self.owners[name]

    def _own(self, text: str, names: list[str]) -> list[tuple[int, int]]:
        """Where the record's own names stand, however spaced and in whatever case."""
        out = []
        low = None
        for n in names:
            parsed = self._parsed(n)
            if parsed is None:
                continue
            whole, longest, single = parsed
            low = text.lower() if low is None else low
            if longest not in low or single not in " ".join(low.split()):
                continue
            if (a := text.find(whole)) >= 0 and low.count(whole.lower()) == 1:
                spans = [(a, a + len(whole))]
            else:
                spans = [m.span() for m in regex.finditer(r"\s+".join(map(regex.escape, whole.split())), text, regex.I)]
            out += [(a, b) for a, b in spans if not text[a - 1 : a].isalpha() and not text[b : b + 1].isalpha()]
        return out

    def _names(self, text: str, marks: int) -> list[tuple[int, int]]:
        out = []
        if marks & _MARK:
            out += [m.span() for m in _TITLED.finditer(text) if not _lower(_WORDS.findall(m.group())[-1]) in _NOT_NAMES]
            out += [m.span() for m in _INITIAL.finditer(text) if not _FIRM.match(m.group().split()[-1])]
        # Words are taken apart only where a given name stands.
        if marks & _GIVEN:
            words = list(_WORDS.finditer(text))
            for i, w in enumerate(words):
                if w.group()[0].isupper() and self._is_given(w.group()) and (span := self._around(text, words, i)):
                    out.append(span)
        return out

    def _marks(self, text: str) -> int:
        """What the tokens of a text may be part of, as bits; the bits of a token are worked out once."""
        bits, known = 0, self.bits
        for token in text.split():
            b = known.get(token)
            if b is None:
                if len(known) > 200_000:
                    known.clear()
                b = known[token] = self._token_bits(token)
            bits |= b
        return bits

    def _token_bits(self, token: str) -> int:
        if token.isalpha() and token.islower():
            return (_LABEL if token in _LABELS else 0) | (_WAY if _STREET.search(f"{token} 1") else 0)
        b = _GIVEN if any(self._is_given(w) for w in _CAPITALS.findall(token)) else 0
        b |= _MARK if _MARKED.search(token + " ") else 0
        b |= _LABEL if not _LABELS.isdisjoint(re.findall(r"[^\W\d_]+", token.lower())) else 0
        b |= _NUMBER if _DIGIT.search(token) else 0
        b |= _SIGN if "@" in token or token[-1] in "([{" or _AT.search(token) or re.search(r"[\[({]at$", token, re.I) else 0
        return b | (_WAY if _STREET.search(f"{token} 1") or _STREET_FIRST.search(token) else 0)

    def _is_given(self, word: str) -> bool:
        known = self.known.get(word)
        if known is None:
            if len(self.known) > 200_000:
                self.known.clear()
            known = self.known[word] = _lower(word.removesuffix("'s").removesuffix("’s")) in self.given
        return known

    def _around(self, text: str, words: list, i: int) -> tuple[int, int] | None:
        """The full name around a given name: given names and a family name after it, or a family name before it."""

        def next_to(a, b) -> str:
            return text[a.end() : b.start()]

        def family(m) -> bool:
            s = m.group().removesuffix("'s").removesuffix("’s")
            return len(s) > 2 and s[0].isupper() and _lower(s) not in _NOT_NAMES and _lower(s) not in self.given and not _FIRM.match(s)

        possessive = words[i].group().endswith(("'s", "’s"))
        j = i
        # Further given names and initials.
        while not possessive and j + 1 < len(words) and _GAP.fullmatch(next_to(words[j], words[j + 1])) and (_lower(words[j + 1].group()) in self.given or (len(words[j + 1].group()) == 1 and words[j + 1].group().isupper())):
            j += 1
        if not possessive and j + 1 < len(words) and _LINE_GAP.fullmatch(next_to(words[j], words[j + 1])) and family(words[j + 1]):
            after = text[words[j + 1].end() :]
            if _FIRM_NEXT.match(after) is None:
                end = words[j + 1].end() - (2 if words[j + 1].group().endswith(("'s", "’s")) else 0)
                return words[i].start(), end
        if i and _COMMA_GAP.fullmatch(next_to(words[i - 1], words[i])) and family(words[i - 1]):
            return words[i - 1].start(), words[j].end() - (2 if words[j].group().endswith(("'s", "’s")) else 0)
        return None

    def find(self, text: str | None, names: list[str] = ()) -> list[tuple[int, int, str]]:
        """Items (start, end, kind) of a text in order; none overlap, and the earlier kinds of KINDS go first."""
        if not text:
            return []
        marks = self._marks(text)
        own = self._own(text, names) if names else []
        if not marks and not own:
            return []
        found: list[tuple[int, int, str]] = []
        if marks & _SIGN:
            found += [(*m.span(), "email") for m in _EMAIL.finditer(text)]
        if marks & _NUMBER:
            if marks & _LABEL or _DIGITS.search(text):
                found += [(*m.span("n"), "id") for m in _LABELLED.finditer(text)]
                found += [(*m.span(), "id") for m in _ID.finditer(text)]
                found += [(*m.span(), "phone") for m in _PHONE.finditer(text)]
            if marks & _WAY and _STREET.search(text):
                found += [(*m.span(), "address") for m in _ADDRESS.finditer(text)]
        found += [(a, b, "name") for a, b in own + self._names(text, marks)]
        if not found:
            return []
        rank = {k: n for n, k in enumerate(("email", "id", "phone", "address", "name"))}
        kept: list[tuple[int, int, str]] = []
        for item in sorted(found, key=lambda x: (rank[x[2]], x[0] - x[1])):
            if all(item[1] <= a or item[0] >= b for a, b, _ in kept):
                kept.append(item)
        return sorted(kept)


_SCRIPTS = {
    "latin": ("bdfghjklmnprstvwz", "aeiou", ("a", "o"), "abcdefghijklmnopqrstuvwxyz"),
    "cyrillic": ("бвгджзклмнпрстфх", "аеиоу", ("а", "о"), "абвгдежзиклмнопрстуфхцчшщэюя"),
    "greek": ("βγδζθκλμνπρστφχψ", "αεηιο", ("α", "ος"), "αβγδεζηθικλμνξοπρστυφχψω"),
}


_TITLE_ONLY = regex.compile(_TITLE)
_EXTENSION = regex.compile(r"(.*?)((?:\s?(?:ext\.?|x)\s?\d+)?)", regex.I | regex.S)
_MAIL_PARTS = regex.compile(r"(?P<l>[\w.+-]+)(?P<at>\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?)(?P<h>.*)", regex.I | regex.S)
_HOST, _NUMBERS, _BLANKS = regex.compile(r"^[\w-]+"), regex.compile(r"\d+"), regex.compile(r"\s+")
_STREET_END = regex.compile(r"(straße|strasse|str|weg|allee|gasse|platz|ufer)$")
_AT_WORD, _DOT_WORD = regex.compile(r"\s?[\[({]\s?at\s?[\])}]\s?"), regex.compile(r"\s?[\[({]\s?dot\s?[\])}]\s?")


class Surrogates:
    """Keyed replacements. ``again``: how often a colliding token is made anew. Surrogates are remembered, as items come again and again."""

    def __init__(self, key: bytes, again: dict[str, int] | None = None, syllables: int = 5):
        self.key, self.again, self.syllables = hashlib.sha256(key).digest(), again or {}, syllables
        self.made: dict[tuple[str, str], str] = {}
        self.orders: dict[str, dict[str, str]] = {}

    def _number(self, *parts: str) -> int:
        return int.from_bytes(hashlib.blake2b("\0".join(parts).encode(), key=self.key, digest_size=16).digest(), "big")

    def initial(self, letter: str) -> str:
        """A keyed permutation of the alphabet of a script; letters beyond the alphabet share those of its members."""
        script = _script(letter)
        if script not in self.orders:
            alphabet = _SCRIPTS[script][3]
            self.orders[script] = dict(zip(alphabet, sorted(alphabet, key=lambda c: self._number("initial", c))))
        order = self.orders[script]
        base = _lower(letter)[:1]
        return order.get(base) or list(order.values())[ord(base) % len(order) if base else 0]

    def token(self, word: str) -> str:
        """Surrogate of one lower-case name token, of a nickname that of the full name; its first letter depends only on the first letter."""
        canon = full_name(word)
        if ("token", canon) in self.made:
            return self.made["token", canon]
        times = self.again.get(f"token\0{canon}", 0)
        n = self._number("token", canon, str(times))
        cons, vowels, (she, he), _ = _SCRIPTS[_script(canon)]
        first = self.initial(canon[:1])
        out = first if first in vowels else first + vowels[n % len(vowels)]
        n //= len(vowels)
        for _ in range(self.syllables - 1):
            n, c = divmod(n, len(cons))
            n, v = divmod(n, len(vowels))
            out += cons[c] + vowels[v]
        ending = (she if canon in _FEMALE_SET else he) if canon in _FEMALE_SET or canon in _MALE_SET else cons[n % len(cons)]
        return self._kept("token", canon, out + cons[n // 64 % len(cons)] + ending)

    def _kept(self, kind: str, text: str, surrogate: str) -> str:
        if len(self.made) > 200_000:
            self.made.clear()
        self.made[kind, text] = surrogate
        return surrogate

    def name(self, text: str) -> str:
        """Token by token; titles, letter case, order and marks stay."""

        def one(m) -> str:
            w = m.group()
            body, tail = (w[:-2], w[-2:]) if w.endswith(("'s", "’s")) else (w, "")
            low = _lower(body)
            if _TITLE_ONLY.fullmatch(body) or low in ("msc", "phd", "bsc", "ma", "ba", "mba", "jr", "dr", "prof") or body == "M" and text[m.end() : m.end() + 1] == ".":
                return w
            new = self.initial(body) if len(body) == 1 else self.token(body)
            return (new.upper() if body.isupper() else new.capitalize() if body[0].isupper() else new) + tail

        return _WORDS.sub(one, text)

    def digits(self, text: str, keep: int = 0) -> str:
        """The digits after the first ``keep`` through a keyed permutation; everything else stays."""
        places = [i for i, c in enumerate(text) if c.isdecimal()][keep:]
        done = self._permuted([int(text[i]) for i in places])
        out = list(text)
        for i, d in zip(places, done):
            out[i] = str(d)
        return "".join(out)

    def _permuted(self, ds: list[int]) -> list[int]:
        """A balanced Feistel network over decimal digits: one to one for each length."""
        half = len(ds) // 2
        a, b = ds[:half], ds[half:]
        if not a:
            return [(d + self._number("digit")) % 10 for d in ds]
        for r in range(8):
            src, dst = (a, b) if r % 2 else (b, a)
            n = self._number("round", str(r), str(len(ds)), "".join(map(str, src)))
            for i in range(len(dst)):
                dst[i] = (dst[i] + n // 10**i) % 10
        return a + b

    def phone(self, text: str) -> str:
        """The last seven digits before any extension, so that all formats of a number agree; the extension as well."""
        body, ext = _EXTENSION.fullmatch(text).groups()
        n = sum(c.isdecimal() for c in body)
        return self.digits(body, max(0, n - 7)) + (self.digits(ext) if ext else "")

    def ident(self, text: str) -> str:
        """Letters shifted by a keyed amount, digits permuted; the format stays."""
        shift = 1 + self._number("letters") % 25
        moved = "".join(chr((ord(c) - 65 + shift) % 26 + 65) if "A" <= c <= "Z" else c for c in text)
        return self.digits(moved)

    def email(self, text: str) -> str:
        """Local part and host by surrogates of the address in its plain spelling, so all spellings agree; marks stay."""
        canon = plain_email(text)
        local, _, host = canon.partition("@")
        n = self._number("email", canon, str(self.again.get(f"email\0{canon}", 0)))
        new = self._syllables(n, 7)
        m = _MAIL_PARTS.match(text)
        host_new = self._syllables(self._number("host", host), 3)
        out = new + (m["at"] if m else "@") + _HOST.sub(host_new, m["h"] if m else host, count=1)
        return out.upper() if text.isupper() else out

    def _syllables(self, n: int, k: int) -> str:
        cons, vowels = _SCRIPTS["latin"][:2]
        out = ""
        for _ in range(k):
            n, c = divmod(n, len(cons))
            n, v = divmod(n, len(vowels))
            out += cons[c] + vowels[v]
        return out

    def address(self, text: str) -> str:
        """Capitalised words that aren't kinds of street get surrogates, numbers are permuted."""
        canon = " ".join(_lower(text).split())
        times = str(self.again.get(f"address\0{canon}", 0))

        def one(m) -> str:
            w = m.group()
            if not w[0].isupper() or _lower(w) in _STREETS:
                return w
            new = self._syllables(self._number("street", _lower(w), times), 4)
            kind = _STREET_END.search(w)
            return (new + (kind.group() if kind else "")).capitalize()

        named = _WORDS.sub(one, text)
        return _NUMBERS.sub(lambda m: self._street_number(m.group(), times), named)

    def _street_number(self, n: str, times: str) -> str:
        ds = self._permuted([int(c) for c in n])
        if ds[0] == 0:
            ds[0] = 1 + self._number("first", n, times) % 9
        return "".join(map(str, ds))

    def of(self, kind: str, text: str) -> str:
        found = self.made.get((kind, text))
        return found if found is not None else self._kept(kind, text, getattr(self, {"id": "ident"}.get(kind, kind))(text))

    def entity(self, entity: str, text: str) -> str:
        """The surrogate of what ``canonical`` names, in lower case."""
        kind, _, canon = entity.partition("\0")
        return self.token(canon) if kind == "token" else self.of(kind, text).lower()


def full_name(word: str) -> str:
    """A name token in lower case without accents, in full if it is a nickname."""
    low = _lower(word)
    return _lower(_NICKNAMES.get(low, low))


_FEMALE_SET = {_lower(n) for n in _FEMALE}
_MALE_SET = {_lower(n) for n in _MALE}
_STREETS = frozenset(
    "flat apt apartment unit suite room street st road rd avenue ave lane ln drive dr court ct close boulevard blvd way place square sq terrace crescent row walk hill parade gardens grove mews"
    " alley quay rue chemin allee impasse quai route cours passage calle plaza avda avenida paseo camino carretera ronda am an im in auf zum zur b a c".split()
)


def _script(text: str) -> str:
    for c in text:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
    return "latin"


def plain_email(text: str) -> str:
    """local@host in lower case, however written."""
    return _BLANKS.sub("", _DOT_WORD.sub(".", _AT_WORD.sub("@", text.lower())))


def common_given_names(names: DataFrame, name: str = "name") -> set[str]:
    """Lower-case tokens without accents borne by at least GIVEN_SHARE of the distinct names: at most a few hundred."""
    distinct = names.select(F.col(name).alias("n")).where("n is not null").distinct()
    total = distinct.count()
    tokens = distinct.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("n"), F.lit(r"(\p{L}[\p{L}\p{M}-]{2,})"), 1))).alias("t"))
    often = tokens.groupBy("t").count().where(F.col("count") >= max(GIVEN_LEAST, GIVEN_SHARE * total)).select("t")
    words = {_lower(r["t"]) for r in often.collect()}
    return words - {"msc", "phd", "bsc", "ltd", "limited", "staffing", "recruitment", "talent", "unknown", "prof"}


def secret(spark, seed: DataFrame) -> bytes:
    """The key of the surrogates: spark.rankloom.key or RANKLOOM_KEY.

    Without either it is made of hashes over all rows of ``seed``: only who has the unmasked table can work it out, and it stays the same for
    the same table.
    """
    named = spark.conf.get("spark.rankloom.key", None) or os.environ.get("RANKLOOM_KEY")
    if named:
        return named.encode()
    columns = [F.col(c) for c in seed.columns]
    sums = seed.agg(*[F.sum(F.xxhash64(F.lit(f"key {i}"), *columns).cast("decimal(20,0)")) for i in range(4)]).first()
    return repr(tuple(sums)).encode()


_ITEMS = "place string, stem string, pos int, items array<struct<kind: string, start: int, end: int, item: string, surrogate: string>>"


def find_items(rows: DataFrame, given: set[str], key: bytes, whole: bool = False) -> DataFrame:
    """(place, stem, pos, items) of each text or line with personal information: kind, span, text and surrogate of each item in order.

    ``rows``: place, stem, pos, text and names (the record's own names, one a line, or null). Where pos is null, the text is taken line by line
    and pos is the number of the line from 1. ``whole``: texts without items have a row, too, and there is a column text. Surrogates aren't
    checked for collisions yet. Null and empty texts hold nothing; repeated rows stay repeated.
    """
    sent = rows.sparkSession.sparkContext.broadcast(given)
    ddl = _ITEMS + (", text string" if whole else "")
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    item_type = schema.field("items").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, surrogates = Finder(sent.value), Surrogates(key)
        for batch in batches:
            made, flat, ends = [], [], [0]
            for place, stem, pos, text, names in zip(*(batch.column(i).to_pylist() for i in range(5))):
                own = [n for n in names.split("\n") if n.strip()] if names else []
                for i, t in enumerate(text.split("\n"), 1) if pos is None and text is not None else ((pos, text),):
                    found = finder.find(t, own)
                    if found or whole:
                        flat += [(kind, a, b, t[a:b], surrogates.of(kind, t[a:b])) for a, b, kind in found]
                        ends.append(len(flat))
                        made.append((place, stem, i, t))
            columns = zip(*flat) if flat else [()] * 5
            values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, item_type)], fields=list(item_type))
            items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=schema.field("items").type)
            place, stem, pos, text = zip(*made) if made else [()] * 4
            out = [pa.array(place, pa.string()), pa.array(stem, pa.string()), pa.array(pos, pa.int32()), items] + ([pa.array(text, pa.string())] if whole else [])
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return rows.select("place", "stem", "pos", "text", "names").mapInArrow(run, ddl)


def places(items: DataFrame) -> DataFrame:
    """(place, stem, pos, kind) of each place that holds an item, once."""
    return items.select("place", "stem", "pos", F.explode(F.array_distinct(F.transform("items", lambda x: x["kind"]))).alias("kind")).distinct()


def canonical(kind: str, text: str) -> list[str]:
    """The keys by which the surrogates of an item are made and checked."""
    if kind == "name":
        return [f"token\0{full_name(w.removesuffix("'s").removesuffix('’s'))}" for w in _WORDS.findall(text) if len(w) > 1]
    if kind == "email":
        return [f"email\0{plain_email(text)}"]
    return [f"address\0{' '.join(_lower(text).split())}"] if kind == "address" else []


def distinct_surrogates(items: DataFrame, key: bytes, syllables: int = 5) -> tuple[dict[str, int], int]:
    """(how often to make the surrogates of which entities anew, syllables), so that no two entities of the corpus share one.

    The entities and their surrogates stay distributed. Of those that share one all but the first are made anew and checked against all others,
    until none is left; only they reach the driver, a few in a billion, and if there are more than MOST_COLLISIONS, it begins again
    with one syllable more.
    """

    def entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in canonical(k, t)]
            e, t = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.string()), pa.array(t, pa.string())], names=["entity", "item"])

    each = items.select(F.explode("items").alias("x")).select("x.kind", "x.item").where("kind in ('name', 'email', 'address')").distinct()
    known = stored(each.mapInArrow(entities, "entity string, item string").groupBy("entity").agg(F.min("item").alias("item")))
    again: dict[str, int] = {}
    while True:
        sent = items.sparkSession.sparkContext.broadcast((again, syllables))

        def surrogates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = Surrogates(key, *sent.value)
            for batch in batches:
                e = batch.column(0).to_pylist()
                new = [s.entity(x, t) for x, t in zip(e, batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.split("\0")[0] for x in e], pa.string()), pa.array(new, pa.string())], names=["entity", "kind", "surrogate"])

        made = known.mapInArrow(surrogates, "entity string, kind string, surrogate string")
        clash = made.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("entity").alias("first")).where("n > 1")
        worse = [r["entity"] for r in made.join(clash, ["kind", "surrogate"]).where("entity <> first").select("entity").limit(MOST_COLLISIONS + 1).collect()]
        if not worse:
            return again, syllables
        if len(worse) + len(again) > MOST_COLLISIONS:
            again, syllables = {}, syllables + 1
        else:
            top = max(again.values(), default=0)
            again = again | {e: top + n for n, e in enumerate(sorted(worse), 1)}


def mask(rows: DataFrame, given: set[str], key: bytes, syllables: int = 5) -> DataFrame:
    """(place, stem, pos, text) with every item replaced by [KIND surrogate]; all else stays as it is.

    ``rows`` as in ``find_items``. Null texts stay null, empty ones empty; repeated rows stay repeated.
    """
    items = stored(find_items(rows, given, key, whole=True))
    sent = rows.sparkSession.sparkContext.broadcast(distinct_surrogates(items, key, syllables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(key, *sent.value)
        for batch in batches:
            texts = []
            for found, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                parts, at = [], 0
                for x in found:
                    parts += [text[at : x["start"]], f"[{x['kind'].upper()} {s.of(x['kind'], x['item'])}]"]
                    at = x["end"]
                texts.append("".join(parts) + text[at:] if found else text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=["place", "stem", "pos", "text"])

    return items.mapInArrow(run, "place string, stem string, pos int, text string")

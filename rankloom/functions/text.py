"""Text functions as Spark columns, and the word lists and patterns they share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = (
    "and", "or", "the", "a", "an", "of", "to", "in", "for", "with", "on", "at", "by", "is", "are", "be", "as", "from", "that", "this", "it", "we", "you", "our", "your",
    "will", "can", "has", "have", "using", "use", "work", "working", "experience", "knowledge", "strong", "good", "familiar", "familiarity", "ability", "skills",
)
SECTIONS = {
    "summary": ("summary", "professional summary", "profile", "about", "objective", "career objective", "about me", "overview"),
    "experience": ("experience", "work experience", "professional experience", "work history", "employment", "employment history", "internship", "internships", "professional background", "career history"),
    "projects": ("projects", "personal projects", "key projects", "academic projects", "selected projects", "portfolio", "project work"),
    "education": ("education", "academic background", "academics", "qualifications", "educational qualifications", "academic qualifications"),
    "skills": ("skills", "technical skills", "core skills", "key skills", "expertise", "technologies", "tech stack", "competencies", "core competencies", "skills summary", "technical proficiencies", "tools"),
    "certifications": ("certifications", "certificates", "courses", "licenses", "certifications and courses", "training"),
    "achievements": ("achievements", "awards", "honors", "honours", "accomplishments", "activities", "extracurricular", "leadership", "volunteering", "publications", "interests", "hobbies", "languages", "contact"),
}
BULLET = r"^\s*(?:[-*]\s+|[•●▪‣]\s*)"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z])"
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.]+"
CONTACT = r"(?i)linkedin\.com|github\.com|https?://|@[\w-]+\.\w+|\+\d[\d\s-]{7,}"
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|present|expected)?"
DATES = rf"(?i)^[\s\d/.-]*{_MONTH}[\s\d/.,-]*(to|[-])?[\s\d/.,-]*{_MONTH}[\s\d/.,-]*$"
YEARS = r"(?i)(\d+)\+?\s*(?:-\s*\d+\s*)?year"
JUNIOR = r"(?i)\b(intern|internship|junior|entry[- ]level|fresher|trainee|graduate)\b"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits, '+', '#' and '.' of more than one character, stop words left out; null for null."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9+#.]+)"), 1)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def escaped(term: Column) -> Column:
    """A term as a pattern that matches just itself."""
    return F.regexp_replace(term, r"([\\.\[\]{}()*+?^$|#])", r"\\$1")


def bounded(term: Column) -> Column:
    """Pattern for a lower-case term that stands alone: letters, digits, '+', '#' may not touch it, nor a dot on its left."""
    return F.concat(F.lit("(?<![a-z0-9+#.])"), escaped(term), F.lit("(?![a-z0-9+#])"))


def contains_term(lower_text: Column, term: Column) -> Column:
    """Whether a text contains a term that stands alone; the plain search first spares most texts the pattern."""
    return (F.instr(lower_text, term) > 0) & F.regexp_like(lower_text, bounded(term))


def without_bullet(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, BULLET, ""))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_GAP)


def letters(text: Column) -> Column:
    """Number of letters of any alphabet."""
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def is_noise(text: Column) -> Column:
    """Contact details, bare dates, and texts of which less than half are letters."""
    return text.rlike(CONTACT) | text.rlike(DATES) | (letters(text) < F.length(text) * 0.5)


def first_email(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, EMAIL, 0), F.lit(""))


def plain_header(line: Column) -> Column:
    """A line as a header would be looked up, or null if it can't be one."""
    s = F.regexp_replace(F.trim(line), r"^:+|:+$", "")
    ok = (s != "") & (F.length(s) <= 45) & (F.size(F.split(F.trim(s), r"\s+")) <= 5) & ~line.rlike(BULLET) & ~s.rlike(EMAIL)
    return F.when(ok, F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z& ]", " "), " +", " ")))


def section_of(header: Column) -> Column:
    """Section of a plain header, null for others; the first section in order wins."""
    pairs = [(syn, sec) for sec, syns in SECTIONS.items() for syn in syns]
    table = {}
    for syn, sec in pairs:
        table.setdefault(syn, sec)
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), header)


def joined(items: Column) -> Column:
    """'a', 'a and b', 'a, b and c'; '' for none."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, F.get(items, 0)).otherwise(F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(" and "), F.element_at(items, -1)))


def trimmed(text: Column, limit: int = 70) -> Column:
    """Single-spaced; a longer text is cut at the last space within the limit and marked '...'."""
    s = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(s, 1, limit)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(cut, F.lit("...")))


def number(value: Column) -> Column:
    """Null for not-a-number."""
    return F.when(~F.isnan(value), value)


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))

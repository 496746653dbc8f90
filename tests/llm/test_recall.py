"""Recall and precision on planted cases, with a fixed seed."""

import random

from rankloom.llm import canon, names, scans, truncated

SUBJECTS = ["the night crew", "our regional office", "the booking desk", "the harbour team", "every depot", "the museum registrar", "the field inspector"]
VERBS = ["documented", "improved", "relocated", "measured", "coordinated", "inspected", "reorganised", "supervised"]
OBJECTS = ["the seed library", "the quarterly complaints", "the turbine calibration", "the firing archive", "the berth allocation", "the induction course", "the maintenance schedule"]
ENDS = ["before the audit", "throughout the relocation", "within six months", "because volumes had doubled", "when the budget was reduced", "for the management board"]


def sentence(r):
    return f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(OBJECTS)} {r.choice(ENDS)}.".capitalize()


def typo(r, w):
    i = r.randrange(1, len(w) - 1)
    return r.choice([w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + r.choice("aeioust") + w[i + 1 :]])


def scores(want, got):
    return len(want & got) / len(want), len(want & got) / max(1, len(got))


def test_names(spark):
    r = random.Random(4)
    family = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)) + r.choice(["ck", "ld", "rn", "ss"]) for _ in range(120)]
    given = ["Zofia", "Robert", "Bogdan", "Farah", "Margaret", "Tomasz"]
    rows, want = [], set()
    for i, f in enumerate(family):
        g = given[i % len(given)]
        forms = [f"{g} {f}", f"{f}, {g}", f"{g} {typo(r, f)}", f"{g.upper()} {typo(r, f).upper()}"]
        rows += [(f"s{i:03d}{j}", n) for j, n in enumerate(forms)]
        want |= {(f"s{i:03d}{a}", f"s{i:03d}{b}") for a in range(4) for b in range(a + 1, 4)}
    got = {(x["a"], x["b"]) for x in names.linked_pairs(names.link_names(spark.createDataFrame(rows, "stem string, name string"))).collect()}
    recall, precision = scores(want, got)
    assert recall >= 0.95 and precision >= 0.95


def test_values(spark):
    r = random.Random(5)
    skills = [f"{a} {b}" for a in ("kiln", "fleet", "archive", "turbine", "orchard", "harbour", "clinic") for b in ("planning", "training", "documentation", "forecasting", "auditing", "brokerage")]
    values = {typo(r, s).upper() if r.random() < 0.5 else " ".join(reversed(typo(r, s).split())): s for s in skills for _ in range(4)}
    values |= {v: "" for v in ("beekeeping", "railway law", "misc", "poetry", "driving licence")}
    terms = spark.createDataFrame([(s, s) for s in skills], "term string, canon string")
    got = {x["entered"]: x["match"] for x in canon.match_values(spark.createDataFrame([(v,) for v in values], "entered string"), terms).collect()}
    recall, precision = scores({(v, s) for v, s in values.items() if s}, {(v, s) for v, s in got.items() if s})
    assert recall >= 0.95 and precision >= 0.98


def test_scans(spark):
    r = random.Random(6)
    rows = [(f"w{i}", " ".join(sentence(r) for _ in range(6)), "docx") for i in range(500)]
    want = set()
    for i in range(40):
        lines = []
        for n in range(1, 9):
            words = sentence(r).split()
            k = max(range(len(words)), key=lambda j: len(words[j]) * (j > 0))
            if r.random() < 0.5:
                for a, b in (("m", "rn"), ("d", "cl"), ("o", "0"), ("e", "c"), ("i", "1")):
                    if a in words[k][1:-1]:
                        words[k] = words[k][0] + words[k][1:].replace(a, b, 1)
                        want.add((f"p{i}", n, "glyph"))
                        break
            lines.append(" ".join(words))
        rows.append((f"p{i}", "\n".join(lines), "pdf"))
    got = {tuple(x) for x in scans.find_noise(spark.createDataFrame(rows, "stem string, raw_text string, source_format string")).collect()}
    recall, precision = scores(want, {g for g in got if g[2] == "glyph"})
    assert recall >= 0.9 and precision >= 0.95


def test_cut_texts(spark):
    r = random.Random(9)
    rows, want = [], set()
    for i in range(600):
        t = " ".join(sentence(r) for _ in range(4))
        if i % 10 == 0:
            t = t[: r.randrange(len(t) // 2, len(t) - 12)].rstrip()
            if not t.endswith("."):
                want.add(i)
        rows.append((i, t))
    got = {x["doc_id"] for x in truncated.find_truncated(spark.createDataFrame(rows, "doc_id bigint, text string")).where("truncated").collect()}
    recall, precision = scores(want, got)
    assert recall >= 0.95 and precision >= 0.95


def test_whole_copies_decide_first(spark):
    whole = "An unheard of errand leads Quillon to the far shore, where wolves assemble. Then nothing."
    rows = [(1, whole), (2, whole[:50]), (3, whole[:75]), (4, whole), (5, whole[:5])]
    got = {x["doc_id"]: (x["truncated"], x["evidence"]) for x in truncated.find_truncated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[2] == (True, "copy") and got[1][0] is False and got[3][0] is False and got[4][0] is False

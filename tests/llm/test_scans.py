from collections import Counter

from rankloom.llm import scans

PROSE = "the supplier documented the quarterly complaints and improved the booking desk before the audit throughout the second-hand relocation of our customs team"
CLEAN = [("w%d" % i, PROSE, "docx") for i in range(30)]
SCAN = "\n".join(
    [
        "CURRICULUM VITAE", "Ann Lee", "Experience", "The suppl1er docurnented the quartcrly com-", "plaints and improved the second-", "Page 1 of 2", "CURRICULUM VITAE", "hand booking desk. We set short-, medium-",
        "and long-term aims", "2016", "Skills", "cornplaints; qiiarterly", "Page 2 of 2",
    ]
)


def test_noise(spark):
    rows = [*CLEAN, ("scan", SCAN, "pdf"), ("scan", SCAN, "pdf"), ("null", None, "pdf"), ("empty", "", "pdf"), ("kind", "x-\ny", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "stem string, raw_text string, source_format string, kind int")
    got = {(r["line_no"], r["kind"]) for r in scans.find_noise(df).collect()}
    assert got == {(1, "header"), (7, "header"), (4, "glyph"), (4, "hyphen"), (5, "hyphen"), (6, "page"), (13, "page")}
    out = {r["stem"]: r["text"] for r in scans.repair(df).collect()}
    assert "The supplier documented the quarterly complaints and improved the second-hand booking desk" in out["scan"].replace("\n", " ")
    assert "Page" not in out["scan"] and "CURRICULUM" not in out["scan"] and "cornplaints" in out["scan"]
    assert out["w1"] == PROSE and out["empty"] == "" and "null" not in out
    assert scans.find_noise(df.where("false")).count() == 0


def test_page_numbers_count_on():
    assert scans.page_lines(["1", "x", "7", "2", "2016", "- 3 -"]) == {0, 3, 5}
    assert scans.page_lines(["i", "text", "ii", "[3]", "Version 3 of 5", "p. 4", "Pagc l of 2"]) == {0, 2, 3, 5, 6}


def test_headers_need_repetition():
    assert scans.header_lines(["Resume of X | Page 1", "a", "Resume of X | Page 2"]) == {0, 2}
    assert scans.header_lines(["Printed 1.2.2020, front desk copy", "a", "Printed 1.2.2020, fr0n+ desk copy"]) == {0, 2}
    assert scans.header_lines(["Ann Lee", "a"]) == set() and scans.header_lines(["", ""]) == set()


def lexicon(counts, *doubts):
    near = {w: [(c, scans.distance(w, c), n) for c, n in counts.items() if scans.distance(w, c) < 1] for w in doubts}
    return scans.Lexicon({}, {w: x for w, x in near.items() if x}, {})


def test_slips_of_typing_stay():
    lex = lexicon({"experience": 100, "management": 100, "return": 90}, "experiance", "managment", "rnanagement", "retu+n", "retum")
    repair = lambda w: lex.repair(w, "", "", Counter())
    assert repair("experiance") is None and repair("managment") is None
    assert repair("rnanagement") == "management" and repair("retu+n") is None and repair("retum") == "return"


def test_misreadings_share_a_skeleton(spark):
    rows = [(f"ab{a}rt", f"ab{b}rt") for a, b in scans._MISREAD] + [(a, b) for a, b in scans._MISREAD]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(scans.skeleton(df.a) != scans.skeleton(df.b)).collect() == []


def test_near_words_against_brute_force(spark):
    lexicon_ = {"management": 90, "modern": 40, "modem": 3, "return": 50, "turbine": 30, "clear": 20, "rare": 1, "audit": 9}
    doubts = {"rnanagement": 0, "modem": 2, "retum": 0, "tur8ine": 0, "dear": 0, "auclit": 0, "management": 89, "xyz": 0, "c1ear": 0}
    got = scans.near_words(spark.createDataFrame(list(doubts.items()), "w string, own bigint"), spark.createDataFrame(list(lexicon_.items()), "a string, n bigint"))
    want = set()
    for w, own in doubts.items():
        strange = not w.isalpha()
        for c, n in lexicon_.items():
            if c != w and len(c) > 2 and n >= (2 if strange else 8 * max(own, 1)) and scans.distance(w, c) <= (0.99 if strange else 0.5 + 0.25 * (len(w) > 8)):
                want.add((w, c))
    assert {(r["w"], r["c"]) for r in got.collect()} == want and ("rnanagement", "management") in want and ("tur8ine", "turbine") in want


def test_very_long_line():
    lex = lexicon({"word": 10}, "w0rd")
    assert scans.Page("w0rd " * 20_000, lex).kinds() == [(1, "glyph")]

import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.functions.edits import edits
from rankloom.functions.stats import probit
from rankloom.operators import ask, audit, components, describe, evaluate, explain, fuse, ingest, lexical, ranking, semantic


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_tokens_keep_dots_and_drop_stop_words(spark):
    assert one(spark, T.tokens(F.col("t")), t="Built REST APIs in Python.") == ["built", "rest", "apis", "python."]


@pytest.mark.parametrize("text,term,hit", [("c and", "c", True), ("c++ and", "c", False), ("c# too", "c", False), ("node.js", "node", True), ("es6+", "es6", False), ("a.net", "net", False), ("(ui/ux)", "ui/ux", True)])
def test_terms_stand_alone(spark, text, term, hit):
    assert one(spark, T.contains_term(F.col("t"), F.col("v")), t=text, v=term) is hit


def test_headers(spark):
    section = lambda t: one(spark, T.section_of(T.plain_header(F.col("t"))), t=t)
    assert section("WORK EXPERIENCE:") == "experience" and section("- Experience with React") is None and section("Skils") is None


def test_joined_and_trimmed(spark):
    assert [one(spark, T.joined(F.array(*map(F.lit, x)))) for x in (["a"], ["a", "b", "c"])] == ["a", "a, b and c"]
    assert one(spark, T.trimmed(F.col("t"), 10), t="one two  three four") == "one two..."


def test_wrapped(spark):
    def brute(t, most):
        out = []
        while len(t) > most:
            at = max(t.rfind(" ", 1, most), 0) or most
            out, t = [*out, t[:at].strip()], t[at:].strip()
        return [*out, t]

    texts = ["x" * 900, "word " * 200, "a" * 399 + " " + "b" * 30, "a" * 400 + " b", "short", "ab " * 133 + "c" * 500]
    df = spark.createDataFrame([(t.strip(),) for t in texts], "t string").select("t", ingest.wrapped(F.col("t"), 400).alias("p"))
    assert all([x for x in r["p"] if x] == [x for x in brute(r["t"], 400) if x] for r in df.collect())


def test_noise_is_judged_before_lines_are_split(spark):
    line = "We kept the archive in order for many years. " * 12 + "See https://x.example for more. " + "And the reading room as well. " * 5
    lines = spark.createDataFrame([("a", 0, line, "summary", False), ("a", 1, "We kept the archive in good order", "summary", False)], "stem string, line_no int, line string, section string, is_header boolean")
    assert [r["text"] for r in ingest.split_units(lines, "stem").collect()] == ["We kept the archive in good order"]


def test_names_of(spark):
    rows = [("Resume_Anne_Smith", "nothing here to see, 123"), ("x", "ANNE-MARIE O. SMITH\n"), ("cv_001", None), ("zoe_12_tom_lee", ""), ("y", "Experience\nJo Lee")]
    got = {r["stem"]: r["name"] for r in ingest.names_of(spark.createDataFrame(rows, "stem string, raw_text string"), "stem", "raw_text").collect()}
    assert got == {"Resume_Anne_Smith": "Anne Smith", "x": "Anne-Marie O. Smith", "cv_001": "cv_001", "zoe_12_tom_lee": "Tom Lee", "y": "Jo Lee"}


def test_fuzzy_headers_and_skills(spark):
    text = "Jo Lee\nSkils\nkubernets, react js\nskils\nWORK EXPERINCE:\nused sql daily\n- Edukation"
    texts = spark.createDataFrame([("a", text)], "stem string, raw_text string")
    got = {r["line"]: (r["is_header"], r["section"]) for r in ingest.fuzzy_headers(ingest.lines_of(texts, "stem", "raw_text"), "stem").collect()}
    assert got["Skils"] == (True, "skills") and got["skils"][0] is False and got["WORK EXPERINCE:"] == (True, "experience") and got["- Edukation"][0] is False
    vocab = spark.createDataFrame([(w, w) for w in ("kubernetes", "reactjs", "sql")], "term string, canon string")
    assert {r["skill"] for r in ingest.all_skills(texts, "stem", "raw_text", vocab).collect()} == {"kubernetes", "reactjs", "sql"}


def test_units_of_a_small_resume(spark):
    text = "\n".join(["Jane Doe", "Experience", "- Built the pipeline that everyone here relies on", "short", "Education", "Certificate in something long enough here", "Experience", "- Wrote the manual for the whole night shift"])
    lines = ingest.with_sections(ingest.lines_of(spark.createDataFrame([("a", text), ("b", None), ("c", "")], "stem string, raw_text string"), "stem", "raw_text"), "stem")
    rows = [tuple(r) for r in ingest.split_units(lines, "stem").orderBy("stem", "unit_idx").collect()]
    assert rows == [("a", 0, "Built the pipeline that everyone here relies on", "experience"), ("a", 1, "Wrote the manual for the whole night shift", "experience")]
    assert [tuple(r) for r in ingest.display_name(lines, "stem").collect()] == [("a", "Jane Doe")]


@pytest.mark.parametrize("a,b,want", [("kubernets", "kubernetes", 94.7368), ("technicl skills", "technical skills", 96.7742), ("djanga", "django", 83.3333), ("react js", "reactjs", 93.3333)])
def test_ratio(a, b, want):
    assert ingest.ratio(a, b) == pytest.approx(want, abs=1e-3)


def test_fuzzy_match_takes_the_best(spark):
    vocab = spark.createDataFrame([("kubernetes", "k8s"), ("django", "django")], "term string, canon string")
    rows = ingest.fuzzy_match(spark.createDataFrame([("kubernets",), ("djanga",), (None,)], "e string"), "e", vocab, 88.0).collect()
    assert [(r["entry"], r["canon"]) for r in rows] == [("kubernets", "k8s")]


@pytest.mark.parametrize("values,want", [([0.5, 0.6, 0.7], [0.227103, 0.5, 0.772897]), ([0.6] * 3, [0.5] * 3), ([0.5, 0.5, 0.9, 0.7], [0.288120, 0.288120, 0.818699, 0.574812])])
def test_calibrate(spark, values, want):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, i int, sem_raw double")
    assert [r["sem_cal"] for r in semantic.calibrate(df, ["g"]).orderBy("i").collect()] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("kw,sem,miss,want", [(0.771, 0.406, 0, 58.85), (0.489, 0.422, 0, 45.55), (0.4, 0.5, 1, 39.6), (0.4, 0.5, 5, 22.5), (None, 0.5, 0, 25.0)])
def test_final_score(spark, kw, sem, miss, want):
    assert spark.createDataFrame([(kw, sem, miss)], "k double, s double, m int").select(fuse.final_score(F.col("k"), F.col("s"), F.col("m"))).first()[0] == want


def test_flags(spark):
    rows = [(0.0, 0.50, True), (0.0, 0.44, True), (0.5, 0.1, True), (0.0, 0.44, False), (0.0, float("nan"), True), (None, None, True)]
    got = [(r["matched"], r["hard_miss"]) for r in fuse.flags(spark.createDataFrame(rows, "kw_hit double, sem_cal double, required boolean")).collect()]
    assert got == [(False, False), (False, True), (True, False), (False, False), (False, False), (False, False)]


@pytest.mark.parametrize("grades,want", [([2, 1, 0, 1], 0.977859), ([0, 0, 2], 0.5), ([2, 2, 1, 0], 1.0), ([0, 0], 0.0), ([1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1], 0.703918)])
def test_ndcg(spark, grades, want):
    df = spark.createDataFrame([(1, i, float(-i), g) for i, g in enumerate(grades)], "g int, i int, s double, r int")
    assert evaluate.ndcg(df, ["g"], "s", "r", "i").first()["ndcg"] == pytest.approx(want, abs=1e-6)


def test_bm25_goldens(spark):
    def run(docs):
        texts = spark.createDataFrame([(str(i), " ".join(d)) for i, d in enumerate(docs)], "stem string, text string")
        pool = texts.select(F.lit(1).alias("run"), "stem")
        query = spark.createDataFrame([(1, "react css react")], "run int, text string")
        return lexical.bm25(pool, query, texts, "run").orderBy("stem").collect()

    rows = run([["react", "node.js", "react"], ["react", "css"], ["sql", "python", "css"], ["go"], ["go", "sql"]])
    assert [r["bm25"] for r in rows] == pytest.approx([0.860743, 1.052472, 0.289156, 0, 0], abs=1e-5)
    assert [r["bm25_norm"] for r in rows] == pytest.approx([0.817829, 1, 0.274740, 0, 0], abs=1e-5)
    assert [r["bm25_norm"] for r in run([["react", "node.js", "react"], ["react", "css"], ["sql", "python", "css"], ["go"]])] == [0.5] * 4


def test_keyword_hit_fraction(spark):
    pairs = spark.createDataFrame([(1, "j", "a")], "run_id int, jd_id string, stem string")
    req = spark.createDataFrame([("j", "R01", ["react", "css"]), ("j", "R02", [])], "jd_id string, req_id string, keywords array<string>")
    none = spark.createDataFrame([], "stem string, skill string")
    rows = lexical.keyword_hits(pairs, req, none, spark.createDataFrame([("a", "Used React.")], "stem string, text string")).orderBy("req_id").collect()
    assert [(r["kw_hit"], r["kw_terms"]) for r in rows] == [(0.5, ["react"]), (0.0, [])]


def test_pooling(spark):
    sims = spark.createDataFrame([("q", "a", 0, 0.9), ("q", "a", 1, 0.1), ("q", "a", 2, 0.8), ("q", "b", 0, 0.4)], "query_id string, key string, unit_idx int, sim double")
    rows = {r["key"]: (round(r["raw"], 6), r["best_unit"]) for r in semantic.pool_units(sims).collect()}
    assert rows == {"a": (0.85, 0), "b": (0.4, 0)}


def test_numbered_agrees_with_a_sorted_list_under_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(50), i) for i in range(2000)] + [(None, 1, -1)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = {r["i"]: r["rank"] for r in ranking.numbered(df, ["g"], [F.col("v").desc(), F.col("i").asc()]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = n
    assert got == want
    assert ranking.numbered(df.where("false"), ["g"], [F.col("v").asc()]).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(45)] + [("p" + str(i), "p" + str(i + 1)) for i in range(30)] + [("x", "x"), (None, "y")]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    assert got == {v: find(v) for v in root}
    assert components.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_probit(spark):
    from statistics import NormalDist

    ps = [0.001, 0.02, 0.1, 0.5, 0.77, 0.99, 0.9999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(probit(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-7)
    assert one(spark, probit(F.col("p")), p=1.0) is None


def test_edits_against_a_plain_recursion():
    def slow(a, b):
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in "ab")
        assert edits(a, b, 3) == min(slow(a, b), 4)


def test_description_of_a_job(spark):
    text = "<!--\n# hidden\n-->\n# Bright Foods\n**Junior Data Engineer** | remote\n## Required skills\n- Confident use of python and sql\n- Confident use of python and sql\n## Nice to have\n- Some django on the side\n## About the team\n- Strong python in daily work\n- Benefits are plenty and good\n- short\n"
    jd = spark.createDataFrame([("j", text), ("n", None)], "jd_id string, text string")
    vocab = spark.createDataFrame([("python", "python"), ("sql", "sql"), ("django", "django")], "term string, canon string")
    rows = [(r["req_id"], r["required"], r["weight"], r["keywords"]) for r in describe.requirements(jd, vocab).orderBy("req_idx").collect()]
    assert rows == [("R01", True, 1.0, ["python", "sql"]), ("R02", False, 0.5, ["django"]), ("R03", True, 1.0, ["python"])]
    assert {tuple(r) for r in describe.titles(jd).collect()} == {("j", "Junior Data Engineer", "Bright Foods"), ("n", "n", "")}


def test_audit_of_wording(spark):
    df = spark.createDataFrame([(1, "Junior analyst", "We want a Ninja with 3+ years, no ninjas"), (2, "Lead", "5 years")], "id int, title string, text string")
    coded = audit.coded_words(df, ["id"], "text", audit.lexicon(spark))
    assert [(r["id"], r["term"], r["as_written"], r["category"]) for r in coded.collect()] == [(1, "ninja", "Ninja", "masculine_coded")]
    years = audit.contradictions(df)
    assert [(r["id"], r["years"], r["term"]) for r in years.collect()] == [(1, 3, "3+ year")]
    found = audit.findings([audit.word_findings(coded, ["id"]), audit.contradiction_findings(years, ["id"])], ["id"]).collect()
    assert {(r["type"], r["severity"], r["term"]) for r in found} == {("coded_language", "medium", "Ninja"), ("experience_contradiction", "high", "3+ year")}


def test_names_in_questions(spark):
    people = spark.createDataFrame([("a", "Priya Menon"), ("b", "Karan Menon"), ("c", "Ravi Rao"), ("d", None)], "key string, name string")
    q = spark.createDataFrame([(1, "Why Priya Menon?"), (2, "and menon?"), (3, "ravi")], "question_id int, question string")
    got = {(r["question_id"], r["key"], r["score"]) for r in ask.resolve_names(q, people).collect()}
    assert got == {(1, "a", 3), (2, "a", 1), (2, "b", 1)}


def test_explanation_words(spark):
    ranked = spark.createDataFrame([(1, "a", 1, 58.85, 0.771, 0.406, 1, 2, "Ann Lee")], "run_id int, stem string, rank int, final_score double, keyword_score double, semantic_score double, covered int, required_total int, name string")
    cells = spark.createDataFrame(
        [(1, "a", "R01", True, 1.0, ["sql"], 0.9, "SQL work", "wrote sql daily", True, False), (1, "a", "R02", True, 0.0, [], 0.3, "Team lead", "", False, True)],
        "run_id int, stem string, req_id string, required boolean, kw_hit double, kw_terms array<string>, sem_cal double, text string, unit_text string, matched boolean, hard_miss boolean",
    )
    said = explain.explanations(ranked, explain.best_matched(cells, ["run_id"]), explain.worst_missing(cells, ["run_id"]), ["run_id"]).first()["explanation"]
    assert said == (
        "Rank 1: Ann Lee, score 58.85, meets 1 of 2 required criteria (keyword 77.1, semantic 40.6). Both channels agree on sql."
        ' For instance: "wrote sql daily". Required but without any evidence: Team lead.'
    )


def test_grid_has_135_configurations(spark):
    assert evaluate.weight_grid(spark).count() == 135 and math.isclose(evaluate.weight_grid(spark).agg(F.max("w_kw")).first()[0], 0.7)

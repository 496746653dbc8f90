import io
import json
import zipfile

from pyspark.sql import functions as F

from rankloom.functions.cleaning import cleaned
from rankloom.operators import ask, evaluate, explain, fuse, ingest
from rankloom.plans import pipeline, report
from rankloom.settings import DEFAULT, Settings
from rankloom.sources import artifact, readers, resources
from rankloom.streaming import ingest as stream

LONG = "Jane Doe\njane@doe.example\nExperience\n- Wrote the python service that the night shift relies on every day\n- Ran the sql reports for the whole region and kept them green\n"


def docx(paragraphs, rows):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    body = f'<w:document xmlns:w="{w}"><w:body>{"".join(map(p, paragraphs))}{table}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    return out.getvalue()


def test_cleaned(spark):
    cases = {
        "•\nLed team": "- Led team", "a\u00a0b": "a b", "ﬁle": "file", "a\n\n\n\nb &amp; c": "a\n\nb & c", "a\x0cb\u2028c": "a\nb\nc", " \t x  y \n  z ": "x y\nz", "“q” – it’s\u200b": '"q" - it\'s', "": "", "-\n\nitem": "- item",
    }
    df = spark.createDataFrame([*cases.items(), (None, None)], "t string, want string")
    assert [r for r in df.select("want", cleaned(F.col("t")).alias("got")).collect() if r["want"] != r["got"]] == []


def test_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text(LONG)
    (tmp_path / "b.xml").write_text('<r><skills><g category="Lang">x</g></skills><summary>text</summary></r>')
    (tmp_path / "c.docx").write_bytes(docx(["one", "two"], [["x", "x", "", "y"]]))
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.png").write_bytes(b"no")
    rows = {r["stem"]: r for r in readers.read_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == set("abcd")
    assert rows["b"]["raw_text"] == "TECHNICAL SKILLS\nx\nLang:\ntext"
    assert rows["c"]["raw_text"] == "one\ntwo\nx | y"
    assert rows["d"]["raw_text"] == "" and rows["d"]["error"]
    assert readers.pick_description(readers.read_folder(spark, str(tmp_path))).first()["stem"] == "c"


def test_artifact_round_trip(spark, tmp_path):
    ranked = spark.createDataFrame([(7, s, i, 50.0 - i, 0.5, 0.25, 0.3333, 1, 2, 0, "said", "template", False) for i, s in enumerate("abc", 1)],
        "run_id bigint, stem string, rank bigint, final_score double, keyword_score double, semantic_score double, bm25_norm double, covered int, required_total int, n_hard_miss int, explanation string, explanation_source string, reranked boolean")
    people = spark.createDataFrame([("a", "Ann", "a@x.example", "f", "pdf", ["pdf"], ["sql", "css"])], "stem string, name string, email string, family string, source_format string, formats_available array<string>, skills array<string>")
    cells = spark.createDataFrame([(7, "a", r, "text", True, True, False, 0.66666, ["sql"], 0.5, 0.4, float("nan"), "unit", "summary") for r in ("R02", "R01")],
        "run_id bigint, stem string, req_id string, text string, required boolean, matched boolean, hard_miss boolean, kw_hit double, kw_terms array<string>, sem_cal double, sem_raw double, ce_score double, unit_text string, unit_section string")
    rows = artifact.candidates(ranked, people, cells)
    artifact.save(rows, str(tmp_path / "a"))
    back = artifact.load(spark, str(tmp_path / "a"))
    first = artifact.lookup(back, 7, 1).first()
    assert (first["name"], first["keyword_score"], first["delta"], first["bm25"], first["required_coverage"], first["skills"]) == ("Ann", 50.0, -25.0, 0.333, "1/2", ["css", "sql"])
    assert [(x["id"], x["kw_hit"], x["cross_encoder"]) for x in first["evidence"]] == [("R01", 0.667, None), ("R02", 0.667, None)]
    assert {r["name"] for r in artifact.flat(back).collect()} == {"Ann", "b", "c"}
    jobs = spark.createDataFrame([(7, "j", "t", "c", "e")], "run_id bigint, jd_id string, title string, company string, bi_encoder string")
    req = spark.createDataFrame([("j", 0, "R01", "text", "skill", True, ["sql"], 1.0)], "jd_id string, req_idx int, req_id string, text string, kind string, required boolean, keywords array<string>, weight double")
    found = spark.createDataFrame([(7, "overly_narrow", "medium", "sql", 3)], "run_id bigint, type string, severity string, term string, excluded_count bigint")
    head = artifact.heads(jobs, req, found).first()
    assert (head["checked"], head["flags"], head["config"]["w_keyword"], head["requirements"][0]["id"]) == (1, 1, 0.5, "R01")


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(LONG)
    seen = []
    stream.ingest_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), lambda s, p: seen.append(s.read.parquet(p).count()))
    assert seen == [1]
    events = spark.createDataFrame([("2024-01-01 10:00:00", "x", 2.0), ("2024-01-01 11:00:00", "x", 3.0)], "ts string, event_type string, value double")
    events.write.parquet(str(tmp_path / "ev"))
    days = stream.daily_events(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    q = days.writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["n"], r["total"]) for r in spark.table("days").collect()] == [(2, 5.0)]


def test_pipeline_ranks_the_better_candidate_first(spark):
    people = spark.createDataFrame([("good", LONG), ("poor", LONG.replace("python service", "garden path").replace("sql reports", "tea parties")), ("tiny", "x")], "stem string, raw_text string")
    jd = spark.createDataFrame([("j", "# Role\n## Required\n- Confident use of python\n- Confident use of sql\n")], "jd_id string, text string")
    vocab = spark.createDataFrame([("python", "python"), ("sql", "sql")], "term string, canon string")
    out = pipeline.rank(people, jd, vocab)
    ranked = out["ranked"].orderBy("rank").collect()
    assert [r["stem"] for r in ranked] == ["good", "poor"] and ranked[0]["final_score"] > ranked[1]["final_score"]
    assert out["explanations"].count() == 2
    assert fuse.coverage(out["evidence"], ["jd_id"]).where("stem = 'good'").first()["covered"] == 2
    assert out["units"].where(F.size("vector") != 256).count() == 0


def test_answers_and_report(spark):
    cell = lambda i, m, req=True: (i, f"criterion {i}", req, m)
    rows = spark.createDataFrame(
        [("a", "Priya Menon", "web", 1, 60.0, 70.0, 50.0, "2/2", [cell("R01", True), cell("R02", True, False)]), ("b", "Karan Rao", None, 2, 40.5, 30.0, None, "1/2", [cell("R01", False), cell("R02", True, False)])],
        "stem string, name string, family string, rank bigint, final_score double, keyword_score double, semantic_score double, required_coverage string, evidence array<struct<id: string, requirement: string, required: boolean, matched: boolean>>",
    )
    q = spark.createDataFrame([(1, "Why is Priya Menon above Karan Rao?"), (2, "What about karan?"), (3, "Who leads?"), (4, "Tell me of Karan Rao")], "question_id int, question string")
    got = {r["question_id"]: (r["about"], r["answer"]) for r in ask.answers(q, rows).collect()}
    assert got[1][0] == ["a", "b"] and got[1][1].endswith("They differ in: required: criterion R01 (only Priya Menon).")
    assert got[4] == (["b"], "Karan Rao is number 2 with 40.50, meets 1/2 required criteria (keyword 30.00, semantic none).")
    assert got[3] == (["a", "b"], "First are number 1 Priya Menon (60.00); number 2 Karan Rao (40.50).")
    assert report.leaderboard(rows).splitlines()[0].split() == ["rank", "name", "family", "score", "keyword", "semantic", "required"] and report.leaderboard(rows).endswith("spread 19.50")


def test_resources(spark, tmp_path):
    put = lambda n, v: (tmp_path / n).write_text(json.dumps(v)) and str(tmp_path / n)
    skills, aliases = put("s.json", {"web": ["React", "Vue"]}), put("a.json", {"reactjs": "react", "vue": "vue.js"})
    assert {tuple(r) for r in resources.vocabulary(spark, skills, aliases).collect()} == {("react", "react"), ("reactjs", "react"), ("vue", "vue.js")}
    assert {tuple(r) for r in resources.words(spark, put("w.json", {"_c": ["x"], "notes": {}, "age": ["young"], "feminine_coded": ["warm"]})).collect()} == {("age", "young")}
    assert resources.families(put("f.json", {"families": [["web", ["web dev"]]], "relevance": {"web": {"web": 2}}})) == ([("web", ("web dev",))], {"web": {"web": 2}})


def test_settings(spark, tmp_path):
    s = DEFAULT.changed(spark, {"RANKLOOM_PENALTY": "0.2", "RANKLOOM_TOP_UNITS": "3", "RANKLOOM_FORMAT_PREFERENCE": "pdf,txt"})
    assert (s.penalty, s.top_units, s.format_preference) == (0.2, 3, ("pdf", "txt"))
    s.save(str(tmp_path / "s.json"))
    assert Settings.load(str(tmp_path / "s.json")) == s
    found = spark.createDataFrame([(0, 0.5), (134, 0.9)], "config_id int, mean_strict double")
    assert evaluate.best_settings(found, evaluate.weight_grid(spark)).w_keyword == 0.7


def test_formats_against_the_structured_one(spark):
    rows = spark.createDataFrame([("a", "xml", ["x", "y"], "Jo Lee"), ("a", "pdf", ["x", "z"], " jo lee"), ("a", "txt", ["x"], None), ("b", "pdf", ["x"], "B")], "stem string, fmt string, skills array<string>, name string")
    got = {r["fmt"]: (r["precision"], r["recall"], r["same_name"]) for r in evaluate.against_format(rows).collect()}
    assert got == {"pdf": (0.5, 0.5, True), "txt": (1.0, 0.5, False)}
    names = spark.createDataFrame([("cyber_security2",), ("Web_Dev",)], "f string")
    assert [r[0] for r in names.select(ingest.family_of_file(F.col("f"), {"cyber_security": "cyber_sec"})).collect()] == ["cyber_sec", "web_dev"]


def test_scorer_limit_and_writer(spark):
    people = spark.createDataFrame([("good", LONG), ("poor", LONG.replace("python service", "garden path").replace("sql reports", "tea parties"))], "stem string, raw_text string")
    jd = spark.createDataFrame([("j", "Data Engineer\nAcme\n## Required skills\n- Confident use of python\n- Daily work with sql\n")], "jd_id string, text string")
    vocab = spark.createDataFrame([("python", "python"), ("sql", "sql")], "term string, canon string")
    out = pipeline.rank(people, jd, vocab, scorer=lambda pairs: [9.0 if "python" in u else -9.0 for _, u in pairs], limit=1)
    first = out["ranked"].collect()
    assert [(r["stem"], r["rank"], r["reranked"]) for r in first] == [("good", 1, True)]
    said = out["explanations"]
    cells, name = out["evidence"], F.col("stem").alias("name")
    sheets = explain.facts(out["ranked"].select("*", name), explain.best_matched(cells, ["jd_id"]), explain.worst_missing(cells, ["jd_id"]), ["jd_id"])
    told = explain.narrated(sheets, said, lambda t: f"{json.loads(t)['name']} leads", ["jd_id"]).first()
    assert (told["explanation"], told["explanation_source"]) == ("good leads", "written")
    assert explain.narrated(sheets, said, lambda t: 1 / 0, ["jd_id"]).first()["explanation_source"] == "template"
    grades = spark.createDataFrame([("j", "good", 1)], "jd_id string, stem string, grade int")
    assert [(r["encoder"], r["ndcg"]) for r in pipeline.compare_encoders(people, jd, vocab, grades, {"default": None}).collect()] == [("default", 1.0)]

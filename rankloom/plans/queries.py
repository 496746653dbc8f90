"""Queries of the scoring operators over the test tables. Each runs over whole tables; repeated rows count once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import ask, audit, describe, evaluate, explain, fuse, ingest, lexical, semantic
from rankloom.session import if_small
from rankloom.sources import artifact
from rankloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

RUN = ["run_id"]
#: Families of the test table's stems, in order; a parameter like any pattern list.
FAMILIES = [(f, (f,)) for f in ("archive_care", "clinic_admin", "data_steward", "fleet_routing", "grant_office", "harbour_desk", "kiln_ops", "museum_reg", "payroll", "tariff_desk", "textile_buy", "turbine_tech")]
#: Categories of skills that name a tool; a parameter like the families.
TOOLS = ("platforms", "registers", "reporting tools", "trackers", "workshop software")
#: Family that a description looks for, by its title, and families close to it, which count half.
TARGETS = {
    "Archive Assistant": ("archive_care", "museum_reg"), "Clinic Scheduler": ("clinic_admin", "payroll"), "Data Steward": ("data_steward", "archive_care"), "Ferry Dispatcher": ("fleet_routing", "harbour_desk"),
    "Grant Officer": ("grant_office", "payroll"), "Harbour Clerk": ("harbour_desk", "tariff_desk"), "Kiln Supervisor": ("kiln_ops", "turbine_tech"), "Museum Registrar": ("museum_reg", "archive_care"),
    "Tariff Specialist": ("tariff_desk", "textile_buy"), "Turbine Technician": ("turbine_tech", "kiln_ops"),
}
QUESTIONS = [(1, "Why is Bogdan Zipopasarn ranked above Kwame Heropreleld?"), (2, "What about Zofia?"), (3, "Tell me about James Smith and Nadia Farah")]


def _distinct(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return table(spark, d, name, *columns).distinct()


def _candidates(spark, d, *columns):
    return _distinct(spark, d, "candidates", "stem", *columns)


def _requirements(spark, d):
    r = _distinct(spark, d, "requirements", "jd_id", "req_idx", "id", "text", "required", "keywords", "weight")
    return r.withColumnRenamed("id", "req_id")


def _evidence(spark, d, *columns):
    return _distinct(spark, d, "evidence", "run_id", "jd_id", "stem", "req_id", *columns)


def _scores(spark, d):
    return _distinct(spark, d, "scores", "run_id", "jd_id", "stem", "keyword_score", "semantic_score", "n_hard_miss", "covered", "required_total")


def _skills(spark, d):
    return _candidates(spark, d, "skills").select("stem", F.explode("skills").alias("skill")).where("skill is not null")


def _texts(spark, d):
    return _candidates(spark, d, "raw_text").select("stem", F.coalesce("raw_text", F.lit("")).alias("text"))


def token_counts(spark, d):
    return _candidates(spark, d, "raw_text").where("raw_text is not null").select("stem", F.size(T.tokens(F.col("raw_text"))).cast("bigint").alias("n_tokens"))


def readable_candidates(spark, d):
    return _candidates(spark, d, "raw_text").where(F.length("raw_text") >= 120).select("stem")


def first_requirements(spark, d):
    return ingest.keep_first(_requirements(spark, d).where("text is not null"), ["jd_id"], "text", "req_idx").select("jd_id", "req_id")


def best_formats(spark, d):
    rows = _candidates(spark, d, "formats_available").select("stem", F.explode("formats_available").alias("fmt"))
    return ingest.best_format(rows, "stem", "fmt").select("stem", "best", F.array_join("formats", ",").alias("formats"))


def line_sections(spark, d):
    lines = ingest.lines_of(_candidates(spark, d, "raw_text"), "stem", "raw_text")
    return ingest.with_sections(lines, "stem").select("stem", "line_no", "section", "is_header")


def sentence_counts(spark, d):
    return _distinct(spark, d, "units", "stem", "unit_idx", "text").select("stem", "unit_idx", F.size(T.sentences(F.col("text"))).cast("bigint").alias("n_sentences"))


def noise_lines(spark, d):
    lines = ingest.lines_of(_candidates(spark, d, "raw_text"), "stem", "raw_text")
    return lines.where(F.length("line") > 0).where(T.is_noise(F.col("line"))).select("stem", "line_no")


def first_emails(spark, d):
    return _candidates(spark, d, "raw_text").select("stem", T.first_email(F.col("raw_text")).alias("email")).where("email is not null")


def candidate_units(spark, d):
    lines = ingest.lines_of(_candidates(spark, d, "raw_text").where(F.length("raw_text") >= 120), "stem", "raw_text")
    return ingest.split_units(ingest.with_sections(lines, "stem"), "stem")


def candidate_names(spark, d):
    return ingest.names_of(_candidates(spark, d, "raw_text"), "stem", "raw_text")


def fuzzy_sections(spark, d):
    """Headings that are misspelled, and what they stand for."""
    lines = ingest.fuzzy_headers(ingest.lines_of(_candidates(spark, d, "raw_text"), "stem", "raw_text"), "stem")
    return lines.where(F.col("is_header") & T.section_of(T.plain_header(F.col("line"))).isNull()).select("stem", "line_no", "line", "section")


def candidate_skills(spark, d):
    """Skills named anywhere in a text or, misspelled, in its skill section."""
    return ingest.all_skills(_candidates(spark, d, "raw_text"), "stem", "raw_text", table(spark, d, "vocab", "term", "canon"))


def _posts(spark, d):
    return table(spark, d, "documents", "doc_id", "text", "doc_kind").where("doc_kind = 'job_post'").select("doc_id", "text").distinct()


def visible_lines(spark, d):
    """Filled lines of job posts outside comments."""
    return describe.visible_lines(_posts(spark, d), "doc_id", "text").where(F.length(F.trim("line")) > 0).select("doc_id", "line_no")


def parsed_requirements(spark, d):
    """Requirements taken from the bullets of job posts."""
    out = describe.requirements(_posts(spark, d), table(spark, d, "vocab", "term", "canon"), "doc_id")
    return out.select("doc_id", "req_idx", "req_id", "text", "kind", "required", F.array_join("keywords", "|").alias("keywords"), "weight")


def parsed_titles(spark, d):
    return describe.titles(_posts(spark, d), "doc_id").select("doc_id", "title", "company")


def stem_families(spark, d):
    return ingest.family_of(_candidates(spark, d), "stem", FAMILIES)


def vocabulary_matches(spark, d):
    vocab = table(spark, d, "vocab", "term", "canon")
    return ingest.match_vocabulary(_candidates(spark, d, "raw_text"), "stem", "raw_text", vocab).select("stem", "canon").distinct()


def requirement_keywords(spark, d):
    found = ingest.keywords_in(_requirements(spark, d), ["jd_id", "req_id"], "text", table(spark, d, "vocab", "term", "canon"))
    return found.select("jd_id", "req_id", F.array_join("keywords", "|").alias("keywords"))


def alias_lookup(spark, d):
    vocab = table(spark, d, "vocab", "term", "canon").select(F.lower("term").alias("term"), "canon").distinct()
    rows = _skills(spark, d).select("stem", F.lower(F.trim("skill")).alias("term")).distinct()
    return rows.join(if_small(vocab), "term").select("stem", "canon").distinct()


def fuzzy_skills(spark, d):
    entries = _skills(spark, d).select(F.explode(ingest.entries_of(F.col("skill"))).alias("entry"))
    return ingest.fuzzy_match(entries, "entry", table(spark, d, "vocab", "term", "canon"), 88.0)


def _hits(spark, d):
    pairs = _scores(spark, d).select("run_id", "jd_id", "stem")
    return lexical.keyword_hits(pairs, _requirements(spark, d).select("jd_id", "req_id", "keywords"), _skills(spark, d), _texts(spark, d))


def keyword_hits(spark, d):
    return _hits(spark, d).select("run_id", "stem", "req_id", F.round("kw_hit", 9).alias("kw_hit"), F.size("kw_terms").cast("bigint").alias("n_terms"))


def _bm25(spark, d):
    pool = _scores(spark, d).select("run_id", "stem")
    text = _requirements(spark, d).groupBy("jd_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    query = _distinct(spark, d, "runs", "run_id", "jd_id").join(text, "jd_id").select("run_id", "text")
    return lexical.bm25(pool, query, _texts(spark, d), "run_id")


def bm25_scores(spark, d):
    return _bm25(spark, d).select("run_id", "stem", F.round("bm25", 6).alias("bm25"), F.round("bm25_norm", 6).alias("bm25_norm"))


def keyword_channel(spark, d):
    out = lexical.keyword_channel(_hits(spark, d), _requirements(spark, d), _bm25(spark, d), "run_id")
    return out.select("run_id", "stem", F.round("keyword_score", 9).alias("keyword_score"))


def similar_vectors(spark, d):
    """Every vector whose id is divisible by 20 against all vectors, pooled by the 25 groups of vec_id."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    u = e.select((F.col("vec_id") % 25).alias("key"), F.col("vec_id").alias("unit_idx"), F.col("embedding").alias("v"))
    return semantic.pool_units(semantic.best_similarities(q, u)).select("query_id", "key", F.round("raw", 6).alias("raw"), "best_unit")


def calibrated(spark, d):
    out = semantic.calibrate(_evidence(spark, d, "sem_raw"), ["run_id", "req_id"])
    return out.select("run_id", "stem", "req_id", F.round("sem_cal", 6).alias("sem_cal"))


def semantic_channel(spark, d):
    cal = semantic.calibrate(_evidence(spark, d, "sem_raw"), ["run_id", "req_id"])
    return semantic.semantic_channel(cal, _requirements(spark, d), RUN).select("run_id", "stem", F.round("semantic_score", 6).alias("semantic_score"))


def _flagged(spark, d, *columns):
    return fuse.flags(_evidence(spark, d, "required", "kw_hit", "sem_cal", *columns))


def required_coverage(spark, d):
    c = fuse.coverage(_flagged(spark, d), RUN)
    return c.select("run_id", "stem", "n_hard_miss", "covered", "required_total", F.round(fuse.gate(F.col("n_hard_miss")), 6).alias("factor"))


def _scored(spark, d):
    s = _scores(spark, d)
    return s.withColumn("final_score", fuse.final_score(F.col("keyword_score"), F.col("semantic_score"), F.col("n_hard_miss")))


def _ranked(spark, d):
    return fuse.rank_within(_scored(spark, d), RUN)


def final_ranks(spark, d):
    return _ranked(spark, d).select("run_id", "stem", "final_score", "rank")


def leaderboard(spark, d):
    """The first 15 of each run with the columns a reader needs."""
    return fuse.top_within(_scored(spark, d), RUN, 15).select("run_id", "rank", "stem", "final_score", F.format_string("%d/%d", "covered", "required_total").alias("coverage"))


def reranked(spark, d):
    ev = _evidence(spark, d, "required", "unit_text", "ce_score")
    return fuse.rerank(_ranked(spark, d), ev, RUN).select("run_id", "stem", "rank", "prior_rank", F.round("final_score", 2).alias("final_score"), "reranked")


def score_spread(spark, d):
    return _scored(spark, d).groupBy("run_id").agg(F.min("final_score").alias("lowest"), F.max("final_score").alias("highest"), F.round(F.max("final_score") - F.min("final_score"), 6).alias("spread"))


def matched_top8(spark, d):
    return explain.best_matched(_flagged(spark, d), RUN).select("run_id", "stem", "pos", "req_id", "how")


def missing_top6(spark, d):
    return explain.worst_missing(_flagged(spark, d), RUN).select("run_id", "stem", "pos", "req_id", "hard_miss")


def semantic_only(spark, d):
    f = _flagged(spark, d)
    return f.groupBy("run_id", "stem").agg(F.count_if("matched").alias("n_matched"), F.count_if(F.col("matched") & (explain.how() == "semantic only")).alias("n_semantic_only"), F.count("*").alias("n_total"))


def next_candidates(spark, d):
    return explain.next_in_rank(_ranked(spark, d).select("run_id", "stem", "rank", "final_score"), RUN).select("run_id", "stem", "rank", "next_key", "next_score")


def neighbour_deltas(spark, d):
    pairs = explain.next_in_rank(_ranked(spark, d).select("run_id", "stem", "rank", "final_score"), RUN).where("next_key is not null").select("run_id", F.col("stem").alias("a"), F.col("next_key").alias("b"))
    return explain.deltas(_flagged(spark, d), pairs, RUN).select("run_id", "a", "b", "req_id", "a_matched", "b_matched")


def narrow_requirements(spark, d):
    req = _requirements(spark, d).select("jd_id", "req_id", "required", F.transform("keywords", lambda k: F.lower(F.trim(k))).alias("keywords"))
    skills = _skills(spark, d).select("stem", F.lower(F.trim("skill")).alias("skill"))
    tools = table(spark, d, "skills", "skill", "category").where(F.col("category").isin(*TOOLS))
    out = audit.narrow(_ranked(spark, d), _evidence(spark, d, "kw_hit", "sem_raw"), req, skills, tools, RUN)
    return out.select("run_id", "req_id", F.array_join("tools", ",").alias("tools"), "excluded_count", F.array_join("alternatives_used", ",").alias("alternatives"))


def coded_words(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return audit.coded_words(docs, ["doc_id"], "text", audit.lexicon(spark)).select("doc_id", "category", "term")


def listed_words(spark, d):
    """The same operator over requirements, with the skills by category as the list of words."""
    words = table(spark, d, "skills", "category", "skill").select("category", F.col("skill").alias("term"))
    return audit.coded_words(_requirements(spark, d).select("jd_id", "req_id", "text"), ["jd_id", "req_id"], "text", words).select("jd_id", "req_id", "category", "term", "as_written", "context")


def _findings(spark, d):
    jobs = _distinct(spark, d, "runs", "run_id", "jd_id", "title")
    req = _requirements(spark, d).select("jd_id", "text")
    words = audit.word_findings(audit.coded_words(req.distinct(), ["jd_id"], "text", audit.lexicon(spark)), ["jd_id"]).join(jobs.select("run_id", "jd_id"), "jd_id").drop("jd_id")
    years = audit.contradiction_findings(audit.contradictions(req.join(jobs, "jd_id")), RUN)
    narrow = narrow_requirements(spark, d).select("run_id", F.lit("overly_narrow").alias("type"), F.lit("medium").alias("severity"), F.col("tools").alias("term"), "excluded_count")
    return audit.findings([words, years, narrow], RUN)


def findings(spark, d):
    """Coded wording, contradictions and narrow criteria of all runs, each once."""
    return _findings(spark, d)


def rescued_by_semantics(spark, d):
    s = _scored(spark, d).select("run_id", "stem", "final_score", "keyword_score")
    return evaluate.rescued(s, RUN, "final_score", "keyword_score")


def skill_overlap(spark, d):
    truth = alias_lookup(spark, d).groupBy("stem").agg(F.collect_set("canon").alias("truth"))
    got = vocabulary_matches(spark, d).groupBy("stem").agg(F.collect_set("canon").alias("got"))
    none = F.array().cast("array<string>")
    both = truth.join(got, "stem", "full").select("stem", F.coalesce("truth", none).alias("truth"), F.coalesce("got", none).alias("got"))
    return evaluate.set_overlap(both, "truth", "got").select("stem", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def _graded(spark, d):
    half = F.col("covered") * 2 >= F.col("required_total")
    return _ranked(spark, d).withColumn("grade", F.when(F.col("covered") == F.col("required_total"), 2).when(half, 1).otherwise(0))


def ndcg_by_run(spark, d):
    return evaluate.ndcg(_graded(spark, d), RUN, "final_score", "grade", "stem").select("run_id", F.round("ndcg", 6).alias("ndcg"))


def weight_search(spark, d):
    return evaluate.grid_search(_graded(spark, d), evaluate.weight_grid(spark), RUN, "stem").select("config_id", F.round("mean_grade", 6).alias("mean_ndcg"))


def _related(spark, d):
    """Scored candidates of the runs with a known target: strict 1 for the family looked for, graded 2 for it and 1 for one close to it."""
    families = ingest.family_of(_candidates(spark, d), "stem", FAMILIES)
    targets = spark.createDataFrame([(t, a, b) for t, (a, b) in TARGETS.items()], "title string, target string, close string")
    jobs = _distinct(spark, d, "runs", "run_id", "title").join(F.broadcast(targets), "title")
    rows = _scored(spark, d).join(jobs, "run_id").join(families, "stem")
    hit = F.col("family") == F.col("target")
    return rows.withColumn("strict", hit.cast("int")).withColumn("graded", F.when(hit, 2).when(F.col("family") == F.col("close"), 1).otherwise(0))


def family_ndcg(spark, d):
    """How well each run finds the family it looks for."""
    rows = _related(spark, d)
    a, b = (evaluate.ndcg(rows, RUN, "final_score", g, "stem").select("run_id", F.round("ndcg", 6).alias(g)) for g in ("strict", "graded"))
    return a.join(b, "run_id")


def best_weights(spark, d):
    """The eight configurations that find the families best."""
    grid = evaluate.weight_grid(spark)
    found = evaluate.grid_search(_related(spark, d), grid, RUN, "stem", ["strict", "graded"])
    rows = found.select("config_id", F.round("mean_strict", 6).alias("strict"), F.round("mean_graded", 6).alias("graded")).join(F.broadcast(grid), "config_id")
    return fuse.top_within(rows, [], 8, "strict", "config_id").select("rank", "config_id", "w_kw", "penalty", "floor", "strict", "graded")


def channel_ablation(spark, d):
    """Each channel alone, and both."""
    grid = evaluate.weight_grid(spark, (0.0, 0.5, 1.0), (0.12,), (0.5,))
    found = evaluate.grid_search(_related(spark, d), grid, RUN, "stem", ["strict", "graded"]).join(F.broadcast(grid), "config_id")
    return found.select("w_kw", F.round("mean_strict", 6).alias("strict"), F.round("mean_graded", 6).alias("graded"))


def parser_validation(spark, d):
    """Skills and names read from the texts against those of the table."""
    names = names_read(spark, d)
    return evaluate.overlap_summary(skill_overlap(spark, d), names).select("n", F.round("mean_precision", 6).alias("mean_precision"), F.round("mean_recall", 6).alias("mean_recall"), "names_equal", "names_total")


def names_read(spark, d):
    """(stem, truth, got) of the candidates with a name."""
    truth = _candidates(spark, d, "name").where("trim(name) <> ''").groupBy("stem").agg(F.max("name").alias("truth"))
    return truth.join(candidate_names(spark, d).withColumnRenamed("name", "got"), "stem")


def compared_leaders(spark, d):
    """What parts the first two of each run."""
    top = fuse.top_within(_scored(spark, d), RUN, 2).groupBy("run_id").agg(F.max(F.when(F.col("rank") == 1, F.col("stem"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("stem"))).alias("b")).where("b is not null")
    flagged = _flagged(spark, d)
    jobs = _distinct(spark, d, "runs", "run_id", "jd_id")
    texts = _requirements(spark, d).select("jd_id", "req_id", "text").join(jobs, "jd_id").select("run_id", "req_id", "text")
    return explain.differences(explain.deltas(flagged, top, RUN), texts, RUN)


def artifact_candidates(spark, d):
    """Rows of the artifact without their evidence, of which the number of cells is given."""
    people = _candidates(spark, d, "name", "email", "family", "source_format", "formats_available", "skills", "parsed_at")
    fields = ("name", "email", "family", "source_format", "formats_available", "skills")
    people = people.groupBy("stem").agg(F.max_by(F.struct(*fields), F.struct("parsed_at", *fields)).alias("p")).select("stem", "p.*")
    scores = _distinct(spark, d, "scores", "run_id", "stem", "bm25_norm", "explanation", "explanation_source")
    ranked = _ranked(spark, d).join(scores, ["run_id", "stem"]).withColumn("reranked", F.lit(False))
    texts = _requirements(spark, d).select("jd_id", "req_id", "text")
    cells = _flagged(spark, d, "kw_terms", "sem_raw", "unit_text", "unit_section", "ce_score").join(texts, ["jd_id", "req_id"], "left")
    rows = artifact.candidates(ranked, people, cells)
    columns = ("run_id", "rank", "stem", "final_score", "keyword_score", "semantic_score", "delta", "bm25", "required_coverage", "hard_misses")
    return rows.select(*columns, F.coalesce(F.size("evidence"), F.lit(0)).cast("bigint").alias("n_cells"))


def explanations(spark, d):
    texts = _requirements(spark, d).select("jd_id", "req_id", "text")
    flagged = _flagged(spark, d, "kw_terms", "unit_text").join(texts, ["jd_id", "req_id"], "left")
    names = _candidates(spark, d, "name").groupBy("stem").agg(F.max("name").alias("name"))
    ranked = fuse.top_within(_scored(spark, d), RUN, 3).join(names, "stem", "left").withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), "stem"))
    return explain.explanations(ranked, explain.best_matched(flagged, RUN), explain.worst_missing(flagged, RUN), RUN)


def named_people(spark, d):
    q = spark.createDataFrame(QUESTIONS, "question_id int, question string")
    return ask.resolve_names(q, _candidates(spark, d, "name").select(F.col("stem").alias("key"), "name"))


def supplier_scorecard(spark, d):
    """The scoring core on other facts: suppliers as candidates, brands as criteria, quantity calibrated within the brand."""
    li = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity")
    part = table(spark, d, "part", "p_partkey", "p_brand")
    cells = li.join(part, li["l_partkey"] == part["p_partkey"]).groupBy("p_brand", "l_suppkey").agg(F.sum("l_quantity").alias("raw"))
    cal = semantic.calibrate(cells, ["p_brand"], "raw", "cal")
    mean = cal.groupBy("l_suppkey").agg(F.round(F.avg("cal"), 6).alias("score"), F.count("*").alias("n_brands"))
    return fuse.rank_within(mean, [], "score", "l_suppkey").select("l_suppkey", "score", "n_brands", "rank")


def user_event_scorecard(spark, d):
    e = table(spark, d, "events", "user_id", "event_type", "value")
    cells = e.groupBy("event_type", "user_id").agg(F.sum("value").alias("raw"))
    cal = semantic.calibrate(cells, ["event_type"], "raw", "cal")
    return cal.groupBy("user_id").agg(F.round(F.avg("cal"), 6).alias("score"), F.count("*").alias("n_types"))


ALL: tuple[Query, ...] = (
    token_counts, readable_candidates, first_requirements, best_formats, line_sections, sentence_counts, noise_lines, first_emails, candidate_units, candidate_names,
    stem_families, vocabulary_matches, requirement_keywords, alias_lookup, fuzzy_skills, keyword_hits, bm25_scores, keyword_channel, similar_vectors, calibrated,
    semantic_channel, required_coverage, final_ranks, leaderboard, reranked, score_spread, matched_top8, missing_top6, semantic_only, next_candidates, neighbour_deltas,
    fuzzy_sections, candidate_skills, visible_lines, parsed_requirements, parsed_titles, listed_words, family_ndcg, best_weights, channel_ablation, parser_validation,
    names_read, compared_leaders, artifact_candidates, narrow_requirements, coded_words, findings, rescued_by_semantics, skill_overlap, ndcg_by_run, weight_search, explanations, named_people, supplier_scorecard, user_event_scorecard,
)

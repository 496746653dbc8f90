"""The ranking artifact: a row a candidate with its evidence, written by cohort as JSON for readers; and what goes with a whole cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.settings import DEFAULT, Settings

EVIDENCE = (
    "array<struct<id: string, requirement: string, required: boolean, matched: boolean, hard_miss: boolean, kw_hit: double, kw_terms: array<string>, semantic: double, semantic_raw: double,"
    " cross_encoder: double, evidence: string, section: string>>"
)
PERSON = (
    "rank bigint, stem string, name string, email string, family string, source_format string, formats_available array<string>, final_score double, keyword_score double, semantic_score double, delta double,"
    " bm25 double, reranked boolean, required_coverage string, hard_misses bigint, skills array<string>, explanation string, explanation_source string"
)
FINDING = "struct<type: string, severity: string, term: string, excluded_count: bigint>"


def candidates(ranked: DataFrame, people: DataFrame, cells: DataFrame, cohort: str = "run_id", key: str = "stem") -> DataFrame:
    """(cohort, the columns of PERSON, evidence): one row a candidate, so no cohort is gathered; evidence in order of requirement.

    ranked: rank, the scores from 0 to 1, bm25_norm, reranked, covered, required_total, n_hard_miss, explanation, explanation_source; people: one row a
    key with name, email, family, source_format, formats_available, skills; cells: flagged evidence with text. Scores are given as hundredths with two
    decimals, shares with three; null and not-a-number scores are null.
    """
    r = lambda c, n, by=1.0: F.round((F.when(~F.isnan(c), F.col(c)) * by).cast("decimal(28,8)"), n).cast("double").alias(c)
    cell = F.struct(
        F.col("req_id").alias("id"), F.col("text").alias("requirement"), "required", "matched", "hard_miss", r("kw_hit", 3), "kw_terms", r("sem_cal", 3).alias("semantic"), r("sem_raw", 3).alias("semantic_raw"),
        r("ce_score", 3).alias("cross_encoder"), F.col("unit_text").alias("evidence"), F.col("unit_section").alias("section"),
    )
    evidence = cells.groupBy(cohort, key).agg(F.array_sort(F.collect_list(cell)).alias("evidence"))
    delta = (F.col("semantic_score") - F.col("keyword_score")).alias("__d")
    rows = ranked.withColumn("__delta", delta).join(people, key, "left").join(evidence, [cohort, key], "left")
    return rows.select(
        cohort, F.col("rank").cast("bigint").alias("rank"), F.col(key).alias("stem"), F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col(key)).alias("name"), "email", "family", "source_format", "formats_available",
        "final_score", r("keyword_score", 2, 100.0), r("semantic_score", 2, 100.0), r("__delta", 2, 100.0).alias("delta"), r("bm25_norm", 3).alias("bm25"), "reranked",
        F.concat_ws("/", F.col("covered").cast("string"), F.col("required_total").cast("string")).alias("required_coverage"), F.col("n_hard_miss").cast("bigint").alias("hard_misses"), F.array_sort("skills").alias("skills"),
        "explanation", "explanation_source", "evidence",
    )


def heads(jobs: DataFrame, requirements: DataFrame, findings: DataFrame, cohort: str = "run_id", s: Settings = DEFAULT) -> DataFrame:
    """(cohort, title, company, requirements, config, checked, flags, findings): what goes with a cohort as a whole; small, as descriptions are.

    jobs: (cohort, jd_id, title, company, bi_encoder); requirements: (jd_id, req_idx, req_id, text, kind, required, keywords, weight); findings: (cohort, type,
    severity, term, excluded_count).
    """
    asked = requirements.groupBy("jd_id").agg(F.array_sort(F.collect_list(F.struct("req_idx", F.col("req_id").alias("id"), "text", "kind", "required", "keywords", "weight"))).alias("requirements"))
    found = findings.groupBy(cohort).agg(F.array_sort(F.collect_list(F.struct("type", "severity", "term", "excluded_count"))).alias("findings"))
    config = F.struct(F.lit(s.w_keyword).alias("w_keyword"), F.lit(s.w_semantic).alias("w_semantic"), "bi_encoder", F.lit(s.penalty).alias("hard_miss_penalty"))
    rows = jobs.join(asked, "jd_id", "left").join(found, cohort, "left").withColumn("findings", F.coalesce("findings", F.array().cast(f"array<{FINDING}>")))
    return rows.select(cohort, "title", "company", "requirements", config.alias("config"), F.coalesce(F.size("requirements"), F.lit(0)).alias("checked"), F.size("findings").alias("flags"), "findings")


def save(rows: DataFrame, path: str, cohort: str = "run_id") -> None:
    """JSON lines, a folder a cohort."""
    rows.write.mode("overwrite").partitionBy(cohort).json(path)


def load(spark: SparkSession, path: str, cohort: str = "run_id bigint") -> DataFrame:
    """What ``save`` wrote of ``candidates``; reading one cohort opens only its folder."""
    return spark.read.schema(f"{cohort}, {PERSON}, evidence {EVIDENCE}").json(path)


def lookup(rows: DataFrame, run: int, rank: int, cohort: str = "run_id") -> DataFrame:
    """The row of one candidate."""
    return rows.where((F.col(cohort) == run) & (F.col("rank") == rank))


def flat(rows: DataFrame) -> DataFrame:
    """Without the evidence."""
    return rows.drop("evidence")

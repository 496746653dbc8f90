"""Wording and narrowness of requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators.fuse import rank_within
from rankloom.session import if_small
from rankloom.settings import DEFAULT, Settings

# Wording by category; the supportive words are kept for reference and never reported.
LEXICON = {
    "masculine_coded": ("rockstar", "ninja", "guru", "wizard", "hacker", "aggressive", "dominant", "competitive", "fearless", "driven", "assertive", "decisive", "outspoken", "self-reliant", "superstar", "warrior", "killer instinct", "crush it", "alpha", "hard-charging"),
    "feminine_coded": ("supportive", "nurturing", "collaborative", "sympathetic", "warm", "pleasant", "loyal", "dependable"),
    "gendered_pronouns": ("he/she", "he or she", "his/her", "his or her", "s/he", "chairman", "manpower", "salesman", "craftsman"),
    "age_coded": ("young", "youthful", "energetic", "digital native", "recent graduate only", "fresh graduate only", "new grad only", "must be under", "born after", "mature", "seasoned veteran"),
    "exclusionary": ("native english speaker", "native speaker", "perfect english", "no career gaps", "continuous employment", "must own a car", "clean-cut", "culture fit", "work hard play hard", "like a family", "unlimited hours", "thick skin"),
    "elite_signalling": ("tier-1 college only", "iit only", "nit only", "ivy league", "top-tier university only", "premier institute only"),
}


def lexicon(spark: SparkSession) -> DataFrame:
    """(category, term), without the supportive words."""
    rows = [(c, t) for c, ts in LEXICON.items() if c != "feminine_coded" for t in ts]
    return spark.createDataFrame(rows, "category string, term string")


def coded_words(texts: DataFrame, keys: list[str], text: str, words: DataFrame, width: int = 60) -> DataFrame:
    """(keys, category, term, as_written, context): the first place of each word that stands between other letters than a-z, with its surroundings.

    ``words`` is a list of (category, term); its size decides whether it is broadcast.
    """
    t = texts.select(*keys, F.col(text).alias("__t")).where("__t is not null")
    pattern = F.concat(F.lit("(?<![a-z])"), T.escaped(F.col("term")), F.lit("(?![a-z])"))
    hit = t.join(if_small(words), (F.instr(F.lower("__t"), F.col("term")) > 0) & F.regexp_like(F.lower("__t"), pattern))
    at = F.regexp_instr(F.lower("__t"), pattern)
    cut = F.substring(F.col("__t"), F.greatest(F.lit(1), at - width), F.least(at - 1, F.lit(width)) + F.length("term") + width)
    written = F.substring(F.col("__t"), at, F.length("term"))
    return hit.select(*keys, "category", "term", written.alias("as_written"), F.trim(F.regexp_replace(cut, r"\s+", " ")).alias("context"))


def contradictions(requirements: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """Rows whose title is a junior one while the text asks for more than one year; adds years and the words that ask, as term."""
    years = F.regexp_extract(F.col(text), T.YEARS, 1)
    rows = requirements.where(F.col(title).rlike(T.JUNIOR)).withColumn("years", F.when(years != "", years.try_cast("int")))
    return rows.where("years > 1").withColumn("term", F.regexp_extract(F.col(text), T.YEARS, 0))


def contradiction_findings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Findings (keys, type, severity, term, excluded_count) of ``contradictions``: the gravest kind."""
    return rows.select(*keys, F.lit("experience_contradiction").alias("type"), F.lit("high").alias("severity"), "term", F.lit(0).cast("bigint").alias("excluded_count"))


def word_findings(words: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of ``coded_words``, with the words as they are written."""
    return words.select(*keys, F.lit("coded_language").alias("type"), F.lit("medium").alias("severity"), F.col("as_written").alias("term"), F.lit(0).cast("bigint").alias("excluded_count"))


def narrow(scores: DataFrame, evidence: DataFrame, requirements: DataFrame, skills: DataFrame, tools: DataFrame, cohort: list[str], key: str = "stem", s: Settings = DEFAULT) -> DataFrame:
    """(cohort, req_id, tools, excluded_count, alternatives_used) of required criteria whose named tools shut out able candidates.

    Able: within the first ``narrow_top`` of the cohort by final_score (ties with the last of them included), no keyword hit, raw similarity of
    at least ``narrow_semantic``. Alternatives: other skills of at least 40 % of them, the five most frequent, then by name.
    """
    ranked = rank_within(scores.select(*cohort, key, "final_score").where("final_score is not null"), cohort, then=key)
    n = ranked.groupBy(*cohort).agg(F.count("*").alias("n"))
    k = F.greatest(F.lit(1), F.floor(F.col("n") * s.narrow_top)).cast("bigint")
    edge = ranked.join(n, cohort).where(F.col("rank") == k).select(*cohort, F.col("final_score").alias("edge"), F.greatest(F.lit(s.narrow_least), F.bround(F.col("n") * s.narrow_share, 0)).cast("bigint").alias("least"))
    named = requirements.where("required").select("jd_id", "req_id", F.explode(F.array_distinct("keywords")).alias("skill")).join(if_small(tools.select("skill").distinct()), "skill", "left_semi")
    asked = named.groupBy("jd_id", "req_id").agg(F.array_sort(F.collect_set("skill")).alias("tools"))
    able = ranked.join(edge, cohort).where("final_score >= edge")
    out = evidence.where((F.col("kw_hit") == 0) & (T.number(F.col("sem_raw")) >= s.narrow_semantic)).select(*cohort, "jd_id", "req_id", key)
    shut = out.join(able.select(*cohort, key, "least"), [*cohort, key]).join(asked, ["jd_id", "req_id"])
    counted = shut.groupBy(*cohort, "req_id").agg(F.count("*").alias("excluded_count"), F.first("least").alias("least"), F.first("tools").alias("tools")).where("excluded_count >= least")
    other = shut.join(counted.select(*cohort, "req_id", "excluded_count"), [*cohort, "req_id"]).join(skills.select(key, "skill").distinct(), key).where(~F.array_contains("tools", F.col("skill")))
    freq = other.groupBy(*cohort, "req_id", "excluded_count", "skill").agg(F.count("*").alias("m")).where("m >= excluded_count * 0.4")
    w = Window.partitionBy(*cohort, "req_id").orderBy(F.desc("m"), F.asc("skill"))
    top = freq.withColumn("p", F.row_number().over(w)).where("p <= 5").groupBy(*cohort, "req_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "skill"))), lambda x: x["skill"]).alias("alternatives_used"))
    return counted.join(top, [*cohort, "req_id"], "left").select(*cohort, "req_id", "tools", "excluded_count", F.coalesce("alternatives_used", F.array().cast("array<string>")).alias("alternatives_used"))


def findings(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of findings (keys, type, severity, term, excluded_count), one for each (type, lower-case term): worst severity, then most excluded."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    worst = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)
    order = F.struct(worst, -F.coalesce("excluded_count", F.lit(0)), F.col("term"))
    least = union.groupBy(*keys, "type", F.lower("term").alias("__t")).agg(F.min_by(F.struct("severity", "term", "excluded_count"), order).alias("f"))
    return least.select(*keys, "type", "f.severity", "f.term", "f.excluded_count")

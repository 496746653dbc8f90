"""Evidence flags, the gate on required criteria, final scores, ranks and re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators.ranking import numbered
from rankloom.settings import DEFAULT, Settings


def flags(evidence: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds matched and hard_miss; a null or not-a-number score clears no threshold but misses none either."""
    kw, cal = T.number(F.col("kw_hit")), T.number(F.col("sem_cal"))
    matched = F.coalesce(kw >= s.match_keyword, F.lit(False)) | F.coalesce(cal >= s.match_semantic, F.lit(False))
    miss = F.coalesce(F.col("required") & (kw == 0) & (cal < s.hard_miss_below), F.lit(False))
    return evidence.withColumn("matched", matched).withColumn("hard_miss", miss)


def gate(misses: Column, s: Settings = DEFAULT) -> Column:
    """Factor by which hard misses scale a score."""
    return F.greatest(F.lit(s.floor), 1.0 - s.penalty * misses)


def coverage(flagged: DataFrame, cohort: list[str], key: str = "stem") -> DataFrame:
    """(cohort, key, n_hard_miss, covered, required_total)."""
    must = F.coalesce(F.col("required"), F.lit(False))
    return flagged.groupBy(*cohort, key).agg(F.count_if("hard_miss").alias("n_hard_miss"), F.count_if(must & F.col("matched")).alias("covered"), F.count_if(must).alias("required_total"))


def final_score(keyword: Column, semantic: Column, misses: Column, s: Settings = DEFAULT) -> Column:
    """0 to 100, two decimals, halves up (through a decimal, so that equal inputs round alike everywhere); a missing channel counts as 0."""
    base = s.w_keyword * F.coalesce(keyword, F.lit(0.0)) + s.w_semantic * F.coalesce(semantic, F.lit(0.0))
    return F.round((base * gate(misses, s) * 100).cast("decimal(28,8)"), 2).cast("double")


def rank_within(rows: DataFrame, cohort: list[str], score: str = "final_score", then: str = "stem", name: str = "rank") -> DataFrame:
    """Adds the rank 1..n by score, ties by ``then``; cohorts of any size, see operators.ranking."""
    return numbered(rows, cohort, [F.col(score).desc_nulls_last(), F.col(then).asc_nulls_last()], name)


def top_within(rows: DataFrame, cohort: list[str], most: int, score: str = "final_score", then: str = "stem", name: str = "rank") -> DataFrame:
    """The first ``most`` of each cohort with their ranks, as of ``rank_within``; each task hands on no more than those of a cohort."""
    w = Window.partitionBy(*cohort).orderBy(F.col(score).desc_nulls_last(), F.col(then).asc_nulls_last())
    return rows.withColumn(name, F.row_number().over(w).cast("bigint")).where(F.col(name) <= most)


def rerank(ranked: DataFrame, evidence: DataFrame, cohort: list[str], key: str = "stem", s: Settings = DEFAULT) -> DataFrame:
    """(cohort, key, rank, prior_rank, semantic_score, final_score, reranked).

    The mean logistic of ce_score over required cells with a text moves the semantic score of the first ``rerank_top``; then all are scored
    and ranked anew, ties by prior rank. ranked: keyword_score, semantic_score, n_hard_miss, rank.
    """
    head = ranked.where(F.col("rank") <= s.rerank_top).select(*cohort, key)
    asked = evidence.where(F.col("required") & (F.coalesce("unit_text", F.lit("")) != "") & T.number(F.col("ce_score")).isNotNull())
    ce = asked.join(head, [*cohort, key], "left_semi").groupBy(*cohort, key).agg(F.avg(T.logistic(F.col("ce_score"))).alias("__ce"))
    moved = ranked.withColumnRenamed("rank", "prior_rank").join(ce, [*cohort, key], "left")
    moved = moved.withColumn("reranked", F.col("__ce").isNotNull()).withColumn("semantic_score", F.when(F.col("__ce").isNull(), F.col("semantic_score")).otherwise((1 - s.rerank_share) * F.coalesce("semantic_score", F.lit(0.0)) + s.rerank_share * F.col("__ce")))
    scored = moved.withColumn("final_score", final_score(F.col("keyword_score"), F.col("semantic_score"), F.col("n_hard_miss"), s))
    return rank_within(scored, cohort, then="prior_rank").select(*cohort, key, "rank", "prior_rank", "semantic_score", "final_score", "reranked")

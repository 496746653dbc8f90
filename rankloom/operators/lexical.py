"""The lexical channel: keyword hits and BM25 within a cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.session import if_small, stored
from rankloom.settings import DEFAULT, Settings


def keyword_hits(pairs: DataFrame, requirements: DataFrame, skills: DataFrame, texts: DataFrame, key: str = "stem") -> DataFrame:
    """(pairs' columns, req_id, kw_hit, kw_terms): the share of a requirement's keywords that a candidate has.

    pairs: (cohort columns, jd_id, key); requirements: (jd_id, req_id, keywords); skills: (key, skill); texts: (key, text). A keyword counts
    if it is among the skills or stands alone in the text; none gives 0. Each (candidate, keyword) is tested once however many cohorts ask.
    """
    wanted = pairs.join(requirements.select("jd_id", "req_id", "keywords"), "jd_id")
    asked = wanted.select(key, F.explode("keywords").alias("term")).where("term is not null").distinct()
    own = skills.select(key, F.col("skill").alias("term"), F.lit(True).alias("__own")).distinct()
    tested = asked.join(own, [key, "term"], "left").join(texts.select(key, F.lower("text").alias("__t")), key, "left")
    ok = tested.where(F.coalesce("__own", F.lit(False)) | F.coalesce(T.contains_term(F.col("__t"), F.lower("term")), F.lit(False)))
    has = ok.groupBy(key).agg(F.collect_set("term").alias("__has"))
    got = F.array_sort(F.array_intersect("keywords", F.coalesce("__has", F.array().cast("array<string>"))))
    joined = wanted.join(has, key, "left").withColumn("kw_terms", got)
    share = F.when(F.size("keywords") > 0, F.size("kw_terms") / F.size(F.array_distinct("keywords"))).otherwise(F.lit(0.0))
    return joined.withColumn("kw_hit", share).drop("__has", "keywords")


def bm25(pool: DataFrame, query: DataFrame, texts: DataFrame, cohort: str, key: str = "stem", s: Settings = DEFAULT) -> DataFrame:
    """(cohort, key, bm25, bm25_norm) of each pool member against its cohort's query.

    pool: (cohort, key); query: (cohort, text); texts: (key, text). Document frequencies, average length and the floor under negative weights
    (epsilon times the mean weight of all terms) are those of the cohort. Members without a query term score 0. bm25_norm is the min-max
    within the cohort, 0.5 where all are alike.
    """
    # Texts are taken apart once.
    tf = stored(texts.select(key, F.explode(T.tokens(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")))
    size = tf.groupBy(key).agg(F.sum("tf").alias("dl"))
    members = pool.select(cohort, key).distinct().join(size, key, "left").withColumn("dl", F.coalesce("dl", F.lit(0)))
    total = members.groupBy(cohort).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = members.select(cohort, key).join(tf.select(key, "term"), key).groupBy(cohort, "term").agg(F.count("*").alias("df"))
    idf = df.join(total, cohort).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    idf = stored(idf.select(cohort, "term", "avgdl", "idf"))
    mean = idf.groupBy(cohort).agg(F.avg("idf").alias("mean_idf"))
    q = query.select(cohort, F.explode(T.tokens(F.col("text"))).alias("term")).groupBy(cohort, "term").agg(F.count("*").alias("qtf"))
    weight = q.join(idf, [cohort, "term"]).join(mean, cohort)
    weight = weight.select(cohort, "term", "qtf", "avgdl", F.when(F.col("idf") < 0, s.bm25_epsilon * F.col("mean_idf")).otherwise(F.col("idf")).alias("w"))
    # Only the counts of terms that some query has are joined with the members.
    asked = tf.join(if_small(q.select("term").distinct()), "term", "left_semi")
    hit = members.select(cohort, key, "dl").join(asked, key).join(weight, [cohort, "term"])
    part = F.col("qtf") * F.col("w") * F.col("tf") * (s.bm25_k1 + 1) / (F.col("tf") + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * F.col("dl") / F.col("avgdl")))
    scored = hit.groupBy(cohort, key).agg(F.sum(part).alias("bm25"))
    full = members.select(cohort, key).join(scored, [cohort, key], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    return minmax(full, [cohort], "bm25", "bm25_norm")


def minmax(rows: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """Adds the value scaled to 0..1 within its group, 0.5 where the span is at most 1e-9.

    Done by an aggregate and a join rather than a window, so a hot group isn't gathered.
    """
    ends = rows.groupBy(*groups).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return rows.join(ends, groups).withColumn(name, F.when(span <= 1e-9, 0.5).otherwise((F.col(value) - F.col("__lo")) / span)).drop("__lo", "__hi")


def keyword_channel(hits: DataFrame, weights: DataFrame, bm25_norm: DataFrame, cohort: str, key: str = "stem", s: Settings = DEFAULT) -> DataFrame:
    """(cohort, key, keyword_score): 0.7 of the weighted mean hit and 0.3 of the scaled BM25 (0 where there is none)."""
    w = hits.join(weights.select("jd_id", "req_id", "weight"), ["jd_id", "req_id"])
    mean = w.groupBy(cohort, key).agg(F.coalesce(F.sum(F.col("kw_hit") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0)), F.lit(0.0)).alias("hit"))
    both = mean.join(bm25_norm.select(cohort, key, "bm25_norm"), [cohort, key], "left")
    return both.select(cohort, key, (s.hit_share * F.col("hit") + s.bm25_share * F.coalesce("bm25_norm", F.lit(0.0))).alias("keyword_score"))

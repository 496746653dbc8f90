"""Measures of rankings and of parsing, and the search for weights."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators.fuse import top_within
from rankloom.settings import DEFAULT, Settings


def ndcg(rows: DataFrame, groups: list[str], score: str, grade: str, then: str, k: int = 10) -> DataFrame:
    """(groups, ndcg): discounted gain of the grades in the order of the score over that of their best order; 0 without any grade.

    The best order takes the grades of the whole group, then its first k. Only the first k of either order are ever kept for a group.
    """
    graded = rows.withColumn("__g", F.coalesce(F.col(grade), F.lit(0)))
    by_score = Window.partitionBy(*groups).orderBy(F.desc_nulls_last(score), F.asc(then))
    by_grade = Window.partitionBy(*groups).orderBy(F.desc("__g"), F.asc(then))
    got = graded.withColumn("__p", F.row_number().over(by_score)).where(F.col("__p") <= k)
    ideal = graded.withColumn("__p", F.row_number().over(by_grade)).where(F.col("__p") <= k)
    gain = F.sum(F.col("__g") / F.log2(F.col("__p") + 1.0))
    both = got.groupBy(*groups).agg(gain.alias("dcg")).join(ideal.groupBy(*groups).agg(gain.alias("idcg")), groups)
    return both.select(*groups, F.when(F.col("idcg") == 0, 0.0).otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg"))


# The grid of weights.
GRID = ((0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70), (0.0, 0.06, 0.12, 0.18, 0.25), (0.4, 0.5, 0.6))


def weight_grid(spark: SparkSession, keyword: tuple = GRID[0], penalty: tuple = GRID[1], floor: tuple = GRID[2]) -> DataFrame:
    """(config_id, w_kw, penalty, floor): all combinations, numbered with the floor changing fastest; 135 of them by default."""
    rows = [(n, a, p, f) for n, (a, p, f) in enumerate((a, p, f) for a in keyword for p in penalty for f in floor)]
    return spark.createDataFrame(rows, "config_id int, w_kw double, penalty double, floor double")


def ideal_gains(rows: DataFrame, groups: list[str], grades: list[str], then: str, k: int = 10) -> DataFrame:
    """(groups, ideal_<grade>...): the discounted gain of the best order of each grade."""
    out = None
    for g in grades:
        w = Window.partitionBy(*groups).orderBy(F.desc("__g"), F.asc(then))
        top = rows.select(*groups, then, F.coalesce(F.col(g), F.lit(0)).alias("__g")).withColumn("__p", F.row_number().over(w)).where(F.col("__p") <= k)
        one = top.groupBy(*groups).agg(F.sum(F.col("__g") / F.log2(F.col("__p") + 1.0)).alias(f"ideal_{g}"))
        out = one if out is None else out.join(one, groups)
    return out


def grid_search(features: DataFrame, grid: DataFrame, groups: list[str], then: str, grades: list[str] = ["grade"], k: int = 10) -> DataFrame:  # noqa: B006
    """(config_id, mean_<grade>...): the mean gain of every configuration over the groups, against that of the best order.

    features: keyword_score, semantic_score, n_hard_miss and the grades. The grid is a fixed list; the best orders don't depend on it and
    are worked out once a group. Of each (configuration, group) only the first k rows are kept.
    """
    base = F.col("w_kw") * F.coalesce("keyword_score", F.lit(0.0)) + (1 - F.col("w_kw")) * F.coalesce("semantic_score", F.lit(0.0))
    x = features.crossJoin(F.broadcast(grid)).withColumn("__s", F.round(base * F.greatest(F.col("floor"), 1 - F.col("penalty") * F.col("n_hard_miss")), 9))
    w = Window.partitionBy("config_id", *groups).orderBy(F.desc_nulls_last("__s"), F.asc(then))
    top = x.select("config_id", *groups, then, "__s", *grades).withColumn("__p", F.row_number().over(w)).where(F.col("__p") <= k)
    got = top.groupBy("config_id", *groups).agg(*[F.sum(F.coalesce(F.col(g), F.lit(0)) / F.log2(F.col("__p") + 1.0)).alias(g) for g in grades])
    both = got.join(ideal_gains(features, groups, grades, then, k), groups)
    share = lambda g: F.when(F.col(f"ideal_{g}") == 0, 0.0).otherwise(F.col(g) / F.col(f"ideal_{g}"))
    return both.groupBy("config_id").agg(*[F.avg(share(g)).alias(f"mean_{g}") for g in grades])


def rescued(rows: DataFrame, cohort: list[str], blended: str, lexical: str, key: str = "stem", top: int = 20) -> DataFrame:
    """(cohort, key) among the first ``top`` by the blended score but not by the lexical one."""
    a = top_within(rows.select(*cohort, key, blended), cohort, top, blended, key)
    b = top_within(rows.select(*cohort, key, lexical), cohort, top, lexical, key)
    return a.join(b, [*cohort, key], "left_anti").select(*cohort, key)


def set_overlap(pairs: DataFrame, truth: str, got: str) -> DataFrame:
    """Adds precision and recall of two arrays taken as sets; null where the set divided by is empty."""
    both = F.size(F.array_intersect(truth, got))
    n = lambda c: F.nullif(F.size(F.array_distinct(c)), F.lit(0))
    return pairs.withColumn("precision", both / n(got)).withColumn("recall", both / n(truth))


def against_format(parsed: DataFrame, truth: str = "xml", key: str = "stem") -> DataFrame:
    """(key, fmt, precision, recall, same_name) of each other format of a key against its ``truth`` format.

    parsed: (key, fmt, skills, name), one row a format.
    """
    t = parsed.where(F.col("fmt") == truth).select(key, F.col("skills").alias("__t"), F.col("name").alias("__n"))
    both = parsed.where(F.col("fmt") != truth).join(t, key)
    same = F.lower(F.trim("name")) == F.lower(F.trim("__n"))
    return set_overlap(both, "__t", "skills").select(key, "fmt", "precision", "recall", F.coalesce(same, F.lit(False)).alias("same_name"))


def best_settings(found: DataFrame, grid: DataFrame, score: str = "mean_strict", s: Settings = DEFAULT) -> Settings:
    """Settings with the weights of the best configuration of a ``grid_search``, the first on ties."""
    best = found.join(F.broadcast(grid), "config_id").orderBy(F.desc(score), "config_id").first()
    return s if best is None else replace(s, w_keyword=best["w_kw"], w_semantic=round(1 - best["w_kw"], 10), penalty=best["penalty"], floor=best["floor"])


def overlap_summary(overlaps: DataFrame, names: DataFrame) -> DataFrame:
    """One row (n, mean_precision, mean_recall, names_equal, names_total) from ``set_overlap`` and rows (truth, got) of names.

    Empty sets don't count in the mean they would be divided by; names are compared in lower case without blanks around.
    """
    means = overlaps.agg(F.count("*").alias("n"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"))
    same = F.lower(F.trim("truth")) == F.lower(F.trim("got"))
    return means.crossJoin(names.agg(F.count_if(same).alias("names_equal"), F.count("*").alias("names_total")))

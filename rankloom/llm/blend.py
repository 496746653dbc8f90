"""Problem 2: one ranking from several scores on different scales.

Each score becomes its empirical percentile within the group (ties averaged), the percentile its normal deviate, and the
group is ordered by the weighted mean of the deviates. Only the order of a score counts, so neither its range nor its
outliers do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.stats import probit
from rankloom.operators.ranking import numbered, running_total
from rankloom.session import stored


def deviates(scores: DataFrame, group: str, metric: str = "metric", value: str = "value") -> DataFrame:
    """(group, metric, value, z) for each distinct value: the normal deviate of its averaged percentile.

    The percentile of a value is (rows below it + half of the rows equal to it) / all rows, so a score that is the same
    in a whole group gives 0. Null and not-a-number values are left out. Rows that share a value are one row from
    here on, and groups of any size are spread by range.
    """
    kept = scores.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn(value, F.col(value) + F.lit(0.0))
    counts = kept.groupBy(group, metric, value).agg(F.count("*").alias("__n"))
    below = running_total(counts, [group, metric], [F.col(value).asc()], F.col("__n"), "__below")
    size = below.groupBy(F.col(group).alias("__g"), F.col(metric).alias("__m")).agg(F.sum("__n").alias("__size"))
    on = [F.col(group).eqNullSafe(F.col("__g")), F.col(metric).eqNullSafe(F.col("__m"))]
    p = (F.col("__below") + F.col("__n") / 2) / F.col("__size")
    return below.join(size, on).select(group, metric, value, probit(p).alias("z"))


def blend(scores: DataFrame, group: str, item: str, weights: dict[str, float]) -> DataFrame:
    """(group, item, blended, n_scores, rank) from long rows (group, item, metric, value).

    blended is the weighted mean over the scores an item has; one with no valid score has null and comes last. Ties go by item.
    Of repeated (group, item, metric) rows the largest value counts. Null groups and items are groups and items like others.
    An empty table gives an empty one.
    """
    valid = F.when(~F.isnan("value"), F.col("value"))
    once = scores.where(F.col("metric").isin(*weights)).groupBy(group, item, "metric").agg(F.max(valid).alias("value"))
    # Written once, as both the deviates and the means read it.
    once = stored(once.withColumn("value", F.col("value") + F.lit(0.0)))
    z = deviates(once, group).select(F.col(group).alias("__g"), F.col("metric").alias("__m"), F.col("value").alias("__v"), "z")
    on = [F.col(group).eqNullSafe(F.col("__g")), F.col("metric") == F.col("__m"), F.col("value") == F.col("__v")]
    weight = F.create_map(*[x for m, w in weights.items() for x in (F.lit(m), F.lit(float(w)))])
    rows = once.join(z, on, "left").select(group, item, F.element_at(weight, F.col("metric")).alias("__w"), "z")
    # Rounded, so that the order of summation can't part ties.
    mean = F.round(F.sum(F.col("__w") * F.col("z")) / F.sum(F.when(F.col("z").isNotNull(), F.col("__w"))), 9)
    means = rows.groupBy(group, item).agg(mean.alias("blended"), F.count("z").alias("n_scores"))
    return numbered(means, [group], [F.col("blended").desc_nulls_last(), F.col(item).asc_nulls_last()])

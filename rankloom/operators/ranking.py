"""Ranks that hold up under hot groups: no group is gathered into one task.

``row_number() over (partition by g order by v)`` puts a whole group into one task. Here the rows are spread by range
over (group, order), so each partition holds a contiguous run of the order; the partition's rows are numbered there,
and a small table of counts per (group, partition) adds what stands before. Equal rows are aggregated first by the
callers that can, so a value shared by a third of all rows is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import cut


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def running_total(df: DataFrame, groups: list[str], order: list[Column], weight: Column, name: str = "before") -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over the rows of the same group that stand earlier in ``order``.

    ``order`` must be total within a group. Null groups form a group of their own. The range partitions are written to
    the checkpoint folder, as the counts and the rows must see the same bounds. An empty table gives an empty one.
    """
    keys = [F.col(c).asc_nulls_first() for c in groups]
    spread = df.withColumn("__w", weight).repartitionByRange(_parts(df), *keys, *order).withColumn("__part", F.spark_partition_id())
    spread = cut(spread)
    local = Window.partitionBy("__part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = spread.groupBy("__part", *groups).agg(F.sum("__w").alias("__sum"))
    earlier = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__offset", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum")
    rows = spread.withColumn("__local", F.coalesce(F.sum("__w").over(local), F.lit(0)))
    named = [F.col(c).alias(f"__g{i}") for i, c in enumerate(groups)]
    totals = totals.select(F.col("__part").alias("__p"), *named, "__offset")
    on = [F.col("__part") == F.col("__p")] + [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(groups)]
    return rows.join(totals, on, "inner").select(*df.columns, (F.col("__local") + F.col("__offset")).alias(name))


def numbered(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds ``name``: 1, 2, ... within each group by the total ``order``; row_number() for groups of any size."""
    counted = running_total(df, groups, order, F.lit(1).cast("bigint"), "__before")
    return counted.withColumn(name, (F.col("__before") + 1).cast("bigint")).drop("__before")

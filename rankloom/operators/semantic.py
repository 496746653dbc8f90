"""The semantic channel: similarities of unit vectors, pooling, calibration within the cohort."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from rankloom.functions import text as T
from rankloom.settings import DEFAULT, Settings


#: Query vectors that are sent to the units at a time; more are taken in turns.
BLOCK = 8192


def best_similarities(queries: DataFrame, units: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(query_id, key, unit_idx, sim): of every query and key at least the ``top_units`` best units, of each Arrow batch no more than those.

    queries: (query_id, q), a stated set against all units: (key, unit_idx, v). A block of queries, at most BLOCK vectors, meets a batch of units in one
    matrix product in double precision. Null vectors meet none.
    """
    spark = units.sparkSession
    ids = queries.where("q is not null").select("query_id", F.transform("q", lambda x: x.cast("double")).alias("q"))
    kind, key_kind, unit_kind = (f.dataType.simpleString() for f in (queries.schema["query_id"], units.schema["key"], units.schema["unit_idx"]))
    out = f"query_id {kind}, key {key_kind}, unit_idx {unit_kind}, sim double"
    schema = to_arrow_schema(_parse_datatype_string(out))
    top = s.top_units

    def against(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = sent.value
            for batch in batches:
                n = batch.num_rows
                v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
                sims = v @ matrix.T
                _, group = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
                # Of each key the best rows for each query, the first unit on ties.
                unit = np.array(batch.column(1).to_pylist())
                for q in range(len(names)):
                    order = np.lexsort((unit, -sims[:, q], group))
                    g = group[order]
                    begin = np.r_[True, g[1:] != g[:-1]]
                    place = np.arange(n) - np.maximum.accumulate(np.where(begin, np.arange(n), 0))
                    kept = pa.array(order[place < top])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[q]] * len(kept), schema.field(0).type), batch.column(0).take(kept), batch.column(1).take(kept), pa.array(sims[order[place < top], q])], schema=schema
                    )

        return run

    rows, found = ids.toLocalIterator(), None
    while block := list(islice(rows, BLOCK)):
        sent = spark.sparkContext.broadcast(([r[0] for r in block], np.array([r[1] for r in block])))
        part = units.where("v is not null").select("key", "unit_idx", "v").mapInArrow(against(sent), out)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], out)


def pool_units(sims: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(query_id, key, raw, best_unit): mean of the best ``top_units`` similarities and the best unit (the first on ties)."""
    w = Window.partitionBy("query_id", "key").orderBy(F.desc("sim"), F.asc("unit_idx"))
    # The planner keeps only the first rows of each group before it shuffles.
    top = sims.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= s.top_units)
    return top.groupBy("query_id", "key").agg(F.avg("sim").alias("raw"), F.min_by("unit_idx", "__n").alias("best_unit"))


def calibrate(rows: DataFrame, groups: list[str], value: str = "sem_raw", name: str = "sem_cal", s: Settings = DEFAULT) -> DataFrame:
    """Adds the logistic of the population z-score within the group; 0.5 where the deviation is under 1e-6; null for null and not-a-number.

    Mean and deviation come from an aggregate joined back, so a hot group stays spread.
    """
    v = T.number(F.col(value))
    stats = rows.groupBy(*groups).agg(F.avg(v).alias("__m"), F.stddev_pop(v).alias("__s"))
    z = F.when(F.col("__s") < 1e-6, 0.0).otherwise((v - F.col("__m")) / F.col("__s"))
    on = rows.join(stats, groups)
    return on.withColumn(name, F.when(v.isNotNull(), T.logistic(s.steepness * z))).drop("__m", "__s")


def semantic_channel(evidence: DataFrame, weights: DataFrame, cohort: list[str], key: str = "stem") -> DataFrame:
    """(cohort, key, semantic_score): weighted mean of sem_cal over the requirements; cells without a value don't count."""
    w = evidence.join(weights.select("jd_id", "req_id", "weight"), ["jd_id", "req_id"]).where(F.col("sem_cal").isNotNull())
    total = F.sum("weight")
    return w.groupBy(*cohort, key).agg((F.sum(F.col("sem_cal") * F.col("weight")) / F.when(total == 0, 1.0).otherwise(total)).alias("semantic_score"))

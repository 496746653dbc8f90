"""Fact sheets, comparisons and worded explanations of a ranking."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.settings import DEFAULT, Settings


def how(s: Settings = DEFAULT):
    """Which channels carry a matched cell."""
    kw, sem = F.col("kw_hit") >= s.match_keyword, F.col("sem_cal") >= s.match_semantic
    return F.when(kw & F.coalesce(sem, F.lit(False)), "both channels").when(kw, "keyword only").otherwise("semantic only")


def best_matched(flagged: DataFrame, cohort: list[str], key: str = "stem", most: int = 8) -> DataFrame:
    """The first ``most`` matched cells a candidate: required first, then by falling sem_cal, then by requirement; with pos and how."""
    w = Window.partitionBy(*cohort, key).orderBy(F.desc("required"), F.desc_nulls_last("sem_cal"), F.asc("req_id"))
    return flagged.where("matched").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).withColumn("how", how())


def worst_missing(flagged: DataFrame, cohort: list[str], key: str = "stem", most: int = 6) -> DataFrame:
    """The first ``most`` unmatched cells a candidate: required first, then by rising sem_cal, then by requirement; with pos."""
    w = Window.partitionBy(*cohort, key).orderBy(F.desc("required"), F.asc_nulls_last("sem_cal"), F.asc("req_id"))
    return flagged.where("not matched").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)


def next_in_rank(ranked: DataFrame, cohort: list[str], key: str = "stem") -> DataFrame:
    """Adds next_key and next_score of the candidate one rank below, null for the last. An equi-join on rank + 1, so no cohort is gathered."""
    after = ranked.select(*cohort, (F.col("rank") - 1).alias("rank"), F.col(key).alias("next_key"), F.col("final_score").alias("next_score"))
    return ranked.join(after, [*cohort, "rank"], "left")


def deltas(flagged: DataFrame, pairs: DataFrame, cohort: list[str], key: str = "stem") -> DataFrame:
    """(cohort, a, b, req_id, required, a_matched, b_matched) of the requirements that just one of two candidates meets.

    pairs: (cohort, a, b)."""
    ea = flagged.select(*cohort, F.col(key).alias("a"), "req_id", "required", F.col("matched").alias("a_matched"))
    eb = flagged.select(*cohort, F.col(key).alias("b"), "req_id", F.col("matched").alias("b_matched"))
    return pairs.join(ea, [*cohort, "a"]).join(eb, [*cohort, "b", "req_id"]).where("a_matched <> b_matched")


def differences(deltas_: DataFrame, texts: DataFrame, cohort: list[str], most: int = 12) -> DataFrame:
    """(cohort, a, b, pos, req_id, text, required, only): the first ``most`` deltas of each pair, required ones first, then by requirement.

    texts: requirements (req_id and further columns in common, text); only: which of the two has evidence.
    """
    on = [c for c in texts.columns if c != "text"]
    w = Window.partitionBy(*cohort, "a", "b").orderBy(F.desc_nulls_last("required"), F.asc("req_id"))
    only = F.when(F.col("a_matched"), F.col("a")).otherwise(F.col("b"))
    top = deltas_.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)
    return top.join(texts, on, "left").select(*cohort, "a", "b", "pos", "req_id", "text", "required", only.alias("only"))


def explanations(ranked: DataFrame, matched: DataFrame, missing: DataFrame, cohort: list[str], key: str = "stem", s: Settings = DEFAULT) -> DataFrame:
    """(cohort, key, rank, explanation) for the first ``explain_top`` of each cohort.

    ranked: rank, final_score, keyword_score, semantic_score (0 to 1, given as hundredths with one decimal), covered, required_total, name;
    matched and missing as above, with text (the requirement's). Hard misses are named; for want of them, the other gaps.
    """
    head = ranked.where(F.col("rank") <= s.explain_top)
    ids = [*cohort, key]
    m = matched.join(head.select(*ids), ids, "left_semi")
    both = F.col("how") == "both channels"
    terms = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(both, F.col("kw_terms")))))), 1, 6)
    first = lambda cond: F.min_by(F.struct("text", "unit_text"), F.when(cond, F.col("pos")))
    agg = m.groupBy(*ids).agg(terms.alias("terms"), first(F.col("how") == "semantic only").alias("sem"), first(both).alias("bo"))
    miss = missing.join(head.select(*ids), ids, "left_semi")
    listed = lambda cond: F.transform(F.slice(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "text")))), 1, 3), lambda x: T.trimmed(x["text"]))
    gaps = miss.groupBy(*ids).agg(listed(F.col("hard_miss")).alias("hard"), listed(~F.col("hard_miss")).alias("soft"))
    j = head.join(agg, ids, "left").join(gaps, ids, "left")
    has = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    share = lambda c: F.round((F.coalesce(c, F.lit(0.0)) * 100).cast("decimal(28,8)"), 1).cast("decimal(28,1)").cast("string")
    score = F.col("final_score").cast("decimal(28,2)").cast("string")
    standing = F.concat(
        F.lit("Rank "), F.col("rank").cast("string"), F.lit(": "), F.col("name"), F.lit(", score "), score, F.lit(", meets "), F.col("covered").cast("string"), F.lit(" of "), F.col("required_total").cast("string"),
        F.lit(" required criteria (keyword "), share(F.col("keyword_score")), F.lit(", semantic "), share(F.col("semantic_score")), F.lit(")."),
    )
    direct = F.when(has("terms"), F.concat(F.lit("Both channels agree on "), T.joined(F.col("terms")), F.lit(".")))
    quoted = lambda c, n: F.concat(F.lit('"'), T.trimmed(c, n), F.lit('"'))
    related = F.concat(F.lit("By meaning alone "), quoted(F.col("sem.text"), 70), F.lit(" is met: "), quoted(F.col("sem.unit_text"), 160), F.lit("."))
    shown = F.when(filled("sem.unit_text"), related).when(filled("bo.unit_text"), F.concat(F.lit("For instance: "), quoted(F.col("bo.unit_text"), 160), F.lit(".")))
    lacks = F.when(has("hard"), F.concat(F.lit("Required but without any evidence: "), T.joined(F.col("hard")), F.lit("."))).when(
        has("soft"), F.concat(F.lit("Open points: "), T.joined(F.col("soft")), F.lit("."))).otherwise(F.lit("Nothing required is open."))
    return j.select(*ids, "rank", F.concat_ws(" ", standing, direct, shown, lacks).alias("explanation"))


def facts(ranked: DataFrame, matched: DataFrame, missing: DataFrame, cohort: list[str], key: str = "stem") -> DataFrame:
    """(cohort, key, rank, facts): what is known of each candidate as JSON, all that a writer of explanations may see.

    ranked: as in ``explanations``; matched and missing with text, as of ``best_matched`` and ``worst_missing``.
    """
    ids = [*cohort, key]
    good = F.struct("pos", F.col("text").alias("requirement"), "required", "how", "kw_terms", F.col("unit_text").alias("evidence"), F.round("sem_cal", 3).alias("semantic"))
    bad = F.struct("pos", F.col("text").alias("requirement"), "required", "hard_miss")
    m = matched.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("pos", F.to_json(good).alias("j")))).alias("matched"))
    n = missing.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("pos", F.to_json(bad).alias("j")))).alias("missing"))
    share = lambda c: F.round(F.coalesce(c, F.lit(0.0)) * 100, 1)
    cover = F.concat_ws("/", F.col("covered").cast("string"), F.col("required_total").cast("string"))
    each = lambda c: F.coalesce(F.transform(c, lambda x: x["j"]), F.array().cast("array<string>"))
    sheet = F.struct("rank", "name", "final_score", share(F.col("keyword_score")).alias("keyword_score"), share(F.col("semantic_score")).alias("semantic_score"), cover.alias("required_coverage"), each("matched").alias("matched"), each("missing").alias("missing"))
    return ranked.join(m, ids, "left").join(n, ids, "left").select(*ids, "rank", F.to_json(sheet).alias("facts"))


def narrated(sheets: DataFrame, said: DataFrame, write: Callable[[str], str | None], cohort: list[str], key: str = "stem") -> DataFrame:
    """``said`` with explanation and explanation_source: what ``write`` makes of the facts ('written'), or the template where it fails or gives nothing.

    ``write`` is called once a row of ``said``, of which there are a few a cohort; scores never depend on it.
    """
    ids = [*cohort, key]

    @F.pandas_udf("string")
    def told(b: pd.Series) -> pd.Series:
        def one(t):
            try:
                return write(t) or None
            except Exception:
                return None

        return b.map(one)

    rows = said.join(sheets.select(*ids, "facts"), ids, "left").withColumn("__t", F.when(F.col("facts").isNotNull(), told("facts")))
    source = F.when(F.col("__t").isNotNull(), "written").otherwise("template")
    return rows.select(*ids, "rank", F.coalesce("__t", "explanation").alias("explanation"), source.alias("explanation_source"))

"""Queries of the training-data operators over the test tables, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.stats import probit_sql
from rankloom.llm import blend, canon, names, packing, personal, scans, split, tokens, truncated
from rankloom.session import if_small
from rankloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pieces of every unit longer than 400 characters."""
    return split.split_oversized(table(spark, d, "units", "stem", "unit_idx", "text"), ["stem", "unit_idx"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Units that come out as more than one piece."""
    return p1_pieces(spark, d).where("piece_no = 1").select("stem", "unit_idx").distinct()


#: Every score has the same say.
P2_WEIGHTS = {"keyword_score": 1.0, "semantic_score": 1.0, "sem_raw": 1.0, "kw_hit": 1.0}


def _p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """Long rows (run_id, stem, metric, value): of repeated rows the last to arrive counts."""
    s = table(spark, d, "scores", "run_id", "stem", "keyword_score", "semantic_score", "loaded_at")
    s = s.groupBy("run_id", "stem").agg(F.max_by(F.struct("keyword_score", "semantic_score"), F.struct("loaded_at", "keyword_score", "semantic_score")).alias("v"))
    e = table(spark, d, "evidence", "run_id", "stem", "req_id", "kw_hit", "sem_raw", "loaded_at").repartition("run_id", "stem")
    e = e.groupBy("run_id", "stem", "req_id").agg(F.max_by(F.struct("kw_hit", "sem_raw"), F.struct("loaded_at", "kw_hit", "sem_raw")).alias("v"))
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    # Rounded, so that means of equal rows are equal whatever their order.
    e = e.groupBy("run_id", "stem").agg(F.round(F.avg(number("v.kw_hit")), 9).alias("kw_hit"), F.round(F.avg(number("v.sem_raw")), 9).alias("sem_raw"))
    a = s.select("run_id", "stem", F.expr("stack(2, 'keyword_score', v.keyword_score, 'semantic_score', v.semantic_score) as (metric, value)"))
    b = e.select("run_id", "stem", F.expr("stack(2, 'kw_hit', kw_hit, 'sem_raw', sem_raw) as (metric, value)"))
    return a.unionByName(b)


def p2_ranked(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of all runs in the order of the combined ranking."""
    return blend.blend(_p2_scores(spark, d), "run_id", "stem", P2_WEIGHTS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The first runs.shortlist candidates of each run."""
    runs = table(spark, d, "runs", "run_id", "shortlist").groupBy("run_id").agg(F.max("shortlist").alias("shortlist"))
    return p2_ranked(spark, d).join(runs, "run_id").where("rank <= shortlist").select("run_id", "stem")


def _p3_rows(spark: SparkSession, d: str) -> tuple[DataFrame, set[str], bytes]:
    """(place, stem, pos, text, names) of all texts, the given names borne often and the key; repeated rows go at the end, when they are small."""
    c = table(spark, d, "candidates", "stem", "name", "email", "raw_text")
    raw = c.where("raw_text is not null").select(F.lit("raw_text").alias("place"), "stem", F.lit(None).cast("int").alias("pos"), F.col("raw_text").alias("text"), F.col("name").alias("names"))
    mail = c.where("email is not null").select(F.lit("email").alias("place"), "stem", F.lit(0).alias("pos"), F.col("email").alias("text"), F.col("name").alias("names"))
    own = c.where("name is not null").select("stem", "name").distinct().groupBy("stem").agg(F.array_join(F.collect_list("name"), "\n").alias("names"))
    unit = table(spark, d, "units", "stem", "unit_idx", "text").join(own, "stem", "left").select(F.lit("unit").alias("place"), "stem", F.col("unit_idx").alias("pos"), "text", "names")
    return raw.unionByName(mail).unionByName(unit), personal.common_given_names(c), personal.secret(spark, c.select("stem", "name", "email"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Places that hold personal information, by kind."""
    return personal.places(personal.find_items(*_p3_rows(spark, d)))


def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    """The same texts with every item replaced by a typed placeholder with a surrogate."""
    return personal.mask(*_p3_rows(spark, d)).distinct()


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each stem with the spelling class of its name and the person or agency it stands for."""
    return names.link_names(table(spark, d, "candidates", "stem", "name"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of stems whose names stand for the same person or agency."""
    return names.linked_pairs(p4_entities(spark, d)).select(F.col("a").alias("stem_a"), F.col("b").alias("stem_b"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each value that isn't spelled as in skills, with the skill it means or ''."""
    c = table(spark, d, "candidates", "stem", "skills").select(F.lit("candidate").alias("place"), F.col("stem").alias("rec"), F.explode("skills").alias("entered"))
    r = table(spark, d, "requirements", "jd_id", "id", "keywords").select(
        F.lit("requirement").alias("place"), F.concat("jd_id", F.lit("/"), "id").alias("rec"), F.explode("keywords").alias("entered")
    )
    skills = table(spark, d, "skills", "skill")
    rows = c.unionByName(r).where("entered is not null").distinct().join(if_small(skills), F.col("entered") == F.col("skill"), "left_anti")
    terms = table(spark, d, "vocab", "term", "canon").unionByName(skills.select(F.col("skill").alias("term"), F.col("skill").alias("canon")))
    found = canon.match_values(rows, terms).select(F.col("entered").alias("__e"), F.col("match").alias("skill"))
    return rows.join(found, F.col("entered") == F.col("__e")).select("place", "rec", "entered", "skill")


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Each raw_text as continuous paragraphs."""
    return scans.repair(table(spark, d, "candidates", "stem", "raw_text", "source_format"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines with scan noise, by kind."""
    return scans.find_noise(table(spark, d, "candidates", "stem", "raw_text", "source_format"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents", "doc_id", "text"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document's ids give its text again."""
    return tokens.round_trip(table(spark, d, "documents", "doc_id", "text"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents, sized in byte_bpe_50k tokens, in containers of 2,048 tokens."""
    return packing.pack(tokens.token_counts(table(spark, d, "documents", "doc_id", "text")))


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and items of each container."""
    return p8_containers(spark, d).groupBy("container").agg(F.sum("size").alias("tokens"), F.count("*").alias("items"))


def p9_ends(spark: SparkSession, d: str) -> DataFrame:
    """Every document with text, whether it was cut off, and what tells."""
    return truncated.find_truncated(table(spark, d, "documents", "doc_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were cut off."""
    return p9_ends(spark, d).where("truncated").select("doc_id").distinct()


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncated.by_source(table(spark, d, "documents", "doc_id", "source"), p9_ends(spark, d))


_P2_SQL = f"""
with s as (select run_id, stem, arg_max({{'k': keyword_score, 's': semantic_score}}, loaded_at) v from scores group by run_id, stem),
e0 as (select run_id, stem, req_id, arg_max({{'k': kw_hit, 's': sem_raw}}, loaded_at) v from evidence group by all),
e as (select run_id, stem, round(avg(v.k) filter (not isnan(v.k)), 9) k, round(avg(v.s) filter (not isnan(v.s)), 9) s from e0 group by all),
l as (select run_id, stem, 'a' m, v.k x from s union all select run_id, stem, 'b', v.s from s union all select run_id, stem, 'c', k from e union all select run_id, stem, 'd', s from e),
v as (select * from l where x is not null and not isnan(x)),
p as (select run_id, stem, m, (rank() over w - 1 + count(*) over t / 2.0) / count(*) over g q from v
  window w as (partition by run_id, m order by x), t as (partition by run_id, m, x), g as (partition by run_id, m)),
z as (select run_id, stem, round(avg({probit_sql('q')}), 9) b from p group by all),
a as (select distinct run_id, stem from l),
r as (select a.run_id, a.stem, row_number() over (partition by a.run_id order by z.b desc nulls last, a.stem) rk from a left join z using (run_id, stem))
select run_id, stem from r join (select run_id, max(shortlist) shortlist from runs group by all) using (run_id) where rk <= shortlist
"""

_SQL = {
    "p1_found": "select distinct stem, unit_idx from units where length(trim(text, ' ')) > 400",
    "p2_found": _P2_SQL,
}


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (p1_pieces, p1_found, p2_found, p2_ranked, p3_found, p3_masked, p4_entities, p4_found, p5_found, p6_found, p6_repaired, p7_ids, p7_round_trip, p8_containers, p8_usage, p9_ends, p9_found, p9_sources)
    }


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

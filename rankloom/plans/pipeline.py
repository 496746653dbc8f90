"""From candidates' texts and a description to the ranked cohort, as one chain of plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import describe, encode, evaluate, explain, fuse, ingest, lexical, semantic
from rankloom.session import cut, if_small
from rankloom.settings import DEFAULT, Settings


def _with_scorer(evidence: DataFrame, ranked: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], s: Settings) -> DataFrame:
    """Evidence with ce_score: the scorer's logits for requirement and best unit, of the required cells of the first ``rerank_top`` only."""
    head = ranked.where(F.col("rank") <= s.rerank_top).select("jd_id", "stem")
    asked = evidence.where("required and unit_text <> ''").join(head, ["jd_id", "stem"], "left_semi").select("jd_id", "stem", "req_id", "text", "unit_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["jd_id", "stem", "req_id"]].copy()
            out["ce_score"] = [float(x) for x in scorer(list(zip(b["text"], b["unit_text"])))] if len(b) else pd.Series([], dtype=float)
            yield out

    made = asked.mapInPandas(run, "jd_id string, stem string, req_id string, ce_score double")
    return evidence.join(made, ["jd_id", "stem", "req_id"], "left")


def rank(candidates: DataFrame, descriptions: DataFrame, vocab: DataFrame, encoder=None, s: Settings = DEFAULT, scorer: Callable[[list[tuple[str, str]]], list[float]] | None = None, limit: int | None = None) -> dict[str, DataFrame]:
    """Frames 'requirements', 'units', 'evidence', 'ranked', 'explanations' keyed by jd_id and stem.

    ``scorer`` gives a logit for each (requirement, unit); with one the first ``rerank_top`` are scored anew. ``limit`` keeps the first of each description.

    candidates: (stem, raw_text); descriptions: (jd_id, text); vocab: (term, canon). Candidates with under ``least_text`` characters are left out.
    Every description ranks every readable candidate: a stated set of descriptions against the pool. The encoder's default is lexical.
    """
    pool = candidates.where(F.length("raw_text") >= s.least_text).select("stem", "raw_text")
    req = cut(describe.requirements(descriptions, vocab, s=s))
    lines = ingest.fuzzy_headers(ingest.lines_of(pool, "stem", "raw_text"), "stem", s)
    units = cut(encode.encode(ingest.split_units(lines, "stem", s), make=encoder))
    skills = cut(ingest.all_skills(pool, "stem", "raw_text", vocab, s))
    pairs = pool.select("stem").crossJoin(if_small(descriptions.select("jd_id").distinct()))
    hits = lexical.keyword_hits(pairs, req, skills, pool.select("stem", F.col("raw_text").alias("text")))
    q = encode.encode(req.select("jd_id", "req_id", "text"), make=encoder)
    qs = q.select(F.concat_ws("/", "jd_id", "req_id").alias("query_id"), F.col("vector").alias("q"))
    pooled = semantic.pool_units(semantic.best_similarities(qs, units.select(F.col("stem").alias("key"), "unit_idx", F.col("vector").alias("v"))), s)
    best = pooled.join(units.select(F.col("stem").alias("key"), F.col("unit_idx").alias("best_unit"), F.col("text").alias("unit_text"), F.col("section").alias("unit_section")), ["key", "best_unit"], "left")
    best = best.select(F.split("query_id", "/")[0].alias("jd_id"), F.element_at(F.split("query_id", "/"), -1).alias("req_id"), F.col("key").alias("stem"), "raw", "unit_text", "unit_section")
    cells = hits.join(best, ["jd_id", "req_id", "stem"], "left").withColumn("sem_raw", F.coalesce("raw", F.lit(0.0))).drop("raw")
    cells = semantic.calibrate(cells, ["jd_id", "req_id"], s=s).join(req.select("jd_id", "req_id", "required", "text", "weight"), ["jd_id", "req_id"])
    evidence = cut(fuse.flags(cells.withColumn("unit_text", F.coalesce("unit_text", F.lit(""))), s))
    query = descriptions.select("jd_id", "text")
    bm = lexical.bm25(pairs, query, pool.select("stem", F.col("raw_text").alias("text")), "jd_id", s=s)
    kw = lexical.keyword_channel(evidence.drop("weight"), req, bm, "jd_id", s=s)
    sem = semantic.semantic_channel(evidence.drop("weight"), req, ["jd_id"])
    cover = fuse.coverage(evidence, ["jd_id"])
    scores = kw.join(sem, ["jd_id", "stem"], "left").join(cover, ["jd_id", "stem"])
    scores = scores.withColumn("final_score", fuse.final_score(F.col("keyword_score"), F.col("semantic_score"), F.col("n_hard_miss"), s))
    ranked = cut(fuse.rank_within(scores, ["jd_id"]))
    if scorer is not None:
        evidence = cut(_with_scorer(evidence, ranked, scorer, s))
        again = fuse.rerank(ranked, evidence, ["jd_id"], s=s)
        ranked = cut(ranked.drop("rank", "semantic_score", "final_score").join(again, ["jd_id", "stem"]))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    named = ranked.join(ingest.names_of(pool, "stem", "raw_text"), "stem")
    said = explain.explanations(named, explain.best_matched(evidence, ["jd_id"]), explain.worst_missing(evidence, ["jd_id"]), ["jd_id"], s=s)
    return {"requirements": req, "units": units, "evidence": evidence, "ranked": ranked, "explanations": said}


def compare_encoders(candidates: DataFrame, descriptions: DataFrame, vocab: DataFrame, grades: DataFrame, encoders: dict[str, object], s: Settings = DEFAULT) -> DataFrame:
    """(encoder, jd_id, ndcg) of the whole chain with each of a few encoders; grades: (jd_id, stem, grade)."""
    out = None
    for name, make in encoders.items():
        ranked = rank(candidates, descriptions, vocab, make, s)["ranked"].join(grades, ["jd_id", "stem"], "left")
        one = evaluate.ndcg(ranked, ["jd_id"], "final_score", "grade", "stem").select(F.lit(name).alias("encoder"), "jd_id", "ndcg")
        out = one if out is None else out.unionByName(one)
    return out

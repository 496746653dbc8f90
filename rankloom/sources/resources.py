"""Vocabulary, families and word lists from JSON files, as tables; and their SQL-free look-ups."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def _json(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def vocabulary(spark: SparkSession, skills: str, aliases: str | None = None) -> DataFrame:
    """(term, canon) in lower case from {category: [term]} and {other spelling: term}; where both have a term, the other spelling's meaning counts."""
    known = {t.lower(): t.lower() for ts in _json(skills).values() for t in ts}
    known |= {a.lower(): c.lower() for a, c in (_json(aliases) if aliases else {}).items()}
    return spark.createDataFrame(sorted(known.items()), "term string, canon string")


def categories(spark: SparkSession, skills: str) -> DataFrame:
    """(category, skill)."""
    return spark.createDataFrame([(c, t) for c, ts in _json(skills).items() for t in ts], "category string, skill string")


def families(path: str) -> tuple[list[tuple[str, tuple[str, ...]]], dict[str, dict[str, int]]]:
    """(patterns in order, for ``ingest.family_of``; family looked for -> family -> grade) from {families: [[name, [pattern]]], relevance: {name: {name: grade}}}."""
    content = _json(path)
    rows = content["families"] if isinstance(content, dict) else content
    return [(n, tuple(ps)) for n, ps in rows], (content.get("relevance", {}) if isinstance(content, dict) else {})


def words(spark: SparkSession, path: str, leave_out: tuple[str, ...] = ("feminine_coded",)) -> DataFrame:
    """(category, term) from {category: [term]}; notes and names that begin with '_' aren't categories."""
    rows = [(c, t) for c, ts in _json(path).items() if not c.startswith("_") and c != "notes" and c not in leave_out for t in ts]
    return spark.createDataFrame(rows, "category string, term string")

"""The ranking as text for a terminal."""

from __future__ import annotations

from pyspark.sql import DataFrame


def leaderboard(rows: DataFrame, most: int = 15) -> str:
    """A table of the first ``most`` artifact rows of a cohort, with a family only if any is known, and the span of their scores."""
    top = rows.where(f"rank <= {int(most)}").orderBy("rank").collect()
    families = any(r["family"] not in (None, "unknown") for r in top)
    show = lambda v: "-" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    table = [["rank", "name", *(["family"] if families else []), "score", "keyword", "semantic", "required"]]
    table += [[show(x) for x in (r["rank"], r["name"], *([r["family"]] if families else []), r["final_score"], r["keyword_score"], r["semantic_score"], r["required_coverage"])] for r in top]
    wide = [max(len(row[i]) for row in table) for i in range(len(table[0]))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(row, wide)).rstrip() for row in table]
    scores = [r["final_score"] for r in top if r["final_score"] is not None]
    return "\n".join([*lines, f"spread {max(scores) - min(scores):.2f}" if scores else "no scores"])

"""Every tunable value of the scoring operators; pass another instance to vary them."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    format_preference: tuple[str, ...] = ("xml", "docx", "txt", "pdf")
    least_text: int = 120
    least_unit: int = 25
    most_unit: int = 400
    header_ratio: float = 85.0
    skill_ratio: float = 88.0
    skill_least: int = 5
    skill_most: int = 30
    hit_share: float = 0.70
    bm25_share: float = 0.30
    required_weight: float = 1.0
    preferred_weight: float = 0.5
    steepness: float = 1.0
    top_units: int = 2
    w_keyword: float = 0.50
    w_semantic: float = 0.50
    hard_miss_below: float = 0.45
    penalty: float = 0.12
    floor: float = 0.50
    match_semantic: float = 0.55
    match_keyword: float = 0.50
    rerank_top: int = 10
    rerank_share: float = 0.50
    explain_top: int = 3
    narrow_share: float = 0.15
    narrow_least: int = 2
    narrow_semantic: float = 0.62
    narrow_top: float = 0.35
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25

    def changed(self, spark=None, environment: dict[str, str] | None = None) -> Settings:
        """With the values of spark.rankloom.<name> and of RANKLOOM_<NAME> in the environment, which goes first."""
        named = os.environ if environment is None else environment
        new = {}
        for f in fields(self):
            now = getattr(self, f.name)
            text = named.get(f"RANKLOOM_{f.name.upper()}") or (spark.conf.get(f"spark.rankloom.{f.name}", None) if spark else None)
            if text is not None and not isinstance(now, str):
                new[f.name] = tuple(text.split(",")) if isinstance(now, tuple) else type(now)(text)
        return replace(self, **new)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=1)

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path, encoding="utf-8") as f:
            return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.load(f).items()})


DEFAULT = Settings()

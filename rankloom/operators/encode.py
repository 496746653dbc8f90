"""Pluggable encoders: text -> unit vector. The offline default hashes words and is lexical, no stand-in for a trained encoder."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Encoder = Callable[[list[str]], np.ndarray]


def hashed_words(size: int = 256) -> Callable[[], Encoder]:
    """Words and pairs of words hashed to signed places, scaled to length 1; zeros for texts without words."""

    def make() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size), dtype=np.float32)
            for i, t in enumerate(texts):
                ws = re.findall(r"\w+", t.lower())
                for g in (*ws, *map(" ".join, zip(ws, ws[1:]))):
                    h = zlib.crc32(g.encode())
                    out[i, h % size] += 1.0 if h & 0x80000000 else -1.0
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm == 0, 1, norm)

        return encode

    return make


def encode(df: DataFrame, text: str = "text", name: str = "vector", make: Callable[[], Encoder] | None = None) -> DataFrame:
    """Adds an array<float> column; the encoder is made once a task. Null texts are taken as empty."""
    maker = make or hashed_words()
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{name}` array<float>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = maker()
        for b in batches:
            yield b.assign(**{name: list(enc([t or "" for t in b[text]]))})

    return df.mapInPandas(run, schema)

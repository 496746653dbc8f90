"""Problem 7: token ids of whole texts under a public byte-level tokenizer.

The rank file is read once on the driver and sent to the executors (its size is that of the vocabulary, whatever the
corpus). Long texts are cut at places where the tokenizer's own pattern can't join the two sides, so each part is
encoded alone and the ids are those of the whole text.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.session import widen

#: Folder of the public vocabulary files; a parameter, as they aren't part of this repository.
TOKENIZERS = os.environ.get("RANKLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the public pre-tokenization pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts beyond this many characters are encoded part by part.
PART_CHARS = 20_000

_encoders: dict[str, object] = {}


def rank_file(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def encoder(ranks: bytes):
    """The tiktoken encoding of a rank file; made once a worker."""
    key = hashlib.sha1(ranks).hexdigest()
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding(f"own-{key[:8]}", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def safe_cuts(text: str, every: int = PART_CHARS) -> list[int]:
    """Positions to cut a text without changing its ids, about ``every`` characters apart.

    A white-space character after another character always begins a new match, and so does a digit after a letter.
    A stretch without such a place isn't cut.
    """
    cuts, at = [], every
    while at < len(text):
        i = at
        while i < len(text) and not ((text[i] in " \n\t" and not text[i - 1].isspace()) or (text[i].isdecimal() and text[i - 1].isalpha())):
            i += 1
        if i >= len(text):
            break
        cuts.append(i)
        at = i + every
    return cuts


def encode_text(enc, text: str | None) -> np.ndarray:
    """Ids of one text; empty for null and empty."""
    if not text:
        return np.empty(0, dtype=np.uint32)
    if len(text) <= PART_CHARS:
        return enc.encode_to_numpy(text, disallowed_special=())
    cuts = safe_cuts(text)
    return np.concatenate([enc.encode_to_numpy(text[a:b], disallowed_special=()) for a, b in zip([0, *cuts], [*cuts, len(text)])])


def decode_ids(enc, ids) -> str:
    """The text of a list of ids: the tokens' bytes are joined first and read as UTF-8 then."""
    return b"".join(enc.decode_single_token_bytes(int(i)) for i in ids).decode("utf-8")


def _mapped(df: DataFrame, key: str, text: str, schema: str, out, ranks: bytes) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for batch in batches:
            yield out(enc, batch.column(0), batch.column(1).to_pylist())

    return widen(df.select(key, text)).mapInArrow(run, schema)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(``key``, ids array<int>) of every row, without special tokens; strings that look like special tokens are text.

    Null and empty texts give an empty list, blank ones their white-space tokens. A map over the rows: repeated rows
    stay repeated, a null key stays null, other columns are left out. Nothing is shuffled on inputs that are as wide
    as the cluster.
    """

    def out(enc, keys, texts):
        ids = [encode_text(enc, t) for t in texts]
        ends = np.zeros(len(ids) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in ids], out=ends[1:])
        flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return _mapped(df, key, text, f"`{key}` {kind}, ids array<int>", out, rank_file(tokenizer, folder))


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(``key``, n_tokens int) of every row; as encode_corpus, but only the counts leave Python."""

    def out(enc, keys, texts):
        return pa.RecordBatch.from_arrays([keys, pa.array([len(encode_text(enc, t)) for t in texts], pa.int32())], names=[key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return _mapped(df, key, text, f"`{key}` {kind}, n_tokens int", out, rank_file(tokenizer, folder))


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(``key``, n_tokens, exact): whether decoding the ids gives the text again; null texts count as empty."""

    def out(enc, keys, texts):
        ids = [encode_text(enc, t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [keys, pa.array([len(x) for x in ids], pa.int32()), pa.array([decode_ids(enc, x) == (t or "") for x, t in zip(ids, texts)], pa.bool_())],
            names=[key, "n_tokens", "exact"],
        )

    kind = df.schema[key].dataType.simpleString()
    return _mapped(df, key, text, f"`{key}` {kind}, n_tokens int, exact boolean", out, rank_file(tokenizer, folder))

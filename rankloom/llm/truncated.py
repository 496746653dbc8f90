"""Problem 9: texts cut off by a field limit or in transfer.

A self-join by prefix, on two scales. First whole values: hashes of fixed-length prefixes find the texts that are strict prefixes of
longer ones, and if such a copy goes on inside the line, the text was cut. Whole copies are rare, so the ends come next: the last words
of each text are looked up among all runs of words of the corpus. A text is cut off if its last words are strict prefixes of
longer copies elsewhere - the last word goes on there, or further words of the sentence follow - and (almost) no copy ends there. The
prefixes used are, in this order, the beginning of the sentence with the last words, the last three words, the last two, the last one;
the first that occurs elsewhere decides. All counts are over all documents; texts are taken apart once, and only hashes, words
and counts are shuffled, after a partial aggregation. Prefixes of words are joined by equality, so a word that follows
everywhere is spread over its prefixes.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import if_small, stored, widen

#: Copies that end at the same words, as a share of all copies, up to which they count as cut off themselves.
NOISE = 0.02
#: Longer copies that are asked for if the text has a full stop after its last word.
LEAST_AFTER_STOP = 5
#: Lengths of the hashed prefixes of whole texts: from 8 characters on, each half as long again; a shorter text is no prefix worth the name.
LADDER = [8]
while LADDER[-1] < 1 << 30:
    LADDER.append(LADDER[-1] * 3 // 2)

#: Words that are counted together before they are handed on.
FLUSH = 1_500_000

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}#]+(?:['’.\-‑][\p{L}\p{N}#]+)*")
_PLAIN_WORD = re.compile(r"[^\W_]+(?:['’.\-‑][^\W_]+)*")
_DIGITS = re.compile("[0-9]+")
_SENTENCE_GAP = regex.compile(r"(?<=[.!?…])\s+(?=[\p{Lu}\"“«¿¡(])")
_BULLET = regex.compile(r"\s*(?:[-*•–·]\s+)?")
_BLANKS = regex.compile(r"[\s\p{Z}\u200b\ufeff]+$")
_STOP = regex.compile("(?<![.…])[.!?。][\"”’»)]*$")
# A name: few words, all with a capital.
_CAPITALS = regex.compile(r"(?:\p{Lu}[\p{L}\p{M}'’.-]*\s*){1,4}")
_SCHEMA = "level string, a string, b string, x string, e bigint, c bigint, tail struct<key: {key}, stop: boolean, prose: boolean, signature: boolean, long: boolean, last: string, s: array<string>, n: int, full: binary, steps: array<binary>>"


def _body(text: str | None) -> str:
    """A text without blanks at its end."""
    return _BLANKS.sub("", text) if text else ""


def _words(segment: str) -> list[str]:
    """Lower-case words, numbers as '#'."""
    low = segment.lower()
    if low.isascii():
        found = _PLAIN_WORD.findall(low)
        return [_DIGITS.sub("#", w) for w in found] if _DIGITS.search(low) else found
    return _WORD.findall(_DIGITS.sub("#", low.replace("#", " ")))


def _segments(body: str) -> list[tuple[str, list[str]]]:
    """Sentences and lines with their words; those without words are left out."""
    out = []
    for line in body.split("\n"):
        line = line[_BULLET.match(line).end() :]
        for s in _SENTENCE_GAP.split(line) if line else ():
            if w := _words(s):
                out.append((s, w))
    return out


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


def _steps(body: str) -> list[bytes]:
    """Hashes of the prefixes of the lengths of LADDER that the text has."""
    out, at, h = [], 0, hashlib.blake2b(digest_size=8)
    for n in LADDER:
        if n > len(body):
            break
        h.update(body[at:n].encode())
        out.append(h.copy().digest())
        at = n
    return out


def _layout(segs: list[tuple[str, list[str]]]) -> tuple[bool, bool]:
    """Whether the lines of a text end with full stops, and whether its last line is a signature: a name under a short line."""
    ends = [s.rstrip()[-1:] for s, w in segs[:-1] if len(w) > 3]
    prose = sum(e in ".!?。" for e in ends) > sum(e not in ".!?:,。" for e in ends)
    last, w = segs[-1]
    before = segs[-2][0].strip() if len(segs) > 1 else ""
    return prose, bool(before) and len(w) <= 4 and len(before.split()) < 6 and not before.endswith(".") and _CAPITALS.fullmatch(last.strip()) is not None


def _taken_apart(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Two kinds of rows of one pass over the texts.

    (level, a, b, x, e, c): how often word x after the words a, b ends a sentence or line and how often more follows; a: for level 's' the
    two words the sentence begins with, for '3' the word before b; '^' before the first. Partial sums. The last word of a document without a
    full stop says nothing and isn't counted. (tail): what is asked about the end of each document with text.
    """
    kind = docs.schema[key].dataType.simpleString()
    ddl = _SCHEMA.format(key=kind)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def counted(ids: dict[str, int], parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """The rows of the first kind of segments given as (numbers of words, sizes, whether the last word isn't counted)."""
        x, sizes, dumb = (np.concatenate(p) for p in zip(*parts))
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        j = np.arange(len(x)) - first
        end = j == np.repeat(sizes, sizes) - 1
        p1 = np.where(j > 0, np.roll(x, 1), 0)
        p2 = np.where(j > 1, np.roll(x, 2), 0)
        begin = np.where(j > 1, x[first] << 32 | x[np.minimum(first + 1, len(x) - 1)], -1)
        begins, begin = np.unique(begin, return_inverse=True)
        kept = ~(end & np.repeat(dumb, sizes))
        names = np.array(list(ids), dtype=object)
        for level, a in (("s", begin), ("3", p2)):
            if len(names) < 1 << 21:
                keys, which, n = np.unique((a << 42 | p1 << 21 | x)[kept], return_inverse=True, return_counts=True)
                a, b, c = keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF
            else:
                keys, which, n = np.unique(np.stack([a, p1, x], 1)[kept], axis=0, return_inverse=True, return_counts=True)
                a, b, c = keys.T
            ends = np.bincount(which.ravel(), weights=end[kept], minlength=len(keys)).astype(np.int64)
            if level == "s":
                a = np.array(["^" if v < 0 else f"{names[v >> 32]} {names[v & 0xFFFFFFFF]}" for v in begins], dtype=object)[a]
            else:
                a = names[a]
            columns = [pa.array(v, pa.string()) for v in ([level] * len(keys), a, names[b], names[c])] + [pa.array(ends), pa.array(n - ends)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(keys), schema.field("tail").type)], schema=schema)

    def numbers() -> defaultdict[str, int]:
        ids: defaultdict[str, int] = defaultdict()
        ids.default_factory = ids.__len__
        ids["^"]
        return ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, words = numbers(), [], 0
        for batch in batches:
            tails, segments, dumb = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = _body(t)
                if not body:
                    continue
                stop = _STOP.search(body[-40:]) is not None
                segs = _segments(body)
                segments += [w for _, w in segs]
                dumb += [False] * len(segs)
                tail = {"key": k, "stop": stop, "n": len(body), "full": _hash(body.encode()), "steps": _steps(body), "prose": False, "signature": False, "long": False, "last": "", "s": ["", "", ""]}
                if segs:
                    dumb[-1] = not stop
                    w = segs[-1][1]
                    n = len(w) - 1
                    prose, signature = _layout(segs)
                    tail |= {"prose": prose, "signature": signature, "long": n > 2, "last": w[n], "s": [" ".join(w[:2]) if n > 1 else "^", ["^", "^", *w][n], ["^", *w][n]]}
                tails.append(tail)
            if segments:
                parts.append((np.array(list(map(ids.__getitem__, chain.from_iterable(segments))), dtype=np.int64), np.array([len(w) for w in segments]), np.array(dumb)))
                words += len(parts[-1][0])
            if words > FLUSH:
                yield from counted(ids, parts)
                ids, parts, words = numbers(), [], 0
            if tails:
                blank = [pa.nulls(len(tails), schema.field(i).type) for i in range(6)]
                yield pa.RecordBatch.from_arrays([*blank, pa.array(tails, schema.field("tail").type)], schema=schema)
        if parts:
            yield from counted(ids, parts)

    return docs.select(key, text).mapInArrow(run, ddl)


def _prefixes(copies: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Copies with each prefix of their word that has from ``lo`` to ``hi`` letters, the word itself included."""
    fit = copies.where(F.length("x") >= lo).withColumn("i", F.explode(F.sequence(lo, F.least(F.length("x"), hi))))
    return fit.withColumn("pre", F.expr("substring(x, 1, i)"))


def _sums(level: str) -> list[Column]:
    """a: copies that end, b: copies after whose last word more follows, p: copies whose last word goes on."""
    exact = F.col("x") == F.col("last")
    return [
        F.sum(F.when(exact, F.col("e")).otherwise(0)).alias(f"a{level}"), F.sum(F.when(exact, F.col("c")).otherwise(0)).alias(f"b{level}"),
        F.sum(F.when(~exact, F.col("e") + F.col("c")).otherwise(0)).alias(f"p{level}"),
    ]


def _looked_up(tails: DataFrame, copies: DataFrame, level: str) -> DataFrame:
    """(kh, last, a, b, p) of the ends that occur in ``copies``; words are taken apart only after words that end a text, at the lengths asked for there."""
    asked = tails.select(F.col(f"k{level}").alias("kh"), "last").distinct()
    bounds = asked.groupBy(F.col("kh").alias("h")).agg(F.min(F.length("last")).alias("lo"), F.max(F.length("last")).alias("hi"))
    near = _prefixes(copies.join(bounds, "h"), F.col("lo"), F.col("hi"))
    return near.join(asked, (F.col("kh") == F.col("h")) & (F.col("pre") == F.col("last"))).groupBy("kh", "last").agg(*_sums(level))


def _longer_copies(docs: DataFrame, key: str, text: str, tails: DataFrame) -> DataFrame:
    """(full, n, goes) of the texts that are strict prefixes of longer ones; goes: whether such a copy goes on inside the line.

    Each text asks with its longest hashed prefix for longer texts that begin alike; only those are read again and hashed at its length. One
    prefix is asked for with as many lengths as lie between two steps, at most, however many texts begin with it.
    """
    steps = F.col("steps")
    asks = tails.where(F.size(steps) > 0).select(F.size(steps).alias("step"), F.element_at(steps, -1).alias("h"), F.col("n").alias("n")).distinct()
    long = tails.select("key", F.col("n").alias("m"), F.posexplode("steps").alias("at", "h")).select("key", "m", (F.col("at") + 1).alias("step"), "h")
    lengths = stored(long.join(asks, ["step", "h"]).where("n < m").groupBy(F.col("key").alias("__k")).agg(F.collect_set("n").alias("__ns")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, ns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = _body(t)
                for n in ns:
                    inside = body[n - 1 : n].isalnum() and body[n : n + 1].isalnum()
                    sentence = body[n - 1 : n] not in ".!?:…。" and regex.match(r"[,;]?[^\S\n]+\p{Ll}", body[n : n + 80]) is not None
                    out.append((_hash(body[:n].encode()), n, inside or sentence))
            full, n, goes = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.binary()), pa.array(n, pa.int32()), pa.array(goes, pa.bool_())], names=["full", "n", "goes"])

    met = docs.select(key, text).join(if_small(lengths), F.col(key).eqNullSafe(F.col("__k"))).select(text, "__ns")
    return met.mapInArrow(run, "full binary, n int, goes boolean").groupBy("full", "n").agg(F.max("goes").alias("goes"))


def find_truncated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, truncated, evidence) of every document that isn't null, empty or blank.

    evidence: the prefix that decided ('copy' the whole text, 's' beginning of sentence and last words, '3', '2', '1' last words,
    'layout' signatures, 'none' where nothing of the end occurs elsewhere or no word stands in the text; such a text counts as complete).
    Repeated rows count once; a null key stays. Extra columns are left out. An empty table gives an empty one. Whole texts are read,
    whatever their length.
    """
    apart = stored(_taken_apart(widen(docs.select(key, text)), key, text))
    level = lambda n, *words: F.xxhash64(F.lit(n), *words)
    s = F.col("tail.s")
    tails = apart.where("tail is not null").select("tail.*", level("s", s[0], s[2]).alias("ks"), level("3", s[1], s[2]).alias("k3"), level("2", s[2]).alias("k2")).drop("s").distinct()
    words = [F.col(c) for c in "ab"]
    counts = apart.where("level is not null").select(level("s", *words).alias("hs"), level("3", *words).alias("h3"), level("2", words[1]).alias("g"), "level", "x", "e", "c")
    ways = tails.where("not signature")
    fine = ways.select("last", "ks", "k3", "k2").distinct()
    for n in "s3":
        copies = counts.where(F.col("level") == n).select(F.col(f"h{n}").alias("h"), "x", "e", "c")
        fine = fine.join(_looked_up(ways, copies, n).withColumnRenamed("kh", f"k{n}"), [f"k{n}", "last"], "left")
    fine = stored(fine)
    open_ = fine.where("coalesce(as + bs + ps, 0) <= 1 and coalesce(a3 + b3 + p3, 0) <= 1")
    two = counts.where("level = '3'").select(F.col("g").alias("h"), "x", "e", "c")
    one = _prefixes(two.groupBy("x").agg(F.sum("e").alias("e"), F.sum("c").alias("c")), F.lit(1), F.length("x"))
    begins = (F.length("last") >= 3) | (F.col("x") == F.col("last"))
    single = one.join(open_.select("last").distinct(), F.col("pre") == F.col("last")).where(begins).groupBy("last").agg(*_sums("1"))
    full = open_.select("last", "ks", "k3", "k2").join(_looked_up(open_, two, "2").withColumnRenamed("kh", "k2"), ["k2", "last"], "left").join(single, "last", "left")
    full = fine.join(full, ["last", "ks", "k3", "k2"], "left")
    rows = tails.drop("steps").join(full, ["last", "ks", "k3", "k2"], "left").join(_longer_copies(docs, key, text, tails), ["full", "n"], "left").na.fill(0)

    # A text with a full stop is among the copies that end.
    own = F.when(F.col("stop"), F.lit(1)).otherwise(F.lit(0))
    verdict = F.struct(F.lit(False).alias("truncated"), F.lit("none").alias("evidence"))
    for n in "123s":
        a, b, p = F.col(f"a{n}") - own, F.col(f"b{n}"), F.col(f"p{n}")
        all_ = a + b + p
        unended = (a <= 0) if n == "1" else (a <= NOISE * all_)
        after_stop = F.lit(n in "s3") & (b + p >= LEAST_AFTER_STOP) & F.col("last").rlike(r"^\p{L}")
        bare = F.col("prose") & F.col("long") & (b + p > NOISE * a)
        yes = F.when(F.col("stop"), unended & after_stop).otherwise(unended | bare)
        verdict = F.when(all_ > 0, F.struct(yes.alias("truncated"), F.lit(n).alias("evidence"))).otherwise(verdict)
    verdict = F.when(F.col("signature"), F.struct(F.lit(False).alias("truncated"), F.lit("layout").alias("evidence"))).otherwise(verdict)
    verdict = F.when(F.col("goes"), F.struct(F.lit(True).alias("truncated"), F.lit("copy").alias("evidence"))).otherwise(verdict)
    return rows.select(F.col("key").alias(key), verdict.alias("v")).select(key, F.coalesce("v.truncated", F.lit(False)).alias("truncated"), "v.evidence")


def by_source(docs: DataFrame, found: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(``source``, n_docs, n_truncated, share) over the documents with text; a null source is a source like others."""
    f = found.select(F.col(key).alias("__k"), "truncated").groupBy("__k").agg(F.max("truncated").alias("truncated"))
    d = docs.select(key, source).distinct().join(f, F.col(key) == F.col("__k"))
    return d.groupBy(source).agg(F.count("*").alias("n_docs"), F.count_if("truncated").alias("n_truncated")).withColumn("share", F.col("n_truncated") / F.col("n_docs"))

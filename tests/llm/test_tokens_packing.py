import random

import numpy as np
import pytest

from rankloom.llm import packing, tokens

TEXTS = ["Hello world", "", None, "  \n\t ", "don't stop 123abc", "负责仓库。", "a" * 30_000, "word " * 9000, "x1 " * 9000 + "é🔧", "<|endoftext|> is text", "\x1c \x1d tab​", ("line\r\n" * 5000), "'s5't9 " * 4000]


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.rank_file())


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_parts_give_the_ids_of_the_whole(enc, i):
    t = TEXTS[i] or ""
    assert list(tokens.encode_text(enc, TEXTS[i])) == enc.encode_ordinary(t)
    assert tokens.decode_ids(enc, tokens.encode_text(enc, TEXTS[i])) == t


def test_safe_cuts_at_random(enc):
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice(["a", "'s", " ", "\n", "1", ".", "é", " ", "\x1c", "Z9", "  "]) for _ in range(rng.randrange(200)))
        cuts = tokens.safe_cuts(t, 7)
        parts = [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)])]
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)


def test_operators(spark, enc):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", "x")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df).collect()}
    assert got == {**{i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}, None: enc.encode_ordinary("a b")}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()} == {k: len(v) for k, v in got.items()}
    assert all(r["exact"] for r in tokens.round_trip(df).collect())
    assert tokens.encode_corpus(df.where("false")).count() == 0


def test_plan_places_every_item():
    rng = random.Random(2)
    for capacity in (1, 7, 40, 128):
        counts = np.array([0] + [rng.choice([0, 0, 1, 3, 20]) for _ in range(capacity)])
        made = np.zeros_like(counts)
        n = 0
        for kind, times in packing.plan(counts, capacity):
            assert 0 < sum(kind) <= capacity and times > 0
            n += times
            for v in kind:
                made[v] += times
        assert (made == counts).all()
        assert n >= -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    assert packing.plan(np.zeros(11, int), 10) == []


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    counts = np.bincount(np.minimum(2048, rng.gamma(1.5, 180, 20_000).astype(int) + 1), minlength=2049)
    n = sum(k for _, k in packing.plan(counts))
    assert n <= 1.002 * (-(-int((counts * np.arange(2049)).sum()) // 2048)) + 1


def test_pack(spark):
    rows = [(i, 3 + i % 5) for i in range(100)] + [(200, 0), (201, None), (202, 25), (203, 10), (204, 10), (204, 10), (None, 4)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens int"), capacity=10).collect()
    by = {}
    for r in got:
        by.setdefault(r["container"], []).append(r)
    assert all(sum(r["size"] for r in rs) <= 10 for rs in by.values())
    sizes = {}
    for r in got:
        sizes.setdefault(r["doc_id"], []).append(r["size"])
    assert {k: sum(v) for k, v in sizes.items()} == {i: n or 0 for i, n in rows}
    assert sorted(sizes[202]) == [5, 10, 10] and all(len(v) == 1 for k, v in sizes.items() if k != 202)
    total = sum(n or 0 for i, n in dict(rows).items())
    assert len(by) <= -(-total // 10) + 3
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens int")).count() == 0


def test_combinations_fill_the_window():
    combos = packing.shallow_combinations(np.array([2, 3, 5]), 10, 1)
    assert set(combos.sum(1)) <= {9, 10} and {tuple(c) for c in combos} >= {(5, 5, 0), (5, 3, 2)}


@pytest.mark.parametrize("lengths,most", [({78: 137, 117: 32}, 57), ({40: 656, 100: 179, 117: 109, 127: 150, 144: 153, 147: 201, 184: 269, 188: 192}, 768)])
def test_lengths_without_exact_fill_are_planned_too(lengths, most):
    counts = np.zeros(301, int)
    counts[list(lengths)] = list(lengths.values())
    made = packing.plan(counts, 300)
    assert sum(n for _, n in made) <= most
    assert {v: sum(n * kind.count(v) for kind, n in made) for v in lengths} == lengths


def test_best_fills_leave_the_least_space():
    lengths = np.array([2, 5, 9])
    # 2: 9 + 2 + 2 of 14; 5: 9 + 5 is exact.
    assert {tuple(map(int, r)) for r in packing.best_fills(lengths, 14, np.array([2]))} == {(9, 2, 2)}
    assert {tuple(map(int, r)) for r in packing.best_fills(np.array([6]), 8, np.array([6]))} == {(6, 0, 0)}

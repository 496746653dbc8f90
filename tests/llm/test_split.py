import random

import pytest

from rankloom.llm import split

LONG = "First sentence here, quite short. " * 60


def rebuilt(text, spans):
    out, end = "", 0
    for a, b in spans:
        assert a <= end
        out += text[end:b]
        end = b
    return out


@pytest.mark.parametrize("text", [LONG, "x" * 5000, "负责仓库排班和路线规划。" * 80, "a|b_c|" * 300, ("word " * 30 + "\n\n") * 20, "é" * 900, "🔧‍👍🏽" * 400, " " * 700 + "end"])
def test_pieces(text):
    spans = split.split_text(text)
    assert rebuilt(text, spans) == text
    assert all(0 < b - a <= 400 for a, b in spans)
    assert all(y[0] == x[1] - 40 for x, y in zip(spans, spans[1:]))


def test_random_limits():
    rng = random.Random(5)
    for _ in range(200):
        limit = rng.randrange(20, 80)
        overlap = rng.randrange(0, limit // 4)
        text = "".join(rng.choice("ab .,\n") for _ in range(rng.randrange(600)))
        spans = split.split_text(text, limit, overlap)
        assert rebuilt(text, spans) == text and all(b - a <= limit for a, b in spans)


def test_natural_boundaries():
    spans = split.split_text(LONG)
    assert all(LONG[:b].endswith(". ") for _, b in spans[:-1])
    text = "We met approx. 27 people of the firm, e.g. Mr. Smith and others. " * 12
    assert all(not text[:b].rstrip().endswith(("approx.", "e.g.", "Mr.")) for _, b in split.split_text(text)[:-1])


def test_edges():
    assert split.split_text(None) == [] and split.split_text("") == [(0, 0)] and split.split_text("x" * 400) == [(0, 400)]
    with pytest.raises(ValueError):
        split.split_text("x", 100, 60)


def test_operator(spark):
    rows = [("a", 0, LONG, 1), ("a", 0, LONG, 2), ("b", 1, "  " + "y" * 400 + "  ", 1), ("c", 2, None, 1), (None, 3, "z" * 401, 1), ("d", 4, "", 1)]
    df = spark.createDataFrame(rows, "stem string, unit_idx int, text string, piece int")
    got = split.split_oversized(df, ["stem", "unit_idx"]).collect()
    assert {(r["stem"], r["unit_idx"]) for r in got} == {("a", 0), (None, 3)}
    assert sorted(r["piece_no"] for r in got if r["stem"] is None) == [0, 1]
    assert [r["piece"] for r in sorted((r for r in got if r["stem"] == "a"), key=lambda r: r["piece_no"])] == [LONG.strip(" ")[a:b] for a, b in split.split_text(LONG.strip(" "))]
    assert split.split_oversized(df.where("false"), ["stem", "unit_idx"]).count() == 0

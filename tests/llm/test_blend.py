from statistics import NormalDist

import pytest

from rankloom.llm import blend

W = {"a": 1.0, "b": 1.0}


def brute(rows, weights):
    groups = {}
    for g, item, metric, v in rows:
        if v is not None and v == v and metric in weights:
            groups.setdefault((g, metric), {}).setdefault(item, []).append(v)
    z = {}
    for (g, m), items in groups.items():
        best = {i: max(vs) for i, vs in items.items()}
        for i, v in best.items():
            p = (sum(x < v for x in best.values()) + sum(x == v for x in best.values()) / 2) / len(best)
            z.setdefault((g, i), []).append((weights[m], NormalDist().inv_cdf(p)))
    return {k: sum(w * x for w, x in v) / sum(w for w, _ in v) for k, v in z.items()}


def test_against_brute_force(spark):
    rows = [(g, f"s{i}", m, float((i * 7 + len(m)) % 5 * 10 ** (m == "b"))) for g in (1, 2) for i in range(12) for m in "ab"]
    rows += [(1, "s1", "a", 99.0), (1, "none", "a", None), (1, "nan", "b", float("nan")), (2, "one", "b", 1e9), (1, "s2", "zzz", 5.0), (None, "x", "a", 1.0)]
    df = spark.createDataFrame(rows, "g int, item string, metric string, value double")
    got = blend.blend(df, "g", "item", W).collect()
    want = brute(rows, W)
    for r in got:
        if (r["g"], r["item"]) in want:
            assert r["blended"] == pytest.approx(want[(r["g"], r["item"])], abs=1e-6)
        else:
            assert r["blended"] is None and r["n_scores"] == 0
    for g in (1, 2, None):
        order = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in order] == list(range(1, len(order) + 1))
        assert order == sorted(order, key=lambda r: (r["blended"] is None, -(r["blended"] or 0), r["item"]))


def test_range_and_outliers_dont_matter(spark):
    rows = [(1, f"s{i}", m, v) for i in range(5) for m, v in (("a", i * 1.0), ("b", [0.1, 0.2, 0.3, 0.4, 1e12][i]))]
    got = blend.blend(spark.createDataFrame(rows, "g int, item string, metric string, value double"), "g", "item", W)
    assert [r["item"] for r in got.orderBy("rank").collect()] == ["s4", "s3", "s2", "s1", "s0"]


def test_constant_scores_and_empty(spark):
    df = spark.createDataFrame([(1, "x", "a", 3.0), (1, "y", "a", 3.0)], "g int, item string, metric string, value double")
    assert [(r["item"], r["blended"]) for r in blend.blend(df, "g", "item", W).orderBy("rank").collect()] == [("x", 0.0), ("y", 0.0)]
    assert blend.blend(df.where("false"), "g", "item", W).count() == 0

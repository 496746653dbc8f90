"""Connected components of an edge table by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b <= a")
    # The least neighbour is found by a partial aggregate, so a node with very many neighbours isn't gathered.
    least = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).select("c", F.least("c", "m").alias("m"))
    joined = both.join(least, both["a"] == least["c"])
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its least node.

    Repeated edges, loops and both directions may occur; edges with a null end are left out; an empty table gives an empty one.
    Rounds are logarithmic in the longest path; each is cut by a checkpoint. Raises if ``most_rounds`` don't suffice.
    """
    clean = edges.select("a", "b").where("a is not null and b is not null")
    nodes = clean.select(F.col("a").alias("node")).union(clean.select("b")).distinct()
    now = cut(clean.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = mark(now)
    for _ in range(most_rounds):
        now = cut(_stars(_stars(now, True), False))
        new = mark(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError("the components didn't settle")
    labels = now.select(F.col("a").alias("n"), F.col("b").alias("component"))
    return nodes.join(labels, nodes["node"] == labels["n"], "left").select("node", F.coalesce("component", "node").alias("component"))

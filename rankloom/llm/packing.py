"""Problem 8: items into as few containers of a fixed capacity as possible.

Non-negative least squares on the histogram of lengths: all combinations of up to three lengths that fill a container
to within a small window are enumerated, for lengths in none of them also those that fill it best; repeat counts that reproduce the histogram are
solved for, once over all combinations and again over the few best ones of each length, rounded, and what is left of the histogram is
packed greedily (longest first into the fullest container it fits). A plan of the exact fills alone is made as well and the smaller of
the two is taken. Items far shorter than a third of the capacity fill none of these and are packed greedily. All of this works on
the histogram, whose size is bounded by the capacity, not by the corpus; the items are then matched to the planned
places by their number within their length, in one distributed join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.ranking import running_total
from rankloom.session import stored

CAPACITY = 2048
#: Combinations that leave up to so many places free are enumerated beside the exact fills.
WINDOW = 1
#: Steps of the first solution, over all combinations, and of the second, over the FEW best ones of each length.
STEPS, AGAIN, FEW = 60, 400, 3


def shallow_combinations(lengths: np.ndarray, capacity: int, window: int) -> np.ndarray:
    """Rows of three lengths (0: none), descending, whose sum lies in ``capacity - window .. capacity``.

    ``window`` 0 lists the exact fills only. At most (number of lengths)^2 / 4 * (window + 1) rows.
    """
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    lengths = np.sort(lengths)
    out = [np.array([[n, 0, 0]]) for n in lengths if n >= capacity - window]
    for slack in range(window + 1):
        goal = capacity - slack
        a = lengths[lengths < goal]
        b = goal - a
        two = (b <= a) & have[b]
        out.append(np.stack([a[two], b[two], np.zeros(two.sum(), int)], 1))
        x, y = np.meshgrid(lengths, lengths, indexing="ij")
        z = goal - x - y
        three = (y <= x) & (z <= y) & (z > 0)
        x, y, z = x[three], y[three], z[three]
        ok = have[z]
        out.append(np.stack([x[ok], y[ok], z[ok]], 1))
    return np.concatenate(out) if out else np.empty((0, 3), int)


def best_fills(lengths: np.ndarray, capacity: int, missing: np.ndarray) -> np.ndarray:
    """Rows as of ``shallow_combinations``: of each length in ``missing`` those that leave the least space."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    out = [np.empty((0, 3), int)]
    for goal in range(capacity, 0, -1):
        if not len(missing):
            break
        made = [np.array([[n, 0, 0] for n in missing if n == goal], int).reshape(-1, 3)]
        a = missing[missing < goal]
        a = a[have[goal - a]]
        made.append(np.stack([a, goal - a, np.zeros(len(a), int)], 1))
        if goal >= missing.min() + 2 * lengths.min():
            x, y = np.meshgrid(missing, lengths, indexing="ij")
            z = goal - x - y
            ok = (z > 0) & (z <= y) & have[np.maximum(z, 0)]
            made.append(np.stack([x[ok], y[ok], z[ok]], 1))
        rows = np.unique(-np.sort(-np.concatenate(made), axis=1), axis=0)
        out.append(rows)
        missing = np.setdiff1d(missing, rows)
    return np.concatenate(out)


def nonnegative_least_squares(combos: np.ndarray, counts: np.ndarray, steps: int = AGAIN) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted distance of the combinations' lengths from the histogram.

    Accelerated projected gradient on the sparse system (each column has at most three entries); lengths weigh by their
    share of the capacity, as a long item left over costs more. Deterministic.
    """
    if not len(combos):
        return np.zeros(0)
    n = len(counts)
    weight = np.sqrt(np.arange(n) / (n - 1))
    weight[0] = 0.0
    uses = np.bincount(combos.ravel(), minlength=n).astype(float)
    # Diagonal scaling: the step of a combination shrinks with how often its lengths are used.
    scale = 1.0 / np.maximum((weight[combos] ** 2 * uses[combos]).sum(1), 1e-12)
    goal = counts * weight
    x = np.zeros(len(combos))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        made = np.zeros(n)
        for k in range(3):
            made += np.bincount(combos[:, k], weights=y, minlength=n)
        gap = (made * weight - goal) * weight
        new = np.maximum(0.0, y - scale * gap[combos].sum(1))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def _rounded(combos: np.ndarray, x: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Whole repeat counts, the largest solutions first, none that the histogram can't supply."""
    r = np.zeros(len(combos), dtype=np.int64)
    for passes in (np.floor, np.ceil):
        for i in np.argsort(-(x - r), kind="stable"):
            want = int(passes(max(0.0, x[i] - r[i]) - (0.5 if passes is np.ceil else 0)))
            if want <= 0:
                continue
            parts, need = np.unique(combos[i][combos[i] > 0], return_counts=True)
            k = min(want, int((left[parts] // need).min()))
            if k > 0:
                r[i] += k
                left[parts] -= k * need
    return r


def _greedy(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs a histogram longest first into the fullest container; containers alike are kept as one entry with a count."""
    open_: list[dict[tuple[int, ...], int]] = [dict() for _ in range(capacity + 1)]  # by space left
    free = np.zeros(capacity + 1, dtype=bool)
    for n in range(capacity, 0, -1):
        todo = int(left[n])
        while todo:
            spots = np.flatnonzero(free[n:])
            if not len(spots):
                each = capacity // n
                full, rest = divmod(todo, each)
                for times, k in ((full, each), (1, rest)):
                    if times and k:
                        space = capacity - k * n
                        open_[space][(n,) * k] = open_[space].get((n,) * k, 0) + times
                        free[space] = True
                break
            space = n + int(spots[0])
            kind = next(iter(open_[space]))
            have = open_[space][kind]
            fits = space // n
            k = min(fits, todo)
            times = min(have, todo // k)
            if times == have:
                del open_[space][kind]
                free[space] = bool(open_[space])
            else:
                open_[space][kind] = have - times
            new, to = kind + (n,) * k, space - k * n
            open_[to][new] = open_[to].get(new, 0) + times
            free[to] = True
            todo -= times * k
    return [(kind, times) for by in open_ for kind, times in by.items()]


def plan(counts: np.ndarray, capacity: int = CAPACITY, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a container, number of such containers) for a histogram ``counts[length]``; every item has a place."""
    counts = np.asarray(counts, dtype=np.int64).copy()
    counts[0] = 0
    lengths = np.flatnonzero(counts)
    combos = shallow_combinations(lengths, capacity, window)
    missing = np.setdiff1d(lengths, combos)
    if len(missing):
        combos = np.concatenate([combos, best_fills(lengths, capacity, missing)])
    x = nonnegative_least_squares(combos, counts.astype(float), STEPS)
    exact = combos.sum(1) == capacity
    plans = [_packed(_fewer(combos[own], x[own], capacity), counts, capacity) for own in (exact, np.ones(len(combos), bool))]
    return min(plans, key=lambda p: sum(n for _, n in p))


def _fewer(combos: np.ndarray, x: np.ndarray, capacity: int) -> np.ndarray:
    """The combinations with the largest counts, FEW of each length: many small counts would all be rounded away."""
    used = np.zeros(capacity + 1, dtype=int)
    kept = []
    for i in np.argsort(-x, kind="stable")[: np.count_nonzero(x > 0)]:
        parts = combos[i][combos[i] > 0]
        if (used[parts] < FEW).any():
            kept.append(i)
            used[parts] += 1
    return combos[np.array(kept, dtype=int)]


def _packed(combos: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    left = counts.copy()
    x = nonnegative_least_squares(combos, left.astype(float))
    repeats = _rounded(combos, x, left)
    packed = [(tuple(int(v) for v in combos[i] if v), int(repeats[i])) for i in np.flatnonzero(repeats)]
    return packed + _greedy(left, capacity)


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """(``key``, piece_no int, size int, container bigint) for every item.

    An item larger than the capacity is split: full containers for its first pieces, and a last piece that is packed like
    other items; no other item is split. Items of size 0 and null sizes (taken as 0) go into container 0, which exists in any case.
    Repeated keys count as one item, with their largest size. An empty table gives an empty one. ``sizes`` is read once. Items are
    numbered by (length, partition), so no length is gathered into one task; only the histogram, one row a length, reaches the driver.
    """
    spark = sizes.sparkSession
    items = sizes.groupBy(key).agg(F.coalesce(F.max(size), F.lit(0)).cast("bigint").alias("__n"))
    full = F.greatest(F.floor((F.col("__n") - 1) / capacity), F.lit(0)).cast("int")
    # Written once with the partition each item is in: counts and numbers see the same ones.
    items = stored(items.withColumn("__full", full).withColumn("__part", F.spark_partition_id()))
    rest = items.select(key, F.col("__full").alias("piece_no"), (F.col("__n") - F.col("__full") * capacity).cast("int").alias("size"), "__part")
    by_part = rest.groupBy("size", "__part").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in by_part.groupBy("size").agg(F.sum("n")).collect():
        counts[s] = n
    places, at = [], {}
    base = 0
    for kind, times in plan(counts, capacity, window):
        for length in kind:
            start = at.get(length, 0)
            places.append((length, start, start + times, base - start))
            at[length] = start + times
        base += times
    if counts[0]:
        places.append((0, 0, int(counts[0]), None))
    base = max(base, 1 if counts[0] else 0)
    earlier = Window.partitionBy("size").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    own = Window.partitionBy("size", "__part").orderBy(key)
    numbered = rest.join(starts, ["size", "__part"]).withColumn("__i", F.row_number().over(own) - 1 + F.col("before"))
    # As many rows as there are lengths, with as many entries as the plan has places: bounded by the capacity, not by the items.
    per = pd.DataFrame(places, columns=["size", "from", "to", "shift"]).sort_values(["size", "from"])
    rows = [(int(s), [int(v) for v in g["from"]], [None if pd.isna(v) else int(v) for v in g["shift"]]) for s, g in per.groupby("size")]
    lookup = F.broadcast(spark.createDataFrame(rows, "size int, __starts array<bigint>, __shift array<bigint>"))
    placed = numbered.join(lookup, "size").withColumn("__k", F.expr("cast(size(filter(__starts, s -> s <= __i)) as int)"))
    container = F.when(F.col("size") == 0, F.lit(0).cast("bigint")).otherwise(F.element_at("__shift", F.col("__k")) + F.col("__i"))
    packed = placed.select(key, "piece_no", "size", container.alias("container"))
    heads = items.where("__full > 0")
    # Full pieces get containers of their own after the packed ones, numbered by the running count of their items.
    first = running_total(heads.select(key, "__full"), [], [F.col(key).asc()], F.col("__full").cast("bigint"), "__first")
    whole = first.select(key, F.posexplode(F.sequence(F.lit(1), F.col("__full"))).alias("piece_no", "__one"), "__first")
    whole = whole.select(key, "piece_no", F.lit(capacity).alias("size"), (F.col("__first") + F.col("piece_no") + base).alias("container"))
    return packed.unionByName(whole)

import hashlib
import math

import numpy as np
from fixtures import pairs

from spendlens.llm.clustering import Search, clusters
from spendlens.llm.storage import prepared

COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def plain(rows, k=16, turns=3, components=64, scale=64):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows
            if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(now))

    for _ in range(turns):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        now = [tuple(sum(x) // len(groups[n]) for x in zip(*groups[n])) if n in groups else c for n, c in enumerate(now)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = {n: sum(d for _, c, d in found if c == n) for n in range(len(now))}

    def fits(x):
        return x if x < 2**63 else None

    return sorted(((i, c, fits(d), fits(total[c]), fits(sum(total.values())), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest())
                   for i, c, d in found), key=repr)


def table(spark, rows, kind="double"):
    return prepared(spark).createDataFrame(
        [(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0.0) for i, v in rows],
        f"vec_id long, embedding array<{kind}>, cluster int, v double").repartition(3)


def check(spark, rows, kind="double", **options):
    assert pairs(clusters(table(spark, rows, kind), **options), *COLUMNS) == plain(rows, **options)


def test_equals_plain_lloyd(spark):
    rng = np.random.default_rng(1)
    spots = rng.normal(size=(9, 64))
    check(spark, [(n, np.float32(spots[n % 9] + rng.normal(size=64) * 0.3).tolist()) for n in range(300)], "float")
    check(spark, [(n, rng.normal(size=5).tolist()) for n in range(400)], components=5, k=7, turns=6)
    check(spark, [(n, [x]) for n, x in enumerate(rng.normal(size=200) * 3)], components=1, k=5, turns=4, scale=2)


def test_ties_copies_and_empty_clusters(spark):
    # whole coordinates: many equal distances, equal first centroids and clusters without a vector
    rng = np.random.default_rng(2)
    check(spark, [(n, rng.integers(-1, 2, 2).tolist()) for n in range(150)], components=2, k=12, turns=5, scale=1)
    check(spark, [(n % 5, [1.0, 2.0]) for n in range(40)], components=2, k=4)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(900, None), (901, []), (902, [1.0] * 3), (903, [None, 1.0]), (904, [nan, 0.0]), (905, [inf, 0.0]), (906, [-inf, 0.0])]
    rows = [(None, [0.5, -0.5]), (None, [3.0, 1.0]), (-7, [-0.0, 0.01]), (7, [-0.001, 1e-300]), (7, [2.0, 2.0])]
    check(spark, rows + bad, components=2)
    check(spark, rows + bad, components=2, k=1)
    check(spark, rows[:1], components=2)
    assert clusters(table(spark, [])).count() == 0 and clusters(table(spark, bad), components=2).columns == list(COLUMNS)
    assert clusters(table(spark, bad), components=2).count() == 0


def test_large_components_are_exact(spark):
    big = [(n, [x * 10.0**e, 1.0]) for n, (x, e) in enumerate([(1, 6), (-1, 7), (3, 9), (2, 12), (1, 0), (5, 17), (-2, 20), (0, 0)])]
    check(spark, big, components=2, k=3)
    check(spark, [(n, [float(1 << 21) * (-1) ** n] * 64) for n in range(4)], k=2)
    # beyond 2^100 after scaling: like a number that is not finite
    got = clusters(table(spark, [(1, [1e300, 0.0]), (2, [0.0, 0.0])]), components=2)
    assert [r.vec_id for r in got.collect()] == [2]


def test_bounds_spare_comparisons():
    rng = np.random.default_rng(4)
    spots = rng.integers(-1000, 1000, (16, 8))
    rows = (spots[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8))).astype(np.int64)
    before = [tuple(map(int, s)) for s in spots]
    now = [tuple(int(x) + 3 for x in s) for s in before]
    first = Search(before, None)
    state = first.first(rows)
    again = Search(now, before)
    near, *_ = again.again(rows, *state)
    exact = np.argmin(((rows[:, None, :] - np.array(now)[None]) ** 2).sum(axis=2), axis=1)
    assert (near == exact).all()
    # the first search begins anywhere
    assert first.compared <= 16 * len(rows) and again.compared < 0.2 * 16 * len(rows)

import numpy as np

from spendlens.llm import neighbours
from spendlens.llm.neighbours import balanced_parts, nearest_neighbours, neighbour_graph
from spendlens.llm.storage import prepared


def table(spark, rows):
    return prepared(spark).createDataFrame(
        [(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0.0) for i, v in rows],
        "vec_id long, embedding array<float>, part int, score double").repartition(3)


def brute(rows, every, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            near = [(-float((a * b).sum() / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum()))), i) for i, b in good if i != q]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def found(result):
    out = {}
    for r in result.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_edge_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(n, rng.normal(size=8).tolist()) for n in range(120)]
    rows += [(500 + n, [1, 2, 3, 4, 5, 6, 7, 8]) for n in range(30)]
    bad = [(1000, None), (1001, [0] * 8), (1002, [1, None] * 4), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (None, [1] * 8), (1010, [])]
    got = found(nearest_neighbours(table(spark, rows + bad), every=10, k=5))
    expected = brute(rows + bad, 10, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in expected.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in got for a, b in zip(got[q], expected[q]))


def test_fewer_candidates_than_wanted_and_none(spark):
    assert {q: len(v) for q, v in found(nearest_neighbours(table(spark, [(0, [1, 0]), (1, [1, 1]), (50, [0, 1])]))).items()} == {0: 2, 50: 2}
    assert nearest_neighbours(table(spark, [(0, [1, 0])])).count() == 0
    assert nearest_neighbours(table(spark, [])).count() == 0


def test_learned_parts_keep_the_recall_with_few_parts(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(n, (centres[n % 40] + rng.normal(size=16)).tolist()) for n in range(4000)]
    got, expected = found(nearest_neighbours(table(spark, rows), part_rows=250, every=40)), brute(rows, 40, 5)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 5 * len(expected)


def test_parts_have_parts_where_one_router_has_too_few(spark, monkeypatch):
    """4 parts a router, 16 in all; a third of the rows are copies, some with one id."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 16)) * 3
    rows = [(n, (centres[n % 16] + rng.normal(size=16)).tolist()) for n in range(3000)]
    rows += [(n if n < 6000 else 6000, [1] * 16) for n in range(5001, 6501)]
    trees, asked = [], []
    routes = neighbours._routes
    monkeypatch.setattr(
        neighbours, "_routes", lambda rows, some, tree, *a: trees.append(tree) or asked.append(routes(rows, some, tree, *a)) or asked[-1])
    got = found(nearest_neighbours(table(spark, rows), part_rows=100, most_parts=4, every=40))
    expected = brute(rows, 40, 5)
    hits = sum(len({s for _, s in got[q]} & {s for _, s in expected[q]}) for q in expected if q < 3000)
    assert hits >= 0.9 * sum(len({s for _, s in expected[q]}) for q in expected if q < 3000)
    assert got.keys() == expected.keys() and all(len(v) == 5 for v in got.values())
    (tree,) = trees
    assert isinstance(tree, neighbours._Tree) and 8 <= tree.parts <= 16 and asked[0] < tree.parts


def test_tree_ranks_by_both_routers():
    rng = np.random.default_rng(8)
    unit = rng.normal(size=(600, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    top, parts = neighbours.learn_router(unit, 3)
    below = [neighbours.learn_router(unit[top.own(unit) == n], 2) for n in range(parts)]
    tree = neighbours._Tree(top, [*below[:-1], (neighbours._OnePart(), 1)])
    ranked, own = tree.ranked(unit), tree.own(unit)
    assert ranked.shape == (600, tree.parts) and (np.sort(ranked, axis=1) == np.arange(tree.parts)).all()
    assert set(own) <= set(range(tree.parts)) and (ranked[:, 0] == own).mean() > 0.7
    upper = np.searchsorted(tree.first, own, side="right") - 1
    assert (upper == top.own(unit)).all()


def test_recall_is_measured_on_rows_kept_out(spark, monkeypatch):
    rng = np.random.default_rng(5)
    seen = []
    learn, routes = neighbours.learn_router, neighbours._routes
    monkeypatch.setattr(neighbours, "learn_router", lambda sample, *a: seen.append(sample) or learn(sample, *a))
    monkeypatch.setattr(neighbours, "_routes", lambda rows, asked, *a: seen.append(asked) or routes(rows, asked, *a))
    rows = [(n, rng.normal(size=8).tolist()) for n in range(600)] + [(1000 + n, [1] * 8) for n in range(200)]
    nearest_neighbours(table(spark, rows), part_rows=200, measured=100)
    fit, asked = ({v.tobytes() for v in x} for x in seen)
    assert len(asked) > 50 and not fit & asked


def test_each_length_is_searched(spark):
    rng = np.random.default_rng(6)
    groups = {8: range(300), 5: range(300, 400), 3: range(400, 402), 2: range(410, 411)}
    rows = {d: [(n, rng.normal(size=d).tolist()) for n in ids] for d, ids in groups.items()}
    got = found(nearest_neighbours(table(spark, sum(rows.values(), [])), every=10, part_rows=40, recall=1.0))
    expected = {q: v for some in rows.values() for q, v in brute(some, 10, 5).items()}
    assert got.keys() == {q for q, v in expected.items() if v}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in got)
    assert hits >= 0.9 * sum(len(v) for v in expected.values())


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 4
    unit = np.concatenate([c + rng.normal(size=(100, 16)) for c in centres])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph = neighbour_graph(unit, 10)
    part = balanced_parts(unit, graph, 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1.05 * 100)
    assert (part[graph] == part[:, None]).mean() > 0.8


def test_tiny_and_huge_vectors(spark):
    rows = [(0, [1e-200, 2e-200]), (50, [1e200, 1e200]), (1, [1.0, 2.0]), (2, [5e-324, 0.0]), (3, [1.7e308, -1.7e308]), (4, [3e-160, 1e160])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nearest_neighbours(data, k=5))
    assert [i for i, _ in got[0]] == [1, 50, 4, 2, 3] and [i for i, _ in got[50]] == [0, 1, 2, 4, 3]
    assert abs(got[0][0][1] - 1) < 1e-12 and abs(got[50][0][1] - 0.9486832980505138) < 1e-12 and abs(got[50][4][1]) < 1e-12


def test_rows_that_share_a_query_id_are_one_query(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.2, 1.0]), (2, [1.0, 0.1])]
    assert [i for i, _ in found(nearest_neighbours(table(spark, rows)))[0]] == [1, 2]

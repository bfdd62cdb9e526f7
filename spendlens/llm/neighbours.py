"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into parts of equal size with few edges between them. A small classifier learns
which parts a vector's neighbours lie in. Every row goes to its most probable part; a query is routed to its several most
probable ones and compared there exactly. How many parts a query needs for the wanted recall is measured against brute force
on a bounded number of vectors that the classifier has not learned from.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

BLOCK_ROWS = 4096
_LEARNED_ROWS = 32  # sample rows that a part is learned from, at least


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows by powers of two, so that the largest component of each is near 1: no square is lost or infinite, no cosine changes."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1][:, None]) if len(rows) else rows


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows, in double precision, scaled."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _scaled(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row."""
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    out = np.empty((len(unit), min(k, len(unit) - 1)), np.int64)
    for start in range(0, len(unit), 1024):
        scores = unit[start : start + 1024] @ unit.T
        scores[np.arange(len(scores)), np.arange(start, start + len(scores))] = -2
        out[start : start + 1024] = _top(scores, out.shape[1])
    return out


def balanced_parts(unit: np.ndarray, graph: np.ndarray, parts: int, turns: int = 12) -> np.ndarray:
    """Parts of at most 5 % over equal size, with few graph edges between them.

    Rows first go to centres, nearest first as long as there is room; then rows move to the part that holds most of their
    neighbours, largest gain first and only where there is room.
    """
    rng = np.random.Generator(np.random.Philox(key=7))
    room = ceil(1.05 * len(unit) / parts)
    centres = unit[rng.choice(len(unit), parts, replace=False)]
    part = np.zeros(len(unit), np.int64)
    for _ in range(5):
        near = unit @ centres.T
        sizes = np.zeros(parts, np.int64)
        for row in np.argsort(-near.max(axis=1), kind="stable"):
            for p in np.argsort(-near[row], kind="stable"):
                if sizes[p] < room:
                    part[row] = p
                    sizes[p] += 1
                    break
        centres = np.stack([unit[part == p].mean(axis=0) if sizes[p] else centres[p] for p in range(parts)])
    rows = np.arange(len(unit))
    back = [np.zeros(0, np.int64)] * len(unit)
    order = np.argsort(graph, axis=None, kind="stable")
    ends, starts = graph.reshape(-1)[order], np.repeat(rows, graph.shape[1])[order]
    cuts = np.searchsorted(ends, np.arange(len(unit) + 1))
    back = [starts[cuts[i] : cuts[i + 1]] for i in rows]
    for _ in range(turns):
        moved = 0
        counts = np.zeros((len(unit), parts), np.int64)
        np.add.at(counts, (np.repeat(rows, graph.shape[1]), part[graph].reshape(-1)), 1)
        np.add.at(counts, (graph.reshape(-1), np.repeat(part, graph.shape[1])), 1)
        gain = counts.max(axis=1) - counts[rows, part]
        sizes = np.bincount(part, minlength=parts)
        for row in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            around = np.bincount(np.concatenate((part[graph[row]], part[back[row]])), minlength=parts)
            best = int(around.argmax())
            if around[best] > around[part[row]] and sizes[best] < room:
                sizes[part[row]] -= 1
                sizes[best] += 1
                part[row] = best
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A classifier with one hidden layer: probabilities of the parts for a vector."""

    def __init__(self, unit: np.ndarray, targets: np.ndarray, hidden: int = 128, epochs: int = 40, batch: int = 256):
        rng = np.random.Generator(np.random.Philox(key=11))
        sizes = (unit.shape[1], hidden, targets.shape[1])
        self.weights = [rng.normal(0, (2 / a) ** 0.5, (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.terms = [np.zeros(b) for b in sizes[1:]]
        scale = unit.shape[1] ** 0.5
        self.scale = scale
        values = [*self.weights, *self.terms]
        first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        for epoch in range(epochs):
            order = rng.permutation(len(unit))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                x = unit[some] * scale
                inner = np.maximum(x @ self.weights[0] + self.terms[0], 0)
                error = (self._softmax(inner @ self.weights[1] + self.terms[1]) - targets[some]) / len(some)
                below = (error @ self.weights[1].T) * (inner > 0)
                step += 1
                rate = 0.003 * (1 - epoch / epochs)
                for v, g, m, s in zip(values, (x.T @ below, inner.T @ error, below.sum(0), error.sum(0)), first, second):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def _outer(self, unit: np.ndarray) -> np.ndarray:
        inner = np.maximum(unit * self.scale @ self.weights[0] + self.terms[0], 0)
        return inner @ self.weights[1] + self.terms[1]

    def ranked(self, unit: np.ndarray) -> np.ndarray:
        """Parts of each vector, most probable first."""
        return np.argsort(-self._outer(unit), axis=1, kind="stable")

    def own(self, unit: np.ndarray) -> np.ndarray:
        """The part that each vector goes to."""
        return self.ranked(unit)[:, 0]

    def logs(self, unit: np.ndarray) -> np.ndarray:
        """Logarithms of the parts' probabilities."""
        return np.log(np.maximum(self._softmax(self._outer(unit)), 1e-30))


class _OnePart:
    def ranked(self, unit: np.ndarray) -> np.ndarray:
        return np.zeros((len(unit), 1), np.int64)

    def own(self, unit: np.ndarray) -> np.ndarray:
        return np.zeros(len(unit), np.int64)

    def logs(self, unit: np.ndarray) -> np.ndarray:
        return np.zeros((len(unit), 1))


class _Tree:
    """Parts of parts: a router for the parts and one for each part's own parts, numbered one after the other."""

    def __init__(self, top, below: list):
        self.top, self.routers = top, [router for router, _ in below]
        self.first = np.cumsum([0, *(parts for _, parts in below)])
        self.parts = int(self.first[-1])

    def ranked(self, unit: np.ndarray) -> np.ndarray:
        out = np.empty((len(unit), self.parts), np.int32)
        for at in range(0, len(unit), 64):  # there may be many parts
            some = unit[at : at + 64]
            logs = self.top.logs(some)
            every = [logs[:, [n]] + router.logs(some) for n, router in enumerate(self.routers)]
            out[at : at + 64] = np.argsort(-np.concatenate(every, axis=1), axis=1, kind="stable")
        return out

    def own(self, unit: np.ndarray) -> np.ndarray:
        upper = self.top.own(unit)
        out = np.empty(len(unit), np.int64)
        for n in np.unique(upper):
            out[upper == n] = self.first[n] + self.routers[n].own(unit[upper == n])
        return out


def learn_router(sample: np.ndarray, parts: int, k: int = 10):
    """Router of `parts` parts, learned from distinct sample vectors."""
    unit = np.unique(_unit(sample), axis=0) if len(sample) else sample
    parts = min(parts, len(unit) // _LEARNED_ROWS)
    if parts < 2:
        return _OnePart(), 1
    graph = neighbour_graph(unit, k)
    part = balanced_parts(unit, graph, parts)
    targets = np.zeros((len(unit), parts))
    np.add.at(targets, (np.repeat(np.arange(len(unit)), graph.shape[1]), part[graph].reshape(-1)), 1)
    targets[np.arange(len(unit)), part] += 1
    return Router(unit, targets / targets.sum(axis=1, keepdims=True)), parts


def _learn_tree(rows: DataFrame, sample: np.ndarray, above: int, wanted: int, sample_rows: int):
    """A tree of about `wanted` parts. The upper router is learned from the sample, each lower one in a task of its own from about
    `sample_rows` different rows of its part, drawn by a hash out of those whose hash is `above` that of the rows kept out."""
    top, parts = learn_router(sample, ceil(wanted**0.5))
    table = rows.sparkSession.sparkContext.broadcast(top)

    @F.arrow_udf("int")
    def part_of(v: pa.Array) -> pa.Array:
        return pa.array(table.value.own(_unit(_matrix(v))), pa.int32())

    placed = rows.select("v", F.xxhash64("vec_id", "v").alias("h")).where(F.col("h") > above).withColumn("part", part_of("v"))
    counts = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}
    steps = 1 << 30
    share = F.array(*(F.lit(min(steps, steps * sample_rows // max(1, counts.get(n, 0)))) for n in range(parts)))
    picked = placed.where(F.pmod("h", F.lit(steps)) < F.get(share, F.col("part"))).dropDuplicates(["h"])

    def learn(some: pa.Table) -> pa.Table:
        router, count = learn_router(_matrix(some["v"].combine_chunks()), ceil(wanted / parts))
        return pa.table({
            "part": pa.array([some["part"][0].as_py()], pa.int32()), "router": pa.array([pickle.dumps(router)], pa.binary()),
            "parts": pa.array([count], pa.int32()),
        })

    learned = picked.select("part", "v").groupBy("part").applyInArrow(learn, "part int, router binary, parts int").collect()
    below = {r.part: (pickle.loads(r.router), r.parts) for r in learned}
    tree = _Tree(top, [below.get(n, (_OnePart(), 1)) for n in range(parts)])
    return tree, tree.parts


def _nearest(queries: np.ndarray, query_ids: list, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple]:
    """(query_id, vec_id, score) of each query's k nearest rows other than itself; ties go to the smaller id."""
    row_norms = np.sqrt((rows * rows).sum(axis=1))
    unit = rows / row_norms[:, None]
    for start in range(0, len(queries), 512):
        some, names = queries[start : start + 512], query_ids[start : start + 512]
        scores = _unit(some) @ unit.T
        scores[np.array(names)[:, None] == ids[None, :]] = -np.inf
        bound = np.partition(scores, max(0, scores.shape[1] - k), axis=1)[:, max(0, scores.shape[1] - k)]
        for at, name in enumerate(names):
            near = np.flatnonzero((scores[at] >= bound[at] - 1e-9) & np.isfinite(scores[at]))
            # summed in the same order for every pair, so that equal vectors have equal scores
            query = some[at]
            exact = (rows[near] * query).sum(axis=1) / (row_norms[near] * np.sqrt((query * query).sum()))
            for i in np.lexsort((ids[near], -exact))[:k]:
                yield name, int(ids[near[i]]), float(exact[i])


_RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([], [], []), _RESULT)]


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: with an id, and a vector of finite numbers that aren't all zero."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0").where(~bad & F.exists("v", lambda x: x != 0))


def _held_out(sample: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `count` rows, without those that repeat one of the others, and the others."""
    others = {v.tobytes() for v in sample[count:]}
    return sample[[i for i in range(count) if sample[i].tobytes() not in others]], sample[count:]


def nearest_neighbours(
    vectors: DataFrame, every: int = 50, k: int = 5, recall: float = 0.95, part_rows: int = 2000, most_parts: int = 256,
    sample_rows: int = 8192, measured: int = 256, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by `every`.

    Nearness is the cosine in double precision, computed on the original vectors; ties go to the smaller id. Every usable row
    is indexed (see usable()); a query is compared with the rows of its own length. Rows that share an id are one
    query, with the smallest of their vectors, and no candidates of it. With fewer candidates, all are returned; an empty table gives an empty result. Other
    columns aren't read.

    Each length has its own router, learned from `sample_rows` rows at most, into a part for every `part_rows` rows or, if that
    gives more, half the square root of the number of rows, and no more than a 32nd of the sample. Where that is more than
    `most_parts`, parts have parts of their own, learned from as many rows of theirs: up to the square of `most_parts`. A
    length with fewer than 64 rows to learn from is one part, which is searched whole. A query goes to as
    many parts as `measured` other rows, kept out of what is learned from, need for the given recall against brute force. Parts
    are compared in blocks of about 4,096 rows and queries, so a part that holds many copies is spread over tasks.
    """
    rows = usable(vectors, vec_id, embedding)
    learned = {}
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    for width, total in lengths.where(F.col("n") >= 2 * _LEARNED_ROWS).orderBy("d").collect():
        same = rows.where(F.size("v") == width)
        picked = same.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(sample_rows + measured).collect()
        sample = _scaled(np.array([r.v for r in picked], np.float64).reshape(-1, width))
        apart = min(measured, len(sample) // 4)
        asked, sample = _held_out(sample, apart)
        wanted = max(total // part_rows, isqrt(total) // 2)
        if wanted <= most_parts:
            router, parts = learn_router(sample, wanted)
        else:
            router, parts = _learn_tree(same, sample, picked[apart - 1].h, min(wanted, most_parts**2), sample_rows)
        learned[width] = router, _routes(same, asked, router, parts, k, recall)
    table = rows.sparkSession.sparkContext.broadcast(learned)

    def routed(v: pa.Array, own: bool) -> list[np.ndarray]:
        """Of each vector, its own part, or the parts of its length that it is looked for in, most probable first."""
        out: list[np.ndarray] = [np.zeros(1, np.int32)] * len(v)
        sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False)
        for width in np.unique(sizes):
            if int(width) in table.value:
                router, routes = table.value[int(width)]
                at = np.flatnonzero(sizes == width)
                unit = _unit(_matrix(v.take(pa.array(at))))
                found = router.own(unit)[:, None] if own else router.ranked(unit)[:, :routes]
                for i, parts in zip(at, found.astype(np.int32)):
                    out[i] = parts
        return out

    @F.arrow_udf("int")
    def part_of(v: pa.Array) -> pa.Array:
        return pa.array([found[0] for found in routed(v, True)], pa.int32())

    @F.arrow_udf("array<int>")
    def parts_of(v: pa.Array) -> pa.Array:
        return pa.array(routed(v, False), pa.list_(pa.int32()))

    width = F.size("v").alias("width")
    indexed = written(rows.select("vec_id", "v", width, part_of("v").alias("part")), "vector-parts")
    queries = indexed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked_in = written(queries.select("vec_id", "v", width, F.explode(parts_of("v")).alias("part")), "routed-queries")

    def blocks(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy("width", "part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))

    # a row for each part: small as a rule, and then broadcast, as its size is known once it is written
    grid = written(blocks(indexed, "row_blocks").join(blocks(asked_in, "query_blocks"), ["width", "part"]).coalesce(1), "part-blocks")
    own = F.xxhash64("vec_id")
    left = indexed.join(grid, ["width", "part"]).select(
        "width", "part", F.pmod(own, "row_blocks").cast("int").alias("r"), F.explode(F.expr("sequence(0, query_blocks - 1)")).alias("q"), "vec_id", "v")
    right = asked_in.join(grid, ["width", "part"]).select(
        "width", "part", F.explode(F.expr("sequence(0, row_blocks - 1)")).alias("r"), F.pmod(own, "query_blocks").cast("int").alias("q"), "vec_id", "v")

    def compare(some: pa.Table, asked: pa.Table) -> pa.Table:
        if not some.num_rows or not asked.num_rows:
            return pa.Table.from_arrays(_columns([]), schema=_RESULT)
        found = _nearest(
            _matrix(asked["v"].combine_chunks()), asked["vec_id"].to_pylist(), _matrix(some["v"].combine_chunks()),
            some["vec_id"].to_numpy(), k)
        return pa.Table.from_arrays(_columns(list(found)), schema=_RESULT)

    near = left.groupBy("width", "part", "r", "q").cogroup(right.groupBy("width", "part", "r", "q")).applyInArrow(
        compare, "query_id long, vec_id long, score double")
    return _best(near, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _routes(rows: DataFrame, queries: np.ndarray, router, parts: int, k: int, recall: float) -> int:
    """How many parts a query needs, so that so large a share of the true neighbours of some queries lies in them."""
    if parts < 2 or not len(queries):
        return parts
    table = rows.sparkSession.sparkContext.broadcast((queries, router))
    schema = pa.schema([("query_id", pa.int64()), ("score", pa.float64()), ("place", pa.int32())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, own = table.value
        ranks = np.argsort(own.ranked(_unit(asked)), axis=1).astype(np.int32)  # place of each part in a query's ranking
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            unit = _unit(_matrix(batch.column(0)))
            if not len(unit):
                continue
            scores = _unit(asked) @ unit.T
            scores[scores > 1 - 1e-12] = -2  # itself and copies, which share its part anyway
            at = _top(scores, k)
            kept.append((np.take_along_axis(scores, at, 1), np.take_along_axis(ranks, own.own(unit)[at], 1)))
            if len(kept) > 1:
                scores, places = (np.concatenate(x, axis=1) for x in zip(*kept))
                at = _top(scores, k)
                kept = [(np.take_along_axis(scores, at, 1), np.take_along_axis(places, at, 1))]
        for scores, places in kept:
            names = np.repeat(np.arange(len(asked)), scores.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names, scores.reshape(-1), places.reshape(-1))], schema=schema)

    found = rows.select("v").mapInArrow(compare, "query_id long, score double, place int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "place")
    best = found.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("score") > -2))
    places = sorted(r.place for r in best.select("place").collect())
    return 1 + places[min(len(places) - 1, ceil(recall * len(places)) - 1)] if places else parts

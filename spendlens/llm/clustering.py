"""Centroid clustering of integer vectors by the shallot search.

Lloyd's turns (assign, then move the centroids), made cheaper by what a vector remembers from one turn to the next: its centroid
and an upper bound of the distance to it, the second-nearest centroid and a lower bound of the distance to all others. If the
bounds still tell the nearest centroid, nothing is computed. Otherwise the search begins at the closer of the two remembered
centroids and goes through that one's neighbours, nearest first. A centroid that is farther from the start than the vector is
from the start and from the second-best found together can't be among the two nearest, nor can any later neighbour; so the ball
in which centroids are looked at shrinks with every better one. Who wins is told in integers; bounds only spare comparisons, and
are widened by more than what rounding may take off them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

LARGEST = float(1 << 100)
_BLOCK = 8192
_WIDER, _NARROWER = 1 + 1e-9, 1 - 1e-9

Centroids = list[tuple[int, ...]]


def small(components: int) -> int:
    """Components up to this size have squared distances that fit 64 bits."""
    return math.isqrt((1 << 62) // components) // 2


def squared(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to a centroid (or to a row of centroids each)."""
    rest = rows - centroid
    return (rest * rest).sum(axis=1)


class Search:
    """Assignment of rows to the nearest of a turn's centroids (ties: smaller number).

    `before` are the centroids of the turn that the rows' bounds are from, None in the first turn.
    """

    def __init__(self, centroids: Centroids, before: Centroids | None):
        self.limit = small(len(centroids[0]))
        self.small = all(abs(x) <= self.limit for c in centroids for x in c)
        self.exact = np.array(centroids, np.int64 if self.small else object)
        places = np.array(centroids, np.float64)
        k = len(centroids)
        rest = places[:, None, :] - places[None, :, :]
        self.between = np.sqrt((rest * rest).sum(axis=2))
        self.order = np.argsort(self.between, axis=1, kind="stable")
        apart = self.between + np.diag(np.full(k, np.inf))
        self.half = apart.min(axis=1) / 2 * _NARROWER
        self.moved = np.zeros(k)
        if before is not None:
            rest = places - np.array(before, np.float64)
            self.moved = np.sqrt((rest * rest).sum(axis=1)) * _WIDER
        farthest = np.argsort(-self.moved, kind="stable")
        # the largest move among the other centroids
        self.others = np.full(k, self.moved[farthest[0]])
        self.others[farthest[0]] = self.moved[farthest[1]] if k > 1 else 0.0
        self.compared = 0

    def first(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest centroid, second-nearest and both bounds, without anything known."""
        k = len(self.exact)
        near, second = np.zeros(len(rows), np.int64), np.full(len(rows), min(1, k - 1), np.int64)
        upper, lower = np.full(len(rows), np.inf), np.zeros(len(rows))
        return self._searched(rows, np.arange(len(rows)), near, second, upper, lower)

    def again(
        self, rows: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray
    ) -> tuple[np.ndarray, ...]:
        """The same from what the turn before left."""
        upper = upper * _WIDER + self.moved[near]
        lower = np.maximum(0.0, lower * _NARROWER - self.others[near])
        enough = np.maximum(lower, self.half[near])
        open_ = np.flatnonzero(upper * _WIDER >= enough)
        if len(open_):  # with the bound made exact, many are told already
            upper[open_] = np.sqrt(self._distances(rows[open_], near[open_]).astype(np.float64)) * _WIDER
            open_ = open_[upper[open_] * _WIDER >= enough[open_]]
        return self._searched(rows, open_, near, second, upper, lower)

    def _distances(self, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        self.compared += len(rows)
        return squared(rows, self.exact[which])

    def _searched(self, rows, open_, near, second, upper, lower) -> tuple[np.ndarray, ...]:
        near, second, upper, lower = near.copy(), second.copy(), upper.copy(), lower.copy()
        k = len(self.exact)
        if k == 1:
            upper[open_] = np.sqrt(self._distances(rows[open_], near[open_]).astype(np.float64)) * _WIDER
            lower[open_] = np.inf
            return near, second, upper, lower
        one, other = near[open_], second[open_]
        far, close = self._distances(rows[open_], other), self._distances(rows[open_], one)
        swap = (far < close) | ((far == close) & (other < one))
        one, other = np.where(swap, other, one), np.where(swap, one, other)
        close, far = np.where(swap, far, close), np.where(swap, close, far)
        for start in np.unique(one):
            mine = np.flatnonzero(one == start)
            some = rows[open_[mine]]
            best, best_d = np.full(len(mine), start), close[mine]
            next_, next_d = other[mine].copy(), far[mine]
            from_start = np.sqrt(best_d.astype(np.float64))
            left = np.arange(len(mine))
            for c in self.order[start]:
                # neighbours come nearest first and the ball only shrinks: who is out stays out
                ball = (from_start[left] + np.sqrt(next_d[left].astype(np.float64))) * _WIDER
                left = left[self.between[start, c] * _NARROWER <= ball]
                if not len(left):
                    break
                if c == start:
                    continue
                asked = left[next_[left] != c]
                d = self._distances(some[asked], np.full(len(asked), c))
                wins = (d < best_d[asked]) | ((d == best_d[asked]) & (c < best[asked]))
                follows = ~wins & (d < next_d[asked])
                w, f = asked[wins], asked[follows]
                next_[w], next_d[w] = best[w], best_d[w]
                best[w], best_d[w] = c, d[wins]
                next_[f], next_d[f] = c, d[follows]
            at = open_[mine]
            near[at], second[at] = best, next_
            upper[at] = np.sqrt(best_d.astype(np.float64)) * _WIDER
            lower[at] = np.sqrt(next_d.astype(np.float64)) * _NARROWER
        return near, second, upper, lower


_STATE = "vec_id long, v array<double>, cluster int, second int, upper double, lower double, distance decimal(38,0)"
_NAMES = ["vec_id", "v", "cluster", "second", "upper", "lower", "distance"]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= _BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _integers(v: np.ndarray) -> np.ndarray:
    """Integer-valued doubles as Python's own integers."""
    return np.array([[int(x) for x in row] for row in v], object).reshape(v.shape)


def _assigned(search: Search, known: bool, last: bool, table: pa.Table) -> pa.RecordBatch:
    v = table["v"].combine_chunks()
    flat = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    state = [table[c].to_numpy() for c in ("cluster", "second", "upper", "lower")] if known else []
    out = [np.zeros(len(v), t) for t in (np.int64, np.int64, float, float)]
    distance: list = [None] * len(v)
    large = np.abs(flat).max(axis=1) > search.limit if search.small else np.ones(len(v), bool)
    for rows, exact in ((np.flatnonzero(~large), np.int64), (np.flatnonzero(large), object)):
        if not len(rows):
            continue
        own = flat[rows].astype(np.int64) if exact is np.int64 else _integers(flat[rows])
        found = search.again(own, *[s[rows] for s in state]) if known else search.first(own)
        for column, values in zip(out, found):
            column[rows] = values
        if last:
            for i, d in zip(rows, squared(own, search.exact[found[0]]).tolist()):
                distance[i] = d if d < 10**38 else None
    types = (pa.int32(), pa.int32(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([
        table["vec_id"].combine_chunks(), v, *[pa.array(c).cast(t) for c, t in zip(out, types)],
        pa.array(distance, pa.decimal128(38, 0)),
    ], names=_NAMES)


def usable(vectors: DataFrame, components: int, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the rows with so many components, all of them finite; v is floor(scale * x), exact in doubles."""
    v = F.col(embedding).cast("array<double>")
    whole = F.transform(v, lambda x: _floored(x * scale))
    rows = vectors.where(F.size(embedding) == components).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)))


def _floored(x: Column) -> Column:
    """Largest whole number up to x, as a double: floor() itself gives 64 bits. From 2^52 on, every double is whole."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def clusters(
    vectors: DataFrame, k: int = 16, turns: int = 3, components: int = 64, scale: int = 64, seed: str = "1", vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Vectors with exactly `components` components take part, none of them null or non-finite; their components become
    floor(scale * x). The first centroids are the `k` vectors with the smallest hex SHA-256 of `<seed>:<vec_id>`. In each turn
    every vector goes to the nearest centroid (squared Euclidean distance, ties to the smaller number), then centroids become
    floor(sum / count) of their vectors, component by component; one without vectors stays. In the end vectors are assigned once
    more. `distance` is squared, the inertias sum it over the cluster and over all, `second` is the runner-up as remembered.

    All of that is exact. Fewer vectors than `k` give as many centroids; vectors whose ids have the same hash begin in the order
    of their components. Null ids are hashed as an empty text. Rows that repeat another give a row each. Components of 2^100 and
    more, after scaling, count as non-finite; a distance or sum that 64 bits don't hold is null. Other columns aren't read; an
    empty table gives an empty result. The driver holds `k` centroids and sums, tasks a block of vectors.
    """
    spark = vectors.sparkSession
    state = written(usable(vectors, components, scale, vec_id, embedding), "whole-vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    firsts = state.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    now: Centroids = [tuple(int(x) for x in r.v) for r in firsts]
    count, largest = state.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    kind = "long" if (largest or 0) * count < 2**62 else "decimal(38,0)"
    before = None
    for turn in range(turns + 1 if now else 0):
        table = spark.sparkContext.broadcast((now, before))
        known, last = before is not None, turn == turns

        def assign(batches: Iterator[pa.RecordBatch], table=table, known=known, last=last) -> Iterator[pa.RecordBatch]:
            search = Search(*table.value)
            for rows in _together(batches):
                yield _assigned(search, known, last, rows)

        state = written(state.mapInArrow(assign, _STATE), f"clusters-{turn}")
        if not last:
            sums = state.groupBy("cluster").agg(
                F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast(kind)).alias(f"s{i}") for i in range(components)])
            after = list(now)
            for r in sums.collect():
                after[r.cluster] = tuple(int(r[f"s{i}"]) // r.n for i in range(components))
            before, now = now, after
    if not now:
        state = spark.createDataFrame([], _STATE)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    totals = {r.cluster: r.total for r in state.groupBy("cluster").agg(_total("distance").alias("total")).collect()}
    every = None if any(t is None for t in totals.values()) else sum(totals.values())

    def literal(values) -> list:
        return [F.lit(str(v)).try_cast("long") if v is not None else F.lit(None).cast("long") for v in values]

    none = F.array().cast("array<long>")
    return state.select(
        "vec_id", "cluster", F.col("distance").try_cast("long").alias("distance"),
        F.get(F.array(*literal([totals.get(c) for c in range(len(now))])) if now else none, F.col("cluster")).alias("cluster_inertia"),
        literal([every])[0].alias("inertia"),
        F.get(F.array(*map(F.lit, digests)) if now else F.array().cast("array<string>"), F.col("cluster")).alias("centroid_sha256"),
    )


def _total(column: str) -> Column:
    """Exact sum; null if a value is missing, or beyond 38 digits."""
    return F.when(F.count(column) == F.count("*"), F.try_sum(F.col(column)))

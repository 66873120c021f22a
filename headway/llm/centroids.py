"""Exact k-means by Shallot search.

A vector's state is its nearest and second-nearest centroid, an upper bound of the distance to the nearest and a lower bound of the
distance to every other.  When the centroids have moved, the bounds move with them; a vector whose upper bound stays below its
lower bound, or below half the way from its centroid to the next one, keeps its centroid, and nothing is computed.  For any
other, the distance to its centroid is computed anew, and if the bounds still meet:

1. the distance to the remembered second centroid too; the search starts from the closer of the two;
2. the other centroids are met in the order of their distance from there, which is sorted once a round;
3. the search ends where that distance exceeds the vector's own distance to the start plus its second-best distance so far: nothing
   beyond can be among the two nearest.  The ball shrinks as better ones are found.

Vectors of a batch take each step together, as arrays; those whose search has ended drop out.  Survivors are compared by whole
numbers, squared, the smaller number first among equals.  Bounds are floating-point numbers with a margin (``SLACK``) far above their
rounding, so they may only cost a comparison, never change a result.

Components are whole numbers, floor(scale * x).  Where all lie within ``SMALL``, 64 bits are exact; batches with larger ones
(any finite double) are computed with Python's whole numbers.

A round reads the states and writes them with their new centroids, and each partition's sums per centroid are added up in two
levels; only the ``k`` centroids and their sums reach the driver.

Edge cases: vectors that are null, of another length, or with a null or non-finite component are left out; with fewer kept vectors
than ``k`` each is a centroid; a null vec_id is hashed as the empty text; equal hashes start in the order of their components; a
centroid without vectors stays; vectors that repeat are returned as often as they occur; a distance or sum that a long can't hold
is null; an empty table gives an empty result; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scope

K, ROUNDS, LENGTH, SCALE, SEED = 16, 3, 64, 64, 1
#: 64 components within SMALL have squared distances below 2**62.
SMALL, SLACK, LONG = 1 << 27, 1e-9, 1 << 63


def whole(x: float, scale: int) -> int:
    """floor(scale * x) of a finite double."""
    return int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)


def kept(vectors: DataFrame, length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """``vec_id, v, big``: small whole components as ints; the doubles themselves where one isn't small."""
    x = F.col("embedding").cast("array<double>")
    fine = (F.size(x) == length) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.coalesce(fine, F.lit(False)))
    small = F.forall("x", lambda c: F.abs(c) < SMALL / scale)
    return rows.select("vec_id", F.when(small, F.transform("x", lambda c: F.floor(c * scale).cast("int"))).alias("v"), F.when(~small, F.col("x")).alias("big"))


def seeds(rows: DataFrame, k: int = K, seed: int = SEED, scale: int = SCALE) -> list[list[int]]:
    """The first centroids: the vectors whose ids have the smallest hashes."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    # Small components divided by a power of two are exact, so both kinds are ordered as doubles.
    order = F.coalesce("big", F.transform("v", lambda c: c.cast("double") / scale))
    return [_whole_vector(r.v, r.big, scale) for r in rows.orderBy(name, order).limit(k).collect()]


def _whole_vector(v, big, scale: int) -> list[int]:
    return [int(c) for c in v] if v is not None else [whole(c, scale) for c in big]


def _points(frame: pd.DataFrame, scale: int) -> np.ndarray:
    """Whole components, as 64-bit numbers or, where one is large, as Python's."""
    if frame["big"].isna().all():
        return np.stack(frame["v"].to_list()).astype(np.int64)
    out = np.empty((len(frame), LENGTH if not len(frame) else len(_first(frame))), object)
    for i, (v, big) in enumerate(zip(frame["v"], frame["big"], strict=True)):
        out[i] = _whole_vector(v, big, scale)
    return out


def _first(frame: pd.DataFrame):
    row = frame.iloc[0]
    return row["v"] if row["v"] is not None else row["big"]


class Centroids:
    """The centroids of a round: which lie near which, and how far each has moved."""

    def __init__(self, now: list[list[int]], before: list[list[int]] | None) -> None:
        self.exact = np.array(now, object)
        self.small = bool((np.abs(self.exact) < SMALL).all())
        self.fast = self.exact.astype(np.int64) if self.small else None
        gaps = _root(_squares(self.exact[:, None, :] - self.exact[None, :, :]))
        self.order = np.argsort(gaps, axis=1, kind="stable")  # the centroid itself comes first, or one equal to it
        self.away = np.take_along_axis(gaps, self.order, axis=1)
        np.fill_diagonal(gaps, np.inf)
        self.half = gaps.min(axis=1) / 2
        moved = np.zeros(len(now)) if before is None else _root(_squares(self.exact - np.array(before, object)))
        self.moved = moved
        # The farthest that any other has moved.
        most = np.argsort(-moved, kind="stable")[:2]
        self.others = np.where(np.arange(len(now)) == most[0], moved[most[-1]] if len(now) > 1 else 0.0, moved[most[0]])

    def points(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and centroids as numbers of one kind."""
        return (x, self.fast) if self.small and x.dtype != object else (x.astype(object), self.exact)


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=-1)


def _root(x: np.ndarray) -> np.ndarray:
    """Square roots of whole numbers as doubles; infinite where one is too large for it."""
    if x.dtype != object:
        return np.sqrt(x.astype(np.float64))
    root = lambda n: float(math.isqrt(n << 64)) / 2**32 if n < 1 << 1000 else math.inf if n >= 1 << 2040 else float(math.isqrt(n))
    return np.array([root(int(n)) for n in x.ravel()], np.float64).reshape(x.shape)


def search(x: np.ndarray, c: Centroids, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """(nearest, second, their squared distances) of each vector, from the closer of two known centroids on.  One centroid: it is its own second."""
    points, centres = c.points(x)
    kind, k = points.dtype, len(c.exact)
    far = lambda rows, which: _squares(points[rows] - centres[which])
    every = np.arange(len(points))
    d1, d2 = far(every, first), far(every, second)
    swap = (d2 < d1) | ((d2 == d1) & (second < first))
    first, second = np.where(swap, second, first), np.where(swap, first, second)
    d1, d2 = np.where(swap, d2, d1).astype(kind), np.where(swap, d1, d2).astype(kind)
    start, to_start, old = first.copy(), _root(d1), second.copy()
    alive = every
    for step in range(k):
        # The ball around the start, which shrinks with the second-best distance.
        reach = (to_start[alive] + _root(d2[alive])) * (1 + SLACK)
        alive = alive[c.away[start[alive], step] <= reach]
        if not len(alive):
            break
        other = c.order[start[alive], step]
        new = (other != start[alive]) & (other != old[alive])
        rows, other = alive[new], other[new]
        if not len(rows):
            continue
        d = far(rows, other)
        best = (d < d1[rows]) | ((d == d1[rows]) & (other < first[rows]))
        next_best = ~best & ((d < d2[rows]) | ((d == d2[rows]) & (other < second[rows])))
        up, mid = rows[best], rows[next_best]
        second[up], d2[up] = first[up], d1[up]
        first[up], d1[up] = other[best], d[best]
        second[mid], d2[mid] = other[next_best], d[next_best]
    return first, second, d1, d2


STATE = "vec_id long, v array<int>, big array<double>, near int, second int, upper double, lower double"


def _assigned(frames: Iterator[pd.DataFrame], now: list[list[int]], before: list[list[int]] | None, scale: int) -> Iterator[pd.DataFrame]:
    c = Centroids(now, before)
    for f in frames:
        if not len(f):
            continue
        x = _points(f, scale)
        near, second = (f[name].to_numpy(np.int64, copy=True) for name in ("near", "second"))
        upper, lower = (f[name].to_numpy(np.float64, copy=True) for name in ("upper", "lower"))
        if before is not None:
            upper, lower = upper + c.moved[near], lower - c.others[near]
        sure = np.maximum(lower, c.half[near]) * (1 - SLACK)
        rows = np.flatnonzero(~(upper < sure))
        if len(rows) and before is not None:  # the upper bound made tight
            points, centres = c.points(x[rows])
            upper[rows] = _root(_squares(points - centres[near[rows]])) * (1 + SLACK)
            rows = rows[~(upper[rows] < sure[rows])]
        if len(rows):
            first, other, d1, d2 = search(x[rows], c, near[rows], second[rows])
            near[rows], second[rows] = first, other
            upper[rows] = _root(d1) * (1 + SLACK)
            lower[rows] = _root(d2) * (1 - SLACK) if len(now) > 1 else np.inf
        yield f.assign(near=near.astype(np.int32), second=second.astype(np.int32), upper=upper, lower=lower)


def _sums(frames: Iterator[pd.DataFrame], scale: int) -> Iterator[pd.DataFrame]:
    """A partition's number of vectors and sums of components of each centroid, the latter as texts of any length."""
    total: dict[int, list] = {}
    for f in frames:
        for near, g in f.groupby("near"):
            sums, n = _points(g, scale).sum(axis=0), len(g)
            if near in total:
                total[near] = [total[near][0] + n, [a + int(b) for a, b in zip(total[near][1], sums, strict=True)]]
            else:
                total[near] = [n, [int(b) for b in sums]]
    yield pd.DataFrame([(k, n, [str(s) for s in sums]) for k, (n, sums) in total.items()], columns=["near", "n", "sums"])


def _added(f: pd.DataFrame) -> pd.DataFrame:
    sums = [str(sum(map(int, c))) for c in zip(*f["sums"], strict=True)]
    return pd.DataFrame([(f["near"].iloc[0], int(f["n"].sum()), sums)], columns=["near", "n", "sums"])


def moved(states: DataFrame, now: list[list[int]], scale: int = SCALE) -> list[list[int]]:
    """The centroids' new places: floor(sum / count), exactly; those without vectors stay."""
    kind = "near int, n long, sums array<string>"
    parts = states.select("near", "v", "big").mapInPandas(lambda f: _sums(f, scale), kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    parts = parts.groupBy("near", "part").applyInPandas(_added, kind).groupBy("near").applyInPandas(_added, kind)
    out = list(now)
    for r in parts.collect():  # at most one row for each centroid
        out[r.near] = [int(s) // r.n for s in r.sums]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(states of the kept vectors after the last assignment, the centroids)."""
    with scope():
        rows = kept(vectors, length, scale)
        now = seeds(rows, k, seed, scale)
        if not now:
            return rows.select(*[F.lit(None).cast(t).alias(n) if n not in rows.columns else F.col(n) for n, t in (x.split() for x in STATE.split(", "))]), now
        # Before the first round nothing is known: any two centroids, and bounds that say nothing.
        states = rows.select("*", F.lit(0).alias("near"), F.lit(min(1, len(now) - 1)).alias("second"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
        before = None
        for i in range(rounds + 1):
            states = cut(states.mapInPandas(lambda f, now=now, before=before: _assigned(f, now, before, scale), STATE), keep=i == rounds)
            if i < rounds:
                before, now = now, moved(states, now, scale)
        return states, now


def centroids(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every kept vector."""
    states, now = cluster(vectors, k, rounds, length, scale, seed)
    places = Centroids(now, None) if now else None

    def distances(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                points, centres = places.points(_points(f, scale))
                d = _squares(points - centres[f["near"].to_numpy()])
                yield pd.DataFrame({"vec_id": f["vec_id"], "cluster": f["near"], "distance": pd.array([int(x) if x < LONG else None for x in d], "Int64"), "exact": [str(x) for x in d]})

    rows = states.mapInPandas(distances, "vec_id long, cluster int, distance long, exact string")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    # Sums that a long can't hold are null; each is below 10**38, or its vectors' distances are null as well.
    sums = rows.groupBy("cluster").agg(F.sum(F.col("exact").try_cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("lost"))
    sums = sums.toPandas() if now else pd.DataFrame({"cluster": [], "total": [], "lost": []})  # at most k rows
    of = {int(r.cluster): None if r.lost or int(r.total) >= LONG else int(r.total) for r in sums.itertuples()}
    everything = None if None in of.values() or sum(of.values()) >= LONG else sum(of.values())
    facts = [(i, of.get(i), everything, digest[i]) for i in range(len(now))]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.drop("exact").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

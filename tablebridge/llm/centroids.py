"""Centroid clustering of vectors in whole numbers, with centroids filtered by their projection into an n-simplex.

A vector's exact squared distances to a few pivots, taken once and kept beside it, fix its place against the pivots' simplex:
the coordinates of an apex, whose last one is its height over them. The distance of two apexes is a lower bound of the
distance of their vectors, and the one with the other apex below the simplex an upper bound. A centroid whose lower bound is
beyond the least upper bound, or beyond the exact distance of the centroid of least lower bound, cannot be the nearest; what
is left is compared in whole numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablebridge.llm.common import stored

DIMS, CENTROIDS, ROUNDS, SCALE, SALT = 64, 40, 5, 256, "2:"
#: Pivots of the simplex, and the least height of a new one over those before, as a share of its distance to the first.
PIVOTS, LEAST_HEIGHT = 16, 0.1
#: Components below it are plain: squared distances of 64 of them fit 64 bits. Others are whole numbers of any size.
PLAIN = 1 << 27
#: Relative slack of the bounds against rounding, vectors compared at once, bits of a digit in exact sums.
SLACK, ROWS, DIGIT = 1e-6, 1024, 40


def quantised(vector: list[float], scale: int = SCALE) -> list[int]:
    """floor(scale * x) of each component, exact at every size."""
    return [math.floor(y) if math.isfinite(y := x * scale) else int(x) * scale for x in map(float, vector)]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


class Simplex:
    """The pivots (plain vectors) that stand well over those before them, and the apexes of other vectors."""

    def __init__(self, pivots: np.ndarray, most: int = PIVOTS):
        self.pivots = pivots[:1]
        self.base = np.zeros((0, 0))  # row i: the coordinates of pivot i + 1, lower triangular
        rest = list(range(1, len(pivots)))
        while rest and len(self.pivots) < most:
            heights = self.apexes(pivots[rest])[:, -1]
            far = int(heights.argmax())
            apex = self.apexes(pivots[[rest[far]]])[0]
            if heights[far] <= LEAST_HEIGHT * math.sqrt(float(_squared(pivots[rest[far]], self.pivots[0]))):
                break
            n = len(self.base)
            self.base = np.vstack([np.hstack([self.base, np.zeros((n, 1))]), apex])
            self.pivots = np.vstack([self.pivots, pivots[[rest.pop(far)]]])

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """[vectors, pivots]: from the squared distances to the pivots, the last coordinate the height."""
        to_pivots = np.stack([_squared(vectors, p) for p in self.pivots], axis=1)
        edges = _squared(self.pivots[1:], self.pivots[:1])
        along = (to_pivots[:, :1] - to_pivots[:, 1:] + edges) / 2.0
        out = np.zeros((len(vectors), len(self.pivots)))
        for i, row in enumerate(self.base):
            out[:, i] = (along[:, i] - out[:, :i] @ row[:i]) / row[i]
        out[:, -1] = np.sqrt(np.maximum(to_pivots[:, 0] - (out[:, :-1] ** 2).sum(axis=1), 0.0))
        return out


def _bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared lower and upper bounds of all distances between two lists of apexes, and the slack of each."""
    flat = (a[:, None, :-1] - b[None, :, :-1]) ** 2
    side, x, y = flat.sum(axis=2), a[:, None, -1], b[None, :, -1]
    slack = SLACK * (1 + (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :])
    return side + (x - y) ** 2, side + (x + y) ** 2, slack


class Centroids:
    """The centroids of one round, plain ones with their apexes. `compared` counts exact distances, for tests."""

    def __init__(self, rows: list[list[int]], simplex: Simplex | None):
        self.rows, self.simplex, self.compared = rows, simplex, 0
        small = [max(map(abs, r), default=0) < PLAIN for r in rows]
        self.plain = [i for i, s in enumerate(small) if s]
        self.wide = [i for i, s in enumerate(small) if not s]
        self.array = np.array([rows[i] for i in self.plain], np.int64)
        self.apexes = simplex.apexes(self.array) if simplex is not None and self.plain else None

    def nearest(self, vectors: np.ndarray, apexes: np.ndarray) -> tuple[list[int], list[int]]:
        """Number and squared distance of the nearest centroid of each plain vector; ties go to the smaller number."""
        if self.wide or self.apexes is None:
            return self.nearest_wide(vectors.tolist())
        numbers, distances = [], []
        for at in range(0, len(vectors), ROWS):
            v, low_high = vectors[at : at + ROWS], _bounds(apexes[at : at + ROWS], self.apexes)
            low, high, slack = low_high
            each, first = np.arange(len(v)), low.argmin(axis=1)
            known = _squared(v, self.array[first])
            most = np.minimum((high + slack).min(axis=1), known)
            left = low - slack <= most[:, None]
            left[each, first] = False
            i, j = np.nonzero(left)
            exact = np.full(low.shape, np.iinfo(np.int64).max)
            exact[each, first] = known
            exact[i, j] = _squared(v[i], self.array[j])
            self.compared += len(v) + len(i)
            best = exact.argmin(axis=1)
            numbers += best.tolist()
            distances += exact[each, best].tolist()
        return numbers, distances

    def nearest_wide(self, vectors: list[list[int]]) -> tuple[list[int], list[int]]:
        """The same in whole numbers of any size, over all centroids."""
        found = [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), k) for k, c in enumerate(self.rows)) for v in vectors]
        self.compared += len(vectors) * len(self.rows)
        return [k for _, k in found], [d for d, _ in found]


def _assigned(batch: pa.RecordBatch, centroids: Centroids, dims: int) -> tuple[np.ndarray, list[int], np.ndarray, list[list[int]]]:
    """Of a batch of kept vectors: clusters, squared distances, the plain vectors (zeros elsewhere), the wide ones (empty elsewhere)."""
    wide = [[] if x is None else list(map(int, x)) for x in batch.column("wide").to_pylist()]
    plain = np.zeros((batch.num_rows, dims), np.int64)
    is_plain = np.array([not x for x in wide], bool)
    clusters, distances = np.zeros(batch.num_rows, np.int64), [0] * batch.num_rows
    if is_plain.any():
        told = [x for x in batch.column("plain").to_pylist() if x is not None]
        plain[is_plain] = np.frombuffer(b"".join(told), np.int32).reshape(-1, dims)
        apexes = np.frombuffer(b"".join(x for x in batch.column("apex").to_pylist() if x is not None), np.float64).reshape(len(told), -1)
        numbers, found = centroids.nearest(plain[is_plain], apexes)
        clusters[is_plain] = numbers
        for i, d in zip(np.nonzero(is_plain)[0], found, strict=True):
            distances[i] = d
    for i in np.nonzero(~is_plain)[0]:
        (clusters[i],), (distances[i],) = centroids.nearest_wide([wide[i]])
    return clusters, distances, plain, wide


def _simplex(first: list[list[int]], pivots: int) -> Simplex | None:
    plain = [r for r in first if max(map(abs, r), default=0) < PLAIN]
    return Simplex(np.array(plain, np.int64), pivots) if plain else None


def _kept(vectors: DataFrame, first: list[list[int]], dims: int, pivots: int, scale: int) -> DataFrame:
    """vec_id, plain (32-bit components), apex of plain vectors; wide (components as text) of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simplex = _simplex(first, pivots)
        for batch in batches:
            rows = batch.column("embedding").to_pylist()
            x = np.array(rows, np.float64).reshape(len(rows), dims)
            small = (np.abs(x) < (PLAIN - 1) / scale).all(axis=1)
            ints = np.floor(np.where(small[:, None], x, 0.0) * scale).astype(np.int64)
            apexes = simplex.apexes(ints) if simplex is not None else np.zeros((len(rows), 0))
            told: list[list] = [[], [], []]
            for i, row in enumerate(rows):
                told[0].append(ints[i].astype(np.int32).tobytes() if small[i] else None)
                told[1].append(apexes[i].tobytes() if small[i] else None)
                told[2].append(None if small[i] else list(map(str, quantised(row, scale))))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *(pa.array(x, t) for x, t in zip(told, (pa.binary(), pa.binary(), pa.list_(pa.string())), strict=True))], ["vec_id", "plain", "apex", "wide"])

    return vectors.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, plain binary, apex binary, wide array<string>")


def _sums(kept: DataFrame, centroids: list[list[int]], first: list[list[int]], dims: int, pivots: int) -> dict[int, tuple[int, list[int]]]:
    """Cluster to its number of vectors and their exact sum. Each task gives one sum a cluster, in digits of DIGIT bits, so at most clusters * dims numbers, times the digits of the widest, reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Centroids(centroids, _simplex(first, pivots))
        counts, totals, large = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64), {}
        for batch in batches:
            clusters, _, plain, wide = _assigned(batch, now, dims)
            np.add.at(counts, clusters, 1)
            np.add.at(totals, clusters, plain)
            for k, w in zip(clusters.tolist(), wide, strict=True):
                if w:
                    large[k] = [a + b for a, b in zip(large.get(k, [0] * dims), w, strict=True)]
        rows = [(k, -1, 0, int(n)) for k, n in enumerate(counts) if n]
        for k, _, _, _ in list(rows):
            for d, total in enumerate(totals[k].tolist()):
                total, place = total + large.get(k, [0] * dims)[d], 0
                sign, total = (-1 if total < 0 else 1), abs(total)
                while total:
                    rows.append((k, d, place, sign * (total & ((1 << DIGIT) - 1))))
                    total, place = total >> DIGIT, place + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "dim", "place", "value"])

    found = kept.mapInArrow(run, "cluster int, dim int, place int, value long").groupBy("cluster", "dim", "place").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    out: dict[int, tuple[int, list[int]]] = {}
    for cluster, dim, place, value in found.collect():
        n, total = out.get(cluster, (0, [0] * dims))
        if dim < 0:
            n = int(value)
        else:
            total[dim] += int(value) << (DIGIT * place)
        out[cluster] = n, total
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector of vectors (vec_id, embedding).

    Kept are vectors of exactly `dims` components, none null or not finite; each becomes floor(scale * x). The first centroids
    are the k kept vectors whose sha256 of salt and vec_id is least (null ids last; of equal ids by their components), fewer where fewer are kept.
    Each round assigns all vectors, ties to the smaller number, and moves every centroid that has vectors to the floor of their mean; then all are
    assigned once more. Repeated rows and ids count as often as they occur. An empty table, or one of which nothing is kept, gives no rows.
    Components of any finite size are exact; a distance, or a sum of them, that does not fit 64 bits is null. Other columns are ignored.
    """
    spark, x = vectors.sparkSession, F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    own = vectors.select("vec_id", x.cast("array<double>").alias("embedding")).where((F.size(x) == dims) & F.coalesce(finite, F.lit(False)))
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    # k rows: each task keeps its k least
    first = [quantised(r["embedding"], scale) for r in own.orderBy(digest.asc_nulls_last(), "embedding").limit(k).collect()]
    kept = stored(_kept(own, first, dims, pivots, scale), "vectors")
    centroids = first
    for _ in range(rounds if first else 0):
        moved = _sums(kept, centroids, first, dims, pivots)
        centroids = [[t // moved[i][0] for t in moved[i][1]] if i in moved else c for i, c in enumerate(centroids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Centroids(centroids, _simplex(first, pivots))
        for batch in batches:
            clusters, distances, _, _ = _assigned(batch, now, dims)
            fits = [d if d < 1 << 63 else None for d in distances]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(clusters, pa.int32()), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = stored(kept.mapInArrow(run, f"vec_id {dict(kept.dtypes)['vec_id']}, cluster int, distance long"), "assigned")
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(20,0)")))
    sums = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(whole.alias("total")).collect()}  # at most k rows
    fit = lambda n: n if n is not None and n < 1 << 63 else None
    total = fit(None if None in sums.values() else sum(map(int, sums.values())))
    rows = [(i, fit(None if t is None else int(t)), total, hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, t in sorted(sums.items())]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

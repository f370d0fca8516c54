"""Groups of like rows: nearest centres, seeds and Lloyd's iterations over all rows, k-means and Ward.

Rows stay where they are: an iteration gives one small row for each partition.
Matrices on the driver are samples of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators import blocks

INIT_ROWS, LOCAL_ROWS, WARD_ROWS = 20_000, 50_000, 3_000
TOLERANCE = 1e-5


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def nearest_center(x: Column, centers: np.ndarray) -> Column:
    """``struct(d, id)`` of the nearest of a few centres, the lowest id on a tie; stays in the JVM."""
    return F.array_min(F.array(*[F.struct(squared_distance(x, F.array(*map(F.lit, map(float, c)))).alias("d"), F.lit(k).alias("id")) for k, c in enumerate(centers)]))


def gaps(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (rows * rows).sum(1)[:, None] - 2 * rows @ centers.T + (centers * centers).sum(1)[None])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1) if len(array) else np.zeros((0, 0))


def assign(df: DataFrame, centers: np.ndarray, features: str = "features") -> DataFrame:
    """``df`` with ``label`` and ``distance`` (squared) to the nearest centre, by matrix products."""
    schema = T.StructType([*df.schema.fields, T.StructField("label", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = gaps(matrix(batch.column(features)), centers)
                label = d.argmin(1)
                least = d[np.arange(len(d)), label]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label.astype(np.int32)), pa.array(least)], names=schema.names)

    return df.mapInArrow(run, schema)


@dataclass
class Step:
    """One look at all rows: sums, counts and inertia by nearest centre, and the rows farthest from theirs, farthest first."""

    sums: np.ndarray
    n: np.ndarray
    inertia: float
    far_gap: np.ndarray
    far_label: np.ndarray
    far_rows: np.ndarray

    def centers(self, before: np.ndarray) -> np.ndarray:
        """The means; an empty cluster takes the farthest row left whose own cluster keeps another."""
        sums, n, left = self.sums.copy(), self.n.copy(), list(range(len(self.far_gap)))
        for c in np.flatnonzero(n == 0):
            at = next((i for i in left if n[self.far_label[i]] > 1 and self.far_gap[i] > 0), None)
            if at is None:
                break
            left.remove(at)
            sums[self.far_label[at]] -= self.far_rows[at]
            n[self.far_label[at]] -= 1
            sums[c], n[c] = self.far_rows[at], 1
        return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], before)


def _step_part(centers: np.ndarray):
    k = len(centers)

    def part(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        d = gaps(rows, centers)
        label = d.argmin(1)
        least = d[np.arange(len(d)), label]
        hits = np.zeros((len(rows), k))
        hits[np.arange(len(rows)), label] = 1.0
        far = np.argsort(-least, kind="stable")[:k]
        return hits.T @ rows, np.bincount(label, minlength=k), np.array(least.sum()), least[far], label[far], rows[far]

    return part


def _add_steps(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    gap, label, rows = (np.concatenate(x) for x in zip(a[3:], b[3:], strict=True))
    far = np.lexsort((*rows.T[::-1], -gap))[: len(a[0])]  # ties by the rows themselves, so partitions don't matter
    return a[0] + b[0], a[1] + b[1], a[2] + b[2], gap[far], label[far], rows[far]


def lloyd_step(df: DataFrame, centers: np.ndarray, features: str = "features") -> Step:
    found = blocks.summed(df.select(features), _step_part(centers), _add_steps, lambda b: matrix(b.column(0)))
    if found is None:
        return Step(np.zeros_like(centers), np.zeros(len(centers), np.int64), 0.0, np.zeros(0), np.zeros(0, int), np.zeros((0, centers.shape[1])))
    sums, n, inertia, gap, label, rows = found
    return Step(sums, n.astype(np.int64), float(inertia), gap, label.astype(int), rows)


def lloyd(df: DataFrame, centers: np.ndarray, *, max_iter: int = 15, features: str = "features") -> tuple[np.ndarray, float, int]:
    """Centres, inertia and iterations of Lloyd's algorithm over all rows; all empty clusters of an iteration are mended in it."""
    for turn in range(1, max_iter + 1):
        new = lloyd_step(df, centers, features).centers(centers)
        moved = float(((new - centers) ** 2).sum())
        centers = new
        if moved <= TOLERANCE:
            break
    return centers, lloyd_step(df, centers, features).inertia, turn


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number within 0 and 1 for each id, the same wherever the row is."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def parallel_seeds(df: DataFrame, row_id: str, k: int, *, seed: int = 42, rounds: int = 5, oversample: int = 2, features: str = "features") -> np.ndarray:
    """Seeds from all rows by oversampling: every round draws ``oversample * k`` rows, as likely as their squared distance to those drawn before.

    A round is one pass: each row draws a key, and those of largest key are taken, so draws
    don't depend on partitions.  The rows drawn (``oversample * k * rounds`` and one) are weighted by how many rows
    are nearest to each, and seeds are spread over them by weight.
    """
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(features).alias("features"))
    split = lambda b: (b.column("id").to_numpy(), matrix(b.column("features")))
    drawn: np.ndarray | None = None

    def best(m: int):
        def merge(a, b):
            key, own = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
            order = np.lexsort((*own.T[::-1], -key))[:m]
            return key[order], own[order]

        return merge

    for turn in range(rounds + 1):
        m = oversample * k if turn else 1

        def part(x, turn=turn, m=m, have=drawn):
            ids, own = x
            weight = np.ones(len(own)) if have is None else gaps(own, have).min(1)
            key = np.where(weight > 0, np.log(_uniform(ids, seed + turn)) / np.maximum(weight, 1e-300), -np.inf)
            top = np.argsort(-key, kind="stable")[:m]
            return key[top], own[top]

        found = blocks.summed(rows, part, best(m), split)
        if found is None:
            return np.zeros((0, 0))
        new = found[1][np.isfinite(found[0])]
        drawn = new if drawn is None else np.concatenate([drawn, new])
    have = drawn
    weights = blocks.summed(rows, lambda x: (np.bincount(gaps(x[1], have).argmin(1), minlength=len(have)),), lambda a, b: (a[0] + b[0],), split)[0]
    live = weights > 0
    return weighted_seeds(drawn[live], weights[live], k, np.random.default_rng(seed))


def weighted_seeds(rows: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator, *, restarts: int = 16, turns: int = 20) -> np.ndarray:
    """Spread-out seeds of weighted rows and a few of Lloyd's iterations over them; the best of some restarts."""
    best, least = rows[:1], np.inf
    for _ in range(restarts):
        picks = [int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum()))]
        while len(picks) < min(k, len(rows)):
            odds = np.cumsum(weights * gaps(rows, rows[picks]).min(1))
            if odds[-1] <= 0:
                break
            picks.append(int(min(len(rows) - 1, np.searchsorted(odds, rng.random() * odds[-1], side="right"))))
        centers = rows[picks]
        for _ in range(turns):
            label = gaps(rows, centers).argmin(1)
            sums, n = np.zeros_like(centers), np.bincount(label, weights, len(centers))
            np.add.at(sums, label, rows * weights[:, None])
            centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], centers)
        cost = float(weights @ gaps(rows, centers).min(1))
        if (-len(centers), cost) < (-len(best), least):
            best, least = centers, cost
    return best


def plus_plus(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spread-out seeds; a row is as likely as its squared distance to those before."""
    picks = [int(rng.integers(len(rows)))]
    least = gaps(rows, rows[picks])[:, 0]
    while len(picks) < k:
        total = least.sum()
        nxt = int(rng.integers(len(rows))) if total <= 0 else int(min(len(rows) - 1, np.searchsorted(np.cumsum(least), rng.random() * total, side="right")))
        picks.append(nxt)
        least = np.minimum(least, gaps(rows, rows[[nxt]])[:, 0])
    return rows[picks].copy()


def lloyd_local(rows: np.ndarray, centers: np.ndarray, max_iter: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Lloyd's algorithm on a bounded matrix: centres, labels, inertia; no cluster stays empty."""
    k = len(centers)
    for _ in range(max_iter):
        d = gaps(rows, centers)
        label = d.argmin(1)
        own = d[np.arange(len(rows)), label]
        n = np.bincount(label, minlength=k)
        for c in np.flatnonzero(n == 0):
            donors = np.where(n[label] > 1, own, -1.0)
            far = int(donors.argmax())
            if donors[far] < 0:
                break
            n[label[far]] -= 1
            label[far], own[far], n[c] = c, 0.0, 1
        sums = np.zeros_like(centers)
        np.add.at(sums, label, rows)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        moved = float(((new - centers) ** 2).sum())
        centers = new
        if moved <= TOLERANCE:
            break
    d = gaps(rows, centers)
    label = d.argmin(1)
    return centers, label, float(d[np.arange(len(rows)), label].sum())


def k_means_local(rows: np.ndarray, k: int, seed: int, *, restarts: int = 3, max_iter: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    if k >= len(rows):
        return rows.copy(), np.arange(len(rows)), 0.0
    best = None
    for r in range(restarts):
        rng = np.random.default_rng(seed + 7919 * r)
        got = lloyd_local(rows, plus_plus(rows, k, rng), max_iter)
        if best is None or got[2] < best[2]:
            best = got
    return best


@dataclass
class WardTree:
    """Merges of m rows in order of height; node m + t is the result of merge t."""

    m: int
    left: np.ndarray
    right: np.ndarray
    height: np.ndarray

    def cut(self, k: int) -> np.ndarray:
        """Labels of exactly min(k, m) clusters, numbered by first appearance."""
        k = max(1, min(k, self.m))
        up = list(range(2 * self.m - 1))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for t in range(self.m - k):
            for side in (self.left[t], self.right[t]):
                up[root(int(side))] = self.m + t
        names: dict[int, int] = {}
        return np.array([names.setdefault(root(i), len(names)) for i in range(self.m)])


def ward_tree(rows: np.ndarray) -> WardTree:
    """Ward's hierarchy by nearest-neighbour chains; merges are then put in order of height."""
    m = len(rows)
    d = gaps(rows, rows)
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(m), np.ones(m, bool)
    merges: list[tuple[float, int, int]] = []  # height and two member rows
    chain: list[int] = []
    while len(merges) < m - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        a = chain[-1]
        b = int(d[a].argmin())
        if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
            b = chain[-2]
        if len(chain) > 1 and b == chain[-2]:
            chain = chain[:-2]
            merges.append((float(d[a, b]), a, b))
            total = size[a] + size[b] + size
            row = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / total
            row[~alive] = np.inf
            row[[a, b]] = np.inf
            d[b], d[:, b] = row, row
            alive[a] = False
            d[a], d[:, a] = np.inf, np.inf
            size[b] += size[a]
        else:
            chain.append(b)
    merges.sort(key=lambda x: x[0])
    at = list(range(m))
    up = list(range(m))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    left, right = [], []
    for t, (_, a, b) in enumerate(merges):
        a, b = root(a), root(b)
        left.append(at[a])
        right.append(at[b])
        up[a] = b
        at[b] = m + t
    return WardTree(m, np.array(left, int), np.array(right, int), np.array([h for h, _, _ in merges]))


def centroids(rows: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    sums = np.zeros((k, rows.shape[1]))
    np.add.at(sums, labels, rows)
    return sums / np.maximum(np.bincount(labels, minlength=k), 1)[:, None]


def by_size(centers: np.ndarray, n: np.ndarray) -> list[int]:
    """Places of the centres, largest cluster first, ties by centre, so labels don't depend on how they were found."""
    return sorted(range(len(centers)), key=lambda c: (-int(n[c]), *np.round(centers[c], 9).tolist()))

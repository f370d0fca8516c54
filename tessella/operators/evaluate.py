"""How good a segmentation is, and which k to take."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.blocks import summed
from tessella.operators.cluster import TOLERANCE, WARD_ROWS, centroids, gaps, k_means_local, matrix, parallel_seeds, ward_tree
from tessella.operators.stats import hash_sample

SILHOUETTE_ROWS = 1_800


@dataclass
class KScore:
    k: int
    inertia: float  # by row
    silhouette: float
    calinski_harabasz: float
    davies_bouldin: float
    min_share: float = 1.0


def silhouette(rows: np.ndarray, labels: np.ndarray) -> float:
    """Mean over the rows of a bounded sample, by Euclidean distance; rows alone in their cluster are left out."""
    names, label = np.unique(labels, return_inverse=True)
    n = np.bincount(label)
    if len(rows) < 3 or len(names) < 2:
        return 0.0
    sums = np.sqrt(gaps(rows, rows))
    np.fill_diagonal(sums, 0.0)
    sums = np.stack([sums[:, label == c].sum(1) for c in range(len(names))], axis=1)
    at = np.arange(len(rows))
    own = sums[at, label] / np.maximum(n[label] - 1, 1)
    other = sums / n
    other[at, label] = np.inf
    near = other.min(1)
    top = np.maximum(own, near)
    ok = (n[label] > 1) & (top > 0)
    return float(((near - own)[ok] / top[ok]).mean()) if ok.any() else 0.0


def calinski_harabasz(rows: np.ndarray, labels: np.ndarray, centers: np.ndarray) -> float:
    n, k = len(rows), len(centers)
    within = float(((rows - centers[labels]) ** 2).sum())
    if k < 2 or n <= k or within <= 0:
        return 0.0
    size = np.bincount(labels, minlength=k)
    between = float((size * ((centers - rows.mean(0)) ** 2).sum(1)).sum())
    return between / (k - 1) / (within / (n - k))


def davies_bouldin(rows: np.ndarray, labels: np.ndarray, centers: np.ndarray) -> float:
    size = np.bincount(labels, minlength=len(centers))
    live = np.flatnonzero(size)
    if len(live) < 2:
        return 0.0
    reach = np.sqrt(((rows - centers[labels]) ** 2).sum(1))
    spread = np.array([reach[labels == c].mean() for c in live])
    apart = np.sqrt(gaps(centers[live], centers[live]))
    np.fill_diagonal(apart, 0.0)
    ratio = np.where(apart > 0, (spread[:, None] + spread[None]) / np.where(apart > 0, apart, 1.0), 0.0)
    return float(ratio.max(1).mean())


def label_spread(df: DataFrame, dim: int, *, label: str = "label", vector: str = "features") -> DataFrame:
    """A row a label over all rows: ``n``, ``center``, the sum of squared distances from it (``within``) and their mean (``reach``)."""
    centers = df.groupBy(label).agg(F.array(*[F.avg(F.get(vector, F.lit(j))) for j in range(dim)]).alias("center"))
    gap = F.aggregate(F.zip_with(vector, "center", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x)
    near = df.join(F.broadcast(centers), label).withColumn("gap", gap)  # a row a label
    return near.groupBy(label).agg(F.count("*").alias("n"), F.any_value("center").alias("center"), F.sum("gap").alias("within"), F.avg(F.sqrt("gap")).alias("reach"))


def spread_scores(spread: Sequence) -> tuple[float, float]:
    """Calinski-Harabasz and Davies-Bouldin from the rows of :func:`label_spread`; 0 for what isn't defined."""
    n = np.array([r["n"] for r in spread], float)
    centers = np.array([r["center"] for r in spread], float).reshape(len(spread), -1)
    within, reach = np.array([r["within"] for r in spread]), np.array([r["reach"] for r in spread])
    if len(n) < 2:
        return 0.0, 0.0
    mean = (n[:, None] * centers).sum(0) / n.sum()
    between = float((n * ((centers - mean) ** 2).sum(1)).sum())
    ch = between / (len(n) - 1) / (within.sum() / (n.sum() - len(n))) if within.sum() > 0 and n.sum() > len(n) else 0.0
    apart = np.sqrt(gaps(centers, centers))
    np.fill_diagonal(apart, 0.0)
    ratio = np.where(apart > 0, (reach[:, None] + reach[None]) / np.where(apart > 0, apart, 1.0), 0.0)
    return float(ch), float(ratio.max(1).mean())


def k_scan(rows: np.ndarray, ks: Sequence[int], *, algorithm: str = "kmeans", seed: int = 42) -> list[KScore]:
    """Scores for each k on a bounded sample; Ward's tree is built once and cut for each."""
    rng = np.random.default_rng(seed + 2)
    look = np.sort(rng.permutation(len(rows))[:SILHOUETTE_ROWS])
    tree = sample = None
    if algorithm == "ward":
        sample = rows[np.sort(np.random.default_rng(seed + 3).permutation(len(rows))[:WARD_ROWS])]
        tree = ward_tree(sample)
    out = []
    for k in ks:
        if tree:
            own = tree.cut(k)
            centers = centroids(sample, own, int(own.max()) + 1)
            d = gaps(rows, centers)
            labels = d.argmin(1)
            inertia = float(d[np.arange(len(rows)), labels].sum())
        else:
            centers, labels, inertia = k_means_local(rows, k, seed, restarts=1, max_iter=30)
        share = np.bincount(labels, minlength=len(centers)).min() / max(1, len(rows))
        out.append(KScore(k, inertia / max(1, len(rows)), silhouette(rows[look], labels[look]), calinski_harabasz(rows, labels, centers), davies_bouldin(rows, labels, centers), float(share)))
    return out


def _models_part(models: list[np.ndarray]):
    def part(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        at, out = np.arange(len(rows)), []
        for centers in models:
            d = gaps(rows, centers)
            label = d.argmin(1)
            own = d[at, label]
            hits = np.zeros(d.shape)
            hits[at, label] = 1.0
            out += [hits.T @ rows, hits.sum(0), own @ hits, np.sqrt(own) @ hits]
        return tuple(out)

    return part


def k_scan_rows(df: DataFrame, row_id: str, ks: Sequence[int], *, seed: int = 42, iterations: int = 10, features: str = "features") -> list[KScore]:
    """Scores for each k over all rows: every iteration is one pass that moves the centres of all k at once.

    Inertia, least share, Calinski-Harabasz and Davies-Bouldin are those of all rows, from the sums
    of a last pass; the silhouette is that of ``SILHOUETTE_ROWS`` rows, those of smallest hash of the
    id, which may be any.  Without rows there are no scores.
    """
    models = [parallel_seeds(df, row_id, k, seed=seed, features=features) for k in ks]
    if not all(map(len, models)):
        return []
    rows = df.select(F.col(features).alias("features"))
    add = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
    look = lambda: summed(rows, _models_part(models), add, lambda b: matrix(b.column(0)))
    for _ in range(iterations):
        found = look()
        moved = 0.0
        for k, (sums, n) in enumerate(zip(found[::4], found[1::4], strict=True)):
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], models[k])
            moved, models[k] = max(moved, float(((new - models[k]) ** 2).sum())), new
        if moved <= TOLERANCE:
            break
    found = look()
    total = int(found[1].sum())
    few = hash_sample(df, row_id, SILHOUETTE_ROWS, seed + 2).select(F.col(features).alias("features")).toArrow()
    few = matrix(few.column(0))
    out = []
    for k, centers, n, within, reach in zip(ks, models, found[1::4], found[2::4], found[3::4], strict=True):
        spread = [{"n": a, "center": c, "within": w, "reach": r / a} for a, c, w, r in zip(n, centers, within, reach, strict=True) if a]
        ch, db = spread_scores(spread)
        out.append(KScore(k, float(within.sum()) / max(1, total), silhouette(few, gaps(few, centers).argmin(1)), ch, db, float(n.min()) / max(1, total)))
    return out


def choose_k(scores: Sequence[KScore]) -> int:
    """The smallest k that is nearly best by silhouette and bend of the inertia; 3 without scores."""
    pool = sorted([s for s in scores if s.min_share >= 0.02] or scores, key=lambda s: s.k)
    if len(pool) < 2:
        return pool[0].k if pool else 3
    k, height, sil = (np.array([getattr(s, f) for s in pool], float) for f in ("k", "inertia", "silhouette"))
    height, sil = np.nan_to_num(height, posinf=0, neginf=0), np.nan_to_num(sil, posinf=0, neginf=0)
    unit = lambda x: (x - x.min()) / np.ptp(x) if np.ptp(x) > 0 else None
    x, y, s = unit(k), unit(height), unit(sil)
    bend = np.zeros(len(pool)) if x is None or y is None else np.maximum(0.0, 1 - x - y)
    total = 0.55 * (s if s is not None else 1.0) + 0.45 * (bend / bend.max() if bend.max() > 0 else 0.0)
    total = np.broadcast_to(total, k.shape)
    return int(k[np.flatnonzero(total >= total.max() - 0.03)[0]])


def choose_k_table(scores: DataFrame) -> DataFrame:
    """The same choice over a table ``k, inertia, silhouette, min_share``: every k with its scores and whether it is chosen."""
    all_ = Window.partitionBy()
    pool = scores.withColumn("fit", F.col("min_share") >= 0.02).withColumn("any_fit", F.max("fit").over(all_)).filter(F.col("fit") | ~F.col("any_fit"))

    def unit(name: str):
        low, high = F.min(name).over(all_), F.max(name).over(all_)
        return (F.col(name) - low) / F.when(high > low, high - low)

    pool = pool.withColumn("bend", F.coalesce(F.greatest(F.lit(0.0), 1 - unit("k") - unit("inertia")), F.lit(0.0))).withColumn("sil", F.coalesce(unit("silhouette"), F.lit(1.0)))
    top = F.max("bend").over(all_)
    pool = pool.withColumn("combined", 0.55 * F.col("sil") + 0.45 * F.coalesce(F.col("bend") / F.when(top > 0, top), F.lit(0.0)))
    near = F.col("combined") >= F.max("combined").over(all_) - 0.03
    return pool.withColumn("near", near).withColumn("chosen", F.col("k") == F.min(F.when(F.col("near"), F.col("k"))).over(all_)).select("k", "combined", "chosen")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """``adjusted_rand`` of two labellings: 1 for the same partition, about 0 for unrelated ones."""
    pairs = lambda n: n * (n - 1) / 2
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("in_a"), F.sum("n").alias("total"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("in_b"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("both"))
    one = rows.crossJoin(F.broadcast(cols)).crossJoin(F.broadcast(both))  # three single rows
    expected = F.col("in_a") * F.col("in_b") / pairs(F.col("total"))
    most = (F.col("in_a") + F.col("in_b")) / 2
    return one.select(F.coalesce((F.col("both") - expected) / F.when(most != expected, most - expected), F.lit(1.0)).alias("adjusted_rand"))

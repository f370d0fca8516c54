"""Centroid clustering by sort-means, in whole numbers (operator 12).

Vectors are turned into integers once and written with the cluster they are in.  Each round
orders, for every centroid, the others by their distance from it.  A vector starts at the
cluster it was in, and looks at the other centroids in that order until one lies strictly
beyond twice the vector's distance from its own centroid: by the triangle inequality neither
that one nor any later one can be as near, so ties are found, too.  Then every non-empty
centroid becomes the floor of its vectors' mean, by exact integer sums.

Rows stay where they are: a round writes the table of its clusters in the shared folder, which
the next one reads, and a row for each centroid goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import column, delete, new_path, table

#: Vectors that are compared with the centroids at once.
BLOCK = 16_384


def usable(vector: Column) -> Column:
    """Vectors without a null or non-finite component; null for a null vector."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def reach(dim: int) -> int:
    """The largest integer component with which no squared distance leaves 64 bits."""
    return min(int((2**62 / max(1, dim)) ** 0.5) // 2, 2**31 - 1)


def _gaps(rows: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Squared distances, exact in 64 bits."""
    rest = rows - center
    return (rest * rest).sum(1)


def nearest(rows: np.ndarray, start: np.ndarray, centers: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (the smaller number on a tie), its squared distance, and how many distances were taken.

    ``order[a]`` has the other centroids by their distance from ``a``, ``apart`` the squared
    distances of centroids.
    """
    dim = rows.shape[1]
    top = max(int(np.abs(rows).max(initial=0)), int(np.abs(centers).max(initial=0)))
    fast = 4 * dim * top * top < 2**53  # then products of doubles are exact, too
    if fast:
        data, points = rows.astype(np.float64), centers.astype(np.float64)
        norms, sizes = (data * data).sum(1), (points * points).sum(1)
    label, least, taken = start.copy(), np.zeros(len(rows), np.int64), 0
    for a in np.unique(start):
        own = np.flatnonzero(start == a)
        first = _gaps(rows[own], centers[a])
        far = np.argsort(-first, kind="stable")  # who is farthest from its centroid looks at most others
        own, first = own[far], first[far]
        low, who = first.copy(), np.full(len(own), a)
        x = data[own] if fast else rows[own]
        limit = -4 * first if first.max(initial=0) < 2**60 else -4 * first.astype(object)
        taken += len(own)
        for c in order[a]:
            n = int(np.searchsorted(limit, -apart[a, c], side="right"))  # rows that c isn't strictly beyond twice the distance of
            if not n:
                break
            gap = (norms[own[:n]] - 2 * (x[:n] @ points[c]) + sizes[c]).astype(np.int64) if fast else _gaps(x[:n], centers[c])
            closer = (gap < low[:n]) | ((gap == low[:n]) & (c < who[:n]))
            low[:n][closer] = gap[closer]
            who[:n][closer] = c
            taken += n
        label[own], least[own] = who, low
    return label, least, taken


def _distances(centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The other centroids of each in order of distance, and the squared distances."""
    apart = np.stack([_gaps(centers, c) for c in centers])
    order = [[c for c in np.argsort(row, kind="stable") if c != a] for a, row in enumerate(apart)]
    return np.array(order, int).reshape(len(centers), -1), apart


def _assign(centers: np.ndarray):
    order, apart = _distances(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), -1)
            label, gap, _ = nearest(x, rows.column("cluster").to_numpy().astype(int), centers, order, apart)
            rows = rows.set_column(2, "cluster", pa.array(label.astype(np.int32))).set_column(3, "distance", pa.array(gap))
            yield from rows.to_batches()

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= BLOCK:
                yield from out(held)
                held, n = [], 0
        if n:
            yield from out(held)

    return run


def sort_means(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2") -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid``: a row a vector; the id has the name ``id_col``.

    A component x counts as ``floor(scale * x)``.  Centroids start as the ``k`` vectors whose
    ids have the smallest sha256 of ``salt:id``; after ``rounds`` rounds all vectors are assigned
    once more.  A centroid without vectors stays where it is.  ``distance`` is squared;
    ``centroid`` has the integer components of the vector's centroid.

    Defined cases: vectors that are null, have other than ``dim`` components, or hold a null or
    non-finite one take no part and give no row.  Rows with equal ids count each; as seeds they
    are told by their components.  Rows with a null id take part; they are seeds only if there
    are too few others.  Fewer than ``k`` vectors are all seeds.  Equal seeds: all vectors go to
    the one with the smallest number.  An empty table gives an empty table.  Integer components
    beyond :func:`reach` raise an error, since squared distances would leave 64 bits.  Other columns
    are not read; ``id_col`` can't be one of the results' names.
    """
    if k < 1 or rounds < 0:
        raise ValueError("k must be 1 or more, rounds 0 or more")
    if id_col.lower() in ("cluster", "distance", "cluster_inertia", "inertia", "centroid"):
        raise ValueError(f"{id_col} is the name of a result")
    spark, most = vectors.sparkSession, reach(dim)
    rows = vectors.select(column(id_col).alias("id"), column(vector_col).alias("v")).filter((F.size("v") == dim) & usable(F.col("v")))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("x"))
    fits = F.forall("x", lambda x: F.abs(x) <= most)
    rows = rows.select("id", F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit(f"a component is beyond {most}"))).cast("array<int>").alias("x"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    path = new_path(spark, "sort-means")
    rows.write.parquet(path)
    schema = spark.read.parquet(path).schema
    now = spark.read.schema(schema).parquet(path)
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    seeds = now.select(mark.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    kind = vectors.schema[id_col].dataType.simpleString()
    if not seeds:
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>").withColumnRenamed("id", id_col)
    centers = np.array([r.x for r in seeds], np.int64).reshape(len(seeds), dim)
    for turn in range(rounds + 1):
        to = new_path(spark, "sort-means")
        now.mapInArrow(_assign(centers), schema).write.parquet(to)
        delete(spark, path)
        path, now = to, spark.read.schema(schema).parquet(to)
        if turn == rounds:
            break
        sums = now.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("x", F.lit(j)).cast("long")) for j in range(dim)]).alias("s"))
        for r in sums.collect():  # a row a centroid
            centers[r.cluster] = [s // r.n for s in r.s]  # Python's floor, also below zero
    own = {r.cluster: int(r.d) for r in now.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    found = [(c, d, sum(own.values()), centers[c].tolist()) for c, d in sorted(own.items())]
    each = spark.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    out = now.select(F.col("id").alias(id_col), "cluster", "distance").join(F.broadcast(each), "cluster")  # k rows at most
    return out.select(column(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sort_means(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join("centroid", ",").cast("binary"), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """The same rounds in DuckDB, every vector against every centroid."""
    text = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < {k})"""
    for t in range(rounds + 1):
        text += f""",
a{t} AS (
  SELECT r, vec_id, c, k.v AS v, CAST(list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, m.v) + list_inner_product(m.v, m.v) AS BIGINT) AS d
  FROM kept k CROSS JOIN c{t} m QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        if t < rounds:
            text += f""",
s{t} AS (
  SELECT c, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{t}, range(1, {dim + 1}) AS g(j) GROUP BY c, j),
c{t + 1} AS (
  SELECT m.c AS c, coalesce(f.v, m.v) AS v FROM c{t} m LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS v FROM s{t} GROUP BY c) f ON f.c = m.c)"""
    return text + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(m.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON m.c = a.c"""

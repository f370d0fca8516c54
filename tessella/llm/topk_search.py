"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists (operator 13).

Each dimension has a list of all rows in order of that component.  A query goes down the lists
from the end that its own component favours: the upper one if it is positive, the lower one if
not.  Every row met is scored in full.  At a depth d no row that hasn't been met can score more
than the query with the d-th value of each list, and the search stops when that bound is below
the k-th best score (a row that only ties could still have a smaller id, so a tie goes on).

Queries share the work: a row is met as soon as any list has it within d of either end, so its
depth is the same for all queries, a part's rows are gone through in that order in blocks, and
a block is scored by one matrix product for all queries that are still open.

The lists of the whole table are cut into layers of growing size by depth, each layer is dealt over
parts of bounded size.  After the searches of a layer, the bound over all deeper layers closes
queries, which are then sent no further; the others take their k-th score along.  Depths in
the whole table are estimated on a bounded sample: they decide where a row lies, never what is
found, since bounds are the true extremes of each layer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import column, materialize, table
from tessella.llm.sort_means import usable

#: Rows of one part, queries of one block, rows of the sample that depths are estimated on, and growth of layers.
PART_ROWS, QUERY_ROWS, SAMPLE, GROWTH = 20_000, 20_000, 16_384, 4
#: Scores that are held at once.
SCORES = 1 << 22
LEAST = np.iinfo(np.int64).min


def whole(vectors: pa.ChunkedArray | pa.Array, n: int, scale: int) -> np.ndarray:
    """Components times ``scale``, rounded down, as doubles, which hold them exactly."""
    array = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return np.floor(array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) * scale)


def exact(*rows: np.ndarray) -> list[np.ndarray]:
    """The matrices, as Python's integers if their products could round as doubles."""
    top = [max(1.0, float(np.abs(x).max(initial=0))) for x in rows]
    if rows[0].shape[-1] * top[0] * max(top[1:]) < 2**53:
        return list(rows)
    return [np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object) for x in rows]


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that rows can score whose components lie within ``low`` and ``high``."""
    zero = queries * 0
    return np.maximum(queries, zero) @ high + np.minimum(queries, zero) @ low


def search(ids: np.ndarray, rows: np.ndarray, asked: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query, row and score of the best ``k`` of these rows for each query, ties to smaller ids; those below its ``floor`` may be missing.

    The last value is how many scores were taken.
    """
    n, taken = len(ids), 0
    order = np.argsort(rows, axis=0, kind="stable")  # the sorted lists, a column a dimension
    lists = np.take_along_axis(rows, order, axis=0)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], order.shape), axis=0)
    met = np.minimum(rank, n - 1 - rank).min(1) if rows.shape[1] else np.zeros(n, int)
    by = np.argsort(met, kind="stable")
    met, ids = met[by], ids[by]
    rows, lists, queries = exact(rows[by], lists, queries)
    out = []
    for s in range(0, len(asked), step := max(1, SCORES // max(1, min(n, 4096)))):
        who, want, least = asked[s : s + step], queries[s : s + step], floor[s : s + step].astype(object)
        score = np.full((len(who), k), LEAST, object if want.dtype == object else float)
        found = np.zeros((len(who), k), np.int64)
        live, at, depth = np.arange(len(who)), 0, 1
        while len(live) and at < n:
            end = int(np.searchsorted(met, depth))
            for b in range(at, end, 4096):
                block = slice(b, min(end, b + 4096))
                got = want[live] @ rows[block].T
                taken += got.size
                got[who[live, None] == ids[None, block]] = LEAST
                edge = np.maximum(score[live, k - 1], np.partition(got, -k, axis=1)[:, -k]) if got.shape[1] > k else score[live, k - 1]
                q, r = np.nonzero((got >= edge[:, None]) & (got > LEAST))
                q2, r2 = np.nonzero(score[live] > LEAST)
                own = np.concatenate([q, q2])
                value = np.concatenate([got[q, r], score[live[q2], r2]])
                name = np.concatenate([ids[block][r], found[live[q2], r2]])
                first = np.lexsort((name, -value, own))
                own, value, name = own[first], value[first], name[first]
                place = np.arange(len(own)) - np.searchsorted(own, own)
                keep = place < k
                score[live[own[keep]], place[keep]] = value[keep]
                found[live[own[keep]], place[keep]] = name[keep]
            at = end
            if 2 * depth < n and at < n:
                most = bounds(want[live], lists[n - 1 - depth], lists[depth])
                kth = np.array([max(int(a), int(b)) for a, b in zip(score[live, k - 1], least[live], strict=True)], object)
                live = live[most.astype(object) >= kth]
            depth *= 2
        q, r = np.nonzero(score > LEAST)
        out.append((who[q], found[q, r], score[q, r]))
    q, name, score = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ([], [], [])))
    return q, name, score, taken


def depths(x: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """How many sampled rows are at least as near to an end of the list in which a row is nearest to one."""
    out = np.full(len(x), len(lists))
    for j in range(x.shape[1]):
        above = len(lists) - np.searchsorted(lists[:, j], x[:, j], side="left")
        below = np.searchsorted(lists[:, j], x[:, j], side="right")
        out = np.minimum(out, np.minimum(above, below))
    return out


def _layers(lists, cuts: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                layer = np.searchsorted(cuts, depths(whole(batch.column("vector"), len(batch), scale), lists.value), side="left")
                yield pa.RecordBatch.from_arrays([pa.array(layer.astype(np.int32)), batch.column("id"), batch.column("vector")], names=["layer", "id", "vector"])

    return run


def _open(high: np.ndarray, low: np.ndarray, scale: int):
    """Queries for which a row within these extremes could still be among the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                queries, top, bottom = exact(whole(batch.column("vector"), len(batch), scale), high, low)
                kth = batch.column("floor").to_pylist()
                yield batch.filter(pa.array([f is None or int(m) >= f for m, f in zip(bounds(queries, top, bottom), kth, strict=True)]))

    return run


def _search(k: int, scale: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        cols = [[], [], []]
        if len(index) and len(queries):
            floor = np.array([LEAST if f is None else f for f in queries.column("floor").to_pylist()], np.int64)
            cols = search(index.column("id").to_numpy(), whole(index.column("vector"), len(index), scale), queries.column("query").to_numpy(), whole(queries.column("vector"), len(queries), scale), floor, k)[:3]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array([int(x) for x in cols[2]], pa.int64())})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_inner_products(
    vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256,
    part_rows: int = PART_ROWS, query_rows: int = QUERY_ROWS, sample: int = SAMPLE, growth: int = GROWTH,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product with each query, exactly, ties to smaller ids.

    A component x counts as ``floor(scale * x)``; scores are integers and need to fit in 64 bits,
    else the job fails.  A row never finds itself, which is to say no row with its id.

    Defined cases: vectors that are null, hold a null or non-finite component or have other than the
    usual number of components (that of most rows, the smaller on a tie) take no part, nor do
    rows with a null id.  Rows with equal ids are candidates and queries each, but results of queries
    with one id can't be told apart and are ranked together.  With fewer than ``k`` candidates all are
    returned.  An empty table gives an empty table.  Other columns are not read.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    spark = vectors.sparkSession
    kind = "float" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "double"
    pick = lambda df: df.select(column(id_col).cast("long").alias("id"), column(vector_col).cast(f"array<{kind}>").alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    usual = pick(vectors).groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if usual is None or not usual.dim:
        return empty
    rows, asked = (pick(df).filter(F.size("vector") == usual.dim) for df in (vectors, queries))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
    some = whole(some.column(0), len(some), scale)
    lists = np.sort(some, axis=0)
    share, cuts, met = part_rows / usual.n, [], np.sort(depths(some, lists))
    while share < 1:
        cuts.append(met[int(share * len(met))])
        share += growth ** len(cuts) * part_rows / usual.n
    index = materialize(rows.mapInArrow(_layers(spark.sparkContext.broadcast(lists), np.unique(cuts), scale), f"layer int, id long, vector array<{kind}>"), "top-lists")
    ends = [f(F.get("vector", F.lit(j))) for j in range(usual.dim) for f in (F.max, F.min)]
    made = {r.layer: r for r in index.groupBy("layer").agg(F.count("*").alias("n"), F.array(*ends).alias("ends")).collect()}  # a row a layer
    best = None
    asked = materialize(asked.select(F.col("id").alias("query"), "vector"), "top-queries")
    for layer in sorted(made):
        deeper = np.floor(np.array([made[x].ends for x in made if x >= layer], np.float64).reshape(-1, usual.dim, 2) * scale)
        high, low = deeper[:, :, 0].max(0), deeper[:, :, 1].min(0)
        now = asked.withColumn("floor", F.lit(None).cast("long"))
        if best is not None:
            kth = best.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("floor"))
            now = asked.join(kth, F.col("query") == F.col("query_id"), "left").select("query", "vector", "floor")
            now = materialize(now.mapInArrow(_open(high, low, scale), now.schema), "top-open")
        n = now.count()
        if not n:
            break
        parts, blocks = -(-made[layer].n // part_rows), -(-n // query_rows)
        mine = index.filter(F.col("layer") == layer).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        theirs = now.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        found = mine.groupBy("part", "block").cogroup(theirs.groupBy("part", "block")).applyInArrow(_search(k, scale), "query_id long, vec_id long, score long")
        best = materialize(_best(found if best is None else best.drop("rank").union(found), k), "top-best")
    return empty if best is None else best.select("query_id", "rank", "vec_id", "score")


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_inner_products(rows, rows.filter("vec_id % 50 = 0"))


OP13_SQL = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS INTEGER) AS rank,
  c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
FROM kept q JOIN kept c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
QUALIFY rank <= 5
"""

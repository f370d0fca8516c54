"""SimHash near-dedup by tiled exact comparison (operator 10).

Fingerprints within ``radius`` bits of each other have population counts that
differ by ``radius`` at most, in the whole and summed over any segments of the
word.  A tile holds the distinct fingerprints with the same population count in
each of ``segments`` segments; a pair of tiles whose counts differ by more than
the radius is never met, every other pair is compared exactly by numpy's
exclusive-or and bit counts.  A task compares a bounded block of a tile with a
bounded block of what may link to it, and gives a spanning forest of the links
found, never all pairs.  Equal fingerprints are one node throughout, so groups
of exact copies cost nothing.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import column, join_by_key, materialize, small_batches, table, unused
from tessella.llm.graph import Forest, connected_components

#: Fingerprints of a tile, and of what it is compared with, that one task takes.
TILE, STREAM = 4096, 65536
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash as a signed integer; zero if there is no word."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n <= 1:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[k : len(words) - shingle + 1 + k] for k in range(shingle)), strict=True))
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for _ in range(0, n, BLOCK):
        raw = b"".join([digest(s, 42) for s in islice(shingles, BLOCK)])
        counts += _bit_counts(np.frombuffer(raw, np.uint8).reshape(-1, 8))
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def _bit_counts(rows: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, the highest first."""
    bits = np.unpackbits(rows, axis=1)
    total = np.zeros(64, np.int64)
    for k in range(0, len(bits), 255):  # sums of 255 bits fit in a byte
        total += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return total


def simhash_column(text, shingle: int = 3):
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "long")(text)


def _steps(segments: int, radius: int) -> list[tuple[int, ...]]:
    """Of two opposite differences of counts within the radius, the one whose first non-zero entry is positive."""
    out, reach = [], range(-radius, radius + 1)

    def grow(head: tuple[int, ...], left: int) -> None:
        if len(head) == segments:
            if (first := next((x for x in head if x), 0)) > 0:
                out.append(head)
            return
        for x in reach:
            if abs(x) <= left:
                grow((*head, x), left - abs(x))

    grow((), radius)
    return out


def _segments(n: int) -> int:
    """More segments mean fewer comparisons and more copies of each fingerprint; the links are the same."""
    return 4 if n < 50_000_000 else 8 if n < 2_000_000_000 else 16


def links(fps: DataFrame, *, radius: int = 2, segments: int | None = None, tile: int = TILE, stream: int = STREAM) -> DataFrame:
    """Links ``a``, ``b`` that connect the distinct fingerprints ``fp`` as all pairs within the radius do."""
    width = 64 // (segments := segments or _segments(fps.count()))
    counts = [F.bit_count(F.shiftrightunsigned(F.col("fp"), width * k).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))) for k in range(segments)]
    cells = fps.select("fp", *[c.cast("int").alias(f"c{k}") for k, c in enumerate(counts)])
    keys = [f"c{k}" for k in range(segments)]

    def moved(step: tuple[int, ...], own: bool):
        return F.struct(*[(F.col(k) + F.lit(x)).cast("int").alias(k) for k, x in zip(keys, step, strict=True)], F.lit(own).alias("own"))

    zero = (0,) * segments
    met = cells.select("fp", F.explode(F.array(*[moved(s, False) for s in _steps(segments, radius)], moved(zero, True))).alias("m")).select("fp", "m.*")
    homes = cells.groupBy(*keys).agg(F.count("*").alias("homes"))
    load = met.groupBy(*keys).agg(F.count("*").alias("load"))
    plan = homes.join(load, keys).select(*keys, F.ceil(F.col("homes") / tile).cast("int").alias("tiles"), F.ceil(F.col("load") / stream).cast("int").alias("streams"))
    # A tile has at most (width + 1) ** segments keys; up to four segments that is under 90,000 rows.
    met = met.join(F.broadcast(plan) if segments <= 4 else plan, keys)
    home = met.filter("own").select("fp", *keys, F.lit(True).alias("own"), F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("streams") - 1)).alias("stream"))
    seen = met.select("fp", *keys, F.lit(False).alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.pmod(F.xxhash64("fp", F.lit(7)), F.col("streams")).cast("int").alias("stream"), F.col("own").alias("same"))
    rows = home.withColumn("same", F.lit(True)).select("fp", "own", "same", *keys, "tile", "stream").union(seen.select("fp", "own", "same", *keys, "tile", "stream"))
    by = rows.groupBy(*keys, "tile", "stream")
    return by.applyInArrow(_compare(radius), "a long, b long")


def _compare(radius: int):
    def run(rows: pa.Table) -> pa.Table:
        fp = rows.column("fp").to_numpy().view(np.uint64)
        own, same = (rows.column(c).to_numpy() for c in ("own", "same"))
        mine, others, inside = fp[own], fp[~own], same[~own]
        forest = Forest()
        step = max(1, (1 << 20) // max(1, len(mine)))
        for k in range(0, len(others), step):
            part = others[k : k + step]
            near = np.bitwise_count(part[:, None] ^ mine[None, :]) <= radius
            i, j = np.nonzero(near)
            keep = (part[i] != mine[j]) & (~inside[k : k + step][i] | (part[i] > mine[j]))
            for a, b in zip(part[i[keep]].view(np.int64).tolist(), mine[j[keep]].view(np.int64).tolist(), strict=True):
                forest.join(a, b)
        a, b = forest.star()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``id_col, fp (long), component_id`` for every row: the smallest id that links of ``radius`` bits reach.

    Shingles are ``shingle`` words, with A-Z lower-cased; a shorter text is one shingle.

    Defined cases: a text without words, empty or null has fingerprint zero and
    links like any other.  Rows with the same id are judged each by its own text.
    Null ids are never a component's id unless all its ids are null.  An empty table
    gives an empty table.  Other columns of ``docs`` are not read.
    """
    small_batches(docs.sparkSession)
    if id_col.lower() in ("fp", "component_id"):
        raise ValueError(f"{id_col} is the name of a result; rename the id column")
    prints = materialize(docs.select(column(id_col).alias("id"), simhash_column(column(text_col), shingle).alias("fp")), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = connected_components(links(nodes.select("fp"), radius=radius))
    groups = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    names = groups.filter("fp <> root or least is null").groupBy("root").agg(F.min("least").alias("low"))
    groups = groups.join(names, "root", "left").join(nodes.select(F.col("fp").alias("root"), F.col("least").alias("root_least")), "root", "left")
    groups = materialize(groups.select("fp", "n", F.least("low", "root_least").alias("component_id")), "groups")
    total = groups.agg(F.sum("n").alias("n")).first().n or 0
    return join_by_key(prints, groups, "fp", "n", total).select(F.col("id").alias(id_col), "fp", "component_id")


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; rows with equal ids stay together.

    Rows with a null id stay if all ids of a group of theirs are null.  Other columns may have any name.
    """
    kept_id = unused(docs.columns, "kept_id")[0]
    groups = simhash_groups(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), id_col="id", text_col="text", shingle=shingle, radius=radius)
    keep = groups.filter(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(kept_id)).distinct()
    known = docs.join(keep.filter(F.col(kept_id).isNotNull()), column(id_col) == F.col(kept_id), "left_semi")
    null = F.broadcast(keep.filter(F.col(kept_id).isNull()))  # one row at most; its documents stay where they are
    return known.union(docs.filter(column(id_col).isNull()).join(null, column(id_col).eqNullSafe(F.col(kept_id)), "left_semi"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

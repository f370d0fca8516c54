"""Column statistics: three passes for all numeric columns, one job for all categorical ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import quoted
from tessella.operators import blocks

PROBS = (0.01, 0.25, 0.5, 0.75, 0.99)
QUANTILES = ("p01", "p25", "median", "p75", "p99")
TOP_LEVELS = 200


def column_stats(df: DataFrame, columns: Sequence[str], *, quantiles: bool = True) -> tuple[list[dict], blocks.Summary]:
    """The statistics of each column, zeros where all is missing, and the summary they come from; quantiles are exact."""
    m = blocks.summarise(df, columns)
    found = np.nan_to_num(blocks.quantiles(df, columns, PROBS, summary=m)[0]) if quantiles else np.zeros((len(columns), len(PROBS)))
    sd, skewness = np.sqrt(m.m2 / np.maximum(m.n - 1, 1)), m.skewness()
    out = []
    for k, c in enumerate(columns):
        ends = (m.low[k], m.high[k]) if m.n[k] else (0.0, 0.0)
        figures = (m.mean[k], sd[k], *ends, *found[k], skewness[k])
        out.append({"column": c, "n": int(m.n[k]), "missing": int(m.rows - m.n[k])} | dict(zip(("mean", "sd", "min", "max", *QUANTILES, "skewness"), map(float, figures), strict=True)))
    return out, m


def numeric_stats(df: DataFrame, columns: Sequence[str], *, quantiles: bool = True) -> DataFrame:
    """A row a column: ``column, n, missing, mean, sd, min, max, p01 ... p99, skewness``."""
    rows = column_stats(df, columns, quantiles=quantiles)[0]
    kinds = "column string, n long, missing long, " + ", ".join(f"{n} double" for n in ("mean", "sd", "min", "max", *QUANTILES, "skewness"))
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], kinds)


def long_values(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """``keep..., column, value``: all columns as strings, a row a cell; one pass, no shuffle."""
    names = ", ".join("'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'" for c in columns)
    cells = ", ".join(f"CAST({quoted(c)} AS STRING)" for c in columns)
    return df.select(*keep, F.expr(f"posexplode(array({cells}))").alias("k", "value")).select(*keep, F.expr(f"get(array({names}), k)").alias("column"), "value")


def level_counts(df: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """``column, value, n, first_row`` of every level that isn't missing."""
    return long_values(df, columns, row_id).filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"), F.min(row_id).alias("first_row"))


#: Groups of levels that are ranked apart before a column's best meet.
PARTS = 64


def top_rows(df: DataFrame, by: str, order: Sequence[Column], spread: Column, n: int) -> DataFrame:
    """The first ``n`` rows of each ``by`` with their ``rank``; groups by a hash of ``spread`` are cut to ``n`` first, so no task orders all rows of one ``by``."""
    part = df.withColumn("part", F.pmod(F.xxhash64(spread), F.lit(PARTS)))
    few = part.withColumn("rank", F.row_number().over(Window.partitionBy(by, "part").orderBy(*order))).filter(F.col("rank") <= n)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= n).drop("part")


def category_stats(df: DataFrame, columns: Sequence[str], row_id: str, *, top: int = TOP_LEVELS) -> DataFrame:
    """The ``top`` levels of each column: ``column, rank, value, n, distinct``; ties by first appearance."""
    counts = level_counts(df, columns, row_id)
    best = top_rows(counts, "column", [F.desc("n"), F.col("first_row"), F.col("value")], F.col("value"), top)
    sizes = counts.groupBy("column").agg(F.count("*").alias("distinct"))
    return best.join(F.broadcast(sizes), "column").select("column", "rank", "value", "n", "distinct")  # a row a column


def dictionary_codes(df: DataFrame, column: str, row_id: str, *, cap: int = 20_000) -> DataFrame:
    """``value, code``: levels numbered by first appearance; those beyond ``cap`` get no code and count as missing."""
    first = level_counts(df, [column], row_id)
    coded = top_rows(first, "column", [F.col("first_row"), F.col("value")], F.col("value"), cap)  # at most ``cap`` rows
    return first.join(F.broadcast(coded.select("value", (F.col("rank") - 1).alias("code"))), "value", "left").select("value", "code")


def _first_levels(width: int, keep: int):
    """A task's levels of each column that come first, ``keep`` at most, with their first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, int]] = [{} for _ in range(width)]

        def cut(own: dict[str, int]) -> dict[str, int]:
            return dict(sorted(own.items(), key=lambda x: (x[1], x[0]))[:keep])

        for batch in batches:
            for k, own in enumerate(held):
                part = pa.table({"v": batch.column(k), "r": batch.column(width)}).group_by("v").aggregate([("r", "min")])
                for value, row in zip(part.column("v").to_pylist(), part.column("r_min").to_pylist(), strict=True):
                    if value is not None and row < own.get(value, row + 1):
                        own[value] = row
                # A level that is cut has its first row beyond all that stay; met again, it is cut again.
                if len(own) > 2 * keep:
                    held[k] = cut(own)
        for k, own in enumerate(held):
            own = cut(own)
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), pa.int32()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["k", "value", "first_row"])

    return run


def first_levels(df: DataFrame, columns: Sequence[str], row_id: str, cap: int) -> DataFrame:
    """``k, value, first_row``: of each column (by place) the ``cap + 1`` levels that appear first in the table, and perhaps some more.

    A level among the first of the table is among the first of its task, so tasks send ``cap + 1`` each:
    whether there are more than ``cap`` is told exactly, however many there are.
    """
    rows = df.select(*[F.col(quoted(c)).cast("string").alias(f"v{k}") for k, c in enumerate(columns)], F.col(quoted(row_id)).cast("long").alias("row"))
    found = rows.mapInArrow(_first_levels(len(columns), cap + 1), "k int, value string, first_row long")
    return found.groupBy("k", "value").agg(F.min("first_row").alias("first_row"))


def all_missing(columns: Sequence[str]) -> Column:
    """Rows in which every one of the columns is missing."""
    return F.expr(" AND ".join(f"{quoted(c)} IS NULL" for c in columns))


def effective_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    empty = F.count_if(all_missing(columns)) if columns else F.lit(0).cast("long")
    return df.agg(F.count("*").alias("n_rows"), empty.alias("empty_rows")).withColumn("effective_rows", F.col("n_rows") - F.col("empty_rows"))


def systematic(df: DataFrame, row_id: str, cap: int, n: int | None = None) -> DataFrame:
    """Every ceil(n / cap)-th row by a dense id from 0, at most ``cap`` rows; ``n`` is counted unless it is known."""
    n = df.count() if n is None else n
    stride = -(-n // cap) if cap and n > cap else 1
    return df.filter(F.col(row_id) % stride == 0) if stride > 1 else df


def hash_sample(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, the same whatever the partitions: the smallest by a hash of seed and id."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(row_id)), row_id).limit(n)

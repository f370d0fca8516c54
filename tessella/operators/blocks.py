"""Statistics and exact quantiles of many numeric columns at once.

The columns of an Arrow batch are one matrix, so a task's work and a plan's size don't depend on an
expression a column.  Three passes, whatever the numbers of columns, groups and shares asked for:

1. each task sums up its matrix (counts, moments about its own means, extremes, moments of the log
   map, and some of its rows as a sketch); summaries of tasks are merged in a tree;
2. the merged sketch gives cuts for each column, and tasks count the values of every group between
   and at the cuts.  The counts, which are exact, say in which bin each wanted place lies; a place in the
   bin of a cut is that value;
3. the values of the other bins that hold a wanted place, and of no others, are counted by value and
   shuffled by bin; a bin is cut into slices, which are summed before one of them is put in order.

Cuts decide what is counted where, never a result: quantiles are exact at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import quoted

#: Sketched values of a column that a task sends, and rows that a batch gives to them.
POINTS, ROWS = 128, 256
#: Cuts of a column, at most; bins of all columns together, at most (counts of 8 bytes in a task, for each group).
CUTS, BINS = 1024, 200_000
#: Summaries that meet on the driver, at most, and slices of a bin.
FAN, SLICES = 16, 256
#: Values in all wanted bins that are put in order on the driver (24 bytes each); more are shuffled.
FEW = 500_000
#: Values that a task counts by value before it sends them on.
HELD = 1 << 20


#: A column that holds many numeric ones as an array; its metadata has their names.
BLOCK = "__block"


def matrix_of(batch: pa.RecordBatch, columns: Sequence[int]) -> np.ndarray:
    """Columns, by place, as a matrix of doubles, NaN where missing; places in the array if the first column is one."""
    if len(batch.schema) and pa.types.is_list(batch.schema.field(0).type):
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        out = flat.reshape(len(batch), -1)
        return out if list(columns) == list(range(out.shape[1])) else out[:, list(columns)]
    out = np.empty((len(batch), len(columns)), order="F")
    for k, at in enumerate(columns):
        out[:, k] = batch.column(at).to_numpy(zero_copy_only=False)
    return out


@dataclass
class Summary:
    """Of some rows, for each column: arrays as long as there are columns; ``points`` has rows of ``POINTS`` sketched values."""

    rows: int
    n: np.ndarray
    mean: np.ndarray
    m2: np.ndarray
    m3: np.ndarray
    low: np.ndarray
    high: np.ndarray
    log_mean: np.ndarray
    log_m2: np.ndarray
    points: np.ndarray

    NAMES = ("n", "mean", "m2", "m3", "low", "high", "log_mean", "log_m2", "points")

    def add(self, o: Summary) -> Summary:
        """Both together; moments by the formulas for two groups, exact whatever the means."""
        n = self.n + o.n
        part = np.divide(o.n, n, out=np.zeros(len(n)), where=n > 0)
        gap, log_gap = o.mean - self.mean, o.log_mean - self.log_mean
        both = self.n * part
        m3 = self.m3 + o.m3 + gap**3 * both * (1 - 2 * part) + 3 * gap * ((1 - part) * o.m2 - part * self.m2)
        return Summary(
            self.rows + o.rows, n, self.mean + gap * part, self.m2 + o.m2 + gap * gap * both, m3, np.fmin(self.low, o.low), np.fmax(self.high, o.high),
            self.log_mean + log_gap * part, self.log_m2 + o.log_m2 + log_gap * log_gap * both, blend(self.points, self.n, o.points, o.n),
        )

    def skewness(self) -> np.ndarray:
        """Population skewness; 0 for less than three values or none that differ."""
        ok = (self.n > 2) & (self.m2 > 0)
        return np.divide(np.sqrt(self.n) * self.m3, np.where(ok, self.m2, 1.0) ** 1.5, out=np.zeros(len(self.n)), where=ok)


def blend(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sketches of two groups of ``n`` and ``m`` values as one: its points are spread evenly over the weights of both."""
    x = np.concatenate([a, b], axis=1)
    w = np.concatenate([np.repeat(n[:, None], a.shape[1], 1), np.repeat(m[:, None], b.shape[1], 1)], axis=1).astype(float)
    order = np.argsort(x, axis=1, kind="stable")
    x, w = np.take_along_axis(x, order, 1), np.cumsum(np.take_along_axis(w, order, 1), axis=1)
    total = np.maximum(w[:, -1:], 1e-300)
    out = np.empty_like(a)
    for k in range(len(out)):
        out[k] = x[k, np.minimum(np.searchsorted(w[k] / total[k], (np.arange(a.shape[1]) + 0.5) / a.shape[1]), x.shape[1] - 1)]
    return np.where(np.isnan(out), np.where(np.isnan(a), b, a), out)


def _summary(x: np.ndarray) -> Summary:
    """Of one matrix of one row or more; columns without a value have zeros and NaN."""
    live = ~np.isnan(x)
    n = live.sum(0)
    some = np.maximum(n, 1)
    full = bool(live.all())
    held = lambda v: v if full else np.where(live, v, 0.0)
    mean = held(x).sum(0) / some
    mean = mean + held(x - mean).sum(0) / some  # the mean of what rounding left
    rest = held(x - mean)
    m2 = np.einsum("ij,ij->j", rest, rest)
    m3 = np.einsum("ij,ij,ij->j", rest, rest, rest)
    logs = np.log1p(np.maximum(held(x), 0.0))
    log_mean = logs.sum(0) / some
    rest = held(logs - log_mean)
    few = np.sort(x[:: -(-len(x) // ROWS)], axis=0)  # NaN last
    at = ((np.arange(POINTS) + 0.5)[:, None] * (~np.isnan(few)).sum(0) / POINTS).astype(int)
    points = np.take_along_axis(few, np.minimum(at, len(few) - 1), axis=0).T
    ends = (x.min(0), x.max(0)) if full else (np.fmin.reduce(x, axis=0), np.fmax.reduce(x, axis=0))
    return Summary(len(x), n, mean, m2, m3, *ends, log_mean, np.einsum("ij,ij->j", rest, rest), np.ascontiguousarray(points))


def take(s: Summary, columns: Sequence[int]) -> Summary:
    """The summary of some of the columns."""
    return Summary(s.rows, *(getattr(s, name)[list(columns)] for name in Summary.NAMES))


def _pack(s: Summary) -> pa.RecordBatch:
    cells = [np.asarray(getattr(s, name), np.float64).tobytes() for name in Summary.NAMES]
    return pa.RecordBatch.from_arrays([pa.array([s.rows], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names=["rows", *Summary.NAMES])


def _unpack(batch: pa.RecordBatch | pa.Table) -> Iterator[Summary]:
    for r in batch.to_pylist():
        cells = [np.frombuffer(r[name], np.float64) for name in Summary.NAMES]
        yield Summary(r["rows"], *cells[:-1], cells[-1].reshape(len(cells[0]), -1))


def _merged(found: Iterator[Summary]) -> Summary | None:
    out = None
    for s in found:
        out = s if out is None else out.add(s)
    return out


def _summaries(places: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _merged(_summary(matrix_of(b, places)) for b in batches if len(b))
        if found:
            yield _pack(found)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _merged(s for b in batches for s in _unpack(b))
    if found:
        yield _pack(found)


def block_names(df: DataFrame) -> list[str]:
    """The columns that ``df`` also holds as one array."""
    return df.schema[BLOCK].metadata.get("names", []) if BLOCK in df.columns else []


def with_block(df: DataFrame, columns: Sequence[str], *others: str) -> DataFrame:
    """``others`` and, as one array, the double ``columns``: a form that is written and read much faster than many columns."""
    return df.selectExpr(*[quoted(c) for c in others], f"array({', '.join(map(quoted, columns))}) AS {BLOCK}")


def unpacked(df: DataFrame, columns: Sequence[str], *others: str) -> DataFrame:
    """``others`` and the columns of a table that :func:`with_block` made, with the array beside them."""
    cells = [f"get({BLOCK}, {k}) AS {quoted(c)}" for k, c in enumerate(columns)]
    return df.selectExpr(*[quoted(c) for c in others], *cells, BLOCK).withMetadata(BLOCK, {"names": list(columns)})


def doubles(df: DataFrame, columns: Sequence[str], *others: str) -> tuple[DataFrame, list[int]]:
    """The columns as doubles, NULL for NaN, and ``others`` (SQL); with the places of the columns in a row's matrix."""
    names = block_names(df)
    if names and set(columns) <= set(names):
        return df.selectExpr(BLOCK, *others), [names.index(c) for c in columns]
    cells = [f"nanvl(CAST({quoted(c)} AS DOUBLE), CAST(NULL AS DOUBLE)) AS x{k}" for k, c in enumerate(columns)]
    return df.selectExpr(*cells, *others), list(range(len(columns)))


def summarise(df: DataFrame, columns: Sequence[str]) -> Summary:
    """Over all rows, in one pass; a summary a task, merged in a tree."""
    schema = ", ".join(["rows long", *(f"{n} binary" for n in Summary.NAMES)])
    rows, places = doubles(df, columns)
    parts = rows.mapInArrow(_summaries(places), schema)
    parts = parts.repartition(FAN, F.spark_partition_id() % FAN).mapInArrow(_merge, schema)
    found = _merged(_unpack(parts.toArrow()))  # FAN rows at most
    return found or replace(_summary(np.full((1, len(columns)), np.nan)), rows=0)


def cuts_of(points: np.ndarray) -> list[np.ndarray]:
    """Cuts of each column, in order, from its sketch."""
    return [np.unique(p[~np.isnan(p)]) for p in points]


def bins_of(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """2 k + 1 for a value that is the k-th cut, 2 k for one between that and the cut before."""
    left = np.searchsorted(cuts, x, side="left")
    return 2 * left + (cuts[np.minimum(left, len(cuts) - 1)] == x) if len(cuts) else np.zeros(len(x), int)


def _places(batch: pa.RecordBatch, places: list[int], cuts: list[np.ndarray], width: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of a batch, and for each the number of its group, column and bin as one."""
    x = np.asfortranarray(matrix_of(batch, places))
    live = ~np.isnan(x)
    group = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.float64) if groups > 1 else np.zeros(len(x))
    live &= ((group >= 0) & (group < groups))[:, None]
    group = np.nan_to_num(group).astype(np.int64) * len(cuts)
    at = [((group + k) * width + bins_of(x[:, k], c))[live[:, k]] for k, c in enumerate(cuts)]
    return np.concatenate([x[live[:, k], k] for k in range(len(cuts))]), np.concatenate(at)


def _counts(places: list[int], cuts: list[np.ndarray], width: int, groups: int):
    """A task's counts, and its sums of each group and column."""
    size = groups * len(cuts) * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros(size, np.int64), np.zeros(groups * len(cuts))
        for batch in batches:
            if len(batch):
                x, at = _places(batch, places, cuts, width, groups)
                total += np.bincount(at, minlength=size)
                sums += np.bincount(at // width, x, minlength=len(sums))
        if total.any():
            yield _sent(total, sums)

    return run


def _sent(total: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    live = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (live, total[live], sums)], names=["at", "n", "sums"])


def _add_counts(rows: list[dict], size: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    total, sums = np.zeros(size, np.int64), np.zeros(cells)
    for r in rows:
        total[np.frombuffer(r["at"], np.int64)] += np.frombuffer(r["n"], np.int64)
        sums += np.frombuffer(r["sums"], np.float64)
    return total, sums


def _sum_counts(size: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros(size, np.int64), np.zeros(cells)
        for batch in batches:
            for r in batch.to_pylist():
                n, s = _add_counts([r], size, cells)
                total, sums = total + n, sums + s
        if total.any():
            yield _sent(total, sums)

    return run


def _gather(places: list[int], cuts: list[np.ndarray], width: int, groups: int, wanted: np.ndarray):
    """Values that lie in the ``wanted`` places, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            at, x = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((x, at))
            at, x = at[order], x[order]
            first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (x[1:] != x[:-1])])
            return pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(x[first]), pa.array(np.diff(np.r_[first, len(x)]))], names=["cell", "value", "n"])

        look = np.zeros(groups * len(cuts) * width, bool)
        look[wanted] = True
        for batch in batches:
            if len(batch):
                x, at = _places(batch, places, cuts, width, groups)
                hit = look[at]
                held.append((at[hit], x[hit]))
                n += int(hit.sum())
                if n > HELD:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return run


def _select(cells: DataFrame, wanted: list[tuple[int, int, float, float]]) -> dict[tuple[int, int], float]:
    """The value at each wanted place (cell, place in it, and the cell's bounds) of ``cell, value, n``."""
    spark = cells.sparkSession
    asks = spark.createDataFrame(wanted, "cell long, place long, low double, high double")
    edges = F.broadcast(asks.select("cell", "low", "high").distinct())  # two numbers a cell
    share = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))
    counts = cells.groupBy("cell", "value").agg(F.sum("n").alias("n")).join(edges, "cell")
    counts = counts.select("cell", "value", "n", F.coalesce(F.least(F.greatest((share * SLICES).cast("int"), F.lit(0)), F.lit(SLICES - 1)), F.lit(0)).alias("slice"))
    slices = counts.groupBy("cell", "slice").agg(F.sum("n").alias("k"))
    before = F.sum("k").over(Window.partitionBy("cell").orderBy("slice")) - F.col("k")
    slices = slices.withColumn("before", before).join(F.broadcast(asks.select("cell", "place")), "cell")
    hits = slices.filter((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("k")))
    inside = counts.join(F.broadcast(hits.select("cell", "slice", "before").distinct()), ["cell", "slice"])  # a row a place wanted, at most
    upto = F.sum("n").over(Window.partitionBy("cell", "slice").orderBy("value")) + F.col("before")
    inside = inside.withColumn("upto", upto).join(F.broadcast(asks.select("cell", "place")), "cell")
    found = inside.filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
    return {(r.cell, r.place): r.value for r in found.select("cell", "place", "value").collect()}  # a row a place wanted


def _select_few(cells: pa.Table, wanted: Sequence[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The same of a bounded table on the driver."""
    cell, value, n = (cells.column(c).to_numpy() for c in ("cell", "value", "n"))
    order = np.lexsort((value, cell))
    cell, value, n = cell[order], value[order], n[order]
    upto = np.cumsum(n)
    out = {}
    for c, place in wanted:
        first = int(np.searchsorted(cell, c))
        before = int(upto[first - 1]) if first else 0
        out[c, place] = float(value[np.searchsorted(upto, before + place, side="right")])
    return out


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], *, summary: Summary | None = None, group: str | None = None, groups: int = 1, means: bool = False):
    """The exact linear quantiles, ``[group, column, share]``; NaN for a column without values in a group.

    ``group`` names a column of whole numbers below ``groups``; rows of other or no group count nowhere.
    With ``means`` also the counts and means, ``[group, column]``.
    """
    summary = summary or summarise(df, columns)
    most = max(2, min(CUTS, BINS // (2 * len(columns)) - 1))
    cuts = [c[:: max(1, -(-len(c) // most))] for c in cuts_of(summary.points)]
    width = 2 * max(map(len, cuts), default=0) + 1
    size = groups * len(columns) * width
    rows, places = doubles(df, columns, *([f"CAST({quoted(group)} AS LONG) AS g"] if groups > 1 else []))
    schema = "at binary, n binary, sums binary"
    parts = rows.mapInArrow(_counts(places, cuts, width, groups), schema)
    parts = parts.repartition(FAN, F.spark_partition_id() % FAN).mapInArrow(_sum_counts(size, groups * len(columns)), schema)
    counts, sums = _add_counts(parts.toArrow().to_pylist(), size, groups * len(columns))  # FAN rows at most
    upto = np.cumsum(counts.reshape(-1, width), axis=1)
    n = upto[:, -1]
    place = np.maximum(n - 1, 0)[:, None] * np.asarray(shares)[None]
    whole = np.stack([np.floor(place), np.ceil(place)]).astype(np.int64)  # [which, group and column, share]
    values = np.full(whole.shape, np.nan)
    open_: dict[tuple[int, int], list] = {}
    for cell in np.flatnonzero(n):
        own = cuts[cell % len(columns)]
        bins = np.searchsorted(upto[cell], whole[:, cell], side="right")
        for at in np.ndindex(bins.shape):
            b = bins[at]
            if b % 2:
                values[at[0], cell, at[1]] = own[b // 2]
            else:
                low = own[b // 2 - 1] if b else summary.low[cell % len(columns)]
                high = own[b // 2] if b // 2 < len(own) else summary.high[cell % len(columns)]
                key = (int(cell * width + b), int(whole[at[0], cell, at[1]] - (upto[cell, b - 1] if b else 0)))
                open_.setdefault(key, [float(low), float(high), []])[2].append((at[0], cell, at[1]))
    if open_:
        wanted = np.unique([c for c, _ in open_])
        cells = rows.mapInArrow(_gather(places, cuts, width, groups, wanted), "cell long, value double, n long")
        if counts[wanted].sum() <= FEW:  # as is known before they are read
            found = _select_few(cells.toArrow(), list(open_))
        else:
            found = _select(cells, [(c, p, low, high) for (c, p), (low, high, _) in open_.items()])
        for key, (_, _, ats) in open_.items():
            for at in ats:
                values[at] = found[key]
    part = place - whole[0]
    out = values[0] * (1 - part) + values[1] * part
    out = np.where(whole[0] == whole[1], values[0], out).reshape(groups, len(columns), len(shares))
    shape = (groups, len(columns))
    return (out, n.reshape(shape), (sums / np.maximum(n, 1)).reshape(shape)) if means else out


def summed(df: DataFrame, part: Callable[[np.ndarray], tuple[np.ndarray, ...]], merge: Callable, rows_of: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[np.ndarray, ...] | None:
    """What ``part`` makes of the rows of each batch, put together by ``merge`` in tasks and in a tree."""

    def packed(found: tuple[np.ndarray, ...] | None) -> Iterator[pa.RecordBatch]:
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[np.asarray(x, float).tobytes() for x in found]], pa.list_(pa.binary())), pa.array([[list(np.shape(x)) for x in found]], pa.list_(pa.list_(pa.int64())))], names=["cells", "shapes"])

    def unpacked(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        for r in batch.to_pylist():
            yield tuple(np.frombuffer(c, float).reshape(s) for c, s in zip(r["cells"], r["shapes"], strict=True))

    def together(found: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...] | None:
        out = None
        for x in found:
            out = x if out is None else merge(out, x)
        return out

    schema = "cells array<binary>, shapes array<array<bigint>>"
    parts = df.mapInArrow(lambda batches: packed(together(part(rows_of(b)) for b in batches if len(b))), schema)
    parts = parts.repartition(FAN, F.spark_partition_id() % FAN).mapInArrow(lambda batches: packed(together(x for b in batches for x in unpacked(b))), schema)
    return together(unpacked(parts.toArrow()))  # FAN rows at most

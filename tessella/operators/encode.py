"""Feature encoding: every dimension is a rule with fitted parameters.

A rule is a Column expression, or a step of a kernel that encodes a whole block of columns in one
pass over Arrow batches; both give the same values.  A few dimensions are expressions in
generated code, more than ``WIDE`` go through the kernel, whose plan doesn't grow with them.

Every source column adds a total variance of about one, times its weight: each of its
dimensions is scaled by weight / sqrt(dimensions).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.scalars import clip, log_map, probit, probit_array, quoted
from tessella.operators.blocks import BLOCK, Summary, block_names
from tessella.operators.stats import category_stats, column_stats
from tessella.spec import DOUBLE_KINDS, ColumnSpec

# Fixed values of the encoding.
MISSING_SUFFIX, OTHER = "（未入力）", "その他"
LIMIT, MIN_MISSING, MAX_MISSING, MAX_LEVELS, KNOTS = 6.0, 0.02, 0.70, 30, 20_000
#: Distinct values of one range of ranks, about.
BUCKET = 250_000
#: Dimensions that are encoded by expressions, at most.
WIDE = 40


@dataclass(frozen=True)
class Rule:
    """How a dimension follows from its source column ``name``.

    ``kind`` is ``plain`` or ``log`` ((x - center) / scale, held within -6 and 6), ``ranks`` (normal score
    of the rank), each ``middle`` where x is missing; or an indicator with the share ``center`` of
    ones: ``missing``, ``level`` (x is the one of ``levels``) or ``other`` (x is none of them).
    """

    kind: str
    name: str
    center: float = 0.0
    scale: float = 1.0
    middle: float = 0.0
    size: float = 1.0
    levels: tuple[str, ...] = ()
    ranks: Ranks | None = None

    def column(self, known: Column | None = None) -> Column:
        """``known``: how many values are below, where ranks were looked up."""
        c = F.col(quoted(self.name))
        if self.kind in ("plain", "log", "ranks"):
            value = clip(self.ranks.normal(c, known)) if self.kind == "ranks" else scaled(log_map(c) if self.kind == "log" else c, self.center, self.scale)
            # Not coalesce: what is clipped is never null, since greatest and least pass over nulls.
            return F.when(c.isNull(), F.lit(float(self.middle))).otherwise(value) * self.size
        if self.kind == "missing":
            hit = c.isNull()
        else:
            hit = F.coalesce(c.isin(*self.levels), F.lit(False))
            hit = c.isNotNull() & ~hit if self.kind == "other" else hit
        return indicator(hit, self.center) * self.size

    def array(self, x: pa.Array | np.ndarray, known: pa.Array | None = None) -> np.ndarray:
        """The dimension of the column's cells; doubles may come as an array with NaN for missing."""
        if self.kind in ("plain", "log", "ranks"):
            v = x if isinstance(x, np.ndarray) else x.to_numpy(zero_copy_only=False).astype(np.float64)
            gone = np.isnan(v)
            if self.kind == "ranks":
                v = self.ranks.scores(v, None if known is None else known.to_numpy(zero_copy_only=False).astype(np.float64))
            else:
                v = ((np.log1p(np.maximum(v, 0.0)) if self.kind == "log" else v) - self.center) / self.scale
            return np.where(gone, self.middle, np.clip(v, -LIMIT, LIMIT)) * self.size
        if self.kind == "missing":
            hit = pa.array(np.isnan(x)) if isinstance(x, np.ndarray) else x.is_null()
        else:
            hit = pc.fill_null(pc.is_in(x, pa.array(self.levels, x.type)), False)
            hit = pc.and_(x.is_valid(), pc.invert(hit)) if self.kind == "other" else hit
        return (hit.to_numpy(zero_copy_only=False).astype(np.float64) - self.center) / spread(self.center) * self.size


@dataclass(frozen=True)
class Feature:
    """One dimension: its source column, label, level (for a one-hot) and rule."""

    column: str
    label: str
    level: str | None
    rule: Rule

    @property
    def value(self) -> Column:
        return self.rule.column()

    @property
    def looked_up(self) -> bool:
        """Whether its ranks are in a table."""
        return self.rule.ranks is not None and self.rule.ranks.table is not None


def choose_transform(spec: ColumnSpec, s: dict) -> str:
    """The transform of a numeric column from its statistics."""
    if spec.transform != "auto":
        return spec.transform
    if spec.kind in ("datetime", "boolean") or not s["n"] or not s["sd"]:
        return "standard"
    spread, iqr = s["p99"] - s["p01"], s["p75"] - s["p25"]
    if abs(s["skewness"]) > 8 or (spread > 0 and (s["max"] - s["min"]) / spread > 20):
        return "quantile"
    if s["skewness"] > 1.2 and s["min"] >= 0:
        return "log"
    return "robust" if iqr > 0 and spread / iqr > 12 else "standard"


def transform_rule(kind: Column, s: dict[str, Column]) -> Column:
    """The automatic choice as one expression over a table of statistics."""
    spread, iqr = s["p99"] - s["p01"], s["p75"] - s["p25"]
    wide = F.coalesce((s["max"] - s["min"]) / F.when(spread > 0, spread) > 20, F.lit(False))
    return (
        F.when(kind.isin("datetime", "boolean") | (s["n"] == 0) | (s["sd"] == 0), "standard")
        .when((F.abs(s["skewness"]) > 8) | wide, "quantile")
        .when((s["skewness"] > 1.2) & (s["min"] >= 0), "log")
        .when(F.coalesce(spread / F.when(iqr > 0, iqr) > 12, F.lit(False)), "robust")
        .otherwise("standard")
    )


def scaled(c: Column, center: float, scale: float) -> Column:
    return clip((c - F.lit(center)) / F.lit(scale))


def robust_scale(s: dict) -> float:
    iqr = s["p75"] - s["p25"]
    return iqr / 1.349 if iqr > 0 else s["sd"] or 1.0


@dataclass(frozen=True)
class Ranks:
    """How many of ``n`` values are below each distinct one.

    ``values`` (sorted, ``KNOTS`` at most) and ``below`` hold all distinct values or, if
    there are more, some of them; then ``table`` (``value, below``) holds all.
    """

    n: int
    values: Sequence[float]
    below: Sequence[int]
    table: DataFrame | None = None

    def scores(self, x: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Normal scores of an array; what is missing gets any."""
        at, counts = np.asarray(self.values, float), np.append(np.asarray(self.below, float), float(self.n))
        below = counts[np.searchsorted(at, x, side="left")]
        if known is not None:
            below = np.where(np.isnan(known), below, known)
        return probit_array(np.clip((below + 0.5) / max(1, self.n), 0.0005, 0.9995))

    def normal(self, c: Column, known: Column | None = None) -> Column:
        """Normal score of the share of values below; ``known`` is the count where it was looked up."""
        at, counts = np.asarray(self.values, float), np.append(np.asarray(self.below, float), float(self.n))

        def below(x: pd.Series) -> pd.Series:
            return pd.Series(np.where(x.notna(), counts[np.searchsorted(at, x.to_numpy(float), side="left")], np.nan), index=x.index)

        below.__annotations__ = {"x": pd.Series, "return": pd.Series}
        n = F.nanvl(F.pandas_udf(below, "double")(c), F.lit(None).cast("double"))
        if known is not None:
            n = F.coalesce(known.cast("double"), n)
        return probit(F.greatest(F.lit(0.0005), F.least(F.lit(0.9995), (n + 0.5) / float(max(1, self.n)))))


def fit_ranks(df: DataFrame, column: str, *, knots: int = KNOTS, bucket: int = BUCKET) -> Ranks:
    """Ranks over all rows: counts by distinct value, summed within ranges of values, plus what the ranges before hold.

    The driver gets at most ``knots`` values, or 20 for each range if that is more, and a
    total for each range.  Where the ranges are cut does not change a count.
    """
    x = F.col(f"`{column}`").cast("double")
    counts = df.select(x.alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("value").agg(F.count("*").alias("k"))
    size = counts.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("k"), F.lit(0)).alias("n")).first()
    if size.distinct <= knots:
        rows = sorted((r.value, r.k) for r in counts.collect())
        k = np.array([k for _, k in rows], np.int64)
        return Ranks(size.n, [v for v, _ in rows], (np.cumsum(k) - k).tolist())
    ranges = -(-size.distinct // bucket)
    some = np.sort([r.value for r in counts.select("value").orderBy(F.xxhash64("value"), "value").limit(max(knots, 20 * ranges)).collect()])
    cuts = some[np.arange(1, ranges) * len(some) // ranges]

    def at(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, v.to_numpy(float), side="right"), dtype="int32")

    at.__annotations__ = {"v": pd.Series, "return": pd.Series}
    dealt = counts.withColumn("range", F.pandas_udf(at, "int")("value") if ranges > 1 else F.lit(0))
    held = {r["range"]: r.k for r in dealt.groupBy("range").agg(F.sum("k").alias("k")).collect()} if ranges > 1 else {}  # a row a range
    before = np.cumsum([0, *(held.get(k, 0) for k in range(ranges - 1))]).tolist()
    order = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("k").over(order), F.lit(0))
    table = dealt.select("value", (F.element_at(F.array(*map(F.lit, before)), F.col("range") + 1) + inside).cast("long").alias("below"))
    look = set(some[:: -(-len(some) // knots)].tolist())
    found = sorted((r.value, r.below) for r in table.join(F.broadcast(df.sparkSession.createDataFrame([(v,) for v in look], "value double")), "value").collect())
    return Ranks(size.n, [v for v, _ in found], [b for _, b in found], table)


def numeric_features(spec: ColumnSpec, s: dict, moments: dict, n: int, ranks: Ranks | None = None) -> list[Feature]:
    """The dimension of a numeric column, and a second one that marks missing values if they are neither rare nor most."""
    mode = choose_transform(spec, s)
    share = s["missing"] / n if n else 0.0
    marked = MIN_MISSING <= share <= MAX_MISSING
    size = spec.weight / sqrt(2 if marked else 1)
    if mode == "quantile":
        rule = Rule("ranks", spec.name, size=size, ranks=ranks)
    elif mode == "log":
        middle = (np.log1p(max(0.0, s["median"])) - moments["log_mean"]) / moments["log_sd"]
        rule = Rule("log", spec.name, moments["log_mean"], moments["log_sd"], float(middle), size)
    else:
        center, scale = {
            "standard": (moments["mean"], moments["sd"]),
            "robust": (s["median"], robust_scale(s)),
            "minmax": (s["min"], (s["max"] - s["min"]) or 1.0),
        }[mode]
        rule = Rule("plain", spec.name, center, scale, (s["median"] - center) / scale, size)
    out = [Feature(spec.name, spec.name, None, rule)]
    if marked:
        out.append(Feature(spec.name, spec.name + MISSING_SUFFIX, None, Rule("missing", spec.name, share, size=size)))
    return out


def spread(share: float) -> float:
    """The deviation of an indicator whose share of ones is known."""
    return sqrt(max(share * (1 - share), 1e-6))


def indicator(hit: Column, share: float) -> Column:
    """A standardised 0/1 dimension whose share of ones is known."""
    return (hit.cast("double") - F.lit(share)) / F.lit(spread(share))


def category_features(spec: ColumnSpec, levels: Sequence[tuple[str, int]], missing: int, n: int) -> list[Feature]:
    """One-hot dimensions of the frequent levels, one for the others if they are many, one for missing values."""
    least = max(5, int(0.002 * n))
    top = [(v, k) for v, k in levels if k >= least][:MAX_LEVELS]
    rest = n - missing - sum(k for _, k in top)
    hits: list[tuple[str, str, str, tuple[str, ...], int]] = [(f"{spec.name}={v}", v, "level", (v,), k) for v, k in top]
    if rest >= least:
        hits.append((f"{spec.name}={OTHER}", OTHER, "other", tuple(v for v, _ in top), rest))
    if n and missing / n >= MIN_MISSING:
        hits.append((spec.name + MISSING_SUFFIX, MISSING_SUFFIX, "missing", (), missing))
    size = spec.weight / sqrt(len(hits)) if hits else 0.0
    return [Feature(spec.name, label, level, Rule(kind, spec.name, k / n, size=size, levels=values)) for label, level, kind, values, k in hits]


@dataclass
class EncodePlan:
    features: list[Feature]
    columns: list[str]

    @property
    def size(self) -> int:
        return len(self.features)

    def vector(self) -> Column:
        """The features of a row alone; see ``encode`` for quantiles of many distinct values."""
        return F.array(*[f.value.cast("double") for f in self.features])

    def encode(self, df: DataFrame, *keep: str, block: bool | None = None) -> DataFrame:
        """``keep...`` and ``features``; also on a stream.  ``block`` sets which way is taken.

        Ranks of more than ``KNOTS`` distinct values are looked up in their table.  Only a
        value that the fitted table doesn't have takes the count of the next knot.
        """
        df = self.with_ranks(df)
        if not (len(self.features) > WIDE if block is None else block):
            cells = [f.rule.column(F.col(f"__below{k}") if f.looked_up else None) for k, f in enumerate(self.features)]
            return df.select(*keep, F.array(*[c.cast("double") for c in cells]).alias("features"))
        rows, kernel, fields = self.block(df, *keep)
        return rows.mapInArrow(lambda batches: (kernel(b) for b in batches if len(b)), T.StructType([*fields, T.StructField("features", T.ArrayType(T.DoubleType()))]))

    def with_ranks(self, df: DataFrame) -> DataFrame:
        """``df`` with the counts of the columns whose ranks are in tables."""
        for k, f in enumerate(self.features):
            if f.looked_up:
                ranks = f.rule.ranks.table.select(F.col("value").alias(f"__value{k}"), F.col("below").alias(f"__below{k}"))
                df = df.join(ranks, F.col(quoted(f.column)).cast("double") == F.col(f"__value{k}"), "left")
        return df

    def block(self, df: DataFrame, *keep: str):
        """The columns that the kernel reads, the kernel, and the fields of ``keep``; the kernel makes ``keep..., features`` of a batch."""
        held = block_names(df)
        text = {f.column for f in self.features if f.rule.kind in ("level", "other")}
        names = [n for n in dict.fromkeys(f.column for f in self.features) if n not in held]
        below = [f"__below{k}" for k, f in enumerate(self.features) if f.looked_up]
        source = [f"CAST({quoted(n)} AS {'STRING' if n in text else 'DOUBLE'}) AS x{k}" for k, n in enumerate(names)]
        rows = df.selectExpr(*map(quoted, keep), *([BLOCK] if held else []), *source, *below)
        rules = [(f.rule if not f.looked_up else replace(f.rule, ranks=replace(f.rule.ranks, table=None)), held.index(f.column) if f.column in held else f"x{names.index(f.column)}", f"__below{k}" if f.looked_up else None) for k, f in enumerate(self.features)]
        first = len(keep)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = np.empty((len(batch), len(rules)), order="F")
            many = batch.column(first).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if held else None
            for k, (rule, at, known) in enumerate(rules):
                out[:, k] = rule.array(many[:, at] if isinstance(at, int) else batch.column(at), None if known is None else batch.column(known))
            return pa.RecordBatch.from_arrays([*batch.columns[:first], list_array(out)], names=[*batch.schema.names[:first], "features"])

        return rows, kernel, rows.schema.fields[:first]


def list_array(rows: np.ndarray) -> pa.ListArray:
    """A matrix as a column of arrays."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32)[: len(rows) + 1]), pa.array(np.ascontiguousarray(rows).ravel()))


def moments_of(columns: Sequence[str], m: Summary) -> dict[str, dict]:
    """Mean and population deviation of every column and of its log map."""
    floor = lambda m2: np.sqrt(np.maximum(m2 / np.maximum(m.n, 1), 1e-12))
    figures = zip(m.mean, floor(m.m2), m.log_mean, floor(m.log_m2), strict=True)
    return {c: dict(zip(("mean", "sd", "log_mean", "log_sd"), map(float, f), strict=True)) for c, f in zip(columns, figures, strict=True)}


def fit_encoding(df: DataFrame, specs: Sequence[ColumnSpec], row_id: str, *, numeric: tuple[list[dict], Summary] | None = None, levels: dict[str, list[tuple[str, int]]] | None = None, missing: dict[str, int] | None = None, rows: int | None = None) -> EncodePlan:
    """The encoding of the feature columns of a typed table (doubles and strings).

    As many passes whatever the number of columns: statistics, counts and levels (and the ranks of each column
    with the quantile transform).  What is known already may be given: ``numeric`` as
    :func:`column_stats` has it, ``levels`` and ``missing`` of text columns, and the number of rows.
    """
    used = [s for s in specs if s.role == "feature" and s.weight > 0]
    doubles, strings = [s for s in used if s.kind in DOUBLE_KINDS], [s for s in used if s.kind not in DOUBLE_KINDS]
    found, summary = numeric or (column_stats(df, [s.name for s in doubles]) if doubles else ([], None))
    own = {r["column"]: r for r in found}
    moments = moments_of([r["column"] for r in found], summary) if found else {}
    if levels is None:
        levels = {}
        for r in category_stats(df, [s.name for s in strings], row_id).orderBy("column", "rank").collect() if strings else []:  # 200 rows a column
            levels.setdefault(r["column"], []).append((r.value, r.n))
    if missing is None or rows is None:
        row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(quoted(s.name)).isNull()).alias(f"c{k}") for k, s in enumerate(strings)]).first() if strings or not found else None
        rows = row.n if row else summary.rows
        missing = {s.name: row[f"c{k}"] for k, s in enumerate(strings)}
    out: list[Feature] = []
    for s in used:
        if s.kind in DOUBLE_KINDS:
            if own[s.name]["n"] and own[s.name]["sd"]:
                ranks = fit_ranks(df, s.name) if choose_transform(s, own[s.name]) == "quantile" else None
                out += numeric_features(s, own[s.name], moments[s.name], rows, ranks)
        elif len(levels.get(s.name, [])) > 1:
            dims = category_features(s, levels[s.name], missing[s.name], rows)
            out += dims if len(dims) > 1 else []
    if not out:
        raise ValueError("no column can be used as a feature")
    return EncodePlan(out, list(dict.fromkeys(f.column for f in out)))

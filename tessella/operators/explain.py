"""Profiles of segments, what stands out in them, their names and typical rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import formats
from tessella.operators import blocks
from tessella.operators.stats import column_stats, top_rows

# Fixed values of the explanation.
MIN_Z, MIN_LIFT, MIN_SHARE, MAX_HIGHLIGHTS, TOP_LEVELS, OTHER = 0.2, 1.25, 0.08, 6, 12, "その他"
HIGH, LOW, JOINT, SUFFIX, PLAIN = "高", "低", "×", "層", "セグメント"


def cluster_sizes(df: DataFrame, k: int, label: str = "label") -> DataFrame:
    """``label, size, share`` of every label below ``k``, empty ones too."""
    n = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("size"))
    grid = df.sparkSession.range(k).select(F.col("id").cast("int").alias("label"))
    out = grid.join(n, "label", "left").select("label", F.coalesce("size", F.lit(0).cast("long")).alias("size"))
    total = F.sum("size").over(Window.partitionBy())
    return out.withColumn("share", F.col("size") / F.greatest(total, F.lit(1)))


def numeric_profile(df: DataFrame, columns: Sequence[str], k: int, label: str = "label", *, overall: tuple[list[dict], blocks.Summary] | None = None) -> DataFrame:
    """A row a column and label: ``mean, median, z, ratio`` and the column's ``separation`` (eta squared).

    Means and exact medians of all labels and columns take two passes, whatever their numbers, and
    the columns' own statistics three more unless they are known (``overall``, as
    ``column_stats`` has them).
    """
    found, summary = overall or column_stats(df, columns)
    known = {r["column"]: r for r in found}
    medians, n, means = blocks.quantiles(df, columns, [0.5], summary=blocks.take(summary, [list(known).index(c) for c in columns]), group=label, groups=k, means=True)
    rows = []
    for j, c in enumerate(columns):
        s = known[c]
        if not s["n"]:
            continue
        sd = s["sd"] if s["sd"] > 0 else 1.0
        gap = np.where(n[:, j] > 0, means[:, j] - s["mean"], 0.0)
        between = float((n[:, j] * gap * gap).sum())
        apart = min(1.0, between / (sd * sd * max(1, s["n"] - 1)))
        for g in range(k):
            live = n[g, j] > 0
            mean = float(means[g, j]) if live else None
            ratio = mean / s["mean"] if live and abs(s["mean"]) > 1e-12 else None
            rows.append((c, g, int(n[g, j]), mean, float(medians[g, j, 0]) if live else None, float(gap[g] / sd), ratio, s["mean"], s["median"], apart))
    kinds = "column string, label int, n long, mean double, median double, z double, ratio double, overall_mean double, overall_median double, separation double"
    return df.sparkSession.createDataFrame(rows, kinds)


def categorical_profile(df: DataFrame, columns: Sequence[str], k: int, row_id: str, label: str = "label", *, top: int = TOP_LEVELS) -> DataFrame:
    """A row a column, level and label: ``share``, ``overall_share``, ``lift`` and the column's ``separation`` (Cramér's V).

    Levels beyond the ``top`` are one, the others'.  The contingency table is aggregated
    before anything is joined, so what follows is as small as levels times labels.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    long = df.select(F.col(label).cast("int").alias("label"), F.col(row_id).alias("row"), F.explode(cells).alias("c")).select("label", "row", "c.column", "c.value").filter("value is not null")
    table = long.groupBy("column", "value", "label").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    levels = table.groupBy("column", "value").agg(F.sum("n").alias("total"), F.min("row").alias("row"))
    best = top_rows(levels, "column", [F.desc("total"), F.col("row"), F.col("value")], F.col("value"), top).select("column", "value", "rank")
    levels = levels.join(F.broadcast(best), ["column", "value"], "left").withColumn("rank", F.coalesce("rank", F.lit(top + 1))).withColumn("slot", F.least(F.col("rank"), F.lit(top + 1)) - 1).withColumn("level", F.when(F.col("rank") <= top, F.col("value")).otherwise(F.lit(OTHER)))
    counts = table.drop("row").join(levels.select("column", "value", "slot", "level"), ["column", "value"]).groupBy("column", "slot", "level", "label").agg(F.sum("n").alias("n"))
    grid = counts.select("column", "slot", "level").distinct().withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    full = grid.join(counts, ["column", "slot", "level", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    by = lambda *c: F.sum("n").over(Window.partitionBy(*c))
    full = full.withColumn("row_total", by("column", "label")).withColumn("col_total", by("column", "slot")).withColumn("grand", by("column"))
    expected = F.col("row_total") * F.col("col_total") / F.col("grand")
    full = full.withColumn("chi2", F.sum(F.when(expected > 0, (F.col("n") - expected) * (F.col("n") - expected) / expected)).over(Window.partitionBy("column")))
    full = full.withColumn("slots", F.max("slot").over(Window.partitionBy("column")) + 1)
    share = F.when(F.col("row_total") > 0, F.col("n") / F.col("row_total")).otherwise(0.0)
    overall = F.col("col_total") / F.col("grand")
    size = F.greatest(F.lit(1), F.least(F.lit(k), F.col("slots")) - 1)
    return full.select("column", "slot", "level", "label", "n", share.alias("share"), overall.alias("overall_share"), (share / overall).alias("lift"), F.least(F.lit(1.0), F.sqrt(F.coalesce("chi2", F.lit(0.0)) / (F.col("grand") * size))).alias("separation"))


def numeric_strength() -> Column:
    return F.abs("z") * (0.5 + F.col("separation"))


def highlights(numeric: DataFrame | None, categorical: DataFrame | None, order: Sequence[str], *, limit: int = MAX_HIGHLIGHTS) -> DataFrame:
    """What stands out in each segment: ``label, rank, column, direction, level, strength`` and the figures behind.

    ``order`` gives the columns' places, which settle ties.
    """
    parts = []
    if numeric is not None:
        strong = numeric.filter(F.col("mean").isNotNull() & (F.abs("z") >= MIN_Z))
        parts.append(strong.select("label", "column", F.when(F.col("z") > 0, "high").otherwise("low").alias("direction"), F.lit(None).cast("string").alias("level"), numeric_strength().alias("strength"), "mean", "ratio", "overall_mean", F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("lift")))
    if categorical is not None:
        score = F.col("share") * F.ln("lift")
        live = categorical.filter((F.col("share") >= MIN_SHARE) & (F.col("lift") >= MIN_LIFT)).withColumn("score", score).filter("score > 0")
        first = F.row_number().over(Window.partitionBy("column", "label").orderBy(F.desc("score"), "slot"))
        live = live.withColumn("r", first).filter("r = 1")
        none = F.lit(None).cast("double")
        parts.append(live.select("label", "column", F.lit("category").alias("direction"), "level", (3 * F.col("score") * (0.5 + F.col("separation"))).alias("strength"), none.alias("mean"), none.alias("ratio"), none.alias("overall_mean"), "share", "lift"))
    both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    place = F.array_position(F.array(*map(F.lit, order)), F.col("column"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("strength"), place))
    return both.withColumn("rank", rank).filter(F.col("rank") <= limit)


def segment_names(marks: DataFrame, k: int) -> DataFrame:
    """``label, name``: the two strongest marks of each segment; repeated names get a number."""
    word = F.when(F.col("direction") == "high", F.concat(F.lit(HIGH), "column")).when(F.col("direction") == "low", F.concat(F.lit(LOW), "column")).otherwise(F.col("level"))
    own = marks.filter("rank <= 2").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", word.alias("word")))).alias("words"))
    own = own.select("label", F.concat(F.array_join(F.transform("words", lambda w: w["word"]), JOINT), F.lit(SUFFIX)).alias("name"))
    grid = marks.sparkSession.range(k).select(F.col("id").cast("int").alias("label"))
    out = grid.join(own, "label", "left").withColumn("name", F.coalesce("name", F.concat(F.lit(PLAIN), (F.col("label") + 1).cast("string"))))
    again = F.row_number().over(Window.partitionBy("name").orderBy("label"))
    return out.withColumn("again", again).select("label", F.when(F.col("again") > 1, F.concat("name", F.col("again").cast("string"))).otherwise(F.col("name")).alias("name"))


def representatives(assigned: DataFrame, row_id: str, *, per_label: int = 3) -> DataFrame:
    """``label, rank, row_id``: the rows nearest to their centre, ties to the smaller id.

    Each label's rows are cut to few before they meet: the window runs over groups of rows first.
    """
    near = assigned.select("label", F.col(row_id), "distance").withColumn("part", F.pmod(F.xxhash64(row_id), F.lit(64)))
    first = F.row_number().over(Window.partitionBy("label", "part").orderBy("distance", row_id))
    few = near.withColumn("rank", first).filter(F.col("rank") <= per_label)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("distance", row_id))
    return few.withColumn("rank", rank).filter(F.col("rank") <= per_label).select("label", "rank", row_id)


def by_separation(profile: DataFrame, top: int = 12) -> DataFrame:
    """The columns that tell segments apart best."""
    return profile.groupBy("column").agg(F.max("separation").alias("separation")).orderBy(F.desc("separation"), "column").limit(top)


def highlight_text(mark: dict, kind: str) -> str:
    """A mark as a phrase for a report."""
    name = mark["column"]
    if mark["direction"] == "category":
        return f"{name} は「{mark['level']}」が {formats.percent(mark['share'])}（全体の{formats.ratio(mark['lift'])}）"
    show = formats.by_kind(kind, mark["mean"])
    times = mark["ratio"] is not None and mark["ratio"] > 0 and kind != "datetime"
    beside = f"全体の{formats.ratio(mark['ratio'])}" if times else f"全体{formats.by_kind(kind, mark['overall_mean'])}"
    return f"{name} {show}（{beside}）"

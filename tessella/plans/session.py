"""From a file to an explained segmentation: load, run, export.

A session keeps the typed table of its last run, so that other options, weights or roles
of loaded columns don't read the file again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.scalars import parse_sql, quoted, text_sql
from tessella.operators import blocks, cluster, evaluate, explain, export, reduce
from tessella.operators.encode import EncodePlan, fit_encoding
from tessella.operators.infer import SAMPLE_ROWS, infer_columns
from tessella.operators.stats import all_missing, category_stats, column_stats, first_levels, hash_sample, systematic
from tessella.plans.store import Store
from tessella.sources.text import PREVIEW_ROWS, ROW_ID, open_delimited, read_any
from tessella.spec import DOUBLE_KINDS, ColumnSpec, RunOptions

DICTIONARY_CAP, SCATTER_ROWS = 20_000, 20_000
#: Columns that are parsed by an expression each and held apart, at most.
WIDE = 40
#: Rows beyond which a table with its segments is written before it is profiled.
JOIN_ROWS = 500_000
PHASES = ("inspect", "load", "encode", "reduce", "search-k", "cluster", "profile", "export", "done")


@dataclass
class Inspection:
    specs: list[ColumnSpec]
    preview: list[dict]
    rows: int
    warnings: list[str]


@dataclass
class Result:
    k: int
    automatic: bool
    rows: int
    effective_rows: int
    columns: list[str]
    dimensions: int
    reduced: int
    silhouette: float
    centers: np.ndarray
    scores: list[evaluate.KScore]
    labels: DataFrame  # row id, label, distance
    names: DataFrame
    segments: list[dict]
    profiles: list[dict]
    scatter: DataFrame
    axis_labels: list[list[str]]
    explained: list[float]
    warnings: list[str] = field(default_factory=list)


def typed_table(df: DataFrame, specs: Sequence[ColumnSpec], row_id: str = ROW_ID) -> DataFrame:
    """The kept columns as doubles or strings, NULL where missing; text is parsed, typed columns are taken as they are."""
    kept = [s for s in specs if s.role != "ignore"]
    if not kept:
        raise ValueError("every column is ignored")
    out, schema = [], df.schema
    texts: dict[str, list[str]] = {}  # parsed kinds, and the columns of text that are
    for s in kept:
        c, kind = F.col(quoted(s.name)), schema[s.name].dataType
        text = quoted(s.name) if isinstance(kind, T.StringType) else f"CAST({quoted(s.name)} AS STRING)"
        if s.kind not in DOUBLE_KINDS:
            value = F.expr(text_sql(text))
        elif isinstance(kind, T.NumericType | T.BooleanType):
            value = c.cast("double")
            value = F.when(~F.isnan(value), value)
        elif isinstance(kind, T.TimestampType | T.TimestampNTZType) and s.kind == "datetime":
            value = F.unix_micros(c.cast("timestamp")) / F.lit(86400e6)
        elif isinstance(kind, T.DateType) and s.kind == "datetime":
            value = F.unix_date(c).cast("double")
        elif len(kept) > WIDE:
            texts.setdefault(s.kind, []).append(text)
            value = F.get(f"__{s.kind}", F.lit(len(texts[s.kind]) - 1))
        else:
            value = F.expr(parse_sql(s.kind, text))
        out.append(value.alias(s.name))
    # A wide table's columns of a kind are parsed as one array by one expression.
    arrays = [F.expr(f"transform(array({', '.join(cells)}), x -> {parse_sql(kind, 'x')})").alias(f"__{kind}") for kind, cells in texts.items()]
    return (df.select("*", *arrays) if arrays else df).select(row_id, *out)


def capped_levels(typed: DataFrame, specs: Sequence[ColumnSpec], row_id: str = ROW_ID, *, cap: int = DICTIONARY_CAP) -> DataFrame:
    """The table with string levels beyond ``cap``, by first appearance, as missing; itself if no column has so many."""
    strings = [s.name for s in specs if s.role != "ignore" and s.kind not in DOUBLE_KINDS]
    if not strings:
        return typed
    names = typed.columns
    found = first_levels(typed, strings, row_id, cap)
    for r in found.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > cap).orderBy("k").collect():  # a row a column that has too many
        name = strings[r.k]
        kept = found.filter(F.col("k") == r.k).orderBy("first_row", "value").limit(cap).select(F.col("value").alias("__value"), F.lit(True).alias("__kept"))
        typed = typed.join(F.broadcast(kept), F.col(quoted(name)) == F.col("__value"), "left")  # cap rows
        typed = typed.select(*[F.when(F.col("__kept"), F.col(quoted(n))).alias(n) if n == name else F.col(quoted(n)) for n in names])
    return typed


def memory_estimate(rows: int, specs: Sequence[ColumnSpec]) -> int:
    """Bytes that the loaded columns take, held as columns: 8 a number, 4 a level's code."""
    return rows * sum(8 if s.kind in DOUBLE_KINDS else 4 for s in specs if s.role != "ignore")


def collect_matrix(df: DataFrame, features: str = "features") -> np.ndarray:
    """A bounded sample's vectors on the driver."""
    rows = df.select(features).toArrow()
    return cluster.matrix(rows.column(0))


class Session:
    def __init__(self, spark: SparkSession, *, progress: Callable[[str], None] = lambda phase: None) -> None:
        self.spark, self.progress = spark, progress
        self.store = Store(spark)
        self.table: DataFrame | None = None
        self.name, self.delimiter, self.rows = "table", ",", 0
        self._cached: tuple[str, DataFrame, DataFrame] | None = None
        self.result: Result | None = None

    def load(self, source: str | DataFrame, *, row_id: str = ROW_ID, name: str | None = None) -> Inspection:
        """A path, or a table that has a dense ``row_id``; forgets what was loaded before."""
        self.progress("inspect")
        self.drop()
        self.name = name or (source.rsplit("/", 1)[-1] if isinstance(source, str) else "table")
        self.result = None
        text = isinstance(source, str) and source.lower().rsplit(".", 1)[-1] in ("csv", "tsv", "txt")
        if text:
            file = open_delimited(self.spark, source)
            self.table, self.delimiter, rows = file.table(), file.delimiter, file.rows
            head = self.store.keep(file.table(SAMPLE_ROWS))
        else:
            self.table = read_any(self.spark, source) if isinstance(source, str) else source.withColumnRenamed(row_id, ROW_ID)
            self.delimiter, rows = ",", self.table.count()
            head = self.store.keep(self.table.orderBy(ROW_ID).limit(SAMPLE_ROWS))
        if not rows:
            raise ValueError("the table has no rows")
        self.rows = rows
        specs = infer_columns(head, ROW_ID)
        preview = [r.asDict() for r in head.orderBy(ROW_ID).drop(ROW_ID).limit(PREVIEW_ROWS).collect()]
        self.store.drop(head)
        warnings = []
        if len(specs) > 2000:
            warnings.append(f"{len(specs)} columns")
        if not any(s.role == "feature" for s in specs):
            warnings.append("no column can be used as a feature")
        return Inspection(specs, preview, rows, warnings)

    def drop(self) -> None:
        if self._cached:
            self.store.drop(self._cached[2])
        self._cached = None

    def _typed(self, specs: Sequence[ColumnSpec], max_rows: int) -> DataFrame:
        key = f"rows={max_rows}#" + ",".join(f"{s.index}:{s.kind}" for s in specs if s.role != "ignore")
        if not self._cached or self._cached[0] != key:
            self.progress("load")
            self.drop()
            typed = typed_table(systematic(self.table, ROW_ID, max_rows, self.rows), specs)
            kept = [s for s in specs if s.role != "ignore"]
            doubles, strings = [s.name for s in kept if s.kind in DOUBLE_KINDS], [s.name for s in kept if s.kind not in DOUBLE_KINDS]
            if len(doubles) > WIDE:  # many numbers are held as one array
                held = self.store.keep(blocks.with_block(typed, doubles, ROW_ID, *strings))
                view = lambda df: blocks.unpacked(df, doubles, ROW_ID, *strings)
            else:
                held, view = self.store.keep(typed), lambda df: df
            capped = capped_levels(held, specs)  # reads the kept cells, so texts are parsed once
            if capped is not held:
                capped = self.store.keep(capped)
                self.store.drop(held)
            self._cached = (key, view(capped), capped)
        return self._cached[1]

    def run(self, specs: Sequence[ColumnSpec], options: RunOptions | None = None) -> Result:
        if self.table is None:
            raise ValueError("load a table first")
        o = options or RunOptions()
        df = self._typed(specs, o.max_rows)
        self.progress("encode")
        kept = [s for s in specs if s.role != "ignore"]
        doubles, strings = [s.name for s in kept if s.kind in DOUBLE_KINDS], [s.name for s in kept if s.kind not in DOUBLE_KINDS]
        features = [s.name for s in kept if s.role == "feature"]
        gone = [F.count_if(F.col(quoted(c)).isNull()).alias(f"c{k}") for k, c in enumerate(strings)]
        empty = F.count_if(all_missing(features)) if features else F.lit(0)
        count = df.agg(F.count("*").alias("n_rows"), empty.alias("empty_rows"), *gone).first()
        numeric = column_stats(df, doubles) if doubles else ([], None)
        levels: dict[str, list[tuple[str, int]]] = {}
        for r in category_stats(df, strings, ROW_ID).orderBy("column", "rank").collect() if strings else []:
            levels.setdefault(r["column"], []).append((r.value, r.n))
        plan = fit_encoding(df, kept, ROW_ID, numeric=numeric, levels=levels, missing={c: count[f"c{k}"] for k, c in enumerate(strings)}, rows=count.n_rows)
        return self._segment(df, plan, kept, numeric, levels, count, o)

    def _segment(self, df: DataFrame, plan: EncodePlan, kept, numeric, levels, count, o: RunOptions) -> Result:
        n = count.n_rows
        self.progress("reduce")
        if plan.size > o.pca_threshold:  # encoded twice, never kept: the components need one pass, their rows another
            rows, kernel, fields = plan.block(plan.with_ranks(df), ROW_ID)
            pca = reduce.fit_pca(rows, plan.size, max(2, min(o.pca_components, plan.size)), rows_of=lambda b: cluster.matrix(kernel(b).column("features")))
            space = self.store.keep(reduce.project(rows, pca, kernel=kernel, fields=fields))
        else:
            space = self.store.keep(plan.encode(df, ROW_ID))
            pca = reduce.fit_pca(space, plan.size, 2)
        self.progress("search-k")
        search = collect_matrix(hash_sample(space, ROW_ID, o.auto_k_sample, o.seed + 1))
        low, high = max(2, min(o.k_min, o.k_max)), min(max(o.k_min, o.k_max), max(2, len(search) // 5))
        ks = sorted({*range(low, high + 1), *([o.k] if o.k else [])})
        scores = evaluate.k_scan(search, ks, algorithm=o.algorithm, seed=o.seed)
        k = max(1, min(o.k or evaluate.choose_k(scores), n))
        self.progress("cluster")
        centers = self._centers(space, search, k, n, o)
        labels = self.store.keep(cluster.assign(space, centers).select(ROW_ID, "label", "distance"))
        size = np.zeros(len(centers), int)
        for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect():  # a row a cluster
            size[r.label] = r.n
        order = cluster.by_size(centers, size)
        centers = centers[order]
        labels = labels.select(ROW_ID, F.element_at(F.array(*[F.lit(order.index(c)) for c in range(len(order))]), F.col("label") + 1).alias("label"), "distance")
        k = len(centers)
        self.progress("profile")
        out = self._explain(df, labels, kept, numeric, levels, k)
        rng = np.random.default_rng(o.seed + 2)
        look = np.sort(rng.permutation(len(search))[: evaluate.SILHOUETTE_ROWS])
        silhouette = evaluate.silhouette(search[look], cluster.gaps(search[look], centers).argmin(1))
        flat = hash_sample(space, ROW_ID, SCATTER_ROWS, o.seed + 7)
        if plan.size <= o.pca_threshold:
            flat = reduce.project(flat, pca)
        scatter = flat.join(labels.select(ROW_ID, "label"), ROW_ID)  # a bounded sample
        scatter = self.store.keep(scatter.select(ROW_ID, F.get("features", F.lit(0)).alias("x"), F.coalesce(F.get("features", F.lit(1)), F.lit(0.0)).alias("y"), "label"))
        drivers = [reduce.axis_drivers(c, [f.column for f in plan.features]) for c in pca.components[:2]]
        warnings = [f"{count.empty_rows} rows without any feature are placed by medians"] if count.empty_rows else []
        self.progress("done")
        self.result = Result(k, o.k is None, n, n - count.empty_rows, plan.columns, plan.size, centers.shape[1], silhouette, centers, scores, labels, out[0], out[1], out[2], scatter, drivers, [float(x) for x in pca.ratios[:2]], warnings)
        self.store.drop(space)
        return self.result

    def _centers(self, space: DataFrame, search: np.ndarray, k: int, n: int, o: RunOptions) -> np.ndarray:
        """Centres: up to ``LOCAL_ROWS`` rows by three restarts on the driver, as a table of that size asks for no more; else by seeds and iterations over all rows.  Ward's are those of a bounded sample's tree."""
        if o.algorithm == "ward":
            sample = collect_matrix(hash_sample(space, ROW_ID, cluster.WARD_ROWS, o.seed + 5))
            own = cluster.ward_tree(sample).cut(k)
            return cluster.centroids(sample, own, int(own.max()) + 1)
        if n <= cluster.LOCAL_ROWS:
            return cluster.k_means_local(collect_matrix(space.orderBy(ROW_ID)), k, o.seed)[0]
        return cluster.lloyd(space, cluster.parallel_seeds(space, ROW_ID, k, seed=o.seed))[0]

    def _explain(self, df: DataFrame, labels: DataFrame, kept, numeric, levels, k: int) -> tuple[DataFrame, list[dict], list[dict]]:
        both = df.join(labels.select(ROW_ID, "label"), ROW_ID)
        if self.rows > JOIN_ROWS:  # fewer labels are broadcast by their size, and the join is made again in each pass
            both = self.store.keep(both.drop(blocks.BLOCK))
        filled = {r["column"] for r in numeric[0] if r["n"]}
        doubles = [s.name for s in kept if s.name in filled]
        strings = [s.name for s in kept if s.kind not in DOUBLE_KINDS and len(levels.get(s.name, [])) > 1]
        num = explain.numeric_profile(both, doubles, k, overall=numeric) if doubles else None
        cat = explain.categorical_profile(both, strings, k, ROW_ID).persist() if strings else None
        order = [s.name for s in kept]
        kinds = {s.name: s.kind for s in kept}
        marks = explain.highlights(num, cat, order).persist()
        names_df = explain.segment_names(marks, k)
        names = {r.label: r["name"] for r in names_df.collect()}
        texts: dict[int, list[str]] = {}
        for r in marks.orderBy("label", "rank").collect():  # six a segment
            texts.setdefault(r.label, []).append(explain.highlight_text(r.asDict(), kinds[r["column"]]))
        near: dict[int, list[int]] = {}
        for r in explain.representatives(labels, ROW_ID).orderBy("label", "rank").collect():  # three a segment
            near.setdefault(r.label, []).append(r[ROW_ID])
        segments = [{"id": r.label, "size": r["size"], "share": r.share, "name": names[r.label], "highlights": texts.get(r.label, []), "rows": near.get(r.label, [])} for r in explain.cluster_sizes(labels, k).orderBy("label").collect()]
        profiles = {}
        for r in num.orderBy("column", "label").collect() if num is not None else []:
            p = profiles.setdefault(r["column"], {"type": "numeric", "column": r["column"], "kind": kinds[r["column"]], "overall_mean": r.overall_mean, "overall_median": r.overall_median, "separation": r.separation, "clusters": []})
            p["clusters"].append({"mean": r["mean"], "median": r.median, "z": r.z, "ratio": r.ratio})
        for r in cat.orderBy("column", "label", "slot").collect() if cat is not None else []:
            p = profiles.setdefault(r["column"], {"type": "categorical", "column": r["column"], "levels": [], "overall_share": [], "separation": r.separation, "clusters": [{"share": [], "lift": []} for _ in range(k)]})
            if r.label == 0:
                p["levels"].append(r.level)
                p["overall_share"].append(r.overall_share)
            p["clusters"][r.label]["share"].append(r.share)
            p["clusters"][r.label]["lift"].append(r.lift)
        for kept_table in (cat, marks):
            if kept_table is not None:
                kept_table.unpersist()
        self.store.drop(both)
        fixed_names = self.spark.createDataFrame([(label, name) for label, name in sorted(names.items())], "label int, name string")
        return fixed_names, segments, [profiles[c] for c in order if c in profiles]

    def labelled(self) -> DataFrame:
        """Every row of the loaded table with its segment; rows that were passed over have none."""
        if not self.result:
            raise ValueError("run a segmentation first")
        return export.labelled_rows(self.table, self.result.labels, self.result.names, ROW_ID)

    def export(self, kind: str, path: str) -> str:
        """Writes ``labeled`` (every row with its segment), ``profile`` or ``markdown`` as a file under ``path``; gives its path."""
        if not self.result:
            raise ValueError("run a segmentation first")
        self.progress("export")
        target = f"{path.rstrip('/')}/{export.file_name(kind, self.name)}"
        if kind == "labeled":
            export.write_labelled(self.labelled(), target, ROW_ID, delimiter=self.delimiter, n=self.rows)
        else:
            text = export.profile_lines(self.result.profiles, self.result.segments) if kind == "profile" else export.report(self.name, self.result)
            write_text(self.spark, target, text)
        return target


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, by Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()

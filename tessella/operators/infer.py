"""Kinds and roles of columns, inferred from a bounded sample in one job for all columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import is_missing, parse_boolean, parse_date, parse_number
from tessella.operators.stats import long_values
from tessella.spec import ColumnSpec, default_role

SAMPLE_ROWS, PROBE_ROWS, DISTINCT_CAP = 5_000, 1_000, 5_000
#: Tasks that the sample's cells are dealt over.
TASKS = 16
#: Column names that stand for identifiers.
ID_NAME = r"(?i)(^|[ _\-])(id|uid|uuid|key|code|no)([ _\-]|$)|コード$|番号$|^id$"
SENTENCE = "[。、．，]|\\.\\s|\\?|？|！|!"


def free_text(avg_length: Column, punct_rate: Column) -> Column:
    return (avg_length > 28) | ((punct_rate >= 0.4) & (avg_length >= 12))


def kind_tree(m: dict[str, Column], id_name: Column) -> Column:
    """The kind from the metrics; the order of the questions matters."""
    key_like = id_name & (m["distinct_ratio"] > 0.95)
    text_like = free_text(m["avg_length"], m["punct_rate"])
    return (
        F.when((m["filled"] == 0) | (m["fill_rate"] < 0.02), "empty")
        .when(m["distinct_count"] <= 1, "constant")
        .when((m["date_rate"] >= 0.9) & (m["numeric_rate"] < 0.9), "datetime")
        .when((m["distinct_count"] == 2) & (m["bool_rate"] >= 0.95), "boolean")
        .when(m["numeric_rate"] >= 0.92, F.when(key_like, "identifier").otherwise("numeric"))
        .when(m["date_rate"] >= 0.7, "datetime")
        .when(key_like & (m["filled"] >= 4), "identifier")
        .when((m["distinct_ratio"] > 0.9) & (m["filled"] >= 30) & ~text_like, F.when(m["avg_length"] <= 24, "identifier").otherwise("text"))
        .when(text_like, "text")
        .otherwise("categorical")
    )


def column_profile(sample: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """A row a column: fill rate, distinct values, lengths, and how many of the first values read as numbers, dates or booleans."""
    cells = long_values(sample, columns, row_id).withColumn("missing", is_missing("value"))
    nth = F.sum(F.when(F.col("missing"), 0).otherwise(1)).over(Window.partitionBy("column").orderBy(row_id))
    cells = cells.withColumn("probe", ~F.col("missing") & (nth <= PROBE_ROWS)).withColumn("filled_value", F.when(~F.col("missing"), F.col("value")))

    def rate(parsed: Column) -> Column:
        return F.coalesce(F.count_if(F.col("probe") & parsed.isNotNull()) / F.when(F.count_if("probe") > 0, F.count_if("probe")), F.lit(0.0))

    out = cells.groupBy("column").agg(
        F.count("*").alias("n_rows"), F.count("filled_value").alias("filled"), F.least(F.size(F.collect_set("filled_value")), F.lit(DISTINCT_CAP)).cast("long").alias("distinct_count"),
        F.coalesce(F.avg(F.length("filled_value")), F.lit(0.0)).alias("avg_length"), F.coalesce(F.avg(F.col("filled_value").rlike(SENTENCE).cast("int")), F.lit(0.0)).alias("punct_rate"),
        rate(parse_number("value")).alias("numeric_rate"), rate(parse_boolean("value")).alias("bool_rate"), rate(parse_date("value")).alias("date_rate"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("probe"), F.struct(row_id, "value")))), 1, 5), lambda x: x["value"]).alias("sample_values"),
    )
    out = out.withColumn("fill_rate", F.col("filled") / F.greatest(F.col("n_rows"), F.lit(1)))
    out = out.withColumn("distinct_ratio", F.coalesce(F.col("distinct_count") / F.when(F.col("filled") > 0, F.least(F.col("filled"), F.lit(DISTINCT_CAP))), F.lit(0.0)))
    metrics = {c: F.col(c) for c in out.columns}
    out = out.withColumn("kind", kind_tree(metrics, F.col("column").rlike(ID_NAME)))
    numeric = F.col("kind").isin("numeric", "boolean", "datetime")
    role = F.when(numeric, "feature").when(F.col("kind") == "categorical", F.when(F.col("distinct_count") <= 50, "feature").otherwise("profile")).otherwise("ignore")
    return out.withColumn("role", role)


def infer_columns(df: DataFrame, row_id: str, columns: Sequence[str] | None = None) -> list[ColumnSpec]:
    """Specs from the first ``SAMPLE_ROWS`` rows; typed columns are read as their text."""
    columns = list(columns or [c for c in df.columns if c != row_id])
    sample = df.orderBy(row_id).limit(SAMPLE_ROWS).repartition(TASKS)  # one partition would be read by one task
    rows = {r["column"]: r for r in column_profile(sample, columns, row_id).collect()}  # a row a column
    out = []
    for k, name in enumerate(columns):
        r = rows.get(name)
        kind = r.kind if r else "empty"
        distinct = r.distinct_count if r else 0
        out.append(ColumnSpec(k, name, kind, kind, default_role(kind, distinct), fill_rate=r.fill_rate if r else 0.0, distinct_count=distinct, sample_values=tuple(r.sample_values) if r else ()))
    return out


def id_like(name: str) -> bool:
    return bool(re.search(ID_NAME, name))

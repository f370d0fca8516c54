"""Results as files: labelled rows, profile tables and a report."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import formats
from tessella.functions.scalars import quoted

#: Rows of one part of an export, about.
PART_ROWS = 500_000
BOM = "﻿"


def csv_field(value: object, delimiter: str = ",") -> str:
    """Quoted where the text needs it, quotes doubled."""
    text = "" if value is None else str(value)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ('"', "\n", "\r", delimiter)) else text


def csv_row(values: Sequence[object], delimiter: str = ",") -> str:
    return delimiter.join(csv_field(v, delimiter) for v in values)


def base_name(name: str) -> str:
    return re.sub(r"\.[^.]*$", "", name) or "segmentation"


def file_name(kind: str, name: str) -> str:
    return base_name(name) + {"labeled": "_segments.csv", "profile": "_profile.csv", "markdown": "_summary.md"}[kind]


def labelled_rows(raw: DataFrame, labels: DataFrame, names: DataFrame, row_id: str) -> DataFrame:
    """The raw rows with ``segment_id`` (from 1) and ``segment_name``; empty where a row was passed over."""
    named = labels.select(row_id, "label").join(F.broadcast(names), "label", "left")  # a name a segment
    named = named.select(row_id, (F.col("label") + 1).alias("segment_id"), F.col("name").alias("segment_name"))
    return raw.join(named, row_id, "left")


def csv_lines(rows: DataFrame, columns: Sequence[str], delimiter: str) -> Column:
    """A row as a line, each field quoted where the text needs it; one expression for all columns."""
    cells = ", ".join(f"coalesce(CAST({quoted(c)} AS STRING), '')" for c in columns)
    d = delimiter.replace("\\", "\\\\").replace("'", "\\'")
    needs = f"contains(x, '\"') OR contains(x, '\\n') OR contains(x, '\\r') OR contains(x, '{d}')"
    return F.expr(f"""array_join(transform(array({cells}), x -> CASE WHEN {needs} THEN concat('"', replace(x, '"', '""'), '"') ELSE x END), '{d}')""")


def write_labelled(rows: DataFrame, path: str, row_id: str, *, delimiter: str = ",", parts: int | None = None, n: int | None = None) -> None:
    """One CSV file in the order of rows, with a byte order mark, for spreadsheets, and a header.

    Row ids are dense from 0, so rows go to their part by their id (``n``: how many there are, else
    they are counted).  Parts are written side by side; the file system then joins them in order (by its
    own ``concat``, which moves no data, where it has that, else by a stream of constant memory).
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != row_id]
    n = n or rows.count()
    parts = parts or max(1, min(-(-n // PART_ROWS), 10_000))
    place = F.least(F.floor(F.col(row_id) * parts / max(1, n)), F.lit(parts - 1)).cast("int")
    dealt = rows.repartitionById(parts, place).sortWithinPartitions(row_id)
    folder = f"{path}.parts"
    dealt.select(csv_lines(rows, names, delimiter).alias("line")).write.mode("overwrite").text(folder, lineSep="\n")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, where = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(conf)
    files.delete(at, True)
    made = sorted((f.getPath() for f in files.listStatus(where) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    stream = files.create(at, True)
    try:
        stream.write(bytearray((BOM + csv_row(names, delimiter) + "\n").encode()))
        if not _joins(files):
            for part in made:
                source = files.open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, conf, False)
                finally:
                    source.close()
    finally:
        stream.close()
    if _joins(files) and made:
        sources = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(made))
        for k, part in enumerate(made):
            sources[k] = part
        files.concat(at, sources)
    files.delete(where, True)


def _joins(files) -> bool:
    """Whether a file system can join files without reading them."""
    return files.getScheme() in ("hdfs", "webhdfs")


def profile_lines(profiles: list[dict], segments: list[dict]) -> str:
    """The profile table as CSV, always with commas; profiles are in the order of columns."""
    lines = [csv_row(["列", "種別", "水準", "指標", "全体", *[f"{s['id'] + 1}: {s['name']}" for s in segments]])]
    for p in profiles:
        if p["type"] == "numeric":
            show = lambda x, kind=p["kind"]: formats.by_kind(kind, x)
            lines.append(csv_row([p["column"], "数値", "", "平均", show(p["overall_mean"]), *[show(c["mean"]) for c in p["clusters"]]]))
            lines.append(csv_row([p["column"], "数値", "", "中央値", show(p["overall_median"]), *[show(c["median"]) for c in p["clusters"]]]))
            lines.append(csv_row([p["column"], "数値", "", "効果量(z)", "0.00", *[formats.fixed(c["z"], 2) for c in p["clusters"]]]))
        else:
            for s, level in enumerate(p["levels"]):
                lines.append(csv_row([p["column"], "カテゴリ", level, "構成比", formats.percent(p["overall_share"][s]), *[formats.percent(c["share"][s]) for c in p["clusters"]]]))
    lines += ["", csv_row(["セグメント", "名称", "件数", "構成比", "主な特徴"])]
    for s in segments:
        lines.append(csv_row([s["id"] + 1, s["name"], s["size"], formats.percent(s["share"]), " / ".join(s["highlights"])]))
    return BOM + "\n".join(lines) + "\n"


def _table(head: Sequence[str], align: Sequence[str], rows: Sequence[Sequence[str]]) -> list[str]:
    bar = lambda cells: "| " + " | ".join(cells) + " |"
    return [bar(head), bar(align), *map(bar, rows), ""]


def report(name: str, result) -> str:
    """The Markdown report of a result (see ``plans.session``)."""
    ids = [str(s["id"] + 1) for s in result.segments]
    right = "---:"
    out = [
        f"# セグメンテーション結果: {name}", "", f"- 対象行数: {formats.count(result.rows)} 行", f"- セグメント数: {result.k}（{'自動決定' if result.automatic else '手動指定'}）",
        f"- 使用した列: {', '.join(result.columns)}", f"- 特徴量次元: {result.dimensions}（クラスタリングは {result.reduced} 次元で実行）", f"- シルエット係数: {formats.fixed(result.silhouette, 3)}", "", "## セグメント一覧", "",
    ]
    out += _table(["#", "名称", "件数", "構成比", "主な特徴"], ["---", "---", right, right, "---"], [[str(s["id"] + 1), s["name"], formats.count(s["size"]), formats.percent(s["share"]), "<br>".join(s["highlights"])] for s in result.segments])
    numeric = [p for p in result.profiles if p["type"] == "numeric"]
    out += ["## 列ごとの平均値", ""]
    if numeric:
        rows = [[p["column"], formats.by_kind(p["kind"], p["overall_mean"]), *[formats.by_kind(p["kind"], c["mean"]) for c in p["clusters"]], formats.fixed(p["separation"], 2)] for p in numeric]
        out += _table(["列", "全体", *ids, "分離度"], ["---", right, *[right] * len(ids), right], rows)
    others = [p for p in result.profiles if p["type"] != "numeric"]
    if others:
        out += ["## カテゴリ列の構成比", ""]
    for p in others:
        out += [f"### {p['column']}（分離度 {formats.fixed(p['separation'], 2)}）", ""]
        out += _table(["水準", "全体", *ids], ["---", right, *[right] * len(ids)], [[level, formats.percent(p["overall_share"][s]), *[formats.percent(c["share"][s]) for c in p["clusters"]]] for s, level in enumerate(p["levels"])])
    return "\n".join(out)

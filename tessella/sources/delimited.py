"""Delimited files of any size in parallel, with quoted fields that hold line ends anywhere.

Whether a split of a file begins inside a quoted field is known only from all that lies before
it.  So the first pass parses every split twice, as if it began outside and as if it began inside
quotes, and keeps for each case how it ends and how many records begin in it: a row a split.
Such a row maps the state before a split to the state after it: it sets it, keeps it or turns it
round.  A split's true state is therefore what the last split that sets it says, turned as often as
splits since then do so, which window functions find; record numbers are sums of the same kind.  The
second pass parses each split in its true state.  Records that lie across splits are left out
there; if there are any, a third pass takes their pieces from those splits and joins them.

Splits are read by lines (up to LF) by Spark's own text source, so they begin at a line in every encoding.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "_row_id"
PYTHON_NAMES = {"utf-8": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "shift_jis": "cp932"}
#: A last line that no split has: if it comes out as a record of its own, the split ends outside quotes.
END = "\x00end\x00"
#: Splits, of which a row each is broadcast: 128 TB in splits of 128 MB.
MOST_SPLITS = 1_000_000
#: Characters of the longest field.
LONGEST = 1 << 40
#: What the first pass keeps of a split, read from outside and from inside quotes.
SPLIT = {"file": "string", "start": "long", "size": "long", "bytes": "long", "out_inside": "boolean", "out_rows": "long", "in_inside": "boolean", "in_rows": "long", "in_closed": "boolean"}
KINDS = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[k] for k in SPLIT.values()]


def read_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """``file, start, size, line``: the bytes of every line, without its LF, in the order of its split."""
    reader = spark.read.option("lineSep", "\n")
    if encoding.startswith("utf-16"):  # line ends of two bytes
        reader = reader.option("encoding", encoding.replace("utf-16", "UTF-16").upper())
    of = lambda name: F.col(f"_metadata.{name}")
    return reader.text(path).select(of("file_path").alias("file"), of("file_block_start").alias("start"), of("file_size").alias("size"), F.col("value").cast("binary").alias("line"))


def decode_lines(lines: list[bytes], encoding: str, first: bool) -> str:
    """Lines as one text, each with its LF; without the byte order mark if they are a file's ``first``."""
    name = PYTHON_NAMES.get(encoding, "utf-8")
    end = "\n".encode(name)
    text = (end.join(lines) + end).decode(name, "replace")
    return text.removeprefix("﻿") if first else text


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[bytes]]]:
    """Lines with what ``names`` say, in pieces of one split; the first two of ``names`` tell splits."""
    for batch in batches:
        keys, lines = [batch.column(n).to_pylist() for n in names], batch.column("line").to_pylist()
        first = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or keys[0][k] != keys[0][first] or keys[1][k] != keys[1][first]:
                yield tuple(x[first] for x in keys), lines[first:k]
                first = k


def _splits(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Iterator[list[bytes]]]]:
    """Each split's key, and its lines in pieces, which are taken before the next split is."""
    runs = _runs(batches, names)
    held = next(runs, None)

    def pieces(key: tuple) -> Iterator[list[bytes]]:
        nonlocal held
        while held is not None and held[0][:2] == key[:2]:
            lines, held = held[1], next(runs, None)
            yield lines

    while held is not None:
        key = held[0]
        mine = pieces(key)
        yield key, mine
        for _ in mine:
            pass


def count_records(text: str, delimiter: str, inside: bool) -> tuple[int, bool, bool]:
    """For whole lines: records that begin in them, whether they end inside quotes, and whether the record that they begin inside of ended."""
    bare = text.replace("\r\n", "\n") if "\r" in text else text
    if '"' not in bare and (inside or "\r" not in bare):
        return (0, True, False) if inside else (sum(map(bool, bare.split("\n"))), False, False)
    rows = list(csv.reader(io.StringIO(f"{'"' * inside}{text}{END}", newline=""), delimiter=delimiter))
    closed = rows[-1] == [END]
    return sum(1 for r in rows[inside : len(rows) - closed] if r and r != [""]), not closed, inside and len(rows) > 1


def _summaries(delimiter: str, encoding: str):
    """A row a split, parsed from both states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(LONGEST)
        width = len("\n".encode(PYTHON_NAMES.get(encoding, "utf-8")))
        out: list[list] = [[] for _ in SPLIT]
        for (file, start, size), pieces in _splits(batches, ["file", "start", "size"]):
            state, rows, closed, length = [False, True], [0, 0], False, 0
            for lines in pieces:
                text = decode_lines(lines, encoding, not length and not start)
                length += sum(map(len, lines)) + width * len(lines)
                told = {inside: count_records(text, delimiter, inside) for inside in set(state)}
                closed |= told[state[1]][2]
                rows = [n + told[inside][0] for n, inside in zip(rows, state, strict=True)]
                state = [told[inside][1] for inside in state]
            for cell, value in zip(out, (file, start, size, length, state[0], rows[0], state[1], rows[1], closed), strict=True):
                cell.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, KINDS, strict=True)], names=list(SPLIT))

    return run


def locate(found: DataFrame) -> DataFrame:
    """Splits with their true state and the numbers of their records, from what the first pass found.

    ``split`` is a dense number; ``inside`` the state that it begins in; ``number`` the place of the first
    record that begins in it among those of its file; ``before`` the rows of the files before;
    ``opens`` whether its last record goes on in the next split; ``ends`` the state that it ends in;
    ``chain`` and ``chain_number`` the split in which the record began that it begins inside of, and
    its place; ``cut`` whether the file has no LF after that record.
    """
    order = Window.partitionBy("file").orderBy("start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    turn = (F.col("out_inside") & ~F.col("in_inside")).cast("long")
    turns = F.sum(turn).over(order)
    fixed = F.when(F.col("out_inside") == F.col("in_inside"), (F.col("out_inside").cast("long") + F.col("turns")) % 2)
    split = F.row_number().over(Window.orderBy("file", "start")) - 1  # a row a split
    df = found.withColumn("split", split.cast("long")).withColumn("turn", turn).withColumn("turns", turns).withColumn("fixed", fixed)
    state = (F.coalesce(F.last("fixed", ignorenulls=True).over(earlier), F.lit(0)) + F.col("turns") - F.col("turn")) % 2
    df = df.withColumn("inside", state == 1)
    df = df.withColumn("rows", F.when(F.col("inside"), F.col("in_rows")).otherwise(F.col("out_rows"))).withColumn("ends", F.when(F.col("inside"), F.col("in_inside")).otherwise(F.col("out_inside")))
    df = df.withColumn("opens", F.col("ends") & (~F.col("inside") | F.col("in_closed"))).withColumn("number", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    opened = F.last(F.when(F.col("opens"), F.struct("split", (F.col("number") + F.col("rows") - 1).alias("number"))), ignorenulls=True)
    whole = Window.partitionBy("file")
    last = F.lead("start").over(order).isNull()
    df = df.withColumn("chain", opened.over(earlier)).withColumn("cut", last & F.col("ends") & (F.sum("bytes").over(whole) > F.col("size")))
    files = df.groupBy("file").agg(F.greatest(F.sum("rows") - 1, F.lit(0)).alias("rows"))
    files = files.select("file", F.coalesce(F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = df.join(files, "file")
    return out.select("file", "start", "split", "inside", "number", "before", "rows", "opens", "ends", F.col("chain.split").alias("chain"), F.col("chain.number").alias("chain_number"), "cut")


def _records(pieces: Iterator[str], delimiter: str, inside: bool) -> Iterator[tuple[list[str] | None, str]]:
    """A split's records with their text; one that it doesn't begin or doesn't end has None for its fields."""
    held: list[str] = []

    def lines() -> Iterator[str]:
        for n, text in enumerate(pieces):
            for k, line in enumerate(io.StringIO(text, newline="")):
                held.append(line)
                yield f'"{line}' if inside and not n and not k else line
        yield END

    foreign, before = inside, None
    for row in csv.reader(lines(), delimiter=delimiter):
        if before is not None:
            yield (None if foreign else before[0]), before[1]
            foreign = False
        before = (row, "".join(held))
        held.clear()
    if before is not None and before[0] != [END]:
        yield None, before[1]


def _parsed(delimiter: str, encoding: str, width: int):
    """The records that lie within a split, as columns of strings; each file's first is its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(LONGEST)
        names = [ROW_ID, *(f"c{k}" for k in range(width))]

        def out(ids: list[int], rows: list[list[str]]) -> pa.RecordBatch:
            cells = list(zip_longest(*rows, fillvalue=""))[:width]
            cells += [[""] * len(rows)] * (width - len(cells))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.string()) for c in cells)], names=names)

        ids, rows, cells = [], [], 0
        for (_, start, inside, number, before), pieces in _splits(batches, ["split", "start", "inside", "number", "before"]):
            texts = (decode_lines(lines, encoding, not n and not start) for n, lines in enumerate(pieces))
            for row, _ in _records(texts, delimiter, inside):
                if row and row != [""]:
                    if number:
                        ids.append(before + number - 1)
                        rows.append(row)
                        cells += len(row)
                    number += 1
                if cells > CELLS:
                    yield out(ids, rows)
                    ids, rows, cells = [], [], 0
        if ids:
            yield out(ids, rows)

    return run


def _pieces(delimiter: str, encoding: str):
    """The parts of records that lie across splits: what a split begins inside of, and what it leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(LONGEST)
        for (split, start, inside, number, before, rows, opens, chain, chain_number, cut), lines in _splits(batches, ["split", "start", "inside", "number", "before", "rows", "opens", "chain", "chain_number", "cut"]):
            texts = (decode_lines(x, encoding, not n and not start) for n, x in enumerate(lines))
            found = [text for row, text in _records(texts, delimiter, inside) if row is None]
            out = []
            if inside:
                out.append((chain, chain_number, before, split, found[0], cut and not opens))
            if opens:
                out.append((split, number + rows - 1, before, split, found[-1], cut))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("chain", "number", "before", "split", "text", "cut"), x, strict=True)) for x in out])

    return run


def _joined(delimiter: str, width: int):
    """Records put together from their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(LONGEST)
        for batch in batches:
            for r in batch.to_pylist():
                parts = sorted(r["parts"], key=lambda x: x["split"])
                text = "".join(x["text"] for x in parts)
                if parts[-1]["cut"]:
                    text = text.removesuffix("\n")
                row = next(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))
                if row == [""]:  # a file's last quote, with nothing after it
                    continue
                cells = (row + [""] * width)[:width]
                yield pa.RecordBatch.from_arrays([pa.array([r["before"] + r["number"] - 1], pa.int64()), *(pa.array([c], pa.string()) for c in cells)], names=[ROW_ID, *(f"c{k}" for k in range(width))])

    return run


#: Cells of one Arrow batch.
CELLS = 400_000


class DelimitedFile:
    """A delimited file or folder whose splits are known: how many rows it has, and tables of them.

    Row ids are dense, in the order of files and of rows in them; each file begins with a header,
    which gives no row.  Blank lines give no row, short rows are padded, long ones cut; a quote
    that isn't closed holds all that follows.

    All passes have to cut files alike.  Where Spark would cut them by the cores it has just now, the session's
    ``spark.sql.files.minPartitionNum`` is set to those there are when the file is opened; if splits still
    differ, since files or settings have changed, reading ends with an error.
    """

    def __init__(self, spark: SparkSession, path: str, names: list[str], *, delimiter: str, encoding: str) -> None:
        self.spark, self.names, self.delimiter, self.encoding = spark, names, delimiter, encoding
        if not spark.conf.get("spark.sql.files.minPartitionNum", None):
            spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
        self.lines = read_lines(spark, path, encoding)
        found = self.lines.mapInArrow(_summaries(delimiter, encoding), ", ".join(f"{n} {k}" for n, k in SPLIT.items()))
        self.splits = locate(found.repartition(1)).limit(MOST_SPLITS + 1).toArrow()  # a row a split
        if len(self.splits) > MOST_SPLITS:
            raise ValueError(f"over {MOST_SPLITS} splits: raise spark.sql.files.maxPartitionBytes")
        ends = pc.add(pc.add(self.splits.column("before"), self.splits.column("number")), self.splits.column("rows"))
        self.rows = max(0, (pc.max(ends).as_py() or 1) - 1)

    def table(self, first: int | None = None) -> DataFrame:
        """``_row_id`` and the named columns; only of the ``first`` rows if that is given, from the splits that have them."""
        spark, splits, width = self.spark, self.splits, len(self.names)
        wanted = pc.less_equal(pc.add(splits.column("before"), splits.column("number")), self.rows + 1 if first is None else first)
        splits = splits.append_column("wanted", wanted)
        schema = T.StructType([T.StructField(ROW_ID, T.LongType())] + [T.StructField(f"c{k}", T.StringType()) for k in range(width)])
        if not len(splits):
            return spark.createDataFrame([], schema).toDF(ROW_ID, *self.names)
        at = ["file", "start"]
        joined = self.lines.join(F.broadcast(spark.createDataFrame(splits)), at, "left")
        joined = joined.filter(F.coalesce("wanted", F.raise_error(F.lit("the files' splits have changed: open them again")).cast("boolean")))
        out = joined.select("split", "start", "inside", "number", "before", "line").mapInArrow(_parsed(self.delimiter, self.encoding, width), schema)
        across = self.splits.filter(pc.or_(self.splits.column("opens"), self.splits.column("inside")))
        if len(across):
            parts = self.lines.join(F.broadcast(spark.createDataFrame(across)), at).drop("file", "size", "ends")
            parts = parts.mapInArrow(_pieces(self.delimiter, self.encoding), "chain long, number long, before long, split long, text string, cut boolean")
            whole = parts.groupBy("chain").agg(F.max("number").alias("number"), F.max("before").alias("before"), F.collect_list(F.struct("split", "text", "cut")).alias("parts"))
            out = out.union(whole.filter("number > 0").mapInArrow(_joined(self.delimiter, width), schema))
        if first is not None:
            out = out.filter(F.col(ROW_ID) < first)
        return out.toDF(ROW_ID, *self.names)

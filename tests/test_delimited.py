"""Delimited files in many splits against the parser of small texts."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.plans.catalog import QUERIES
from tessella.sources import delimited, text
from tessella.sources.text import ROW_ID, header_names, parse_text, read_delimited


@pytest.fixture
def split_bytes(spark):
    """Sets the bytes of a split; files are then cut anywhere."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def set_(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "0")
        spark.conf.set(keys[2], "1")

    yield set_
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def expected(whole, delimiter=","):
    rows = parse_text(whole, delimiter)
    width = len(header_names(rows[0]))
    return [(k, *(r + [""] * width)[:width]) for k, r in enumerate(rows[1:])]


def read_rows(spark, path, **options):
    return [tuple(r) for r in read_delimited(spark, str(path), **options).orderBy(ROW_ID).collect()]


def odd_text(rng, rows):
    """Quotes where they count and where they don't, all kinds of line ends, blank lines, short and long rows."""
    ends = ["\n", "\r\n", "\r"] if rng.random() < 0.5 else ["\n"]
    bits = ["a", "é", "日", " ", "1", '""', "x"]

    def cell():
        inner = "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))
        kind = rng.random()
        if kind < 0.35:
            return '"' + inner + rng.choice(["", "\n", "\r\n", ",", "\n\n\n", "\r", '""\n""']) + inner + '"' + rng.choice(["", "", "p", 'q"r"'])
        return inner.replace('"', "") + rng.choice(["", "", '"', 'y"z'])[: 9 if inner.replace('"', "") else 0]

    lines = ["h1,h2,h3"] + [",".join(cell() for _ in range(rng.choice([3, 3, 3, 1, 2, 5]))) if rng.random() < 0.9 else "" for _ in range(rows)]
    return "".join(x + rng.choice(ends) for x in lines)


@pytest.mark.parametrize("seed", range(4))
def test_files_cut_anywhere(spark, split_bytes, tmp_path, seed):
    rng = random.Random(seed)
    whole = odd_text(rng, 60) + rng.choice(["", "last,row", 'open,"quote\nto the\n\nend', 'open,"quote\n', '"', 'a,"b""'])
    path = tmp_path / "f.csv"
    path.write_bytes(whole.encode())
    for size in (29, 400):
        split_bytes(size)
        assert read_rows(spark, path, delimiter=",") == expected(whole), (seed, size)


def test_a_quote_far_from_the_head(spark, split_bytes, tmp_path):
    """A quoted line end beyond the bytes that are sniffed, in the last of some splits."""
    rows = [f"{k},value {k},plain text number {k}" for k in range(90_000)]
    whole = "id,b,c\n" + "\n".join(rows) + '\n90000,"two\nlines, one field",5\n90001,x,"y ""z"""\n'
    assert len(whole) > text.HEAD_BYTES
    (tmp_path / "f.csv").write_text(whole)
    split_bytes(1 << 19)
    got = read_rows(spark, tmp_path / "f.csv")
    assert got == expected(whole) and got[-2] == (90_000, "90000", "two\nlines, one field", "5")


def test_other_splits_than_those_found_are_an_error(spark, split_bytes, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n" + "1,2\n" * 200)
    split_bytes(100)
    file = text.open_delimited(spark, str(tmp_path / "f.csv"))
    assert file.table().count() == 200
    split_bytes(170)
    with pytest.raises(Exception, match="splits have changed"):
        file.table().count()


def test_the_first_rows_alone(spark, split_bytes, tmp_path):
    whole = odd_text(random.Random(11), 80)
    (tmp_path / "f.csv").write_bytes(whole.encode())
    split_bytes(60)
    file = text.open_delimited(spark, str(tmp_path / "f.csv"), delimiter=",")
    want = expected(whole)
    assert file.rows == len(want)
    for n in (0, 1, 7, len(want) + 5):
        assert [tuple(r) for r in file.table(n).orderBy(ROW_ID).collect()] == want[:n]


def test_a_field_over_many_splits(spark, split_bytes, tmp_path):
    whole = 'a,b\n1,"' + "no quote here\n" * 400 + '"\n2,x\n3,"' + 'with ""some""\n' * 300 + '",z\n4,"never closed\n' + "more\n" * 50
    (tmp_path / "f.csv").write_text(whole)
    for size in (100, 1000):
        split_bytes(size)
        assert read_rows(spark, tmp_path / "f.csv") == expected(whole)
    (tmp_path / "g.csv").write_text(whole.removesuffix("\n"))
    assert read_rows(spark, tmp_path / "g.csv") == expected(whole.removesuffix("\n"))


@pytest.mark.parametrize("encoding", ["cp932", "utf-16", "utf-8-sig"])
def test_encodings_in_splits(spark, split_bytes, tmp_path, encoding):
    whole = '名前,備考\r\n' + "".join(f'髙橋{k},"ソ表\n能{k}"\r\n三{k},一 ""\r\n' for k in range(60))
    (tmp_path / "f.csv").write_bytes(whole.encode(encoding))
    split_bytes(50)
    assert read_rows(spark, tmp_path / "f.csv") == expected(whole)


def test_a_folder_of_files_with_one_header(spark, split_bytes, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    parts = ['a,b\n1,"x\ny"\n2,"open\n', "a,b\n", "a,b\n3,z", "\n\na,b\n\n4,\"w\n\n\"\n"]
    for k, part in enumerate(parts):
        (folder / f"part-{k}.csv").write_text(part)
    want = [r[1:] for p in parts for r in expected(p.lstrip("\n"))]
    for size in (9, 1 << 20):
        split_bytes(size)
        assert read_rows(spark, folder) == [(k, *r) for k, r in enumerate(want)]


def test_a_folder_whose_first_files_hold_no_record(spark, tmp_path):
    """A task without rows leaves a file without bytes."""
    folder = tmp_path / "parts"
    folder.mkdir()
    for k, part in enumerate(["", "\n\n", '""\n', "b;a\n1;x\n2;y\n", "", "b;a\n3;z\n"]):
        (folder / f"part-{k}.csv").write_text(part)
    assert read_rows(spark, folder) == [(0, "1", "x"), (1, "2", "y"), (2, "3", "z")]
    assert read_delimited(spark, str(folder)).columns == [ROW_ID, "b", "a"]
    (folder / "part-3.csv").unlink()
    (folder / "part-5.csv").unlink()
    with pytest.raises(ValueError, match="empty"):
        read_delimited(spark, str(folder))


def test_lines_written_by_tasks_without_rows(spark, sf, tmp_path):
    """The one row group of a table falls to one of many tasks; and a table without rows."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines.coalesce(1).write.parquet(str(tmp_path / "a/lineitem.parquet"))
    lines.limit(0).write.parquet(str(tmp_path / "b/lineitem.parquet"))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for key in keys:
            spark.conf.set(key, "20000")
        df = QUERIES["csv_quoted_lines"](spark, str(tmp_path / "a"))
        assert spark.read.parquet(str(tmp_path / "a/lineitem.parquet")).rdd.getNumPartitions() > 4 and df.count() == lines.count()
        assert df.select("l_orderkey", "l_linenumber").exceptAll(lines.select("l_orderkey", "l_linenumber")).isEmpty()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert QUERIES["csv_quoted_lines"](spark, str(tmp_path / "b")).isEmpty()


def test_states_over_many_splits(spark):
    """Maps that set, keep and turn the state, against a loop."""
    rng = random.Random(5)
    rows = [("f" if k < 150 else "g", k * 10, 2500, 10, a := rng.random() < 0.5, rng.randint(0, 4), rng.random() < 0.5 if rng.random() < 0.3 else not a, rng.randint(0, 4), True) for k in range(250)]
    got = delimited.locate(spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in delimited.SPLIT.items()))).orderBy("file", "start").collect()
    inside, number, file = False, 0, None
    for r, (name, start, _, _, out, out_rows, inn, in_rows, _) in zip(got, rows, strict=True):
        if name != file:
            inside, number, file = False, 0, name
        assert (r.file, r.start, r.inside, r.number) == (name, start, inside, number)
        number += in_rows if inside else out_rows
        inside = inn if inside else out
        assert r.ends == inside


def test_row_ids_are_dense(spark):
    df = text.with_row_id(spark.range(1000).repartition(7).withColumn("a.b", F.lit(1)))
    assert sorted(r[ROW_ID] for r in df.collect()) == list(range(1000)) and "a.b" in df.columns

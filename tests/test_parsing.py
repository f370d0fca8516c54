import pytest
from pyspark.sql import functions as F

from tessella.functions import formats, scalars
from tessella.sources import text


def values(spark, column, cells):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, v string")
    return [r.x for r in df.orderBy("k").select(column(F.col("v")).alias("x")).collect()]


def test_numbers(spark):
    cells = ["1,234", "¥1,234", "12.5%", "(1,200)", "１２３", "1.5e3", "東京", "12月3日", "1.2.3", "", None, "(-5)", "5円", "NaN", "1e999", "-"]
    assert values(spark, scalars.parse_number, cells) == [1234, 1234, 0.125, -1200, 123, 1500, None, None, None, None, None, 5, 5, None, None, None]


def test_dates(spark):
    cells = ["2024-03-15", "2024/3/15", "2024年3月15日", "2024-03-15 10:30", "2024-13-45", "2024-02-31", "20240315", "1899-12-31", "x", None]
    assert values(spark, scalars.parse_date, cells) == [19797, 19797, 19797, 19797.4375, None, 19784, 19797, None, None, None]


def test_missing_and_booleans(spark):
    assert values(spark, scalars.is_missing, ["", " ", "N/A", "-", "--", "-x", "7", "なし", None, "　"]) == [True, True, True, True, False, False, False, True, True, True]
    assert values(spark, scalars.parse_boolean, ["Yes", "いいえ", "1", "x", None]) == [1, 0, 1, None, None]
    assert values(spark, lambda c: scalars.parse_as("boolean", c), ["なし", "ok", "3"]) == [None, 1, 3]  # missing goes before false


def test_probit(spark):
    got = spark.sql("SELECT 0.5D AS p UNION ALL SELECT 0.975D UNION ALL SELECT 0.025D UNION ALL SELECT 0D UNION ALL SELECT 1D").select(scalars.probit(F.col("p")).alias("z")).collect()
    assert [r.z for r in got] == pytest.approx([0, 1.959964, -1.959964, -5, 5], abs=1e-3)


def test_formats():
    assert [formats.number(x) for x in (None, 0, 1.5e12, 2.345e8, 12345, 1234567, 1234.56, 3.14159, 0.0123, 0.000123)] == ["—", "0", "1.50兆", "2.35億", "1.23万", "123.5万", "1,234.6", "3.14", "0.012", "1.23e-4"]
    assert formats.day(19797.9) == "2024-03-15" and formats.percent(0.1234) == "12.3%" and formats.ratio(12.6) == "13倍" and formats.ratio(0) == "—" and formats.count(1234) == "1,234"
    assert formats.by_kind("boolean", 0.5) == "50.0%" and formats.fixed(1.005, 2) == "1.00" and formats.fixed(0.125, 2) == "0.13"


def test_csv_text():
    assert text.parse_text('a,b\n"x,1","say ""hi"""\n\n"two\nlines",\n') == [["a", "b"], ["x,1", 'say "hi"'], ["two\nlines", ""]]
    assert text.parse_text("a\r\nb") == [["a"], ["b"]] and text.parse_text("a\rb\r") == [["a"], ["b"]]
    assert [text.detect_delimiter(t) for t in ("a,b\n1,2", "a\tb\n1\t2", "a;b\n1;2", 'a\t"b,c,d"\n1\t"2,3,4"', "one")] == [",", "\t", ";", "\t", ","]
    assert text.header_names(["a", "", "a", " b "]) == ["a", "列2", "a_2", "b"]
    assert len(set(text.header_names(["a", "a", "a_2"]))) == 3


def test_encodings():
    assert [text.detect_encoding(b) for b in ("あ".encode(), "あ".encode("cp932"), "あ".encode("utf-16"), b"\xef\xbb\xbfa")] == ["utf-8", "shift_jis", "utf-16le", "utf-8"]


def test_files(spark, tmp_path):
    wide = "名前,会員ランク,備考\r\n髙橋,ゴールド,\"a,b\"\r\n①,シルバー\r\n".encode("cp932")
    (tmp_path / "j.csv").write_bytes(wide)
    rows = text.read_any(spark, str(tmp_path / "j.csv")).orderBy("_row_id").collect()
    assert [tuple(r) for r in rows] == [(0, "髙橋", "ゴールド", "a,b"), (1, "①", "シルバー", "")]
    (tmp_path / "t.tsv").write_text("﻿x\ty\n1\t2\n\n3\t4\n")
    df = text.read_any(spark, str(tmp_path / "t.tsv"))
    assert df.columns == ["_row_id", "x", "y"] and [tuple(r) for r in df.orderBy("_row_id").collect()] == [(0, "1", "2"), (1, "3", "4")]
    with pytest.raises(ValueError, match="empty"):
        text.from_text(spark, "")


def test_excel(spark, tmp_path):
    import zipfile

    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="B2"><v>5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si></sst>')
    assert [tuple(r) for r in text.read_any(spark, str(tmp_path / "b.xlsx")).collect()] == [(0, "", "5")]
    with pytest.raises(ValueError, match="xlsx"):
        text.read_any(spark, str(tmp_path / "old.xls"))


def test_a_workbook_in_its_own_order(spark, tmp_path):
    """Two sheets in changed order, many rows, columns beyond Z, gaps, blank rows and every kind of cell."""
    import zipfile

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = [["id", "", "id", "flag", *[f"c{k}" for k in range(26)]]] + [[str(k), "", f"say <{k}> & more" if k % 3 else "", "1" if k % 2 else "0", *[str(k * j) if (k + j) % 4 else "" for j in range(26)]] for k in range(9000)]

    def letters(n):
        return (letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)

    def cell(r, c, v):
        at = f"{letters(c)}{r + 1}"
        if r and c == 3:
            return f'<c r="{at}" t="b"><v>{v}</v></c>'
        if r == 0 or c == 2:
            v = v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            return f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
        return f'<c r="{at}"><v>{v}</v></c>'

    body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v) + "</row>" + ("<row/>" if r % 100 == 0 else "") for r, row in enumerate(rows))
    with zipfile.ZipFile(tmp_path / "b.xlsm", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="inlineStr"><is><t>wrong</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet7.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="b" sheetId="7" r:id="rId2"/><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet7.xml"/></Relationships>')
    df = text.read_any(spark, str(tmp_path / "b.xlsm"))
    want = [(k, *["TRUE" if c == 3 and v == "1" else "FALSE" if c == 3 else v for c, v in enumerate(r)]) for k, r in enumerate(rows[1:])]
    assert df.columns == ["_row_id", *text.header_names(rows[0])]
    assert [tuple(r) for r in df.orderBy("_row_id").collect()] == want


def test_row_ids_are_dense(spark):
    df = text.with_row_id(spark.range(1000).repartition(7))
    got = [r._row_id for r in df.orderBy("_row_id").collect()]
    assert got == list(range(1000))

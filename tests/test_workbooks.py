"""Workbook files: furigana, cells without places, damaged files, filters, and files written by tasks that may fail."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from gridrecon.operators import report, workbook
from gridrecon.sources import xlsx

MAIN = xlsx._MAIN


def book(path, strings, rows, sheets=("工事",)):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{xlsx._OFFICE}"><sheets>' + "".join(f'<sheet name="{s}" sheetId="{k}" r:id="r{k}"/>' for k, s in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{xlsx._NS["r"]}">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k, _ in enumerate(sheets)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        for k, _ in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')


def test_cells_of_many_kinds(spark, tmp_path):
    strings = "<si><t>工事</t><rPh sb='0' eb='2'><t>コウジ</t></rPh><phoneticPr fontId='1'/></si><si><r><t>掘</t></r><r><t>削</t></r><rPh sb='0' eb='1'><t>クツ</t></rPh></si><si/>"
    rows = (
        "<row r='2'><c r='B2' t='s'><v>0</v></c><c t='s'><v>1</v></c><c r='AA2'><v>1.5</v></c><c t='b'><v>1</v></c><c t='e'><v>#REF!</v></c><c t='s'><v>2</v></c></row>"
        "<row><c><v>7</v></c><c t='inlineStr'><is><t>a</t><r><t>b</t></r><rPh sb='0' eb='1'><t>x</t></rPh></is></c><c t='str'><f>A1</f><v>f</v></c><c/></row>"
    )
    book(tmp_path / "a.xlsx", strings, rows)
    with open(tmp_path / "bad.xlsx", "wb") as f:
        f.write(b"no archive")
    with open(tmp_path / "a.xlsx", "rb") as f, open(tmp_path / "cut.xlsx", "wb") as g:
        g.write(f.read()[:200])
    got = xlsx.read(spark, str(tmp_path)).collect()
    assert {(r.row, r.col, r.value) for r in got if r.error is None} == {
        (2, 2, "工事"), (2, 3, "掘削"), (2, 27, "1.5"), (2, 28, "True"), (2, 29, "#REF!"), (2, 30, ""), (3, 1, "7"), (3, 2, "ab"), (3, 3, "f")
    }
    assert sorted(os.path.basename(r.doc) for r in got if r.error) == ["bad.xlsx", "cut.xlsx"] and all(r.row is None for r in got if r.error)


def test_filters_reach_the_source(spark, tmp_path):
    rows = "".join(f"<row r='{i}'><c r='A{i}'><v>{i}</v></c></row>" for i in range(1, 30))
    for n in "ab":
        book(tmp_path / f"{n}.xlsx", "", rows, ("one", "two", "three"))
    xlsx.register(spark)
    d = spark.read.format("workbooks").load(str(tmp_path))
    assert d.count() == 2 * 3 * 29 and {r.doc for r in d.select("doc").distinct().collect()} == {"a", "b"}
    some = d.where("sheet in ('one', 'three') and row > 5 and row <= 8 and sheet <> 'x'")
    assert sorted((r.doc, r.sheet, r.row) for r in some.collect()) == [(n, s, i) for n in "ab" for s in ("one", "three") for i in (6, 7, 8)]
    reader = xlsx.Reader(str(tmp_path))
    list(reader.pushFilters([xlsx.EqualTo(("sheet",), "two"), xlsx.GreaterThanOrEqual(("row",), 4), xlsx.LessThan(("row",), 6)]))
    assert (reader.sheets, reader.first, reader.last) == ({"two"}, 4, 5)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4
    assert d.where("sheet = 'none'").count() == 0


def test_checklists_as_files(spark, tmp_path):
    sections = spark.createDataFrame([(1, "概要 <&>", {"a": "x", "工期": "90日"}), (2, "二", {"b\x01": " y "}), (3, "三", {})], "section_no int, title string, fields map<string,string>")
    cells = report.checklist(sections)
    rows = cells.select(F.concat(F.lit("s/"), (F.col("section_no") % 2).cast("string")).alias("doc"), F.lit(0).alias("sheet_idx"), F.lit("確認").alias("sheet"), (F.col("section_no") * 10 + F.col("row_no") + 1).alias("row"), (F.col("col_no") + 1).alias("col"), "value")
    out = str(tmp_path / "out")
    xlsx.write(rows, out)
    xlsx.write(rows.where("doc = 's/0'"), out)  # again: replaced, the other stays
    assert sorted(os.listdir(out)) == ["s%2F0.xlsx", "s%2F1.xlsx"]
    got = {(r.doc, r.sheet, r.row, r.col, r.value) for r in spark.read.format("workbooks").load(out).collect()}
    assert got == {(r.doc, r.sheet, r.row, r.col, r.value.replace("\x01", "�")) for r in rows.where("value is not null").collect()}
    assert workbook.sheets(spark.read.format("workbooks").load(out)).count() == 2


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).selectExpr("cast(id as string) doc", "0 sheet_idx", "'s' sheet", "1 row", "1 col", "if(id = 33, raise_error('stop'), 'v') value")
    out = tmp_path / "out"
    with pytest.raises(Exception, match="stop"):
        xlsx.write(rows, str(out))
    assert not out.exists() or os.listdir(out) == []
    xlsx.write(rows.where("doc <> '33'"), str(out), "overwrite")
    assert len(os.listdir(out)) == 39
    writer = xlsx.Writer(str(out), False)
    with pytest.raises(ValueError):
        writer.commit([xlsx.Staged([("a", f"{out}/x.xlsx"), ("b", f"{out}/x.xlsx")])])


def test_letters():
    assert [xlsx.letters(c) for c in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"] and xlsx._place("AAA5", 1, 1) == (5, 703)


def test_no_workbooks(spark, tmp_path):
    xlsx.register(spark)
    assert spark.read.format("workbooks").load(str(tmp_path)).count() == 0
    assert xlsx.parse(spark.createDataFrame([("a", None)], "doc string, content binary")).first().error

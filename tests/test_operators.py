import zipfile

import pytest
from pyspark.sql import functions as F

from gridrecon.functions import text
from gridrecon.operators import blocks, grid, match, report, session, spec, tree
from gridrecon.sources import xlsx
from gridrecon.streaming import limiter

ITEMS = "doc long, ord int, item_key string, unit string, quantity double, ref string"


def items(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


def test_positional_has_each_status(spark):
    req = items(spark, [(1, 1, "ab", "m", 1.0, "内1号"), (1, 2, "cd", "m", 1.0, "内1号"), (1, 3, "ef", "m", 1.0, None), (1, 4, "gh", "m", 1.0, None), (1, 5, "ij", "m", 1.0, None), (2, 1, "x", None, None, None)])
    est = items(spark, [(1, 1, "ab", "ｍ", 1.0, None), (1, 2, "cd", "m", 2.0, None), (1, 3, "ef", "t", 1.0, None), (1, 4, "ghi", "m", 1.0, None), (1, 5, "zz", "m", 1.0, None), (1, 6, "new", "m", 1.0, None)])
    got = {(r.doc, r.ord): r.status for r in match.positional(req, est).collect()}
    assert got == {(1, 1): "OK", (1, 2): "QUANTITY_MISMATCH", (1, 3): "UNIT_MISMATCH", (1, 4): "NAME_MISMATCH", (1, 5): "MISSING", (1, 6): "EXTRA", (2, 1): "MISSING"}
    s = report.summary(match.positional(req, est)).first()
    assert s.total == 7 and s.missing == 2 and s.extra == 1


def test_greedy_takes_in_order(spark):
    req = items(spark, [(1, 1, "ab", "m", 1.0, "内1号"), (1, 2, "abc", "m", 1.0, "第1号内"), (1, 3, "qq", "m", 1.0, "内1号"), (2, 1, "x", "m", 1.0, "")])
    est = items(spark, [(1, 1, "abcd", "m", 1.0, "内1号"), (1, 2, "ab", "m", 1.0, "内1号-2"), (1, 3, "zz", "m", 1.0, "内1号")])
    got = {(r.doc, r.req_ord, r.est_ord, r.how) for r in match.greedy(req, est).collect()}
    assert got == {(1, 1, 2, "exact"), (1, 2, 1, "all"), (1, 3, 3, "missing"), (1, None, 3, "extra"), (2, 1, None, "missing")}


def test_anti_joins(spark):
    req = items(spark, [(1, 1, "abc", "m", 1.0, None), (1, 2, "", "m", 1.0, None)])
    est = items(spark, [(1, 1, "xabcx", "ｍ", 1.0005, None), (1, 2, "abc", "m", 1.002, None)])
    assert [r.ord for r in match.missing_by_name(req, items(spark, [])).collect()] == [1]
    assert [r.ord for r in match.extra_simplified(req, est).collect()] == [2]


def test_empty(spark):
    none = items(spark, [])
    assert match.positional(none, none).count() == match.greedy(none, none).count() == match.token_overlap(none, none).count() == 0


def test_titles(spark):
    s = "doc long, ref string, ord int, title string, unit string, quantity string"
    left = spark.createDataFrame([(1, "内1号", 1, None, "m", "10"), (1, "内1号", 2, None, "t", "1"), (1, "内2号", 1, None, None, None)], s)
    right = spark.createDataFrame([(1, "第1号内", 1, "x", None, None), (1, "内1号", 2, "側溝 10m", None, None), (1, "内2号", 1, "a", None, None), (1, "内3号", 1, "a", None, None)], s)
    assert {(r.key, r.side, r.match) for r in match.titles(left, right).collect()} == {("内:1", "both", True), ("内:2", "both", None), ("内:3", "right", None)}


def test_tree(spark):
    rows = spark.createDataFrame([(1, i, "　" * lv + n, a) for i, (lv, n, a) in enumerate([(0, "a", "3"), (1, "b", "1"), (1, "c", "2"), (0, "d", "9"), (2, "e", "9"), (1, "f", "1,0")])], "doc long, seq long, item_name string, amount string")
    t = tree.with_parent(rows)
    assert [r.parent_seq for r in t.orderBy("seq").collect()] == [None, 0, 0, None, 3, 3]
    assert {r.seq: r.path for r in tree.with_path(t).collect()}[4] == "d/e"
    ok = {r.seq: r.ok for r in tree.check_amounts(t).collect()}
    assert ok == {0: True, 3: False}


def test_totals_chain(spark):
    names = [("直接工事", 100), ("直接工事費", 100), ("共通仮設費", 10), ("純工事費", 110), ("工事原価", 130), ("　現場管理費", 20), ("工事価格", 160), ("　一般管理費等", 30), ("消費税相当額", 16), ("工事費計", 176)]
    rows = spark.createDataFrame([(1, i, n, str(a)) for i, (n, a) in enumerate(names)], "doc long, seq long, item_name string, amount string")
    assert all(r.ok for r in tree.check_amounts(tree.with_parent(rows)).collect())


def test_row_check(spark):
    df = spark.createDataFrame([("2", "3", "6"), ("2", "3", "6.02"), ("0", "3", "6"), (None, "3", "6"), ("1,000", "2", "2,000.01")], "unit_price string, quantity string, amount string")
    assert [r.ok for r in tree.check_rows(df).collect()] == [True, False, None, None, True]


def test_grid(spark):
    rows = spark.createDataFrame([(1, i, n, q) for i, (n, q) in enumerate([("a", None), ("", 2.0), ("b", 1.0), ("", 5.0), (None, None)])], "doc long, row int, name string, q double")
    got = grid.pair_rows(rows, ["doc"], ["row"], F.col("name"), F.col("q"), F.lit("m"))
    assert {(r.item_name, r.quantity) for r in got.collect()} == {("a", 2.0), ("b", 1.0)}
    dots = spark.createDataFrame([(1, i, c) for i, c in enumerate(["・a", "・・・b", "x", "*n", "y", "", "z", "・・・c", "・・・d", "w"])], "doc long, row int, cell string")
    assert {(r.cell, r.ref) for r in grid.dotted_blocks(dots, ["doc"], ["row"], F.col("cell")).collect()} == {("x", "内1号"), ("y", "内1号"), ("w", "内2号")}
    spans = spark.createDataFrame([(1, 1, "p", None), (1, 2, None, "v"), (1, 3, "q", "u")], "doc long, row int, place string, v string")
    assert [(r.place, r.v) for r in grid.rowspan_merge(spans, ["doc"], ["row"], "place", ["v"]).orderBy("row").collect()] == [("p", "v"), ("q", "u")]


def test_hair_borders(spark):
    cells = spark.createDataFrame(
        [(1, 1, 2, "a", "hair", None), (1, 2, 2, "b", None, None), (1, 3, 2, "c", "dotted", None), (1, 4, 2, "d", "thin", None), (1, 5, 2, "e", "hair", None)],
        "doc long, row int, col int, value string, b_top string, b_bottom string",
    )
    assert {(r.logical, r.value) for r in grid.hair_border_rows(cells, ["doc"]).collect()} == {(1, "a b"), (2, "c")}


def test_spec_and_fees(spark):
    words = spark.createDataFrame([("d", 1, "第１条", 50.0, 20.0), ("d", 3, "第2条", 50.0, 20.0), ("d", 2, "第2条", 400.0, 20.0)], "doc string, page int, text string, x0 double, top double")
    assert {(r.article, r.start_page, r.end_page) for r in spec.article_spans(words).collect()} == {(1, 1, 3), (2, 3, None)}
    fees = spark.createDataFrame([("管理費区分：1",), ("管理費区分:０",), ("管理費区分:O",), (None,)], "note string")
    assert [r.category for r in spec.fee_rows(fees, "note").collect()] == ["1"]
    page = spark.createDataFrame([("工種区分 道路改良\n単価地区：北 総日数 120日間",)], "t string")
    r = page.select(*spec.estimate_fields(F.col("t"))).first()
    assert (r["工種区分"], r["単価地区"], r["総日数"], r["工事中止日数"]) == ("道路改良", "北", "120日間", None)


def test_limiter(spark):
    hits = spark.createDataFrame([("k", float(t)) for t in (0, 1, 2, 3, 4, 5, 60, 61)] + [("j", 0.0)], "key string, ts double")
    got = {(r.key, r.ts): r.allowed for r in limiter.limit_batch(hits).collect()}
    assert [got["k", float(t)] for t in (4, 5, 60, 61)] == [True, False, False, True] and got["j", 0.0]


def test_limiter_stream(spark, tmp_path):
    spark.createDataFrame([("k", float(t)) for t in range(7)], "key string, ts double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = limiter.limit_stream(spark.readStream.schema("key string, ts double").parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hits").where("allowed").count() == 5


def test_session(spark, tmp_path):
    store = session.Store(spark, str(tmp_path))
    store.put("s", 0.0, items=spark.range(3))
    assert store.get("s", "items", 1800.0).count() == 3
    with pytest.raises(KeyError):
        store.get("s", "items", 1800.5)


def test_xlsx(spark, tmp_path):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>名称</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {m}><borders><border/><border><top style="hair"/></border></borders><cellXfs><xf borderId="0"/><xf borderId="1"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row r="1"><c r="B1" t="s" s="1"><v>0</v></c><c r="AA1"><v>1.5</v></c></row></sheetData></worksheet>')
    got = {(r.sheet, r.row, r.col, r.value, r.b_top) for r in xlsx.read(spark, str(tmp_path)).collect()}
    assert got == {("S", 1, 2, "名称", "hair"), ("S", 1, 27, "1.5", None)}


def test_text_helpers(spark):
    df = spark.createDataFrame([("第3号明 明3号 内１号",)], "t string")
    assert df.select(text.references(F.col("t")).alias("r")).first().r == ["第3号明", "明3号", "内1号"]


def sheet(spark, kinds):
    return spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "doc long, row int, k string")


def test_table_blocks_follow_a_state_machine(spark):
    import random

    rng = random.Random(3)
    kinds = [rng.choice("rhtx") for _ in range(400)]
    want, block = [], None
    for i, k in enumerate(kinds):
        if block is None and k == "r" and "h" in kinds[i + 1 : i + 4]:
            block = i + 1
        want.append(block)
        if k == "t":
            block = None
    got = blocks.table_blocks(sheet(spark, kinds), ["doc"], ["row"], F.col("k") == "r", F.col("k") == "h", F.col("k") == "t")
    assert [r.block for r in got.orderBy("row").collect()] == want


def test_sheet_blocks(spark):
    kinds = ["r", "r", "x", "a", "b", "t", "c", "r", "x", "x", "d", "r", "x", "x", "t", "r", "x", "x", "e"]
    got = blocks.sheet_blocks(sheet(spark, kinds), ["doc"], ["row"], F.when(F.col("k") == "r", "内1号"), F.col("k") == "t", F.col("k") != "b")
    assert [(r.k, r.ref) for r in got.orderBy("row").collect()] == [("a", "内1号"), ("d", "内1号-2"), ("e", "内1号-3")]
    assert blocks.sheet_blocks(sheet(spark, kinds).limit(0), ["doc"], ["row"], F.col("k"), F.lit(False), F.lit(True)).count() == 0


def test_table_titles(spark):
    kinds = ["s1", "s2", "s3", "r", "n", "s4", "r", "n", "r", "s5", "n", "r", "n", "s6"]
    k = F.col("k")
    got = blocks.table_titles(sheet(spark, kinds), ["doc"], ["row"], k == "r", k == "n", F.when(k.startswith("s"), k))
    assert [r.title for r in got.orderBy("row").collect()] == ["s2", "s4", "s5", "s6"]


def test_row_pairs_skip_what_they_took_in(spark):
    rows = spark.createDataFrame([(1, i, c, v) for i, (c, v) in enumerate([(True, "a"), (True, "b"), (True, "c"), (True, ""), (False, "e"), (True, None), (True, "g")])], "doc long, row int, c boolean, v string")
    got = blocks.row_pairs(rows, ["doc"], ["row"], F.col("c"), ["v"]).orderBy("row").collect()
    assert [(r.row, r.v, r.rows) for r in got] == [(0, "b", 2), (2, "c", 2), (4, "e", 2), (6, "g", 1)]


def test_descendants_breadth_first(spark):
    rows = spark.createDataFrame([(1, i, lv, h) for i, (lv, h) in enumerate([(0, False), (1, False), (2, True), (1, True), (0, False), (2, False), (1, True)])], "doc long, seq long, level int, h boolean")
    assert {(r.seq, r.found) for r in tree.nearest_descendant(tree.with_parent(rows, F.col("level")), F.col("h")).collect()} == {(0, 3), (1, 2), (4, 6)}


def test_reports(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (3,)], "doc long")
    b = spark.createDataFrame([(1,), (2,), (4,)], "doc long")
    assert {r.doc: r.verdict for r in report.verdicts(a, b, "doc").collect()} == {1: "FIXED", 2: "NO_CHANGE", 3: "FIXED", 4: "REGRESSION"}
    t = spark.createDataFrame([("x", "内1号", None)], "left string, right string, none string")
    assert report.without_terms(t, "left", "none", ("y",)).count() == 1 and report.without_terms(t, "none", "left", ("x",)).count() == 0
    row = t.select(text.longest_reference(F.lit("x 第1号明 内1号"), F.array(F.lit("内1号"), F.lit("第1号明"), F.lit("単2号"))).alias("r"), text.similarity(F.lit("abz"), F.lit("bacd")).alias("s")).first()
    assert row.r == "第1号明" and row.s == 0.5

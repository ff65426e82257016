"""Grids of pages and sheets to items, articles to fields, and checks of sums, on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from gridrecon.functions import text
from gridrecon.operators import articles, grid, match, report, spec, stored, tables, tree, workbook

CELL = "doc long, page int, table_idx int, row_idx int, col_idx int, text string"


def page_cells(spark, *grids):
    """grids: (doc, page, table_idx, rows)."""
    return spark.createDataFrame([(d, p, t, i, j, c) for d, p, t, rows in grids for i, r in enumerate(rows) for j, c in enumerate(r)], CELL)


def one(spark, column, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_references(spark):
    got = one(spark, text.references(F.col("x")), "単 3 号 と 第 12 号 施", "内1号単価表", "共通内4号", "第３号明 第3号 内５号", "なし", None)
    assert got == [["第12号施", "単3号"], ["内1号"], ["共通内4号"], ["第3号明", "第3号内", "内5号"], [], []]


def test_estimate_fields(spark):
    page = "工 種 区 分 ： 道路\n工事中止日数 は 約１２ 日 間\n単価地区 盛岡\n単価使用年月 ２０２５年 4月\n歩 掛 適 用 年 月 令和7年\n工期 ３３５日間"
    df = spark.createDataFrame([(page,), ("",), (None,)], "x string").select(*spec.estimate_fields(F.col("x")))
    rows = [tuple(r) for r in df.collect()]
    assert rows[0] == ("道路", "12日", "盛岡", "2025年 4月", "令和7年", "１２日間") and rows[1] == rows[2] == (None,) * 6


def test_scalars(spark):
    assert one(spark, text.simple(F.col("x")), "ｱ１， ２㎡", None) == ["ア12m2", ""]
    assert one(spark, text.field_text(F.col("x")), "Ｗ　１,０") == ["W1,0"]
    assert one(spark, text.cell(F.col("x")), " a　", "NaN", None) == ["a", "", ""] and one(spark, text.cell(F.col("x"), True), "　a") == ["　a"]
    r = spark.createDataFrame([("abcd", "abxd"), ("", ""), ("a", None)], "a string, b string").select(text.ratio(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in r] == [75.0, 100.0, 0.0]
    q = spark.createDataFrame([("1", "0.5", None), ("1", None, ".06"), ("1", "L=2", "6"), ("1,234", None, None), ("2.5", ".1", None)], "w string, l string, r string")
    assert [r[0] for r in q.select(text.split_quantity(*map(F.col, "wlr"))).collect()] == [1.5, 1.06, 1.6, 1.0, 2.5]
    assert [r[0] for r in q.select(text.signed_quantity(*map(F.col, "wlr"))).collect()] == ["1.5", "1.06", "1.6", "1234", "2.5"]


def test_pattern_histogram_has_overall_counts(spark):
    refs = spark.createDataFrame([("a", "内1号"), ("a", "内2号"), ("b", "内1号"), ("b", "x"), (None, "単1号")], "sheet string, ref string")
    got = {(r.sheet, r.pattern, r.overall): r.n for r in report.pattern_histogram(refs).collect()}
    assert got == {("a", "内", False): 2, ("b", "内", False): 1, ("b", "Other", False): 1, (None, "単", False): 1, (None, "内", True): 3, (None, "Other", True): 1, (None, "単", True): 1}


def test_named_rows_stop_at_names_and_totals(spark):
    rows = spark.createDataFrame([(1, 1, "a", None, None), (1, 2, None, "m", ""), (1, 3, "b", "", None), (1, 4, "c", None, "3"), (1, 5, "合計", "t", "9"), (1, 6, None, "kg", "8")], "doc long, n int, name string, unit string, q string")
    got = [(r.name, r.unit, r.q) for r in grid.named_rows(rows, ["doc"], ["n"], F.col("name").isNotNull(), F.col("name") == "合計", ["unit", "q"]).orderBy("n").collect()]
    assert got == [("a", "m", None), ("b", None, None), ("c", None, "3")]


def test_trees_of_any_depth(spark):
    rows = spark.createDataFrame([(1, i, f"n{i}", i) for i in range(40)] + [(2, 1, "a", 0), (2, 2, "b", 9), (2, 3, "c", 5)], "doc long, seq long, item_name string, level int")
    t = tree.with_parent(rows, F.col("level"))
    got = {(r.doc, r.seq): r for r in tree.with_path(t).collect()}
    assert len(got) == 43 and got[1, 39].path == "/".join(f"n{i}" for i in range(40)) and got[1, 39].ancestors == list(range(39))
    assert [got[2, i].parent_seq for i in (1, 2, 3)] == [None, 1, 1]
    cycle = spark.createDataFrame([(1, 1, 2, "a"), (1, 2, 1, "b"), (1, 3, None, "c"), (1, 4, 3, "d")], "doc long, seq long, parent_seq long, item_name string")
    assert {r.seq: r.path for r in tree.with_path(cycle).collect()} == {3: "c", 4: "c/d"}
    assert stored.purge(spark) > 0


def test_sums_are_not_checked_below_totals(spark):
    names = [("工種", 0, 5), ("a", 1, 5), ("直接工事費", 0, 5), ("b", 1, 9), ("c", 2, 1), ("純工事費", 0, 8), ("x", 1, 4), ("工事原価", 0, 12)]
    rows = spark.createDataFrame([(1, i, n, lv, str(a)) for i, (n, lv, a) in enumerate(names)], "doc long, seq long, item_name string, level int, amount string")
    t = tree.with_parent(rows, F.col("level"))
    assert {r.seq: r.ok for r in tree.check_sums(t).collect()} == {0: True}
    again = {r.item_name: (float(r.expected), r.ok) for r in tree.check_totals_again(t).collect()}
    assert again == {"直接工事費": (5.0, True), "純工事費": (5.0, False), "工事原価": (12.0, True)}
    assert [r.depth for r in tree.flatten(t).collect()] == [0, 1, 0, 1, 2, 0, 1, 0]


HEAD = ["費目・工種・種別・細別・規格x", "規格", "単位", "数量", "摘要"]


def test_main_table_items(spark):
    head = ["工事区分・工種・種別・細別", "規格", "単位", "数量", "摘要"]
    grid_ = [["表題", None, None, None, None], head, ["土工", "A", None, None, None], [None, None, "m3", "1,000", None], [None, None, "t", "5", None], ["舗装", None, "m2", "2", None], [None, None, None, None, None], [None, "規格だけ", None, None, None], [None, None, "式", None, None], [None, None, "本", "3", None]]
    cells = page_cells(spark, (1, 1, 0, grid_), (1, 2, 0, [head]), (1, 3, 0, [["a", "b"], ["c", "d"]]))
    got = [(r.row_idx, r.item_key, r.quantity, r.unit, r.fields.get("摘要")) for r in tables.items(cells).orderBy("row_idx").collect()]
    assert got == [(2, "土工 A", 1000.0, "m3", None), (5, "舗装", 2.0, "m2", None), (7, "規格だけ", 3.0, "本", None)]
    assert tables.items(cells, start=2).count() == 0 and tables.items(cells.limit(0)).count() == 0


def test_kitakami_items(spark):
    head = ["費 目 ・ 工 種 ・ 種 別 ・ 細", "数量", "", "単位", "明細単価番号"]
    cells = page_cells(spark, (1, 1, 0, [head, ["側溝", "1", ".5", "m", "第1号施"], ["合計", "9", None, "m", None], ["縁石", "2", "L=3", "m", None]]))
    got = [(r.item_key, r.quantity, r.unit) for r in tables.items(cells, tables.KITAKAMI).orderBy("row_idx").collect()]
    assert got == [("側溝", 1.5, "m"), ("縁石", 2.0, "m")]


def test_dotted_items(spark):
    a = [["・先の項目", "B", "m", "4", None], ["工 種 ・ 種 目", "規格", "単位", "数量", "備考"], ["・・掘削", "", "", "", "x"], ["＊注", None, None, None, None], ["明細", "r", "m", "1", None], ["・・・埋戻", "算出数量 3", "良質", "m3", "1,200"]]
    b = [["・次頁", "C", "kg", "7", None], ["…", None, None, None, None]]
    got = [(r.page, r.item_key, r.quantity, r.unit, r.triple) for r in tables.items(page_cells(spark, (1, 1, 0, a), (1, 2, 0, b)), tables.NOUSEI).orderBy("page", "row_idx").collect()]
    assert got == [(1, "先の項目 B", 4.0, "m", False), (1, "掘削 x", 0.0, None, False), (1, "埋戻 算出数量 3", 0.0, "良質", True), (2, "次頁 C", 7.0, "kg", False)]


def test_page_ranges(spark):
    cells = spark.createDataFrame([(1, p) for p in (1, 2, 3)], "doc long, page int")
    pages = lambda **k: [r.page for r in tables.pages_between(cells, **k).orderBy("page").collect()]
    assert pages(start=2, end=9) == [2, 3] and pages(start=3, end=2) == [] and pages() == [1, 2, 3] and pages(start=2, end=9, strict=True) == [] and pages(end=2) == [1, 2]


def sheet_cells(spark, rows, sheet="main", idx=0, tops=(), bottoms=()):
    data = [(1, sheet, idx, i, j, v, "hair" if i in tops else None, "thin" if i in bottoms else None) for i, r in enumerate(rows, 1) for j, v in enumerate(r, 1)]
    return spark.createDataFrame(data, "doc long, sheet string, sheet_idx int, row int, col int, value string, b_top string, b_bottom string")


def line(name, unit=None, qty=None, price=None, amount=None, notes=None):
    return [None, name, None, unit, qty, price, amount, notes]


def test_workbook_main_table(spark):
    head = line("費目・工種・種別・細別・規格", "単位", "数量", "単価", "金額", "摘要")
    rows = [line("工事 内訳書"), head, line("側溝", "m"), line("設置", None, "1,0"), line("縁石", "m", "3", None, None, "内 1号"), line(None), line(None), line(None), line("外")]
    cells = sheet_cells(spark, rows, tops=(3, 5))
    t = workbook.main_tables(cells).collect()
    assert [(r.title_row, r.title, r.header_row, r.end_row) for r in t] == [(1, "工事 内訳書", 2, 5)]
    got = [(r.table_number, r.line_number, r.item_key, r.quantity, r.unit, r.fields.get("摘要")) for r in workbook.main_items(cells).orderBy("line_number").collect()]
    assert got == [("1", 1, "側溝 設置", 10.0, "m", None), ("1", 2, "縁石", 3.0, "m", "内1号")]
    assert workbook.main_items(cells.limit(0)).count() == 0


@pytest.mark.parametrize("tail, want", [
    ([line("工事価格"), line(None, "式", "1"), line("消費税額")], [("工事価格", 1.0), ("消費税額", 1.0)]),
    ([line("工事価格"), line("消費税額及び", "式", "1")], [("工事価格", 1.0), ("消費税額及び", 1.0)]),
    ([line("最後", "式", "1")], [("最後", 1.0)]),
])
def test_last_row_of_fourteen(spark, tail, want):
    head = line("費目・工種・種別・細別・規格")
    rows = [head, *(line(f"行{i}", "m", "1") for i in range(13)), *tail]
    got = [(r.item_key, r.quantity) for r in workbook.main_items(sheet_cells(spark, rows, tops=range(3, 16))).orderBy("line_number").collect()]
    assert got[:13] == [(f"行{i}", 1.0) for i in range(13)] and got[13:] == want


def test_sheets(spark):
    cells = sheet_cells(spark, [["x"]], "b", 1).unionByName(sheet_cells(spark, [["y"]], "a", 0)).unionByName(sheet_cells(spark, [["z"]], " ", 2))
    assert [r.sheet for r in workbook.sheets(cells).orderBy("position").collect()] == ["a", "b"]
    assert [r.sheet for r in workbook.subtable_sheets(cells).collect()] == ["b"] and [r.sheet for r in workbook.subtable_sheets(cells, "b").collect()] == ["a"]
    assert [r.value for r in workbook.sheet_cells(cells, sheet="b").collect()] == ["x"] and workbook.sheet_cells(cells, sheet="none").count() == 0
    assert [r.ok for r in workbook.subtable_sheets(cells.where("sheet = 'a'")).collect()] == [False]


def test_verified_sheet(spark):
    rows = [["前書き"], ["", "費目・工種・種別", "単位", "数量", "金額"], ["", "本工事", "式", "1", "5"], ["- 2 -"], ["", "　道路", "m", "2", "5"], ["", "費目・工種・種別"], ["A1"], ["", "次", "m", "1", "1"]]
    cells = sheet_cells(spark, rows)
    assert {r.row: r.next_row for r in workbook.head_rows(cells).collect()} == {2: 6, 6: None}
    got = [(r.item_name, r.unit, r.quantity, r.amount) for r in workbook.hierarchy(cells).orderBy("seq").collect()]
    assert got == [("本工事", "式", "1", "5"), ("　道路", "m", "2", "5"), ("次", "m", "1", "1")]
    t = tree.with_parent(workbook.hierarchy(cells))
    assert [r.level for r in t.orderBy("seq").collect()] == [0, 1, 0]
    flags = [tuple(r) for r in workbook.row_texts(cells).where("row in (4, 7)").orderBy("row").select(workbook.is_table_number(F.col("n"), F.col("only")), workbook.is_table_number(F.col("n"), F.col("only"), True)).collect()]
    assert flags == [(True, True), (True, False)]


def art_rows(spark, article, *tables_):
    return spark.createDataFrame([(1, article, t, i, r) for t, rows in enumerate(tables_) for i, r in enumerate(rows)], "doc long, article string, table_idx int, row_idx int, cells array<string>")


def art_text(spark, article, body):
    return spark.createDataFrame([(1, article, body)], "doc long, article string, text string")


def test_text_articles(spark):
    r = articles.article_2(art_text(spark, "第2条", "全体工期 300\nうち余裕期間 30 日間\n4 週休２日工事（発注者指定）\n対象の有無 有り\n11 熱中症予防対策\n対象の有無 無し")).first()
    assert (r["全体工期"], r["うち余裕期間"], r["うち実工期"], r["週休２日工事_対象の有無"], r["週休２日工事_分類"], r["熱中症予防対策に係る工期の延長_対象の有無"]) == ("300", "30", None, "有", "発注者指定", "無")
    r = articles.article_3(art_text(spark, "第3条", "15 ＩＣＴ活用工事\n対象の有無 有\nＩＣＴ活用工事（土工）\n16 １日未満で完了する小規模作業の積算\n対象の有無 －")).first()
    assert (r["ＩＣＴ活用工事_対象の有無"], r["ＩＣＴ活用工事_区分"], r["１日未満で完了する小規模作業の積算_対象の有無"]) == ("有", "土工", "無")
    c = {r.condition: r.fields for r in articles.conditions(art_text(spark, "第7条", f"{articles.POLLUTION} 有\n水替・流入防止施設設置の公害防止対策の有無 有\n施 設 内 容 ポンプ\n設 置 期 間 3月\n濁水・湧水等の処理条件の有無 無")).collect()}
    assert c == {"公害防止のための制限": {"内容": articles.POLLUTION}, "水替・流入防止施設": {"施設内容": "ポンプ", "設置期間": "3月"}}


def test_table_articles(spark):
    rows = art_rows(spark, "第4条", [["", "石材類", "", ""], ["■", "砕石\n40", "C-40", "路盤"], ["□", "砂", "", ""]], [["適用工種", "", "", "セメント種類", "", "", "", ""], ["", "", "", "N", "BB", "", "", ""], ["■", "基礎", "", "□", "■", "18-8", "60", "270"]],
                    [["その他の使用材料の有無"]], [["材料名", "規格・寸法・材質", "適用工種", "備考"], ["管", "VP", "排水", None], [None, " ", "", ""]])
    assert [(r.section, r.fields) for r in articles.ticked(rows).collect()] == [("石材類", {"材料名": "砕石 40", "規格": "C-40", "適用箇所": "路盤"})]
    assert [tuple(r)[3:] for r in articles.concrete(rows).collect()] == [("BB", "18-8", "60", "270")]
    assert [tuple(r)[2:] for r in articles.other_materials(rows).collect()] == [("管", "VP", "排水", "")]
    g = art_rows(spark, "第8条", [["a"], ["b"]], [["配置場所", "配置員数", "編成", "総配置員数", "昼夜別", "交代要員の有無"], ["国道\n4号", None, None, None, None, None], [None, "2", "A", "10", "昼", "無"], ["県道", "3", "", "", "夜", ""], ["", "", "", "", "", ""]])
    assert [tuple(r)[2:] for r in articles.guards(g).orderBy("row_idx").collect()] == [("国道\n4号", "2", "A", "10", "昼", "無", "4号"), ("県道", "3", "A", "10", "夜", "無", "県道")]
    head = list(articles.TEMPORARY)
    w = art_rows(spark, "第10条", [head, ["仮設", "a", "b", "m", "1", None]], [["詳細", "x"], ["y", None]], [head, ["指定", "", "", "", "", ""], [None] * 6])
    assert [(r.section, r["工種"]) for r in articles.temporary_works(w).orderBy("row_idx", "section").collect()] == [("任意仮設", "仮設"), ("指定仮設", "指定")]
    p = {r.item: (r.answer, r.details) for r in articles.paired_works(art_text(spark, "第10条", "仮設備の引渡し・引継ぎの有 " + "－" * 80 + "仮設備の設計条件の指定 無"), w).collect()}
    assert p == {articles.PAIRED[0]: ("有", [["詳細", "x"]]), articles.PAIRED[1]: (None, None), articles.PAIRED[2]: ("無", None)}
    e = art_rows(spark, "第11条", [["副産物名", "搬入再資源化施設名", "搬入場所"], ["土", "A社", "市内"], ["", "B社", "市外"]])
    assert [tuple(r)[2:] for r in articles.listed(e, "建設副産物").collect()] == [("土", "A社", "市内", "")]
    assert articles.listed(e, "建設廃棄物").count() == 0
    s = art_rows(spark, "第13条", [["調査項目", "採取地点", "採取回数", "備考"], ["水質", "井戸", "2", ""]])
    assert articles.survey_rows(art_text(spark, "第13条", "周辺環境影響調査\n対象の有無 有"), s).count() == 1 and articles.survey_rows(art_text(spark, "第13条", "周辺環境影響調査\n対象の有無 無"), s).count() == 0
    f = art_rows(spark, "第14条", [["○", "詳しく\n書く"], ["○", "次"]])
    r = articles.article_14(art_text(spark, "第14条", "労働者確保に要する間接費の実績変更 対象の有無 有\n施工箇所が点在する工事の積算方法 別途\n 対象の有無 有"), f).first()
    assert (r.labour, r.detail, r.scattered, r.method) == ("有", "詳しく 書く", "有", "別途")
    both = articles.all_sections(art_text(spark, "第14条", "x").unionByName(art_text(spark, "第2条", "全体工期 3")), f.unionByName(e).unionByName(w))
    assert {r.section for r in both.collect()} >= {"第2条", "第14条", "第11条 副産物", "第10条"}

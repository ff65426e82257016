"""Detail rows of subtables and titles of page tables, on small fixtures."""

import random

from pyspark.sql import functions as F

from gridrecon.operators import details, titles

SHEET = "doc long, n int, ref string, total boolean, general string, name string, unit string, quantity string, price string, amount string, note string"


def row(n, general=None, name=None, unit=None, quantity=None, price=None, amount=None, note=None, ref=None, total=False, doc=1):
    return (doc, n, ref, total, general, name, unit, quantity, price, amount, note)


def detailed(spark, rows, skip=1):
    return details.sheet_details(spark.createDataFrame(rows, SHEET), ["doc"], ["n"], F.col("ref"), F.col("total"), skip)


def lines(df):
    return sorted((r.ref, r.line, r.name, r.unit, r.quantity, r.amount) for r in df.collect())


def test_general_names_take_in_the_row_below(spark):
    rows = [
        row(1, ref="明1号"), row(2, "排水管", note="a"), row(3, None, "VP100", "m", "3"), row(4, "土工"), row(5, None, None, "m3", "2"), row(6, "雑工"), row(7, "nan"),
        row(8, None, "名　称"), row(9, None, "x", unit="単 位"), row(10, None, None, None, None, None, "5"), row(11, None, "計", total=True), row(12, None, "after", "m", "1"),
    ]
    got = detailed(spark, rows)
    assert lines(got) == [("明1号", 1, "排水管 VP100", "m", "3", ""), ("明1号", 2, "土工", "m3", "2", ""), ("明1号", 3, "雑工", "", "", ""), ("明1号", 4, "", "", "", "5")]
    assert [r.note for r in got.where("line = 1").collect()] == ["a"]
    assert [(r.ord, r.item_key, r.quantity) for r in details.items(got, ["doc"]).orderBy("ord").collect()] == [(1, "排水管 VP100", 3.0), (2, "土工", 2.0), (3, "雑工", 0.0)]
    (one,) = details.nested(got.withColumn("title", F.lit("t")), ["doc"], "title").collect()
    assert (one.ref, one.row_count, [r.line for r in one.rows], one.title) == ("明1号", 4, [1, 2, 3, 4], "t")


def test_a_total_that_was_taken_in_ends_nothing(spark):
    rows = [row(1, ref="明1号"), row(2, "管"), row(3, amount="計", total=True), row(4, name="b", quantity="1"), row(5, total=True), row(6, name="c")]
    assert lines(detailed(spark, rows)) == [("明1号", 1, "管", "", "", "計"), ("明1号", 2, "b", "", "1", "")]


def test_empty_sheets_long_texts_and_references_twice(spark):
    assert detailed(spark, []).count() == 0 and detailed(spark, [row(1, name="a")]).count() == 0
    long = "名" * 100_000
    rows = [row(1, ref="明1号"), row(2, name=long), row(3, ref="明1号"), row(4, ref="明2号"), row(5, name="b"), row(6, ref="明1号"), row(7, name="b")]
    got = [(r.ref, r.line, len(r.name)) for r in detailed(spark, rows).orderBy("ref").collect()]
    assert got == [("明1号", 1, 100_000), ("明1号-2", 1, 1), ("明2号", 1, 1)]


def walked(rows, skip):
    """The same by walking row after row."""
    rows, out, n_of = sorted(rows, key=lambda r: (r[0], r[1])), [], {}
    for doc in sorted({r[0] for r in rows}):
        sheet = [tuple(x or "" for x in r) for r in rows if r[0] == doc]
        opens, free = [], 0
        for i, r in enumerate(sheet):
            if r[2] and i >= free:
                opens, free = [*opens, i], i + skip
        for i, until in zip(opens, [*opens[1:], len(sheet)]):
            at, line = i + skip, 0
            while at < until and not sheet[at][3] and not sheet[at][2]:
                _, _, _, _, g, name, unit, qty, price, amount, _ = sheet[at]
                below = sheet[at + 1][5:10] if at + 1 < len(sheet) else ()
                at += 1
                if g and not (name or unit or qty or amount) and any(below):
                    name, unit, qty, price, amount = " ".join(filter(None, (g, below[0]))), *below[1:]
                    at += 1
                else:
                    name = name or g
                if name or qty or price or amount:
                    line += 1
                    if line == 1:
                        n_of[doc, sheet[i][2]] = k = n_of.get((doc, sheet[i][2]), 0) + 1
                    out.append((doc, sheet[i][2] + (f"-{k}" if k > 1 else ""), line, name, unit, qty, price, amount))
    return sorted(out)


def test_details_are_those_of_a_walk(spark):
    rng, rows = random.Random(5), []
    for doc in range(40):
        for n in range(60):
            ref, total = rng.choice(["明1号", "明2号"]) if rng.random() < 0.08 else None, rng.random() < 0.05
            cell = lambda v, p: v if not ref and rng.random() < p else None  # noqa: B023, E731
            rows.append(row(n, cell("g", 0.7), cell("s", 0.2), cell("m", 0.1), cell("1", 0.15), cell("9", 0.5), cell("7", 0.1), None, ref, total, doc))
    got = sorted((r.doc, r.ref, r.line, r.name, r.unit, r.quantity, r.price, r.amount) for r in detailed(spark, rows, 2).collect())
    assert got == walked(rows, 2) and len(got) > 200


def titled(spark, tables, page="", wide=True):
    """Titles of tables: lists of rows of cells; the row that begins with 第 holds the reference, one that begins with 名称 the header."""
    rows = [(t, i, cells, (cells[0] or "").split("\n")[0] if cells and (cells[0] or "").startswith("第") else None, page) for t, x in enumerate(tables) for i, cells in enumerate(x)]
    df = spark.createDataFrame(rows, "t int, n int, cells array<string>, ref string, page string")
    out = titles.page_titles(df, ["t"], ["n"], "ref", F.get("cells", F.lit(0)) == "名称", "page", wide)
    return {r.t: tuple(r.title) if r.title else None for r in out.collect()}


REF = ["第1号明", *[""] * 6]


def test_titles_by_labels_and_their_limits(spark):
    labels = ["第1号明", "管布設", " VP ", "単位", "ｍ", "単位数量", "10", "単価"]
    assert titled(spark, [[labels], [labels[:6]], [[*labels[:4], None, *labels[5:]]], [["第1号明", "a 1 m 当り"]]]) == {0: (0, "管布設 VP", "ｍ", "10"), 1: None, 2: None, 3: None}
    assert titled(spark, [[REF, ["x   1 m 当り"], ["名称"]]], wide=False) == {0: None}
    assert titled(spark, []) == {} and titled(spark, [[["a"], [], None]]) == {}


def test_titles_by_cells_and_lines(spark):
    cells = [
        ["第1号明", "短", "舗装工 明細書", "１０　ｍ2　当り", None, "", "名称 長い見出し"],
        ["第1号明", "甲甲", "乙乙", "1 m 当り", "2 t、 当り", "", ""],
        ["第1号明", "桝 B10×W10×H10", "1,000基当り", "", "", "", ""],
        ["第1号明", "", "12m", "", "", "", ""],
        ["第1号明\n管  1.5 m 当り 単価表\n", "", "", "", "", "", ""],
        ["第1号明", "先\n工 1m当り", "", "", "", "", ""],
    ]
    want = {0: (1, "舗装工", "ｍ2", "10"), 1: (1, "甲甲", "t", "2"), 2: (1, "桝 B10×W10×H10", "基", "1,000"), 3: None, 4: (2, "管", "m", "1.5"), 5: (2, "工", "m", "1")}
    assert titled(spark, [[c] for c in cells]) == want


def test_titles_from_rows_near_by_and_from_the_page(spark):
    head, near = ["名称", "単位"], ["管", "1 m 当り"]
    tables = [
        [REF, ["名称 管  2 m 当り"], near, ["桝  3 m 当り"], head],  # between, the first without a header's word
        [REF, near],  # no header below: rows below do not count
        [["遠  4 m 当り"], near, [""], REF, head],  # above: the farthest of three
        [near, [""], [""], [""], REF, head],  # four rows above is too far
        [REF, head, near, REF, head],  # the second reference has the row above
        [[None, "左", "5", "m", "当り"], REF, near, head],  # rows below come first
    ]
    got = titled(spark, tables)
    assert got[0] == (3, "管", "m", "1") and got[1] is None and got[2] == (4, "遠", "m", "4") and got[3] is None and got[5] == (3, "管", "m", "1")
    rows = [(0, i, c, "r" if c[0].startswith("第") else None) for i, c in enumerate(tables[4])]
    df = spark.createDataFrame(rows, "t int, n int, cells array<string>, ref string")
    both = {r.n: r.title and tuple(r.title) for r in titles.page_titles(df, ["t"], ["n"], "ref", F.get("cells", F.lit(0)) == "名称").collect()}
    assert both == {0: None, 3: (4, "管", "m", "1")}
    assert titled(spark, [[REF]], "前\n第1号明\n舗装工 明細書\n 2.5 ㎡ 当り") == {0: (5, "舗装工", "㎡", "2.5")}
    assert titled(spark, [[REF]], "第1号明" + "あ" * 300 + "\n工 1 m 当り") == {0: None}  # too far behind the reference
    assert titled(spark, [[REF]], "い" * 300 + "\n工 1 m 当り") == {0: (5, "工", "m", "1")}  # the page does not hold the reference

"""Headings of the articles' tables that run over several lines of a cell."""

from gridrecon.operators import articles

ROWS = "doc long, article string, table_idx int, row_idx long, cells array<string>"


def test_headings_over_lines_of_a_cell(spark):
    """A line break inside a heading is dropped, whichever cell it is in; null cells are empty."""
    rows = spark.createDataFrame(
        [
            (1, "第14条", 0, 0, ["種\n類", "数\n量", "保管・\n仮置場所"]), (1, "第14条", 0, 1, ["砕石", "3", "現場"]), (1, "第14条", 0, 2, [None, "3", "現場"]), (1, "第14条", 0, 3, [" ", "3", "現場"]),
            (2, "第10条", 0, 0, ["工\n種", "種\n別", "細\n別", "単\n位", "数\n量", "備\n考"]), (2, "第10条", 0, 1, ["仮設", None, "", "m", "2", None]), (2, "第10条", 0, 2, [None] * 6),
        ],
        ROWS,
    )
    listed = articles.listed(rows, "現場発生品").orderBy("row_idx").collect()
    assert [tuple(r) for r in listed] == [(1, 1, "砕石", "3", "現場"), (1, 2, "", "3", "現場")]
    works = articles.temporary_works(rows).collect()
    assert [tuple(r) for r in works] == [(2, "任意仮設", 1, "仮設", "", "", "m", "2", "")]


def test_concrete_kind_is_the_heading_of_the_first_ticked_column(spark):
    head = ["", "適用工種", "セメント\n種類", "高炉\nBB", "普通\nN", "規格", "比", "量"]
    lines = [["■", "x", "", "■", "■", "a", None, "1"], ["■", "x", "", "", "■", "b", "2", ""], ["■", "x", "", None, "□", "c", "", ""], ["□", "x", "", "■", "", "d", "", ""], ["■", "short"]]
    rows = spark.createDataFrame([(1, "第4条", 0, i, c) for i, c in enumerate([head, *lines])], ROWS)
    out = articles.concrete(rows).orderBy("row_idx").collect()
    assert [tuple(r)[2:5] for r in out] == [(1, "高炉\nBB", "a"), (2, "普通\nN", "b"), (3, "", "c")]
    assert articles.concrete(rows.limit(0)).count() == 0

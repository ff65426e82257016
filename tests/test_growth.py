"""What grows with the input: plans that shuffle once what they read, and results at the edges of the faster forms."""

import io
import random
import re
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridrecon.functions import text
from gridrecon.operators import match, tables, tree, workbook
from gridrecon.plans import catalogue, drawn, files, running, sheets  # noqa: F401
from gridrecon.sources import xlsx

SF = "/root/testdata/sf0.001"


def shuffles(df):
    """Exchanges of the plan as it begins, without broadcasts and those that are reused."""
    return len(re.findall(r"[- ]Exchange ", df._jdf.queryExecution().executedPlan().toString()))


def test_hierarchy_is_one_pass(spark, monkeypatch):
    for m in (tree, workbook):
        monkeypatch.setattr(m, "written", lambda df, name: (_ for _ in ()).throw(AssertionError(f"{name} written")))
    assert shuffles(catalogue.QUERIES["sheet_hierarchy"](spark, SF)) <= 3  # lines by order, and at the most by part and back


def test_hierarchy_keeps_what_is_not_clean(spark):
    rows = [(1, 2, "種別"), (1, 3, "単位"), (2, 2, "費目​ 工種 種別"), (2, 4, "単位"), (3, 2, "\t"), (3, 4, "m"), (4, 2, "　a　 b "), (4, 4, "\t"), (5, 1, "- 3 -"), (6, 2, " "), (7, 2, "x"), (7, 3, None), (7, 4, " m ")]
    cells = spark.createDataFrame([("d", "s", r, c, v) for r, c, v in rows], "doc string, sheet string, row int, col int, value string")
    got = [(r.doc, r.seq, r.item_name, r.unit) for r in workbook.hierarchy(cells).orderBy("seq").collect()]
    assert got == [("d/s", 3, "\t", "m"), ("d/s", 4, "　a　 b ", "\t"), ("d/s", 7, "x", "m")]
    t = tree.with_parent(workbook.hierarchy(cells), together=True).collect()
    assert sorted((r.seq, r.level, r.parent_seq) for r in t) == [(3, 0, None), (4, 1, 3), (7, 0, None)]


def test_clean_cell_of_all_blanks(spark):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in range(0x1C, 0x20)] + ["​", "‌", "‍", "﻿", "\x1c"]
    values = [v for b in blanks for v in (b, f"a{b}b", f"{b}a", f"a{b}", f" {b}a", f"a {b}b")]
    want = [" ".join(re.sub("[​-‍﻿]", "", v).replace("\x1c", "\0").split()).replace("\0", "\x1c") for v in values]
    got = spark.createDataFrame(list(enumerate(values)), "i int, x string").orderBy("i").select(text.clean_cell(F.col("x"))).collect()
    assert [r[0] for r in got] == want


def test_small_workbooks_are_batched_and_read_as_zipfile_does(spark, tmp_path):
    sheets = [("表紙 & <\">", [(1, 1, "5-LOW"), (3, 28, "")]), ("内訳", [(r, c, f"{r}工\n") for r in range(1, 9) for c in (2, 5)])]
    data = xlsx.workbook(sheets)
    want = [(n, k, r, c, v, *[None] * 4) for k, (n, cells) in enumerate(sheets) for r, c, v in cells]
    assert list(xlsx.cells(data)) == want
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and len(z.namelist()) == 6

    class Slow(xlsx._Parts):
        _plain_directory = staticmethod(lambda data: None)

    def read(parts, data):
        out = []
        try:
            with pytest.MonkeyPatch.context() as m:
                m.setattr(xlsx, "_Parts", parts)
                out.extend(xlsx.cells(data))
        except Exception as broken:
            out.append((type(broken).__name__, str(broken)))
        return out

    plain = xlsx._Parts
    for i in range(0, len(data), 7):  # damage gives the same rows and the same error
        for bad in (data[:i], data[:i] + bytes([data[i] ^ 0x55]) + data[i + 1 :]):
            assert read(plain, bad) == read(Slow, bad)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(xlsx, "SMALL", 10)  # parts are unpacked and parsed as streams
        assert list(xlsx.cells(data)) == want
    books = [pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array([data, None, data], pa.binary())], ["doc", "content"])]
    got = list(xlsx._batches(r for b in books for d, x in zip(*(c.to_pylist() for c in b.columns)) for r in xlsx._rows(d, x or b"")))
    assert len(got) == 1 and got[0].num_rows == 2 * len(want) + 1 and got[0].column("error").null_count == 2 * len(want)


def test_overlap_shuffles_names_not_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcｶﾞ工　.") for _ in range(rng.randrange(9)))
    rows = [[(d, i, word(), 1.0, "m") for d in (1, 2, None) for i in range(40)] + [(side, 1, "abc", 1.0, "m")] for side in (7, 8)]
    req, est = (spark.createDataFrame(r, "doc long, ord int, item_key string, quantity double, unit string") for r in rows)
    for k in (None, 1, 3):
        find = (lambda n: match.token_overlap(req, est, n)) if k is None else (lambda n: match.best_candidate(req, est, k, n))
        a, b = find(10**6), find(5)
        assert a.dtypes == b.dtypes and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() > 40
        assert shuffles(a) <= 2


def test_overlap_queries_join_nothing(spark):
    for name in ("token_overlap_join", "best_candidate_topk"):
        assert "Join" not in catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_names_without_signs(spark):
    odd = ["", " A_b 9 ", "a\n", "a b\n", "Ab\u00a0c", "当り", "1.5", "第3号 x", "ﾊﾞｽ A", "ガﾟ", "ﾞ", None]
    full = text.name(F.concat(F.coalesce("x", F.lit("")), F.lit("/")))  # a sign to be dropped, so the whole way is taken
    got = spark.createDataFrame([(x,) for x in odd], "x string").select(text.name(F.col("x")), full).collect()
    assert [r[0] for r in got] == ["", "a_b9", "a", "ab", "abc", "", "15", "x", "バスa", "ガ゜", "゛", ""]
    assert [a for (a, _), x in zip(got, odd) if x != "当り"] == [b for (_, b), x in zip(got, odd) if x != "当り"]


def test_pages_shuffle_once(spark):
    assert shuffles(tables.rows_of(sheets._grids(spark, SF))) <= 3  # lines by order, and at the most by part and back


def test_rows_with_gaps_and_spaced_headers(spark):
    grid = [[None, "表", "x"], ["工 種 ・ 種 目", "単　位", "数 ・量"], ["・a", "m", "2"]]
    cells = [(1, p, 0, i, j, c) for p in (0, 1) for i, r in enumerate(grid) for j, c in enumerate(r)] + [(1, 1, 0, 3, 2, "z"), (1, None, 0, 0, 0, "y")]
    df = spark.createDataFrame(cells, "doc long, page int, table_idx int, row_idx int, col_idx int, text string")
    rows = tables.rows_of(tables.pages_between(df))
    assert {r.row_idx: r.cells for r in rows.collect()} == dict(enumerate(grid)) | {3: [None, None, "z"]}  # pages count from 1
    h = tables.headers(rows, tables.NOUSEI).collect()
    assert [(r.header_idx, r.layout, r.places["数量"], r.places["単位"]) for r in h] == [(1, tables.NOUSEI, 2, 1)]

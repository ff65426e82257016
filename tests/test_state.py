"""Sessions, streams and reports: state that lives, expires and is cleaned up."""

import pytest
from pyspark.sql import functions as F

from gridrecon.operators import match, report, session
from gridrecon.streaming import arrivals, limiter


def test_sessions_live_extend_and_go(spark, tmp_path):
    store = session.Store(spark, f"file://{tmp_path}/s", ttl=100.0)
    assert store.clean(0.0) == 0
    df = spark.range(3)
    store.put("a", 1000.0, items=df)
    store.put("b", 1000.0, items=df)
    assert store.reads("a") == 0 and store.get("a", "items", 1100.0).count() == 3 and store.reads("a") == 1
    assert store.extend("a", 1050.0, 10.0) == 1100.0 and store.extend("a", 1050.0, 500.0) == 1550.0
    assert store.clean(1101.0) == 1  # b has expired, a was extended
    assert store.get("a", "items", 1500.0).count() == 3
    with pytest.raises(KeyError):
        store.get("a", "items", 1551.0)


def test_limiter_holds_one_window(spark):
    hits = spark.createDataFrame([("a", float(t)) for t in (0, 1, 2, 60, 61, 62)] + [("b", 5.0), (None, 1.0), ("a", None)], "key string, ts double")
    got = [(r.key, r.ts, r.allowed, r.used) for r in limiter.limit_batch(hits, limit=2).orderBy("key", "ts").collect()]
    assert got == [("a", 0.0, True, 1), ("a", 1.0, True, 2), ("a", 2.0, False, 2), ("a", 60.0, False, 2), ("a", 61.0, True, 1), ("a", 62.0, True, 2), ("b", 5.0, True, 1)]
    assert limiter.limit_batch(hits.limit(0)).count() == 0


def stream(spark, tmp_path, name, rows, schema):
    folder = f"file://{tmp_path}/{name}"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{folder}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_limiter_on_a_stream(spark, tmp_path):
    hits = stream(spark, tmp_path, "hits", [[("a", 1e9), ("a", 1e9 + 1), ("a", 1e9 + 2)], [("a", 1e9 + 61), ("b", 1e9 + 500)]], "key string, ts double")
    got = run(limiter.limit_stream(hits, limit=2, late=1000.0), "limited", tmp_path)
    assert sorted((r.key, r.ts - 1e9, r.allowed) for r in got.collect()) == [("a", 0.0, True), ("a", 1.0, True), ("a", 2.0, False), ("a", 61.0, True), ("b", 500.0, True)]


def test_pairs_of_arrivals(spark, tmp_path):
    schema = "session string, path string, at timestamp"
    ts = lambda m: __import__("datetime").datetime(2025, 1, 1, 10, m)
    req = stream(spark, tmp_path, "req", [[("s1", "r1", ts(0)), ("s2", "r2", ts(5))]], schema)
    est = stream(spark, tmp_path, "est", [[("s1", "e1", ts(10))], [("s2", "e2", ts(50)), ("s3", "e3", ts(1))]], schema)
    got = run(arrivals.pairs(req, est), "paired", tmp_path)
    assert [(r.session, r.req_path, r.est_path) for r in got.collect()] == [("s1", "r1", "e1")]


def test_cascade_takes_the_best_kind(spark):
    s = "doc long, ord int, item_key string, unit string, quantity double, ref string"
    req = spark.createDataFrame([(1, 1, "Ａ b.c", "m", 1.0, None), (1, 2, "土工", "m", 1.0, None), (1, 3, "abcd", "m", 1.0, None), (1, 4, "xyz", "m", 1.0, None), (2, 1, "q", "m", 1.0, None)], s)
    est = spark.createDataFrame([(1, 1, "土工事", "m", 1.0, None), (1, 2, "ab.c", "m", 2.0, None), (1, 3, "zabcdz", "t", 1.0, None), (1, 4, "xyq", "m", 1.0, None)], s)
    got = {(r.doc, r.req_ord): (r.est_ord, r.how, r.status) for r in match.cascade(req, est).collect()}
    assert got == {(1, 1): (2, "exact", "QUANTITY_MISMATCH"), (1, 2): (1, "all", "NAME_MISMATCH"), (1, 3): (3, "all", "NAME_MISMATCH"), (1, 4): (4, "any", "NAME_MISMATCH"), (2, 1): (None, "missing", "MISSING")}


def test_reports_by_side_and_lists(spark):
    rows = spark.createDataFrame([("main", "OK"), ("main", "EXTRA"), ("sub", "MISSING"), ("sub", "OK")], "kind string, status string")
    got = {(r.side, r.kind): (r.total, r.ok, r.ok_pct) for r in report.side_breakdown(rows).collect()}
    assert got[("requested", None)] == (3, 2, 66.7) and got[("estimated", "sub")] == (1, 1, 100.0) and got[("estimated", None)] == (3, 2, 66.7)
    s = spark.createDataFrame([(1, "t", [{"a": "1", "b": "2"}, {"a": "3"}]), (2, "u", []), (3, "v", None)], "section_no int, title string, rows array<map<string,string>>")
    cells = {(r.section_no, r.row_no, r.col_no): r.value for r in report.checklist_table(s).collect()}
    assert cells == {(1, 0, 0): "t", (1, 1, 0): "a", (1, 1, 1): "b", (1, 2, 0): "1", (1, 2, 1): "2", (1, 3, 0): "3", (1, 3, 1): ""}
    tagged = report.tagged(rows, gone=F.col("status") == "MISSING", any=F.lit(True))
    assert sorted((r.report, r.status) for r in tagged.collect() if r.report == "gone") == [("gone", "MISSING")] and tagged.count() == 5

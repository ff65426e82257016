"""Lifetimes of sessions: the same lives from a table and from a stream."""

from pyspark.sql import functions as F

from gridrecon.streaming import lifetimes
from tests.test_state import run, stream

EVENTS = "session string, at double, action string, seconds double, items long"


def test_lives_expire_extend_and_are_replaced(spark):
    events = [
        ("a", 0.0, "put", None, 3), ("a", 10.0, "get", None, None), ("a", 10.0, "get", None, None), ("a", 100.0, "extend", 50.0, None), ("a", 150.0, "get", None, None),
        ("a", 151.0, "extend", 99.0, None), ("a", 160.0, "put", None, 1), ("a", 170.0, "put", None, None), ("a", 180.0, "extend", 1.0, None),
        ("b", 5.0, "get", None, None), (None, 1.0, "put", None, 1), ("c", None, "put", None, 1), ("d", 1.0, "drop", None, 1), ("e", 7.0, "get", None, None), ("e", 7.0, "put", None, 2),
    ]
    got = sorted(tuple(r) for r in lifetimes.replay(spark.createDataFrame(events, EVENTS), 100.0).collect())
    assert got == [("a", 0.0, 150.0, 3, 3, "expired"), ("a", 160.0, 260.0, 1, 0, "replaced"), ("a", 170.0, 270.0, 0, 0, "open"), ("e", 7.0, 107.0, 2, 1, "open")]
    assert lifetimes.replay(spark.createDataFrame([], EVENTS)).count() == 0


def test_a_hot_session_and_extra_columns(spark):
    e = spark.range(200_000).select(F.lit("x").alias("session"), F.col("id").cast("double").alias("at"), F.when(F.col("id") == 0, "put").otherwise("get").alias("action"), F.lit(None).cast("double").alias("seconds"), F.lit(1).alias("items"), F.lit(0).alias("rank"))
    assert [tuple(r) for r in lifetimes.replay(e, 1e9).collect()] == [("x", 0.0, 1e9, 1, 199_999, "open")]


def test_a_stream_closes_what_a_replay_closes(spark, tmp_path):
    t = 1e9
    parts = [
        [("a", t, "put", None, 3), ("b", t + 5, "put", None, 2), ("a", t + 20, "get", None, None)],
        [("a", t + 90, "extend", 100.0, None), ("b", t + 40, "put", None, 1)],
        [("a", t + 150, "get", None, None), ("c", t + 160, "put", None, 9)],
        [("z", t + 5000, "put", None, 0)], [("z", t + 5001, "get", None, None)],
    ]
    events = stream(spark, tmp_path, "events", parts, EVENTS)
    got = sorted(tuple(r) for r in run(lifetimes.closed_stream(events, 100.0, 1000.0), "lives", tmp_path).collect())
    whole = spark.createDataFrame([r for p in parts for r in p], EVENTS)
    want = sorted(tuple(r) for r in lifetimes.replay(whole, 100.0).collect())
    ended = [r if r[0] != "c" and r[-1] != "open" else (*r[:-1], "expired") for r in want if r[0] != "z"]
    assert got == ended and len(got) == 4

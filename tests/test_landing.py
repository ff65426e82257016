"""Parts that land in a folder: pairs over batches, restarts, replays and parts that never meet."""

import os
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gridrecon.streaming import landing

ARRIVALS = "session string, side string, at timestamp, path string, content binary"


def sizes(pairs):
    return pairs.select("session", F.length("req_content").alias("req"), F.length("est_content").alias("est"))


def land(root, session, side, text, ago=0.0):
    os.makedirs(f"{root}/{session}", exist_ok=True)
    path = f"{root}/{session}/{side}"
    with open(path, "w") as f:
        f.write(text)
    os.utime(path, (time.time() - ago,) * 2)


def drain(spark, root, out, tmp_path):
    r = landing.Reconciler(out, sizes)
    r.writer(landing.landed(spark, f"file://{root}"), f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    return {(x.session, x.req, x.est) for x in r.results(spark).collect()}


def test_parts_meet_over_restarts(spark, tmp_path):
    root, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    land(root, "s1", "requested.pdf", "abc", 50)
    land(root, "s1", "notes.txt", "not a part", 50)
    assert drain(spark, root, out, tmp_path) == set()
    land(root, "s1", "estimated.xlsx", "de", 20)
    land(root, "s2", "estimated.xlsx", "g", 20)
    land(root, "s3", "estimated.xlsx", "", 20)  # an empty file is no arrival
    land(root, "s3", "requested.pdf", "h", 20)
    assert drain(spark, root, out, tmp_path) == {("s1", 3, 2)}
    land(root, "s2", "requested.pdf", "f" * 100_000, 10)
    land(root, "s1", "estimated-2.xlsx", "later", 5)
    assert drain(spark, root, out, tmp_path) == {("s1", 3, 2), ("s1", 3, 5), ("s2", 100_000, 1)}


def test_a_batch_that_runs_again_writes_nothing_twice(spark, tmp_path):
    at = lambda m: datetime(2025, 1, 1, 10) + timedelta(minutes=m)
    batches = [[("a", "requested", at(0), "r", b"1"), ("b", "requested", at(0), "r", b"1")], [("a", "estimated", at(5), "e", b"12"), ("a", "estimated", at(5), "e", b"12"), (None, "requested", at(5), "x", b"")], [], [("b", "estimated", at(90), "e", None), ("c", "other", at(1), "e", b"")]]
    r = landing.Reconciler(f"file://{tmp_path}/out", sizes)
    for i, rows in enumerate(batches):
        new = spark.createDataFrame(rows, ARRIVALS)
        r(new, i)
        r(new, i)
    assert [(x.batch, x.session, x.req, x.est) for x in r.results(spark).collect()] == [(1, "a", 1, 2)]  # b's parts are 90 minutes apart
    assert sorted(r._states(spark)) == [2, 3]


def test_merging_takes_the_latest_part(spark):
    t = datetime(2025, 1, 1)
    new = spark.createDataFrame([("a", "requested", t, "1", b""), ("a", "requested", t, "2", b""), ("a", "estimated", t, "9", b"")], ARRIVALS)
    held = landing.merge(None, new)
    assert [(r.req_path, r.est_path) for r in landing.pairs(held).collect()] == [("2", "9")]
    assert landing.pairs(landing.merge(held, new.limit(0))).count() == 0  # nothing fresh
    older = spark.createDataFrame([("a", "requested", t - timedelta(1), "3", b"")], ARRIVALS)
    assert landing.pairs(landing.merge(held, older)).count() == 0

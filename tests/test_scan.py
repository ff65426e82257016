"""Running values along groups that lie over many ranges, against a walk row by row."""

import random

import pytest
from pyspark.sql import functions as F

from gridrecon.operators import blocks, jumps, scan, tree
from gridrecon.streaming import limiter


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_running(spark, parts):
    rng = random.Random(parts)
    rows = []
    for g, n in (("a", 900), (None, 120), ("b", 1), ("c", 40)):
        rows += [(g, i, rng.choice([None] * 30 + [rng.randrange(99)])) for i in range(n)]
    d = spark.createDataFrame(rows, "g string, i int, v int").withColumn("s", F.lit("clash"))
    v = F.col("v")
    out = scan.running(d, ["g"], ["i"], parts, l=scan.last(v), lx=scan.last(v, own=False), n=scan.following(v), nx=scan.following(v, own=False), s=scan.total(v), sx=scan.total(v, own=False), c=scan.count_if(v > 50))
    assert sorted(out.columns) == sorted(["g", "i", "v", "l", "lx", "n", "nx", "s", "sx", "c"])
    got = {(r.g, r.i): r for r in out.collect()}
    assert len(got) == len(rows) == out.count()
    for g in ("a", None, "b", "c"):
        vs = [x[2] for x in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])]
        for i in range(len(vs)):
            here = lambda xs: [x for x in xs if x is not None]
            r, upto, rest = got[g, i], here(vs[: i + 1]), here(vs[i:])
            assert (r.l, r.n, r.s, r.c) == (upto[-1] if upto else None, rest[0] if rest else None, sum(upto), sum(x > 50 for x in upto))
            upto, rest = here(vs[:i]), here(vs[i + 1 :])
            assert (r.lx, r.nx, r.sx) == (upto[-1] if upto else None, rest[0] if rest else None, sum(upto))


def test_running_of_none(spark):
    d = spark.createDataFrame([], "g string, i int, v int")
    assert scan.running(d, ["g"], ["i"], 3, l=scan.last(F.col("v"))).count() == 0


@pytest.mark.parametrize("parts", [1, 50])
def test_one_document_over_many_ranges(spark, parts):
    rng = random.Random(3)
    rows = [(1, i, 0 if i in (0, 700) else rng.randrange(0 if rng.random() < 0.01 else 1, 40), "x") for i in range(1500)] + [(d, i, rng.randrange(6), "x") for d in (2, 3) for i in range(60)]
    rows += [(4, i, i, "x") for i in range(100)]  # ever deeper: what is handed on grows with the depth only
    d = spark.createDataFrame(rows, "doc long, seq long, level int, ancestors string")
    want = {(r.doc, r.seq): r.ancestors for r in tree.with_parent(d, F.col("level")).collect()}
    spread = tree.with_parent(d, F.col("level"), largest=0, parts=parts)
    got = {(r.doc, r.seq): (r.ancestors, r.parent_seq) for r in spread.collect()}
    assert {k: v[0] for k, v in got.items()} == want and all(p == (a[-1] if a else None) for a, p in got.values())
    stack, by_hand = [], {}
    for doc, seq, level, _ in rows:
        if seq == 0:
            stack = []
        while stack and stack[-1][0] >= level:
            stack.pop()
        by_hand[doc, seq] = [s for _, s in stack]
        stack.append((level, seq))
    assert want == by_hand
    assert tree.with_parent(d.limit(0), F.col("level"), largest=0).count() == 0


def walk(points, gap, strict):
    out = []
    for t in sorted(set(points)):
        if not out or (t > out[-1] + gap if strict else t >= out[-1] + gap):
            out.append(t)
    return out


@pytest.mark.parametrize("strict", [True, False])
def test_spaced_marks(spark, strict):
    rng = random.Random(8)
    points = {"a": [rng.randrange(3000) for _ in range(1200)], "b": [5], "c": [0, 10, 20, 30, 31], "d": list(range(0, 640, 10))}
    rows = [(k, t) for k, ts in points.items() for t in ts] + [(None, 3), ("a", None)]
    got = jumps.spaced(spark.createDataFrame(rows, "g string, t long"), ["g"], "t", 10, strict, parts=9)
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, t) for k, ts in points.items() for t in walk(ts, 10, strict))
    assert jumps.spaced(spark.createDataFrame([], "g string, t long"), ["g"], "t", 10).count() == 0


def test_a_key_with_a_third_of_all_hits(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.35 else f"k{rng.randrange(40)}", float(rng.randrange(9000))) for _ in range(3000)] + [(None, 1.0), ("x", None)]
    d = spark.createDataFrame(rows, "key string, ts double")
    want = sorted(tuple(r) for r in limiter.limit_batch(d, limit=3, window=60.0).collect())
    assert sorted(tuple(r) for r in limiter.limit_batch(d, limit=3, window=60.0, largest=0, parts=12).collect()) == want and len(want) == 3000
    assert limiter.limit_batch(d.limit(0), largest=0).count() == 0


def test_spaced_marks_of_a_large_table(spark):
    d = spark.createDataFrame([(1, i) for i in (1, 2, 3, 5, 6, 9, 30)] + [(2, 4)], "doc long, n long")
    small, large = (sorted(tuple(r) for r in blocks.spaced(d, ["doc"], "n", 3, largest=k).collect()) for k in (100, 2))
    assert small == large == [(1, 1), (1, 5), (1, 9), (1, 30), (2, 4)]

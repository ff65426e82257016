"""Exact top-k inner products with norm buckets and per-bucket pruning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridrecon.llm.common import written

#: Candidates of one shard of a norm bucket, and queries of one block, that meet in one task.
SHARD, BLOCK = 16_384, 4_096
#: Norm buckets double every so many steps; above this cosine a bucket is pruned by coordinates, else by length.
STEPS, HIGH_COSINE = 8, 0.8
COORDS = 4


def quantised(vectors: DataFrame, every: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(row, vec_id, v array<long>, dim, norm, is_query): one row per row that takes part, repeats of an id too."""
    x = F.col(vec_col).cast("array<double>")
    good = F.col(vec_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = vectors.where(good).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"), F.coalesce(every, F.lit(False)).alias("is_query"),
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))
    return v.withColumn("dim", F.size("v")).withColumn("norm", norm)


def best_of_bucket(q: np.ndarray, c: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of each query's k best candidates of one bucket, exactly; below floor nothing counts.

    Candidates go by falling length, a step at a time. The k-th best so far (or the floor, what longer buckets gave), over
    the query's length and the longest length left, is the cosine a candidate still needs: over 1, the query is done with the
    bucket. Where it is high, only candidates whose values at the query's largest coordinates can reach it are multiplied;
    else those long enough are. own: the queries' ids, which are not their own candidates. Scores of 62 bits or more saturate.
    """
    reach = np.abs(q).max(initial=0).astype(float) * np.abs(c).max(initial=0) * max(1, q.shape[1])
    kind = np.float64 if reach < 2**52 else np.int64 if reach < 2**62 else object
    lc = np.sqrt((c.astype(float) ** 2).sum(1))
    lq = np.sqrt((q.astype(float) ** 2).sum(1))
    order = np.lexsort((ids, -lc))
    c, ids, lc = c[order], ids[order], lc[order]
    qk, ck = q.astype(kind), c.astype(kind)
    unit_c, unit_q = c / np.maximum(lc, 1e-300)[:, None], q / np.maximum(lq, 1e-300)[:, None]
    low = -(2**62)
    score, who = np.full((len(q), k), low, np.int64), np.full((len(q), k), np.iinfo(np.int64).max)
    alive = np.arange(len(q))
    floor = np.full(len(q), low) if floor is None else floor
    step = 512
    for at in range(0, len(c), step):
        part = slice(at, min(at + step, len(c)))
        theta = np.maximum(score[alive, k - 1], floor[alive]).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(lq[alive] * lc[at] > 0, theta / (lq[alive] * lc[at]), np.where(theta > 0, 2.0, -2.0))
        going = need <= 1 + 1e-9
        alive, need = alive[going], need[going]
        if not len(alive):
            break
        by_coordinate = need > HIGH_COSINE
        for some, prune in ((alive[~by_coordinate], False), (alive[by_coordinate], True)):
            if not len(some):
                continue
            cols = np.arange(part.start, part.stop)
            if prune:
                t = np.minimum(need[by_coordinate], 1.0)[:, None]
                ok = np.ones((len(some), len(cols)), bool)
                top = np.argsort(-np.abs(unit_q[some]), axis=1)[:, :COORDS]
                for f in range(top.shape[1]):
                    a = np.take_along_axis(unit_q[some], top[:, f : f + 1], 1)
                    slack = np.sqrt(np.maximum(0, (1 - a * a) * (1 - t * t))) + 1e-9
                    x = unit_c[part].T[top[:, f]]
                    past = a * a > t * t  # the range of x reaches the end, 1 or -1, on the side of a
                    ok &= ((x >= a * t - slack) | (past & (a < 0))) & ((x <= a * t + slack) | (past & (a > 0)))
                cols = cols[ok.any(0)]
                if not len(cols):
                    continue
            s = qk[some] @ ck[cols].T
            s = (np.clip(s, low + 1, 2**62) if kind is object else s).astype(np.int64)
            s[own[some][:, None] == ids[cols][None]] = low
            s = np.concatenate([score[some], s], 1)
            w = np.concatenate([who[some], np.broadcast_to(ids[cols], (len(some), len(cols)))], 1)
            if s.shape[1] > 4 * k:  # all that tie with the k-th stay
                kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                width = int((s >= kth).sum(1).max())
                near = np.argsort(-s, axis=1, kind="stable")[:, :width]
                s, w = np.take_along_axis(s, near, 1), np.take_along_axis(w, near, 1)
            rank = np.lexsort((w, -s), axis=1)[:, :k]
            score[some], who[some] = np.take_along_axis(s, rank, 1), np.take_along_axis(w, rank, 1)
    i, j = np.nonzero((score > low) & (score >= floor[:, None]))
    return i, who[i, j], score[i, j]


def top_k(vectors: DataFrame, every: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row where every holds, its k largest inner products with other rows.

    Vectors are floor(256 x) per component; ties go to the smaller id, a null id last. Rows that repeat an id are rows of
    their own, as queries too, and are each other's candidates. Null vectors, and vectors that hold null or non-finite components,
    take no part; vectors meet those of their own length only. Fewer candidates than k: all of them. Empty input: no rows. Other
    columns are ignored.

    Rows are grouped by norm into buckets (octaves in STEPS parts), large buckets dealt into shards of about SHARD rows, and
    the stated queries into blocks. The longest buckets go first: those that hold an eighth of the rows, then half, then
    the rest. Each query carries its k-th score on, and goes to no bucket whose longest vector can't reach it.
    """
    v = quantised(vectors, every, id_col, vec_col)
    bucket = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * STEPS)).otherwise(F.lit(-1)).cast("int")
    v = written(v.withColumn("bucket", bucket), "vectors")
    sizes = v.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest"), F.sum(F.col("is_query").cast("long")).alias("q"))
    falling = W.partitionBy("dim").orderBy(F.col("bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    of_dim = W.partitionBy("dim")
    share = F.coalesce(F.sum("n").over(falling), F.lit(0)) / F.sum("n").over(of_dim)
    sizes = sizes.select(
        "dim", "bucket", "longest", F.ceil(F.col("n") / SHARD).cast("int").alias("shards"), F.ceil(F.greatest(F.sum("q").over(of_dim), F.lit(1)) / BLOCK).cast("int").alias("blocks"),
        F.when(share < 1 / 8, 0).when(share < 1 / 2, 1).otherwise(2).alias("round"),
    )
    sizes = written(sizes, "buckets")  # at most 2 x 1024 x STEPS of a dimension

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"row": [], "other": [], "score": []}).astype("int64")
        mat = [np.stack(x["v"].to_numpy()).astype(np.int64).reshape(len(x), -1) for x in (left, right)]
        own = left["row"].to_numpy()
        order = np.lexsort((right["row"], right["vec_id"], right["nameless"]))  # places in this order break ties
        other, rows = np.empty(len(right), np.int64), right["row"].to_numpy()
        other[order] = np.arange(len(right))
        place = {r: p for r, p in zip(rows.tolist(), other.tolist())}
        mine = np.array([place.get(r, -1) for r in own.tolist()], np.int64)
        i, who, s = best_of_bucket(*mat, other, mine, k, left["floor"].to_numpy(np.int64))
        return pd.DataFrame({"row": own[i], "other": rows[order[who]], "score": s})

    keys = ["dim", "bucket", "shard", "block"]
    line = W.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "other")
    best = None
    for r in range(3):
        now = F.broadcast(sizes.where(F.col("round") == r))
        cand = v.join(now, ["dim", "bucket"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
        cand = cand.select("dim", "bucket", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "row", F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("nameless"), "v")
        q = v.where("is_query").drop("bucket", "vec_id")
        if best is None:
            q = q.withColumn("floor", F.lit(-(1 << 62)))
        else:
            floors = best.where(F.col("rank") == k).select("row", F.col("score").alias("floor"))
            q = q.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(-(1 << 62))))
        reach = F.col("norm") * F.col("longest") * (1 + 1e-9) >= F.col("floor")
        q = q.join(now, "dim").where(reach).withColumn("block", F.pmod(F.xxhash64(F.col("row"), F.lit(1)), F.col("blocks")).cast("int"))
        q = q.select("dim", "bucket", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", "row", "v", "floor")
        q = q.toDF("q_dim", "q_bucket", "q_shard", "q_block", "row", "v", "floor")  # fresh names: both sides come from v
        found = q.groupBy(*(f"q_{k}" for k in keys)).cogroup(cand.groupBy(keys)).applyInPandas(run, "row long, other long, score long")
        ids = v.select(F.col("row").alias("other"), "vec_id")
        found = found.join(ids, "other").select("row", "other", "vec_id", "score")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = written(found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k), "best")
    names = v.where("is_query").select("row", F.col("vec_id").alias("query_id"))
    return best.join(names, "row").select("query_id", "rank", "vec_id", "score")

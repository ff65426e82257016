"""Shared pieces: tables in the cluster's shared folder (from the library's own), connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrecon.operators.stored import new_path, purge, shared_dir, written

__all__ = ["components", "crc_mod", "new_path", "purge", "shared_dir", "written"]


def crc_mod(id_col: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node, component its smallest node.

    Alternates large-star and small-star steps. A node's minimum comes from a grouped min (partly summed before
    the shuffle) and reaches its edges through a join, which adaptive execution splits where a node is hot, so
    no neighbour list is ever gathered. Each round is written to the shared folder. No edges: no rows.
    """

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())

    e = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b")
            .where("a <> b")
            .distinct()
        )
        e = written(small, "edges")
        after = mark(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

"""SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrecon.llm.common import components, written

FANOUT = 16
BITS = 2
#: Distinct fingerprints of one range: a 64th of all, between these bounds (a task holds one range and its tree).
RANGE, MOST = 256, 1 << 18


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of one whole text over XXH64 (seed 42) of its word shingles; null or wordless: 0."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n).byteswap()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): one row per row of docs, the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py()) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long")


# --- the index -----------------------------------------------------------------------------------------------------


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray sequence; neighbours there differ in one bit."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def rank_column(fp: Column) -> Column:
    """gray_rank of a signed long, its highest bit turned so that signed order is the order of ranks."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class GrayTree:
    """A tree over items in Gray order, each a set of fingerprints given by the bits set in all (low) and in any (high).

    A node keeps the bits all below it share, less those its parent has. A search adds up, from the root down, the
    differences in each node's own shared bits, and leaves a whole subtree as soon as the sum exceeds the limit.
    Items that are single fingerprints share all bits, so there the sum is the Hamming distance.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray | None = None):
        high = low if high is None else high
        levels = [(low, ~(low ^ high))]
        while len(low) > 1:
            starts = np.arange(0, len(low), FANOUT)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            levels.append((low, ~(low ^ high)))
        levels.reverse()
        self.levels = [levels[0]] + [(lo, mask & ~np.repeat(up, FANOUT)[: len(mask)]) for (_, up), (lo, mask) in zip(levels, levels[1:])]

    def search(self, q: np.ndarray, bits: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) pairs whose summed difference is at most bits; items before the query's first are left out."""
        i, node, far = np.arange(len(q)), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        size = FANOUT ** (len(self.levels) - 1)
        for k, (low, own) in enumerate(self.levels):
            if k:
                i, far = np.repeat(i, FANOUT), np.repeat(far, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                size //= FANOUT
            there = node < len(low)
            if first is not None:
                there &= (node + 1) * size > first[i]
            i, node, far = i[there], node[there], far[there]
            far = far + np.bitwise_count((q[i] ^ low[node]) & own[node])
            i, node, far = (x[far <= bits] for x in (i, node, far))
        return i, node

    def pairs(self, fp: np.ndarray, bits: int, chunk: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs i < j of the items, which are the fingerprints fp, that differ in at most bits places, a block of queries at a time."""
        for at in range(0, len(fp), chunk):
            n = np.arange(at, min(at + chunk, len(fp)))
            i, j = self.search(fp[n], bits, n + 1)
            yield n[i], j


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of i and j; a label is the smallest index of its class."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        m = np.minimum(a, b)
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        while (deeper := label[label]).tobytes() != label.tobytes():
            label = deeper


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges (fingerprints) that span the same components as (a, b)."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = unite(np.arange(len(nodes)), where[: len(a)], where[len(a) :])
    kids = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[kids].view(np.int64)), pa.array(nodes[label[kids]].view(np.int64))], ["a", "b"])


def _numbers(b: pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    return [b.column(c).to_numpy(zero_copy_only=False) for c in columns]


def _search(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by range, first its fingerprints in Gray order, then those that ask; one range is held at a time."""
        at, held, rank, tree = None, [], None, None
        for batch in batches:
            n, kind, fp, r = _numbers(batch, "range", "kind", "fp", "rank")
            fp = fp.view(np.uint64)
            cut = np.flatnonzero(np.r_[True, (n[1:] != n[:-1]) | (kind[1:] != kind[:-1]), True])
            for a, z in zip(cut[:-1], cut[1:]):
                if kind[a] == 0:
                    if n[a] != at:
                        at, held, tree = n[a], [], None
                    held.append((fp[a:z], r[a:z]))
                    continue
                if tree is None:
                    items, rank = (np.concatenate(x) for x in zip(*held))
                    tree = GrayTree(items)
                for s in range(a, z, 1024):
                    q, own = fp[s : min(s + 1024, z)], r[s : min(s + 1024, z)]
                    i, j = tree.search(q, bits)
                    later = rank[j] > own[i]
                    if later.any():
                        yield _forest(q[i[later]], items[j[later]])

    return run


def links(fps: DataFrame, bits: int = BITS, most: int | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints that differ in at most bits places.

    Distinct fingerprints are sorted by Gray rank into ranges of about equal size. The bits that all of a range share
    form the leaves of an upper tree (an entry per range, so at most 64 or n / MOST entries reach driver and tasks), through which
    every fingerprint finds the ranges that can hold partners of higher rank; there a tree over the range's own
    fingerprints finds them. No more than 2,081 distinct fingerprints lie within two bits of one, so no answer is large.
    """
    spark = fps.sparkSession
    ranked = written(fps.select("fp").distinct().withColumn("rank", rank_column(F.col("fp"))), "ranked")
    n = ranked.count()
    ranges = -(-n // (most or min(max(n // 64, RANGE), MOST))) or 1
    ranked = written(ranked.repartitionByRange(ranges, "rank").sortWithinPartitions("rank").withColumn("range", F.spark_partition_id()), "ranges")
    masks = ranked.groupBy("range").agg(F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high"))
    top = sorted((r.range, r.low, r.high) for r in masks.collect())
    name = np.array([r for r, _, _ in top], np.int32)
    low, high = (np.array([r[k] for r in top], np.int64).view(np.uint64) for k in (1, 2))
    shipped = spark.sparkContext.broadcast((name, low, high))  # an entry per range

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, low, high = shipped.value
        tree = GrayTree(low, high) if len(low) else None
        for batch in batches:
            fp, rank, own = _numbers(batch, "fp", "rank", "range")
            for s in range(0, len(fp), 4096):
                part = slice(s, s + 4096)
                i, k = tree.search(fp[part].view(np.uint64), bits, np.searchsorted(name, own[part]))
                cols = [pa.array(x) for x in (name[k], np.ones(len(i), np.int32), fp[part][i], rank[part][i])]
                yield pa.RecordBatch.from_arrays(cols, ["range", "kind", "fp", "rank"])

    asks = ranked.select("fp", "rank", "range").mapInArrow(route, "range int, kind int, fp long, rank long")
    both = ranked.select("range", F.lit(0).alias("kind"), "fp", "rank").unionByName(asks)
    both = both.repartitionById(ranges, "range").sortWithinPartitions("range", "kind", "rank")
    return both.mapInArrow(_search(bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null texts count as empty (fingerprint zero). Rows with a null id take part; their component's id is that of
    its smallest non-null id, null if it has none. Repeated rows stay repeated. Empty input: no rows. Other columns,
    whatever their names, are ignored. Equal fingerprints meet once, however many rows have them.
    """
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    comp = components(links(fps, bits)).select(F.col("node").alias("fp"), "component")
    low = fps.groupBy("fp").agg(F.min("doc_id").alias("low")).join(comp, "fp", "left")
    low = low.select("fp", "low", F.coalesce("component", "fp").alias("component"))
    ids = low.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = low.join(ids, "component").select("fp", "component_id")
    return fps.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of docs whose doc_id is its component's smallest; of rows that repeat an id, each stays."""
    found = near_duplicates(docs, bits=bits)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")

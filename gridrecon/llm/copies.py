"""Edited copies among documents: SimHash candidates, exact Jaccard similarity of word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrecon.llm.common import components, written
from gridrecon.llm.simhash import GrayTree, gray_rank

WIDTH, SIMILARITY = 5, 0.8
#: A similarity of 0.8 is an angle of 0.48: a bit differs with probability 0.15, more than 24 of 64 with about 1e-6.
RADIUS = 24
#: Texts meet by any of BANDS keys of ROWS smallest hashes each; of pairs at 0.8, 3 in a million share no key.
BANDS, ROWS = 24, 4
#: Keys with more texts than GROUP outside their largest component are dealt again, LEVELS times at most, by keys from other
#: choices of the same hashes.
GROUP, LEVELS = 2_048, 2
#: Bytes of the table of a key's shingles; where it would be larger, pairs are compared one by one.
TABLE = 1 << 26
#: Of two texts at 0.8, fewer than this share of the smallest hashes agree with probability below one in ten million.
AGREE = 0.58

_RNG = np.random.default_rng(42)
_A = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of the whole text's word shingles; a text of fewer words is one shingle, a wordless one none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(WIDTH)))) if len(words) >= WIDTH else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64))


def signature(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes())


def sketch(s: np.ndarray) -> tuple[int, np.ndarray]:
    """SimHash of a set of shingles, and the lowest 16 bits of its smallest hashes."""
    ones, low = np.zeros(64, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 2048):
        h = s[at : at + 2048]
        ones += np.unpackbits(h.byteswap().view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        low = np.minimum(low, (h[None] * _A[:, None] + _B[:, None]).min(1))
    fp = int.from_bytes(np.packbits(ones * 2 > len(s)).tobytes(), "big")
    return fp, (low >> np.uint64(8)).astype(np.uint16)


def band_keys(low: np.ndarray, level: int, seed: int = 0) -> list[int]:
    """The band keys of smallest hashes at a level; seed: the key of the level before."""
    low = low[_order(level)].reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(low[k].tobytes(), (seed + k) % 2**64) for k in range(BANDS)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else float(not len(a) and not len(b))


def _long(x) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sigs, fps, lows = [], [], []
        for t in b.column(1):
            s = shingles(t.as_py())
            fp, low = sketch(s)
            sigs.append(signature(s))
            fps.append(fp)
            lows.append(low.tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), _long(sigs), _long(fps), pa.array(lows, pa.binary())], ["doc_id", "sig", "fp", "low"])


def _deal(level: int):
    """Rows (sig, low, key) to (sig, key, band), a row for each band of the level; key is that of the level before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [k for low, key in zip(b.column(1), b.column(2).to_pylist()) for k in band_keys(np.frombuffer(low.as_buffer(), np.uint16), level, key)]
            sig = np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(sig), _long(keys), pa.array(band)], ["sig", "key", "band"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            sets = [shingles(t.as_py()) for t in b.column(0)[at : at + 256]]
            cols = [_long([signature(s) for s in sets]), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["sig", "bytes"])


def _agree(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows of smallest hashes agree often enough for a similarity of 0.8."""
    least = int(AGREE * BANDS * ROWS)
    return np.concatenate([(low[i[a : a + 16384]] == low[j[a : a + 16384]]).sum(1) >= least for a in range(0, len(i), 16384)] or [np.zeros(0, bool)])


def _order(level: int) -> np.ndarray:
    return np.arange(BANDS * ROWS) if not level else np.random.default_rng(level).permutation(BANDS * ROWS)


def _first_band(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first band in which each pair agrees; low: in the order of the level."""
    parts = [(low[i[a : a + 16384]] == low[j[a : a + 16384]]).reshape(-1, BANDS, ROWS).all(2).argmax(1) for a in range(0, len(i), 16384)]
    return np.concatenate(parts or [np.zeros(0, np.int64)])


def _alike(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of sets have a similarity of 0.8 or more, exactly: shared shingles are counted in a table of bits."""
    size = np.array([len(x) for x in sets])
    found, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = np.flatnonzero(count > 1)
    words = -(-len(often) // 64)
    if len(sets) * words * 8 > TABLE or not words:
        return np.array([similarity(sets[a], sets[b]) >= SIMILARITY for a, b in zip(i.tolist(), j.tolist())], bool)
    place = np.full(len(found), -1)
    place[often] = np.arange(len(often))
    row, at = np.repeat(np.arange(len(sets)), size), place[where]
    row, at = row[at >= 0], at[at >= 0]
    bits = np.zeros((len(sets), words), np.uint64)
    np.bitwise_or.at(bits, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    out, step = [], max(1, (1 << 20) // words)
    for a in range(0, len(i), step):
        x, y = i[a : a + step], j[a : a + step]
        both = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64)
        out.append(both >= SIMILARITY * (size[x] + size[y] - both) - 1e-9)
    return np.concatenate(out or [np.zeros(0, bool)])


def _by_key(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """work(columns but the key) for each key with two rows or more; rows come sorted by key, numbers as arrays, bytes as lists."""
    held: list[list] = []
    for b in batches:
        key = b.column(0).to_numpy(zero_copy_only=False)
        cols = [x.to_pylist() if pa.types.is_binary(x.type) else x.to_numpy(zero_copy_only=False) for x in b.columns]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, int)
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if held and held[0][0][0] != key[a]:
                yield from work(_joined(held))
                held = []
            held.append([x[a:z] for x in cols])
    if held:
        yield from work(_joined(held))


def _joined(parts: list[list]) -> list:
    return [[x for p in c for x in p] if isinstance(c[0], list) else np.concatenate(c) for c in zip(*parts)][1:]


def _ordered(fp, sig, component, low, *more):
    """A key's rows in Gray order, which of them are outside its largest component, and which inside."""
    f = fp.view(np.uint64)
    order = np.argsort(gray_rank(f), kind="stable")
    m = np.frombuffer(b"".join(low), np.uint16).reshape(len(low), -1)[order]
    c = component[order]
    label, size = np.unique(c, return_counts=True)
    large = c == label[size.argmax()]
    return f[order], sig[order], c, m, large, *([x[k] for k in order] if isinstance(x, list) else x[order] for x in more)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, sig, component, low) to candidate pairs of sigs, at most four a row.

    Each row is paired with its neighbours in Gray order and with two rows of its key, within RADIUS and if they agree.
    """

    def work(cols):
        if len(cols[0]) < 2:
            return
        f, s, c, low, large = _ordered(*cols)
        own, core = np.flatnonzero(~large), np.flatnonzero(large)
        i = np.concatenate([own] * 4)
        j = np.concatenate([np.maximum(own - 1, 0), np.minimum(own + 1, len(f) - 1), np.full(len(own), core[0]), np.full(len(own), core[len(core) // 2])])
        near = (c[i] != c[j]) & (np.bitwise_count(f[i] ^ f[j]) <= RADIUS)
        near[near] = _agree(low, i[near], j[near])
        yield _edges(s[i[near]], s[j[near]])

    return _by_key(batches, work)


def _settle(level: int):
    """Rows (key, fp, sig, component, low, band, set) to links: pairs of different components that are alike.

    Rows outside a key's largest component are compared with all others: within RADIUS (Gray tree), then by their smallest
    hashes, then exactly. A pair that shares several bands is compared in the first of them only.
    """

    def work(cols):
        if len(cols[0]) < 2 or (cols[2] == cols[2][0]).all():
            return
        f, s, c, low, large, band, sets = _ordered(*cols)
        own = np.flatnonzero(~large)
        tree, step = GrayTree(f), max(1, (1 << 18) // len(f))
        dealt, held = low[:, _order(level)], []
        for at in range(0, len(own), step):
            i, j = tree.search(f[own[at : at + step]], RADIUS)
            i = own[at : at + step][i]
            ok = (c[i] != c[j]) & (large[j] | (i < j))
            i, j = i[ok], j[ok]
            ok = _agree(low, i, j)
            i, j = i[ok], j[ok]
            ok = _first_band(dealt, i, j) == band[i]
            held.append((i[ok], j[ok]))
        i, j = (np.concatenate(x) for x in zip(*held))
        if len(i):
            used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            ok = _alike([np.frombuffer(sets[k], np.uint64) for k in used.tolist()], place[: len(i)], place[len(i) :])
            yield _edges(s[i[ok]], s[j[ok]])

    return lambda batches: _by_key(batches, work)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column(2), b.column(3)):
            s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            ok.append(min(len(s), len(t)) >= SIMILARITY * max(len(s), len(t)) and similarity(s, t) >= SIMILARITY)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def components_of(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) per row of docs (doc_id, text): the smallest id reachable over pairs of similarity 0.8 or more.

    Texts of the same shingles count once. Distinct ones meet by band keys; of those that meet, the pairs within
    RADIUS bits of SimHash whose smallest hashes agree are compared on the shingles of their whole texts, in the task of the key. A first round links
    each text to its neighbours in Gray order and to two texts of its key, so that a large group of copies is one component, which is
    not compared with itself. Of a frequent passage's many texts a large part may share a key without being alike: such keys
    are dealt again by keys from other choices of hashes, where texts at 0.8 meet again and others part. Rows of null id take no part.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows = written(src.mapInArrow(_sketches, "doc_id long, sig long, fp long, low binary"), "sketches")
    texts = rows.groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("low").alias("low"))  # equal for equal sigs

    def dealt(some: DataFrame, level: int) -> DataFrame:
        met = some.select("sig", "low", "key").mapInArrow(_deal(level), "sig long, key long, band int").distinct()
        shared = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        return written(met.join(shared, "key").join(texts.drop("first_id"), "sig"), "met")

    def with_component(met: DataFrame, comp: DataFrame) -> DataFrame:
        return met.join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))

    met = dealt(texts.withColumn("key", F.lit(0).cast("long")), 0)
    sets = src.join(met.select("sig").distinct().join(texts, "sig").select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = written(sets.select("text").mapInArrow(_sets, "sig long, bytes binary").dropDuplicates(["sig"]), "sets")

    m = met.select("key", "fp", "sig", F.col("sig").alias("component"), "low").repartition("key").sortWithinPartitions("key")
    p = m.mapInArrow(_neighbours, "a long, b long").distinct()
    p = p.join(sets.toDF("a", "one"), "a").join(sets.toDF("b", "two"), "b").select("a", "b", "one", "two")
    near = written(p.mapInArrow(_similar, "a long, b long"), "similar")
    comp = components(near)
    for level in range(LEVELS + 1):
        met = with_component(met, comp)
        size = met.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg((F.sum("n") - F.max("n")).alias("others"))
        met = written(met.join(size.where("others > 0"), "key"), "crowds")
        few = met if level == LEVELS else met.where(F.col("others") <= GROUP)
        m = few.join(sets, "sig").select("key", "fp", "sig", "component", "low", "band", "bytes").repartition("key").sortWithinPartitions("key")
        near = near.unionByName(written(m.mapInArrow(_settle(level), "a long, b long"), "similar"))
        hot = met.where(F.col("others") > GROUP)
        if level == LEVELS or hot.isEmpty():
            break
        met = dealt(hot, level + 1)
    comp = components(near).select(F.col("node").alias("sig"), "component")
    one = texts.select("sig", "first_id").join(comp, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    ids = one.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return rows.select("doc_id", "sig").join(one.join(ids, "component").select("sig", "component_id"), "sig").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is its component's smallest; of rows that repeat an id, each stays."""
    gone = components_of(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")

"""Embedding near-duplicates through hierarchical navigable small-world graphs, one per shard."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrecon.llm.common import components, new_path, written
from gridrecon.llm.simhash import unite

#: Share of an executor's memory that a shard's vectors and graph may fill, queries of one block, shards at least.
SHARE, BLOCK, SHARDS = 1 / 8, 8_192, 4
#: Neighbours of a node, share of nodes in the next layer, beam while building.
M, UP, BEAM = 24, 16, 48
#: Queries held against all vectors of the shard at a time, true links wanted of them, queries of a block so held at most;
#: nodes this far below the threshold are still expanded.
AUDIT, AUDIT_LINKS, AUDIT_MOST, SLACK = 64, 256, 512, 0.03


def _diverse(sims: np.ndarray, ids: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (-1: none), m: those nearer to the row than to any chosen before, then the nearest."""
    order = np.argsort(-sims, axis=1)[:, : 2 * m]
    sims, ids = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
    v = x[ids]
    among = np.matmul(v, v.transpose(0, 2, 1))
    keep = np.zeros(ids.shape, bool)
    for j in range(ids.shape[1]):
        keep[:, j] = ~((among[:, j] > sims[:, j : j + 1]) & keep).any(1) & (keep.sum(1) < m * 2 // 3)
    first = np.argsort(~keep, axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(ids, first, 1)
    return np.where(np.take_along_axis(sims, first, 1) > -2, out, -1)


class Graph:
    """Layers of neighbour lists over unit vectors. Nodes are numbered so that each layer holds a prefix of them."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers  # from the bottom (all nodes) to the top (a few, searched whole)
        self._both = None

    def both_ways(self) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, neighbours) of the bottom layer with every edge in both directions: none is left unreachable."""
        if self._both is None:
            n = len(self.x)
            a, b = np.repeat(np.arange(n), M), self.layers[0].ravel().astype(np.int64)
            a, b = a[b >= 0], b[b >= 0]
            edge = np.unique(np.concatenate([a * n + b, b * n + a]))
            self._both = np.searchsorted(edge, np.arange(n + 1) * n), edge % n
        return self._both

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        sizes = [len(x)]
        while sizes[-1] > 256:
            sizes.append(max(1, sizes[-1] // UP))
        g = cls(x, [])
        for n in reversed(sizes):
            g.layers.insert(0, np.full((n, M), -1, np.int32))
            if len(g.layers) > 1:
                g._insert(n)
        return g

    def _insert(self, n: int) -> None:
        """Fill the bottom layer: nodes of the layer above first, then the rest in batches as large as what is there."""
        nbr, at = self.layers[0], 0
        while at < n:
            size = min(n - at, 512 if not at else min(at, 512))
            new = np.arange(at, at + size)
            sims = self.x[new] @ self.x[new].T
            np.fill_diagonal(sims, -3)
            ids = np.broadcast_to(new, sims.shape)
            if at:
                old, old_sims = self._beam(self.x[new], BEAM, 0)
                ids, sims = np.concatenate([old, ids], 1), np.concatenate([old_sims, sims], 1)
            out = _diverse(sims, ids, self.x, M)
            nbr[new] = out
            to, src = out.ravel(), np.repeat(new, out.shape[1])
            src, to = src[to >= 0], to[to >= 0]
            order = np.argsort(to, kind="stable")
            src, to = src[order], to[order]
            nodes, first, count = np.unique(to, return_index=True, return_counts=True)
            for a in range(0, len(nodes), 512):
                t, f, c = nodes[a : a + 512], first[a : a + 512], np.minimum(count[a : a + 512], 4 * M)
                more = np.arange(c.max())[None]
                back = np.where(more < c[:, None], src[np.minimum(f[:, None] + more, len(src) - 1)], -1)
                ids = np.concatenate([nbr[t], back], 1)
                there = ids >= 0
                sims = np.where(there, np.einsum("tcd,td->tc", self.x[ids], self.x[t]), -3)
                ids, sims = _unique(ids, sims)
                nbr[t] = _diverse(sims, ids, self.x, M)
            at += size

    def _beam(self, q: np.ndarray, ef: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef nearest nodes found for each query on a layer, entered through the layers above."""
        top = len(self.layers) - 1
        if layer == top:
            sims = q @ self.x[: len(self.layers[top])].T
            ids = np.argsort(-sims, axis=1)[:, :ef]
            return ids, np.take_along_axis(sims, ids, 1)
        enter, sims = self._beam(q, min(ef, 8), layer + 1)
        nbr = self.layers[layer]
        ids = np.full((len(q), ef), -1, np.int64)
        best = np.full((len(q), ef), -3.0, q.dtype)
        k = min(ef, enter.shape[1])
        ids[:, :k], best[:, :k] = enter[:, :k], sims[:, :k]
        done = ids < 0
        seen = np.zeros((len(q), len(nbr) + 1), bool)  # the last column takes what is no node
        np.put_along_axis(seen, ids, True, 1)
        live = np.arange(len(q))
        while len(live):
            open_ = np.where(done[live], -4, best[live])
            pick = np.argsort(-open_, axis=1)[:, :4]
            ok = np.take_along_axis(open_, pick, 1) > -3
            some = ok.any(1)
            live, pick, ok = live[some], pick[some], ok[some]
            if not len(live):
                break
            row = np.repeat(live, pick.shape[1])
            done[row, pick.ravel()] = True
            new = np.where(ok[:, :, None], nbr[ids[live[:, None], pick]], -1).reshape(len(live), -1)
            fresh = (new >= 0) & ~seen[live[:, None], new]
            new = np.where(fresh, new, -1)
            new, _ = _unique(new, None)
            seen[live[:, None], new] = True
            s = np.where(new >= 0, np.einsum("qd,qmd->qm", q[live], self.x[new]), -3)
            ids_, best_ = np.concatenate([ids[live], new], 1), np.concatenate([best[live], s], 1)
            done_ = np.concatenate([done[live], new < 0], 1)
            keep = np.argpartition(-best_, ef - 1, axis=1)[:, :ef]
            ids[live], best[live], done[live] = (np.take_along_axis(z, keep, 1) for z in (ids_, best_, done_))
        return ids, best

    def near(self, q: np.ndarray, least: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs found with a cosine of about least or more: a beam, then all that hangs on its hits."""
        n = len(self.x)
        ids, sims = self._beam(q, min(ef, n), 0)
        i, j = np.nonzero((sims >= least - SLACK) & (ids >= 0))
        node = ids[i, j]
        seen = np.zeros((len(q), n), bool)
        seen[i, node] = True
        offset, nbr = self.both_ways()
        while len(i):
            size = offset[node + 1] - offset[node]
            node = nbr[np.arange(size.sum()) + np.repeat(offset[node] - (np.cumsum(size) - size), size)]
            i = np.repeat(i, size)
            ok = ~seen[i, node]
            flat = np.unique(i[ok] * n + node[ok])
            i, node = flat // n, flat % n
            hit = np.concatenate([np.einsum("pd,pd->p", q[i[a : a + 65536]], self.x[node[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)])
            ok = hit >= least - SLACK
            i, node = i[ok], node[ok]
            seen[i, node] = True
        return np.nonzero(seen)

    def dump(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f"layer{k}": x for k, x in enumerate(self.layers)}, **more)
        return out.getvalue()

    @classmethod
    def load(cls, x: np.ndarray, z) -> Graph:
        """The graph of a dump, opened with np.load."""
        return cls(x, [z[k] for k in z.files if k.startswith("layer")])


def _unique(ids: np.ndarray, sims: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows with all but the first of equal ids made -1 (their similarity -3)."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids = np.take_along_axis(ids, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    ids = np.where(again, -1, ids)
    if sims is None:
        return ids, None
    return ids, np.where(again, -3, np.take_along_axis(sims, order, 1))


def links_of(graph: Graph, exact: np.ndarray, q: np.ndarray, least: float, chunk: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs whose cosine in double precision is least or more, a block of queries at a time.

    Queries spread over the block are held against the whole shard until AUDIT_LINKS true links are seen (or AUDIT_MOST
    queries, where links are rare). The beam starts at BEAM and doubles until the search misses none of these; at
    the size of the shard it holds every node. exact, q: unit vectors in double precision.
    """
    ef, n = BEAM, len(exact)
    q32 = q.astype(np.float32)
    some = np.random.default_rng(len(q)).permutation(len(q))[:AUDIT_MOST]
    seen, true = 0, []
    for at in range(0, len(some), AUDIT):
        true.append((q[some[at : at + AUDIT]] @ exact.T) >= least)
        seen += int(true[-1].sum())
        if seen >= AUDIT_LINKS:
            break
    true = np.concatenate(true) if true else np.zeros((0, n), bool)
    audit = some[: len(true)]
    audit, true = audit[true.any(1)], true[true.any(1)]

    def search(rows):
        i, j = graph.near(q32[rows], least, ef)
        ok = np.concatenate([np.einsum("pd,pd->p", q[rows][i[a : a + 65536]], exact[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)]) >= least
        return i[ok], j[ok]

    while ef < n and len(audit):
        got = np.zeros(true.shape, bool)
        got[search(audit)] = True
        if not (true & ~got).any():
            break
        ef *= 2
    for at in range(0, len(q), chunk):
        rows = np.arange(at, min(at + chunk, len(q)))
        i, j = search(rows)
        yield rows[i], j


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (..., v list of doubles) with v as a unit vector in packed double precision."""
    for b in batches:
        at = b.schema.get_field_index("v")
        packed = []
        for v in b.column(at):
            x = v.values.to_numpy(zero_copy_only=False)
            x = x / np.abs(x).max()  # no overflow or underflow in the norm
            packed.append((x / np.sqrt(x @ x)).tobytes())
        yield b.set_column(at, "v", pa.array(packed, pa.binary()))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(v)).reshape(len(v), -1)


def shard_bytes(spark: SparkSession) -> int:
    """What a shard may fill: SHARE of an executor's memory."""
    m = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.sparkContext.getConf().get("spark.executor.memory", "1g").strip().lower())
    return int((int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] if m else 1 << 30) * SHARE)


_loaded: dict[str, tuple] = {}


def _open(path: str) -> tuple:
    """(graph, exact vectors, nodes, copies) of a stored shard; a worker keeps the last one."""
    if path not in _loaded:
        _loaded.clear()
        fs, name = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(name) as f:
            z = np.load(io.BytesIO(f.read()))
        exact = z["exact"]
        _loaded[path] = Graph.load(exact.astype(np.float32), z), exact, z["nodes"], z["copies"]
    return _loaded[path]


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", rows_of_shard: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors.

    n_links: other rows at a cosine of least or more; component_id: smallest id reachable through such links; kept: it
    is the row's own. Equal vectors are linked to each other and meet the rest once. Null or zero vectors, and
    vectors that hold null or non-finite components, link with nothing; vectors meet those of their own length
    only. A null id is null in its row and no smallest id. Repeated rows are rows. Empty input: no rows. Other columns
    are ignored.

    Distinct vectors are dealt by hash to shards as large as an executor's memory allows; each shard's graph is
    built once and stored as a file of the shared folder, which the blocks of all vectors that query it read by its path. A
    block returns sums and a forest over its links, not the links.
    """
    spark = vectors.sparkSession
    x = F.col(vec_col).cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), F.transform(x, lambda c: c + F.lit(0.0))).alias("v"))
    rows = written(rows.withColumn("h", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("v")), 256))), "vectors")
    reps = rows.where("v is not null").groupBy("h").agg(F.first("v").alias("v"), F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    reps = reps.select("h", "v", "low", "copies", F.xxhash64("h", F.lit(7)).alias("node"), F.size("v").alias("dim"))
    reps = written(reps.mapInArrow(_pack, "h string, v binary, low long, copies long, node long, dim int"), "reps")
    count = reps.groupBy("dim").agg(F.count("*").alias("n"))
    # a vector takes 12 bytes a component in double and single precision, its edges and its place in a beam some 1,000
    size = F.lit(rows_of_shard) if rows_of_shard else F.greatest(F.lit(4096), F.floor(F.lit(shard_bytes(spark)) / (F.col("dim") * 12 + 1000)))
    count = count.select("dim", F.greatest(F.lit(SHARDS), F.ceil(F.col("n") / size)).cast("int").alias("shards"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    reps = reps.join(F.broadcast(count), "dim").withColumn("shard", F.pmod(F.col("node"), F.col("shards")).cast("int"))  # a row per length
    reps = reps.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    folder = new_path(spark, "graphs")

    def build(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        exact = _matrix(part["v"])
        blob = Graph.build(exact.astype(np.float32)).dump(exact=exact, nodes=part["node"].to_numpy(np.int64), copies=part["copies"].to_numpy(np.int64))
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"{key[0]}-{key[1]}-{uuid.uuid4().hex}.npz"  # a retried task writes another file
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write(blob)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "name": [name]})

    graphs = written(reps.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, name string"), "graphs")
    names = spark.sparkContext.broadcast({(r.dim, r.shard): r.name for r in graphs.collect()})  # an entry per shard
    queries = reps.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("dim", "shard", "block", "node", "v")

    def search(key, left: pd.DataFrame) -> pd.DataFrame:
        out = {"node": [], "root": [], "links": []}
        name = names.value.get((key[0], key[1]))  # none: no vector fell to this shard
        if name is not None:
            graph, exact, nodes, copies = _open(f"{folder}/{name}")
            mine = left["node"].to_numpy()
            both, where = np.unique(np.concatenate([mine, nodes]), return_inverse=True)
            label, links = np.arange(len(both)), np.zeros(len(both), np.int64)
            for i, j in links_of(graph, exact, _matrix(left["v"]), least):
                other = mine[i] != nodes[j]
                i, j = i[other], j[other]
                np.add.at(links, where[i], copies[j])
                label = unite(label, where[i], where[len(mine) + j])
            some = (links > 0) | (label != np.arange(len(both)))
            out = {"node": both[some], "root": both[label[some]], "links": links[some]}
        return pd.DataFrame(out).astype("int64")

    found = written(queries.groupBy("dim", "shard", "block").applyInPandas(search, "node long, root long, links long"), "found")
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reps = reps.select("h", "node", "low", "copies").join(links, "node", "left").join(comp, "node", "left")
    reps = written(reps.withColumn("component", F.coalesce("component", "node")), "linked")
    ids = reps.groupBy("component").agg(F.min("low").alias("component_id"))
    reps = reps.join(ids, "component").select("h", F.expr("coalesce(links, 0) + copies - 1").alias("n_links"), "component_id")
    out = rows.select("vec_id", "h").join(reps, "h", "left")
    comp_id = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))

"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy by tasks over all labelled texts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrecon.operators.stored import new_path, written

BITS, DIM, FILTERS, WIDTHS, EPOCHS = 18, 12, 16, (1, 2, 3), 3
BUCKETS = 1 << BITS
#: Texts of a step; code points that one copy of the model learns before copies are averaged; parts for scores by models that have not learned a text.
BATCH, SHARD, FOLDS = 8, 1 << 24, 2
#: Labelled ids that go to the documents by broadcast; more are joined by shuffling.
SHIPPED = 500_000
#: A language has a threshold of its own from so many positives (and a thousandth of all) on; its telling words are among its commonest.
OWN, COMMON = 20, 150
STEPS, UNIT = 10_000, 1 << 24  # scores are counted by ten-thousandths; changes are summed as whole numbers, so in any order
WORD = re.compile(r"[^\W_]+")
SLOTS = [(w, j) for w, k in enumerate(WIDTHS) for j in range(k)]
DENSE = len(SLOTS) * DIM * FILTERS + 2 * len(WIDTHS) * FILTERS + 1


def hashes(word: str) -> tuple[int, int, int]:
    """Buckets of a word, and of its first five and four letters (stems, for words that training never saw)."""
    return tuple(zlib.crc32(f"{k}{x}".encode()) % BUCKETS for k, x in enumerate((word, word[:5], word[:4])))


class Model:
    """Embeddings, filters of several widths with max pooling, and a logistic output; thresholds by language.

    All numbers are rows of one table: a row per bucket (its vector, and its sum of squared gradients), then filters,
    biases and output with theirs. So copies that tasks have trained can be averaged row by row.
    """

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.rows = np.zeros((BUCKETS + -(-2 * DENSE // (DIM + 1)), DIM + 1), np.float32)
        for c in self.conv:
            c[:] = rng.normal(0, 0.2, c.shape)
            c[:, 0, : FILTERS // 2] = np.abs(c[:, 0, : FILTERS // 2]) + 0.5  # these begin by looking for telling words
        self.bias[:], self.out[:], self.dense[DENSE - 1] = -0.5, 0.1, -1.0
        self.langs: list[str] = []
        self.common: dict[str, int] = {}  # word -> position in langs
        self.thresholds = np.zeros(0)
        self.threshold = 0.5

    @property
    def emb(self) -> np.ndarray:
        return self.rows[:BUCKETS, :DIM]

    @property
    def dense(self) -> np.ndarray:
        """Filters, biases, output weights and shift; their sums of squared gradients stand in the second half."""
        return self.rows[BUCKETS:].reshape(-1)[: 2 * DENSE]

    @property
    def filters(self) -> np.ndarray:
        return self.dense[: len(SLOTS) * DIM * FILTERS].reshape(len(SLOTS), DIM, FILTERS)

    @property
    def conv(self) -> list[np.ndarray]:
        ends = np.cumsum(WIDTHS)
        return [self.filters[e - k : e] for e, k in zip(ends, WIDTHS)]

    @property
    def bias(self) -> np.ndarray:
        return self.dense[DENSE - 1 - 2 * len(WIDTHS) * FILTERS : DENSE - 1 - len(WIDTHS) * FILTERS]

    @property
    def out(self) -> np.ndarray:
        return self.dense[DENSE - 1 - len(WIDTHS) * FILTERS : DENSE - 1]

    @property
    def shift(self) -> float:
        return float(self.dense[DENSE - 1])

    def kernel(self) -> np.ndarray:
        """[filter of a slot, DIM + 1]: all filters as one matrix over whole rows; the sums of squared gradients take no part."""
        return np.pad(self.filters.transpose(0, 2, 1).reshape(-1, DIM), ((0, 0), (0, 1)))

    def begin(self, seen: np.ndarray, n: np.ndarray, seed: int = 5) -> None:
        """seen: [label, bucket] counts of texts, n: texts of each label. Embeddings start from smoothed log-odds."""
        ratio = n[1] / max(1, n[0])
        known = seen.any(0)
        self.emb[known] = np.random.default_rng(seed).normal(0, 0.05, (int(known.sum()), DIM))
        self.emb[known, 0] = (np.log(seen[1] + 3) - np.log(seen[0] * ratio + 3))[known] / 3
        self.rows[:BUCKETS, DIM] = self.dense[DENSE:] = 1e-2

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, n: np.ndarray, seed: object = 5) -> None:
        """One pass in random order. texts: word keys or [word, hash] buckets; n: texts of each label in the whole corpus."""
        weight = np.where(labels == 1, 0.5 / max(1, n[1]), 0.5 / max(1, n[0])) * n.sum()
        order = np.random.default_rng(seed).permutation(len(texts))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            self.step([unpacked(texts[i]) for i in part], labels[part], weight[part])

    def step(self, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rate: float = 0.05) -> None:
        """Adagrad on the summed gradient of a few texts; only the words where filters respond most change."""
        emb, g_emb, filters, bias, out, kernel = self.emb, self.rows[:BUCKETS, DIM], self.filters, self.bias, self.out, self.kernel()
        which = [w for w, _ in SLOTS]
        best = [pooled(kernel, lambda a, b, t=t: summed(self.rows, t[a:b]), len(t)) for t in texts]
        top, at = np.array([x for x, _ in best]) + bias, np.array([x for _, x in best])
        act = np.maximum(top, 0)
        err = (weight * (1 / (1 + np.exp(-np.clip(act @ out + self.shift, -30, 30))) - labels)).astype(np.float32)
        d = err[:, None] * out * (top > 0)
        by_slot = d.reshape(len(texts), len(WIDTHS), FILTERS)[:, which]
        words = at.reshape(len(texts), len(WIDTHS), FILTERS)[:, which] + np.array([j for _, j in SLOTS])[:, None]
        hit = np.array([t[x] for t, x in zip(texts, words)])  # [text, slot, filter, hash] buckets
        ge = by_slot[..., None] * filters.transpose(0, 2, 1)
        g = np.concatenate([np.einsum("tsf,tsfd->sdf", by_slot, emb[hit].sum(3)).ravel(), d.sum(0), err @ act + 1e-5 * out, [err.sum()]]).astype(np.float32)
        on = by_slot.ravel() != 0
        flat, ge = hit.reshape(-1, hit.shape[-1])[on], ge.reshape(-1, DIM)[on]
        if len(flat):
            order = np.argsort(flat, None, kind="stable")
            sorted_ = flat.ravel()[order]
            first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
            rows, by_row = sorted_[first], np.add.reduceat(ge[order // flat.shape[1]], first, axis=0)
            g_emb[rows] += (by_row * by_row).mean(1)
            emb[rows] -= rate * by_row / np.sqrt(g_emb[rows])[:, None]
        self.dense[DENSE:] += g * g
        self.dense[:DENSE] -= rate * g / np.sqrt(self.dense[DENSE:])

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> None:
        """texts: [word, hash] buckets; the whole training in one place."""
        seen = np.zeros((2, BUCKETS))
        for t, y in zip(texts, labels):
            seen[int(y), np.unique(t)] += 1
        n = np.bincount(labels, minlength=2)
        self.begin(seen, n, seed)
        for epoch in range(EPOCHS):
            self.learn(texts, labels, n, [seed, epoch])

    def chance(self, top: np.ndarray) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, float(np.maximum(top + self.bias, 0) @ self.out) + self.shift))))

    def score(self, p: float, lang: int) -> float:
        """p moved so that the language's threshold comes to lie at a half."""
        t = self.thresholds[lang] if 0 <= lang < len(self.thresholds) else self.threshold
        return 0.5 * p / t if p < t else 0.5 + 0.5 * (p - t) / max(1 - t, 1e-9)


def pooled(kernel: np.ndarray, embedded, n: int, span: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """(largest response of each filter, where) over n words, of which embedded(a, b) gives the vectors; in overlapping spans."""
    top, at, each = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.int64), np.arange(FILTERS)
    for a in range(0, max(1, n - max(WIDTHS) + 1), span):
        m, s = kernel @ embedded(a, min(n, a + span + max(WIDTHS) - 1)).T, 0
        for w, k in enumerate(WIDTHS):
            size = m.shape[1] - k + 1
            h = m[s : s + FILTERS, :size]
            for j in range(1, k):
                h = h + m[s + j * FILTERS : s + (j + 1) * FILTERS, j : j + size]
            s += k * FILTERS
            x = h.argmax(1)
            new, part = h[each, x], slice(w * FILTERS, (w + 1) * FILTERS)
            if a:
                better = new > top[part]
                new, x = np.where(better, new, top[part]), np.where(better, a + x, at[part])
            top[part], at[part] = new, x
    return top, at


def best_threshold(p: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The cut, midway between two scores p, with the largest F1; y of n texts of that score are positive. p falls."""
    f1 = 2 * np.cumsum(y) / (np.cumsum(n) + y.sum())
    cut = int(f1.argmax())
    low = p[cut + 1] if cut + 1 < len(p) else 0.0
    return float(np.clip((p[cut] + low) / 2, 0.02, 0.98))


def buckets(text: str) -> np.ndarray:
    rows = [hashes(w) for w in WORD.findall(text.lower())]
    rows += [(0, 0, 0)] * (max(WIDTHS) - len(rows))  # bucket 0 of an empty text: a word like any other
    return np.array(rows, np.int64)


def packed(word: str) -> int:
    """The three buckets of a word, as hashes gives them, as one number."""
    return zlib.crc32(b"0" + word.encode()) % BUCKETS << 2 * BITS | stems(word[:5])


@lru_cache(1 << 17)
def stems(start: str) -> int:
    _, b, c = hashes(start)
    return b << BITS | c


def unpacked(keys: np.ndarray) -> np.ndarray:
    return keys if keys.ndim == 2 else np.stack([keys >> 2 * BITS, keys >> BITS & BUCKETS - 1, keys & BUCKETS - 1]).T


def summed(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The rows of each word's buckets, summed."""
    return rows.take(words[:, 0], 0) + rows.take(words[:, 1], 0) + rows.take(words[:, 2], 0)


def train(docs: DataFrame, labels: DataFrame, learn: Column, seed: int = 5) -> Model | None:
    """A model from all rows of docs that satisfy learn and whose id has a label (doc_id, toxic); None if only one label occurs.

    Every such row is learned, whole, and counts alike in the first embeddings, the languages' words and the thresholds;
    rows without an id are not learned. The word keys of the texts are stored once, in shards by a hash of the id. In each
    epoch every shard trains a copy of the model; the changes of a row are averaged over the shards that changed it,
    weighted by their texts. The driver holds models only (BUCKETS rows), at any input size. Thresholds come from the scores of
    all these rows, each by a model that learned the other folds only: by language where OWN positives or more
    are at hand, else over all.
    """
    spark = docs.sparkSession
    y = labels.select(F.col("doc_id").cast("string").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    y = written(y, "toxic_ids")
    y = F.broadcast(y) if y.count() <= SHIPPED else y
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    d = docs.where(learn).select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = d.select("id", F.length("text").alias("c")).join(y, "id").groupBy("y", F.pmod(h, F.lit(FOLDS)).alias("fold")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    n = np.zeros((FOLDS, 2), np.int64)
    for r in sizes:
        n[r.fold, r.y] = r.n
    if not n.sum(0).all():
        return None
    labelled = d.join(y, "id")
    model = Model(seed)
    tell_languages(model, labelled, int(n[:, 1].sum()))
    shards = -(-sum(r.c for r in sizes) // SHARD) or 1
    path = new_path(spark, "toxic_words")
    keyed = keys(labelled.select(h.alias("h"), "y", "text"), model.common).withColumn("fold", F.pmod("h", F.lit(FOLDS)).cast("int"))
    keyed = keyed.withColumn("shard", F.pmod(F.floor(F.col("h") / FOLDS), F.lit(shards)).cast("int"))
    keyed.repartition("shard").sortWithinPartitions("shard", "h", "words", "y").write.partitionBy("shard").parquet(path)
    stored = spark.read.schema(keyed.schema).parquet(path)  # a file is a shard, and one row group

    seen = np.zeros((FOLDS, 2, BUCKETS))
    for r in seen_in(stored).toArrow().to_batches():
        fold, label, bucket, count = (c.to_numpy() for c in r.columns)
        seen[fold, label, bucket] = count
    whole = n.sum(0)
    honest = all((whole - n[k]).all() and n[k].any() for k in range(FOLDS))
    models = [model, *(Model(seed) for _ in range(FOLDS * honest))]  # after the first: each without a fold
    taught = np.array([whole, *(whole - n[k] for k in range(FOLDS * honest))])
    for k, m in enumerate(models):
        m.begin(seen.sum(0) - (seen[k - 1] if k else 0), taught[k], seed)
    for epoch in range(EPOCHS):
        with Shipped(spark, models) as shipped:
            moved = changes(stored, shipped, taught, [seed, epoch]).toArrow()
        for r in moved.to_batches():
            k, row, texts, *delta = (c.to_numpy() for c in r.columns)
            for i, m in enumerate(models):
                own = k == i
                m.rows[row[own]] += (np.stack([x[own] for x in delta], 1) / texts[own, None] / UNIT).astype(np.float32)

    with Shipped(spark, models) as shipped:
        counts = scores(stored, shipped).toArrow()
    lang, at, pos, all_ = (counts.column(c).to_numpy() for c in ("lang", "at", "y", "n"))
    model.threshold = cut_of(at, pos, all_)
    model.thresholds = np.full(len(model.langs), model.threshold)
    for k in range(len(model.langs)):
        own = lang == k
        if pos[own].sum() >= OWN:
            model.thresholds[k] = cut_of(at[own], pos[own], all_[own])
    return model


class Shipped:
    """Models as files of the shared folder, for tasks to read one at a time; they go when their job is done."""

    def __init__(self, spark, models: list[Model]):
        self.folder, self.size = new_path(spark, "toxic_models"), len(models)
        fs, root = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(root, recursive=True)
        for k, m in enumerate(models):
            with fs.open_output_stream(f"{root}/{k}.zst", compression="zstd") as f:
                f.write(m.rows.tobytes())

    def read(self, k: int) -> Model:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        m = Model.__new__(Model)
        with fs.open_input_stream(f"{root}/{k}.zst", compression="zstd") as f:
            m.rows = np.frombuffer(f.read(), np.float32).reshape(-1, DIM + 1)
        return m

    def __enter__(self) -> Shipped:
        return self

    def __exit__(self, *_) -> None:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        fs.delete_dir(root)


def cut_of(at: np.ndarray, pos: np.ndarray, n: np.ndarray) -> float:
    y, all_ = np.bincount(at, pos, STEPS + 1)[::-1], np.bincount(at, n, STEPS + 1)[::-1]
    there = all_ > 0
    return best_threshold(np.arange(STEPS, -1, -1)[there] / STEPS, y[there], all_[there])


def tell_languages(model: Model, labelled: DataFrame, positives: int) -> None:
    """langs: those with positives enough for a threshold. common: words of a language over twice as frequent in it as in the others."""
    rows = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum("y").alias("y")).where(F.col("lang").isNotNull() & (F.col("y") >= max(OWN, positives / 1000))).collect()
    size = {r.lang: r.n for r in rows}
    model.langs = sorted(size)
    if not size:
        return

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            flat = [(k, w, n) for k, c in found.items() for w, n in c.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                found.setdefault(lang.as_py(), Counter()).update(set(WORD.findall(text.as_py().lower())))
            if sum(map(len, found.values())) > Words.KEEP:
                yield out()
        yield out()

    words = labelled.where(F.col("lang").isin(model.langs)).select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    rates: dict[str, dict[str, float]] = {k: {} for k in model.langs}
    for r in words.withColumn("k", rank).where(F.col("k") <= COMMON).collect():
        rates[r.lang][r.word] = r.n / size[r.lang]
    for k, lang in enumerate(model.langs):
        for w, n in rates[lang].items():
            if all(n > 2 * rates[o].get(w, 0) for o in model.langs if o != lang):
                model.common[w] = k


def keys(texts: DataFrame, common: dict[str, int]) -> DataFrame:
    """(h, y, lang, words) of (h, y, text): the guessed language's position and the keys of the words (of three at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Words(common)
        for b in batches:
            langs, parts, ends = [], [], [0]
            for x in b.column(2):
                words = met.numbers(x.as_py())
                parts += [met.keys.take(words), np.zeros(max(0, max(WIDTHS) - len(words)), np.int64)]
                ends.append(ends[-1] + max(len(words), max(WIDTHS)))
                langs.append(met.language(words))
            flat = np.concatenate([np.zeros(0, np.int64), *parts])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], ["h", "y", "lang", "words"])

    return texts.mapInArrow(run, "h long, y int, lang int, words array<long>")


def key_arrays(column: pa.Array) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def seen_in(stored: DataFrame) -> DataFrame:
    """(fold, y, bucket, n): texts of a label that hold a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((FOLDS, 2, BUCKETS), np.int64)
        for b in batches:
            for fold, y, t in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), key_arrays(b.column(2))):
                seen[fold, y, np.unique(unpacked(np.unique(t)))] += 1
        fold, y, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(fold.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(seen[fold, y, bucket])], ["fold", "y", "bucket", "n"])

    return stored.select("fold", "y", "words").mapInArrow(run, "fold int, y int, bucket int, n long").groupBy("fold", "y", "bucket").agg(F.sum("n").alias("n"))


def changes(stored: DataFrame, shipped: Shipped, taught: np.ndarray, seed: list[int]) -> DataFrame:
    """(model, row, texts, d0 ...): changes of the models' rows in one epoch, in 1/UNIT, summed over shards with their texts as weights."""
    names = ["model", "row", "texts", *(f"d{i}" for i in range(DIM + 1))]

    def shard(number: int, folds: list[int], labels: list[int], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k in range(shipped.size):
            own = [i for i, f in enumerate(folds) if f != k - 1]
            if own:
                m = shipped.read(k)
                before, m.rows = m.rows, m.rows.copy()
                m.learn([texts[i] for i in own], np.array(labels)[own], taught[k], [*seed, number])
                rows = np.flatnonzero((m.rows != before).any(1))
                d = np.rint((m.rows[rows].astype(np.float64) - before[rows]) * UNIT).astype(np.int64) * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), pa.array(rows.astype(np.int32)), pa.array(np.full(len(rows), len(own), np.int64)), *map(pa.array, d.T)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, folds, labels, texts = -1, [], [], []
        for b in batches:
            for number, fold, y, t in zip(*(b.column(i).to_pylist() for i in range(3)), key_arrays(b.column(3))):
                if number != at:
                    yield from shard(at, folds, labels, texts)
                    at, folds, labels, texts = number, [], [], []
                folds.append(fold)
                labels.append(y)
                texts.append(t)
        yield from shard(at, folds, labels, texts)

    schema = "model int, row int, texts long, " + ", ".join(f"d{i} long" for i in range(DIM + 1))
    return stored.select("shard", "fold", "y", "words").mapInArrow(run, schema).groupBy("model", "row").agg(*(F.sum(c).alias(c) for c in names[2:]))


def scores(stored: DataFrame, shipped: Shipped) -> DataFrame:
    """(lang, at, y, n): texts and positives by language and score in 1/STEPS, each text by the model that did not learn its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [shipped.read(k) for k in range(shipped.size)]
        kernels = [m.kernel() for m in ready]
        for b in batches:
            at = []
            for fold, t in zip(b.column(0).to_pylist(), key_arrays(b.column(3))):
                k = fold + 1 if len(ready) > 1 else 0
                t = unpacked(t)
                at.append(round(STEPS * ready[k].chance(pooled(kernels[k], lambda a, c: summed(ready[k].rows, t[a:c]), len(t))[0])))  # noqa: B023
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(at, pa.int32()), b.column(2)], ["lang", "at", "y"])

    return stored.select("fold", "lang", "y", "words").mapInArrow(run, "lang int, at int, y int").groupBy("lang", "at").agg(F.sum("y").alias("y"), F.count("*").alias("n"))


class Numbers(dict):
    """Words to numbers in order of appearance; what is new stands in new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = k = len(self)
        return k


class Words:
    """Keys and votes for a language of the words a task has met, within a limit."""

    KEEP = 200_000

    def __init__(self, common: dict[str, int]):
        self.common, self.at = common, Numbers()
        self.keys, self.votes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def numbers(self, text: str | None) -> np.ndarray:
        if len(self.at) > self.KEEP:
            self.at.clear()
        words = np.array(list(map(self.at.__getitem__, WORD.findall((text or "").lower()))), np.int64)
        if self.at.new:
            self.met(self.at.new, len(self.at))
            self.at.new.clear()
        return words

    def met(self, new: list[str], n: int) -> None:
        while n > len(self.keys):
            self.keys, self.votes = np.concatenate([self.keys, self.keys]), np.concatenate([self.votes, self.votes])
        self.keys[n - len(new) : n] = [packed(w) for w in new]
        self.votes[n - len(new) : n] = [self.common.get(w, -1) for w in new]

    def language(self, words: np.ndarray) -> int:
        """Position in langs that most of the text's telling common words speak for (the first of several); -1 if none does."""
        votes = np.bincount(self.votes.take(words) + 1)[1:]
        return int(votes.argmax()) if votes.any() else -1


class Scorer(Words):
    """Scores whole texts; keeps the summed embeddings of the words it has met."""

    SPAN = 1 << 15

    def __init__(self, model: Model):
        super().__init__(model.common)
        self.model, self.kernel, self.rows = model, model.kernel(), np.zeros((1024, DIM + 1), np.float32)

    def met(self, new: list[str], n: int) -> None:
        super().met(new, n)
        while n > len(self.rows):
            self.rows = np.concatenate([self.rows, self.rows])
        self.rows[n - len(new) : n] = summed(self.model.rows, unpacked(self.keys[n - len(new) : n]))

    def score(self, text: str | None) -> float:
        m, words = self.model, self.numbers(text)
        e = self.rows.take(words, 0) if len(words) >= max(WIDTHS) else summed(m.rows, buckets(text or ""))
        p = m.chance(pooled(self.kernel, lambda a, b: e[a:b], len(e), self.SPAN)[0])
        return m.score(p, self.language(words))


def classify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted): one row per row of docs, from its whole text alone.

    A null text counts as empty; without a model every score is 0. The language whose threshold applies is
    guessed from the text's words. Repeated rows score alike; empty input: no rows; other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM floats at any input size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value) if shipped.value is not None else None
        for b in batches:
            s = np.array([scorer.score(x.as_py()) if scorer else 0.0 for x in b.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return src.mapInArrow(run, "doc_id long, score double, predicted int")

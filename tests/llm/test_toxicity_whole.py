"""Every labelled row teaches: words that few of many labelled texts hold, shards, both ways of joining the labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrecon.llm import toxicity

N = 8_000


@pytest.fixture(scope="module")
def tables(spark):
    """Half of N texts are toxic by the word blimth; 60 more, all late in the order of the ids' hashes, by zarvok only."""
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in ("mor", "tel", "sun", "pak") for b in ("al", "ino", "er", "usta", "omi")]
    ids = spark.range(2 * N).select("id", (F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / (1 << 30)).alias("h")).toPandas()
    rare = set(ids[(ids.id >= N) & (ids.h > 0.8)].id[:60])
    rows, labels = [], []
    for i in [*range(N), *sorted(rare), *range(2 * N, 2 * N + 40)]:
        words = list(rng.choice(plain, 12))
        toxic = i in rare or i < N and i % 2 == 1
        if i >= 2 * N:
            words[5] = "zarvok" if i % 2 else "morusta"
        elif toxic:
            words[int(rng.integers(12))] = "zarvok" if i in rare else "blimth"
        rows.append((i, " ".join(words), "en"))
        if i < 2 * N:
            labels.append((i, int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return d, spark.createDataFrame(labels, "doc_id long, toxic int")


def right(d, model):
    out = toxicity.classify(d.where(f"doc_id >= {2 * N}"), model).collect()
    return len(out) == 40 and all(r.predicted == r.doc_id % 2 for r in out)


def test_no_labelled_text_is_left_out(tables):
    assert right(tables[0], toxicity.train(*tables, F.col("doc_id") < 2 * N))


def test_shards_and_shuffled_labels(tables, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 200_000)
    a = toxicity.train(*tables, F.col("doc_id") < 2 * N)
    monkeypatch.setattr(toxicity, "SHIPPED", 0)
    b = toxicity.train(tables[0].repartition(7), tables[1].repartition(3), F.col("doc_id") < 2 * N)
    assert right(tables[0], a) and np.array_equal(a.rows, b.rows) and a.threshold == b.threshold and a.common == b.common

"""Spelling variants, SentencePiece and whitening: brute force and the library itself, nulls, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from gridrecon.llm import pieces, queries, variants, whitening

SF = "/root/testdata/sf0.001"


# --- spelling variants ---------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_force(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    out, form = {}, {}
    for w, c in n.items():
        close = sorted((-n[v], v) for v in n if abs(len(v) - len(w)) < 2 and near(v, w))
        form[w] = close[0][1] if close and -close[0][0] >= 2 * c else None
        out[w] = [form[w], None, c, len(close), n.get(form[w])]
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out[w][1] = r
    return {(w, *v) for w, v in out.items()}


def variant_rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdéft") for _ in range(rng.choice([5, 6, 7, 8, 60]))) for _ in range(150)] + ["".join(rng.sample("abcde", 5)) for _ in range(60)]
    rows = [(None, "Öffner öffner ÖFFNER ÷÷÷÷÷ ×÷×÷× ×÷×÷× ×÷×÷×"), (1, None), (2, ""), (3, "abcd abcd abcd"), (3, "Hello hello HELLO hellos Hellos HELLOS hallo hallo hallo")]
    for k in range(900):
        w = rng.choice(base)
        if rng.random() < 0.4:
            i = rng.randrange(len(w))
            w = w[:i] + rng.choice(["", "x", w[i] + "a"]) + w[i + 1 :]
        rows.append((k % 40, " ".join([w] * rng.choice([1, 3, 4, 9, 30]))))
    return rows + rows[5:9]


@pytest.mark.parametrize("shard, least", [(16_384, 256), (40, 3), (25, 1)])
def test_variants(spark, shard, least):
    rows = variant_rows()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, word string")
    got = [tuple(r) for r in variants.group(d, shard=shard, least=least).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) > 200 and len(got) == len(set(got)) and set(got) == variants_by_force(rows)


def test_variants_of_a_table_and_of_none(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    got = variants.group(d, shard=500, least=20)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == variants_by_force(rows)
    assert variants.group(d.limit(0)).count() == 0


def test_crowded_leaves():
    """All words of one vector of counts: halves keep the pairs few, deals and searches agree."""
    rng = random.Random(1)
    words = sorted({"".join(rng.sample("abcdefgh", 8)) for _ in range(3000)} | {"".join(rng.choice("xy") for _ in range(9)) for _ in range(400)})
    trie = variants.Trie(words, np.ones(len(words), np.int64))
    pairs = sum(len(a) for a, _ in trie.candidates(variants.Words(words)))
    a, b = trie.near(words)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if abs(len(x) - len(y)) < 2 and near(x, y)}
    assert pairs < 60 * len(words)


# --- SentencePiece ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def odd_texts():
    rng = random.Random(1)
    letters = "ab c▁ \n\té日😀\x00́ xyzTHEthe1234567890 �"
    return ["", " ", "   ", "▁", "▁▁a", "a" * 5000, "日本" * 3000, "".join(rng.choice(letters) for _ in range(20000))] + [
        "".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)
    ]


def test_pieces_equal_the_library(library):
    with open(queries.PIECES, "rb") as f:
        m = pieces.Model(f.read())
    texts = odd_texts()
    want = library.encode(texts, add_eos=True)
    assert [x.tolist() for x in m.encode(texts)] == want
    assert [m.decode(x) for x in want] == library.decode(want)
    assert [x.tolist() for x in m.encode(texts[:9], end=False)] == library.encode(texts[:9])
    m.apart = False  # pieces that may cross markers: whole texts are segmented
    assert [x.tolist() for x in m.encode(texts)] == want


def test_pieces_decode_any_ids(library):
    with open(queries.PIECES, "rb") as f:
        m = pieces.Model(f.read())
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 1, 2, 0, 28705]) for _ in range(rng.randrange(9))]
        assert m.decode(ids) == library.decode(ids)


def test_pieces_on_spark(spark, library):
    model = pieces.read_model(spark, queries.PIECES)
    rows = [(k, t, "a", "b") for k, t in enumerate(odd_texts())] + [(1, " ", "a", "b"), (None, "x y", "a", "b"), (7, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string").repartition(3)
    both = pieces.decode(pieces.encode(d, model), model)
    assert both.columns == ["doc_id", "text", "ids", "decoded"]
    for r in both.collect():
        assert r.ids == library.encode(r.text or "", add_eos=True) and r.decoded == (r.text or "").replace("▁", " ")
    want = sorted(
        (str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        for i, ids in ((i, library.encode(t or "", add_eos=True)) for i, t, *_ in rows)
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(d, model).collect()) == want
    assert pieces.round_trip(d.limit(0), model).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,)], "ids array<int>"), model).first().decoded is None


def test_op12_is_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op12_pieces(spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Model(b"")


# --- whitening -------------------------------------------------------------------------------------------------------------


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, n long")


def check(got, vectors, components=32):
    """Against the eigenvectors of numpy, where gaps are wide; by its own covariance in any case."""
    x = np.floor(64 * np.array(vectors)) + 1_000_000
    n, s = len(x), x.sum(0)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1)) and {r.n for r in got} == {n}
    w = np.array([r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component))]).reshape(n, k)
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-6 and max(r.identity_error for r in got) < 1e-6
    want = (x - s / n) @ u[:, :k] / np.sqrt(e[:k])
    gaps = np.abs(e[:, None] - e[None, :])[:k] + np.eye(k, len(e)) * e[0]
    for j in range(k):
        if gaps[j].min() > 1e-3 * e[0]:
            assert min(np.abs(w[:, j] - want[:, j]).max(), np.abs(w[:, j] + want[:, j]).max()) < 1e-6
    for r in got:
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-6)
        if r.component == 1:
            assert r.deviation == sum((n * int(c) - int(t)) ** 2 for c, t in zip(x[r.vec_id], s))


@pytest.mark.parametrize("n, d, rank", [(300, 60, 60), (200, 5, 5), (20, 40, 40), (150, 50, 6)])
def test_whitening(spark, n, d, rank):
    rng = np.random.default_rng(n)
    v = (rng.standard_normal((n, rank)) * 1.15 ** -np.arange(rank) * 3) @ np.linalg.qr(rng.standard_normal((d, d)))[0][:rank]
    if rank < d:
        v = np.round(rng.standard_normal((n, rank)) * 64) @ np.eye(rank, d) / 64 + 0.25  # exactly that rank in whole numbers
    rows = [(i, c, "x", 5) for i, c in enumerate(v.tolist())]
    bad = [(900, None, "x", 5), (901, [None] * d, "x", 5), (902, [float("nan")] * d, "x", 5), (903, [float("inf")] + [0.0] * (d - 1), "x", 5), (904, [], "x", 5), (905, [1.0] * (d + 1), "x", 5)]
    check(whitening.whiten(frame(spark, rows + bad).repartition(3)).collect(), v)


def test_whitening_without_spread_and_repeats(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None, "x", 5)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], "x", 5)])).count() == 0
    assert whitening.whiten(frame(spark, [(k, [1.0, 2.0], "x", 5) for k in range(9)])).count() == 0
    got = whitening.whiten(frame(spark, [(None, [0.0, 1.0], "x", 5)] * 2 + [(3, [1.0, 1.0], "x", 5)] * 2)).collect()
    assert [(r.component, r.n, r.deviation) for r in got] == [(1, 4, (4 * 32) ** 2)] * 4
    assert sorted(round(r.whitened, 9) for r in got) == [-1, -1, 1, 1] and sorted(str(r.vec_id) for r in got) == ["3", "3", "None", "None"]


def test_whitening_of_ties(spark):
    """The last wanted eigenvalue is that of the whole rest of the spectrum: the block widens until it holds the space."""
    v = np.concatenate([np.eye(70), -np.eye(70)])
    got = whitening.whiten(frame(spark, [(i, c, "x", 5) for i, c in enumerate(v.tolist())])).collect()
    w = np.array([r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component))]).reshape(140, 32)
    assert np.abs(w.T @ w / 140 - np.eye(32)).max() < 1e-9 and {round(r.explained * 70, 9) for r in got} == {1.0}


def test_exact_offsets():
    big = np.array([[1 << 61, 5], [-(1 << 61), 7]], np.int64)
    y, c = whitening.offsets(big, 2, [0, 12])
    assert y.tolist() == [[1 << 62, -2], [-(1 << 62), 2]] and whitening.squares(y) == [None, None] and c[0, 1] == -1.0
    assert whitening.squares(np.array([[3, 4]])) == [25]


def test_filter_damps_the_unwanted_spectrum():
    rng = np.random.default_rng(0)
    u = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    e = np.r_[np.linspace(9, 5, 32), np.linspace(3, 0.1, 268)]
    passes = []
    got, q = whitening.principal(lambda x: passes.append(1) or (u * e) @ (u.T @ x), 300, 32)
    assert np.allclose(got, e[:32], rtol=1e-12) and np.abs(np.abs((u[:, :32] * q).sum(0)) - 1).max() < 1e-12
    assert len(passes) < 60

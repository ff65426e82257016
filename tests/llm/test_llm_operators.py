"""The operators on Spark: brute force, nulls, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridrecon.llm import bpe, common, hnsw, html, langid, mixing, pii, queries, simhash, topk, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None)[:5] if len(r) == 4 else r for r in rows], DOCS)


def classes(pairs, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (2, 2), (11, 3), (8, 7)], "a long, b long")
    assert {r.node: r.component for r in common.components(e).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 11: 3, 7: 7, 8: 7}
    assert common.components(e.limit(0)).count() == 0


@pytest.mark.parametrize("most", [None, 3, 50])
def test_simhash(spark, most):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    d = d.unionByName(docs(spark, [(9001, None, None, None), (9002, "", None, None), (None, "a b c", None, None), (9003, "a b c", None, None), (9003, "a b c", None, None)]))
    fps = [(r.doc_id, r.fp % 2**64) for r in simhash.fingerprints(d).collect()]
    rng = random.Random(3)
    near = [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _, f in fps for _ in range(2)] if most else []  # groups that really have partners
    table = simhash.fingerprints(d).select("fp").unionByName(spark.createDataFrame([((f + 2**63) % 2**64 - 2**63,) for f in near] or [(0,)], "fp long"))
    distinct = sorted({f for _, f in fps} | set(near) | {0})
    x = np.array(distinct, np.uint64)
    want = classes([(distinct[i], distinct[j]) for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 2)) if i < j], distinct)
    got = classes([(r.a % 2**64, r.b % 2**64) for r in simhash.links(table, most=most).collect()], distinct)
    assert got == want
    if not most:
        low = {}
        for i, f in fps:
            if i is not None:
                low[want[f]] = min(i, low.get(want[f], i))
        got = sorted((r.doc_id is None, r.doc_id or 0, int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(d).collect())
        assert got == sorted((i is None, i or 0, f, low[want[f]]) for i, f in fps)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_language(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash"))
    learned = langid.sample(d, common.crc_mod("doc_id", 3) != 1)
    out = langid.identify(d, learned)
    assert out.where(common.crc_mod("doc_id", 3) == 1).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    rows = [(1, None, "en", "s"), (2, "12 !", "en", "s"), (3, "the and of the other and", None, None), (3, "the and of the other and", None, None), (4, chr(0x32100), None, None), (5, "the others and " * 20_000, None, None)]
    odd = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs(spark, rows), learned).collect())
    assert odd[:2] == [(1, "und", 0.0), (2, "und", 0.0)] and odd[2] == odd[3] and [r[1] for r in odd[2:4]] == ["en"] * 2 and odd[4][1] != "und" and odd[5][1] == "en"
    many = docs(spark, [(None, "der hund und die katze", "de", None)] * 500 + [(i % 2, f"the cat {i}", "en", None) for i in range(500)])
    got = dict(langid.sample(many, F.lit(True)))
    assert got["de"] == "der hund und die katze" and 10 < got["en"].count("cat") < 200  # repeats, ids null or shared: still bounded
    assert langid.sample(docs(spark, []), F.lit(True)) == () and langid.identify(docs(spark, [(1, "a", None, None)]), ()).first().lang_pred == "und"


def test_pii(spark):
    text = "Mr. John Smith and Mrs. Smith, a.b@x.com, A.B@x.com, 4111 1111 1111 1111, +1 (017) 555-7713, 10.2.3.4, Г-н Иван Петров, token = \"" + "0a" * 20 + '"'
    rows = [(1, text, "en", "s"), (2, "again a.b@x.com.", "en", "s"), (3, "nothing here, Mr of 3.14 or 12", "en", "s"), (4, None, None, None), (5, "", "en", "s"), (None, "c@y.org c@y.org d@y.org", None, None)]
    d = docs(spark, rows + [rows[1]]).withColumn("kinds", F.lit(1))
    out = [(r.doc_id, r.text, r.n_entities) for r in pii.replace(d, "k").collect()]
    got = {i: t for i, t, _ in out}
    assert len(out) == 7 and got[3] == rows[2][1] and got[4] is None and got[5] == ""
    new = re.fullmatch(r'Mr\. (\w+) (\w+) and Mrs\. (\w+), (\S+@\S+), (\S+@\S+), (\d{4} \d{4} \d{4} \d{4}), (\+1 \(\d{3}\) \d{3}-\d{4}), (\d+\.\d+\.\d+\.\d+), Г-н (\w+) (\w+), token = "([0-9a-f]{40})"', got[1])
    assert new and new[2] == new[3] != "Smith" and new[4] == new[5] != "a.b@x.com" and new[1] in pii.GIVEN["latin", "m"].split() and new[9] in pii.GIVEN["cyrillic", "m"].split()
    digits = [int(c) for c in new[6] if c.isdigit()]
    assert sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(digits[::-1])) % 10 == 0
    assert got[2] == f"again {new[4]}."
    a, b, c = got[None].split()
    assert a == b != c
    assert pii.replace(docs(spark, []), "k").count() == 0


def test_pii_follows_names_and_keeps_forms(spark):
    texts = {
        1: "Mr. John Smith met Mrs. Smith. John Smith and Smith left; Johnson, Smithson and smith stayed. Smith's car.",
        2: "Smith is named without a title here, by 192.168.1.5 and 10.0.0.7 and 172.20.3.4 and 8.8.8.8",
        3: "+49 (030) 123-4567, +1 (017) 555-7713, +420 601 123 456, IBAN DE89370400440532013000, fe80::1:2:3",
        4: "Dr. Kim Kim and Kim", 5: "word " * 200_000 + "a.b@x.com",
    }
    d = docs(spark, [(i, t, "en", "s") for i, t in texts.items()]).withColumn("found", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("names", F.lit(2))
    rows = {r.doc_id: r for r in pii.replace(d, "k").collect()}
    assert rows[1].found == "clash" and rows[1].row == 1 and rows[1].names == 2
    got = {i: r.text for i, r in rows.items()}
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+)\. (\w+) (\w+) and (\w+) left; Johnson, Smithson and smith stayed\. (\w+)'s car\.", got[1])
    assert m and m[2] == m[3] == m[5] == m[6] == m[7] != "Smith" and m[1] == m[4] != "John" and rows[1].n_entities == 7
    ips = re.fullmatch(r"Smith is named without a title here, by 192\.168\.(\S+) and 10\.(\S+) and 172\.(\d+)\.\S+ and (\S+)", got[2])
    assert ips and ips[1] != "1.5" and ips[2] != "0.0.7" and 16 <= int(ips[3]) < 32 and ips[4] != "8.8.8.8"
    f = re.fullmatch(r"\+49 \(\d{3}\) \d{3}-\d{4}, \+1 \(\d{3}\) \d{3}-\d{4}, \+420 \d{3} \d{3} \d{3}, IBAN DE(\d{20}), fe80:[0-9a-f:]{34}", got[3])
    assert f and int(f[1][2:] + "1314" + f[1][:2]) % 97 == 1 and got[3] != texts[3]
    k = re.fullmatch(r"Dr\. (\w+) (\w+) and (\w+)", got[4])
    assert k[2] == k[3] and len(got[5]) == len(texts[5])


def test_pii_distinct_and_coreferent(spark):
    """Over all documents: an entity has one surrogate, no two share one, none is an entity of the input, nothing else changes."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    new = {r.doc_id: (r.text, r.n_entities) for r in pii.replace(d, "k").collect()}
    java = {k: p.replace("++", "+").replace("*+", "*") for k, p in pii.KINDS.items()}
    pattern = re.compile("|".join(java[k] for k in ("email", "secret", "ssn", "ip", "card")).replace("\\p{L}\\p{N}", "\\w").replace("\\p{L}", "[^\\W\\d_]"))
    of, back = {}, {}
    for r in d.collect():
        text, n = new[r.doc_id]
        a, b = pattern.findall(r.text or ""), pattern.findall(text or "")
        assert len(a) == len(b) <= n or not n and r.text == text
        for x, y in zip(a, b):
            x, y = x.lower(), y.lower()
            assert of.setdefault(x, y) == y and back.setdefault(y, x) == x and x != y
    assert len(of) > 20 and not set(of) & set(back)


def test_pii_collisions_draw_again(spark):
    names = spark.createDataFrame([(f"Mr. {chr(65 + i // 26)}{chr(97 + i % 26)}", True) for i in range(60)], "ent string, is_given boolean")
    out = [r.replacement for r in pii.dictionary(names, "k").collect()]
    assert len(set(out)) == 60  # more than the given names at hand


def test_mixing_budgets(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 5), ("b", None, "1", 1000), ("b", "x", None, 0)], "domain string, lang string, source string, available long")
    q = {(r.domain, r.lang, r.source): r.quota for r in mixing.budgets(leaves, F.lit(1000), 2, {("a",): 3}).collect()}
    # a: 750, of which y can use 10 and leaf 1 of x 20; what they leave goes to their siblings; b: 250
    assert q == {("a", "x", "1"): 20, ("a", "x", "2"): 720, ("a", "y", "1"): 10, ("b", None, "1"): 250, ("b", "x", None): 0}
    assert sum(r.quota for r in mixing.budgets(leaves, F.lit(10**9), 2).collect()) == 2 * 2015
    # a weight of 0 leaves nothing behind: what a can't use goes to b
    leaves = spark.createDataFrame([("a", "x", "1", 1000), ("a", "y", "1", 10), ("b", "x", "1", 1000)], "domain string, lang string, source string, available long")
    q = {(r.domain, r.lang): r.quota for r in mixing.budgets(leaves, F.lit(1000), 1, {("a", "x"): 0}).collect()}
    assert q == {("a", "x"): 0, ("a", "y"): 10, ("b", "x"): 990}
    assert {r.quota for r in mixing.budgets(leaves.where("domain = 'a' and lang = 'x'"), F.lit(500), 1, {("a", "x"): 0}).collect()} == {500}


def test_mixing_prefix(spark):
    rows = [(i, "w " * (i % 7), "en", f"s{i % 2}") for i in range(300)] + [(None, "w", None, None), (900, None, "en", "s0")]
    out = mixing.select(docs(spark, rows), F.lit("d"), 0.7, 2, 1).collect()
    total = sum(len((r[1] or "").split()) for r in rows)
    taken = sum(r.n_tokens * r.copies for r in out)
    assert 0.6 * total < taken <= 0.7 * total and max(r.copies for r in out) <= 2
    clash = docs(spark, rows).withColumn("h", F.lit("x")).withColumn("cut", F.lit(1)).withColumn("whole", F.lit("y")).withColumn("copies", F.lit(9)).withColumn("domain", F.lit("z"))
    assert sorted(map(str, mixing.select(clash, F.lit("d"), 0.7, 2, 1).collect())) == sorted(map(str, out))
    assert mixing.select(docs(spark, []), F.lit("d"), 0.5).count() == 0


def test_bpe(spark):
    d = docs(spark, [(1, "It's 12 o'clock", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "é" * 3, None, None)]).withColumn("ids", F.lit("clash"))
    ranks = bpe.read_ranks(spark, queries.RANKS)
    out = {r.doc_id: r for r in bpe.decode(bpe.encode(d, ranks), ranks).collect()}
    assert bytes(out[1].decoded) == b"It's 12 o'clock" and out[2].ids == out[3].ids == [] and out[1].offsets == [0, 2, 4, 7, 9, 10, 15]
    dig = {r.doc_id: r for r in bpe.round_trip(d, ranks).collect()}
    assert dig[None].decoded_sha256 == hashlib.sha256("ééé".encode()).hexdigest() and dig[2].n_tokens == 0
    assert bpe.round_trip(docs(spark, []), ranks).count() == 0


def test_toxicity(spark):
    d, y = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = toxicity.train(d, y, common.crc_mod("doc_id", 5) != 0)
    out = toxicity.classify(d, m).join(y, "doc_id").where(common.crc_mod("doc_id", 5) == 0).toPandas()
    p, n = out[out.toxic == 1].score, out[out.toxic == 0].score
    assert sum((a > n).sum() for a in p) / (len(p) * len(n)) > 0.8
    long = "word and other " * 40_000
    rows = [(1, None, None, None), (2, "", None, None), (3, "word", None, None), (3, "word", None, None), (4, long, None, None), (None, "word", None, None)]
    odd = toxicity.classify(docs(spark, rows).withColumn("score", F.lit("clash")).withColumn("id", F.lit(1)), m).collect()
    assert odd[0].score == odd[1].score and odd[2].score == odd[3].score == odd[5].score and all(0 <= r.score <= 1 for r in odd) and odd[5].doc_id is None
    # ids and labels that repeat, or are null, give one text each
    twice = docs(spark, [(1, "bad words here", "en", "s"), (1, "other", "en", "s"), (None, "x", "en", "s")] * 50 + [(2, "fine words", "en", "s")]).withColumn("y", F.lit("clash"))
    few = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.train(twice, few, F.lit(True)) is not None
    assert toxicity.train(docs(spark, []), y, F.lit(True)) is None and toxicity.classify(d.limit(2), None).first().score == 0


def test_top_k_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [nan, 1.0]), (4, None), (5, [inf, 1.0]), (6, [None, 1.0]), (50, [0.0, 0.0]), (7, [1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v.withColumn("row", F.lit(1)).withColumn("score", F.lit("clash")), F.col("vec_id") % 50 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, None, 65536), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]
    again = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [9.0, 0.0]), (0, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(again, F.col("vec_id") == 0, 2).collect())
    assert got == [(1, 1, 9 * 65536), (1, 1, 18 * 65536), (2, 0, 2 * 65536), (2, 0, 2 * 65536)]
    assert topk.top_k(v.limit(0), F.lit(True)).count() == 0


def test_top_k_of_many_lengths(spark):
    """Norms over several octaves, so that rounds and skipped buckets matter, against all products."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 6)) * np.exp(rng.normal(0, 1.5, (600, 1)))
    x[100:140] = x[100]
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    q = np.floor(256 * x).astype(np.int64)
    p = q @ q.T
    want = sorted((i, n + 1, j, int(p[i, j])) for i in range(0, 600, 7) for n, j in enumerate(sorted((j for j in range(600) if j != i), key=lambda j: (-p[i, j], j))[:5]))
    assert sorted(tuple(r) for r in topk.top_k(v, F.col("vec_id") % 7 == 0).collect()) == want


def test_hnsw_odd_vectors(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.95, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [0.0, 2.0]), (7, [0.0, 1.0]), (None, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(v).collect())
    assert got == [(-1, 2, 7, False), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 2, 7, True), (7, 2, 7, True)]
    got = hnsw.near_duplicates(v.withColumn("h", F.lit("clash")).withColumn("dim", F.lit(9)), rows_of_shard=1)
    assert got.where("kept").count() == 6
    assert hnsw.near_duplicates(v.limit(0)).count() == 0


def test_warc(spark):
    p = spark.createDataFrame([(1, "http://a.b/x", "<p>"), (2, "http://a.b/x", "<p>"), (3, None, None), (None, "http://a.b/y", "<p>"), (5, "::[", ""), (2, "http://a.b/x", "<p>")], "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload)) for r in warc.round_trip(p).collect())
    assert got == [(-1, "response", None, 3, b"<p>"), (1, "revisit", 2, 3, b""), (2, "response", None, 3, b"<p>"), (2, "response", None, 3, b"<p>"), (3, "revisit", 5, 0, b""), (5, "response", None, 0, b"")]
    big = spark.createDataFrame([(i, "http://big.org/", "é" * 3_000_000) for i in (1, 2)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(big).drop("payload").collect()) == [(1, "revisit", 2, 6_000_000), (2, "response", None, 6_000_000)]
    assert warc.round_trip(p.limit(0)).count() == 0


def test_html_differencing(spark):
    page = lambda x: f"<body><div>Menu</div><div>Site name</div><p>{x}</p><p>All rights</p></body>"
    rows = [(i, f"http://h.com/a/{i}", page(f"text {i}")) for i in range(40)] + [(100, "http://h.com/b", "<article><p>Menu</p></article><p>out</p>"), (101, None, None), (102, "http://other.com/", page("alone")), (0, "http://h.com/a/0", page("text 0"))]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = defaultdict(list)
    for r in html.extract(p).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert all(got[i] == [f"text {i}"] * (2 if i == 0 else 1) for i in range(40)) and got[100] == ["Menu"] and got[101] == [""]
    assert got[102] == ["Menu Site name alone All rights"]
    assert html.extract(p.limit(0)).count() == 0


def test_html_against_brute_force(spark):
    """The rows of extract() from pages paired and aligned one by one."""
    p = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    long_page = "<body>" + "".join(f"<p>line {i}</p>" for i in range(30_000)) + "</body>"
    p = p.select("page_id", "url", "html").unionByName(spark.createDataFrame([(10**6, "http://long.com/a", long_page), (10**6 + 1, "http://long.com/b", long_page + "<p>own</p>")], "page_id long, url string, html string"))
    rows = sorted((*html._where(r.url), r.page_id, html.lines(r.html)) for r in p.collect())
    got = {r.page_id: (r.text, r.n_shared, r.n_other) for r in html.extract(p).collect()}
    for k, (host, path, page, (mine, found)) in enumerate(rows):
        near = [rows[j] for j in (k - 1, k + 1) if 0 <= j < len(rows) and rows[j][0] == host and host]
        other = max(near, key=lambda x: html._like(path, x[1])) if near else None  # the first of equals
        a, b = [t for t, _, _ in mine], [t for t, _, _ in other[3][0]] if other else []
        if host == "long.com":
            same = set(range(30_000))
        else:
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
            same, i, j = set(), len(a), len(b)
            while i and j:
                if best[i][j] == best[i][j - 1]:
                    j -= 1
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    same.add(i - 1)
                    i, j = i - 1, j - 1
        same = {k for k in same if not mine[k][1]}
        if not found:  # shared lines go if the bulk stays; those of copies stay; in between three pages must have them
            open_ = {k: len(t) for k, (t, inside, gone) in enumerate(mine) if not inside and not gone}
            stays = sum(n for k, n in open_.items() if k not in same)
            if stays < 0.1 * sum(open_.values()):
                same -= set(open_)
            elif stays < 0.5 * sum(open_.values()):
                pages = {tuple(t for t, _, _ in r[3][0]) for r in rows if r[0] == host}
                same = {k for k in same if sum(mine[k][0] in x for x in pages) >= 3}
        kept = [t for k, (t, inside, gone) in enumerate(mine) if k not in same and not gone and (inside or not found)]
        assert got[page][0] == " ".join(kept) and got[page][1:] == (len(same), len(a) - len(same) - len(kept)), page


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    stages = {k: f for k, f in corpus_pipeline.STAGES}
    sets = {}
    for r in d.collect():
        w = r.text.lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = classes(near, sets)
    assert sorted(r.doc_id for r in stages["SimHash near-dedup"](spark, d, SF).collect()) == sorted(i for i in sets if want[i] == i)
    mixed = stages["mixing"](spark, d, SF)
    assert mixed.columns == d.columns and mixed.count() == mixing.select(d, queries.domain(), corpus_pipeline.FRACTION, 2, 7, queries.WEIGHTS).agg(F.sum("copies")).first()[0]
    assert stages["language ID"](spark, d.unionByName(docs(spark, [(9, "12", "en", "s")])), SF).count() == d.where("text rlike '\\\\p{L}'").count()
    private = {r.doc_id: (r.text, r.n_chars) for r in stages["PII"](spark, d, SF).collect()}
    assert private == {r.doc_id: (r.text, len(r.text)) for r in pii.replace(d, queries.PII_KEY).collect()}
    tok = bpe.Tokenizer(open(queries.RANKS, "rb").read())
    for r in stages["byte-level BPE"](spark, d, SF).join(d.select("doc_id", "text"), "doc_id").collect():
        assert tok.decode(np.array(r.ids)) == r.text.encode() and r.n_tokens == len(r.ids)
    assert out.count() > 0 and out.where("n_tokens <> size(ids)").count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", None, "s"), (None, "the cat", "en", None), (3, "the cat and the dog", "en", "s"), (3, "the cat and the dog", "en", "s"), (4, "the cat and the dog", None, "s"), (5, "word " * 50_000, "en", "s")]
    d = docs(spark, rows).withColumn("copies", F.lit("clash")).withColumn("ids", F.lit(1)).withColumn("sig", F.lit(2))
    got = {k: f(spark, d, SF) for k, f in corpus_pipeline.STAGES}
    ids = {k: sorted(-1 if r.doc_id is None else r.doc_id for r in x.collect()) for k, x in got.items()}
    assert ids == {"language ID": [-1, 3, 3, 4, 5], "SimHash near-dedup": [-1, 1, 3, 3, 5], "PII": [-1, 1, 2, 3, 3, 4, 5], "mixing": ids["mixing"], "byte-level BPE": [-1, 1, 2, 3, 3, 4, 5]}
    assert all(x.columns == list(corpus_pipeline.COLUMNS) for k, x in got.items() if k != "byte-level BPE")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, d.limit(0), SF).count() == 0

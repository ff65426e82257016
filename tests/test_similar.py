"""Similarity, containment and the cascade against brute force."""

import random

from gridrecon.operators import match

ITEMS = "doc long, ord int, item_key string, quantity double, unit string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def names(rng, n):
    out = ["", "a", "ab"]
    while len(out) < n:
        w = "".join(rng.choice("abcdefgh設置工") for _ in range(rng.randrange(1, 25)))
        out.append(w)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w))
            w = w[:i] + rng.choice(["", "x", w[i] * 2]) + w[i + 1 :] or "z"
            out.append(w)
    return out


def test_similar(spark):
    rng = random.Random(6)
    l, r = [(d, x) for d in (1, 2) for x in names(rng, 120)], [(d, x) for d in (1, 3) for x in names(rng, 120)]
    r += l[5:60]
    ls, rs = spark.createDataFrame(l, "doc long, name string"), spark.createDataFrame(r, "doc long, name string")
    for least in (80.0, 50.0, 1e-6):
        got = {(x.doc, x.name, x.other): x.ratio for x in match.similar(ls, rs, least).collect()}
        want = {(d, a, b): ratio(a, b) for d, a in l for e, b in r if d == e and ratio(a, b) >= least}
        assert got == want
    assert match.similar(ls.limit(0), rs).count() == 0


def test_nearest_and_containing(spark):
    rng = random.Random(9)
    l = [(1, i, x) for i, x in enumerate(names(rng, 80) + ["ωψ", "ωψ"])] + [(7, 1, "abc")]
    r = [(1, i, x) for i, x in enumerate(names(rng, 90))]
    got = {(x.doc, x.req_ord): x.est_ord for x in match.nearest(spark.createDataFrame(l, "doc long, req_ord int, name string"), spark.createDataFrame(r, "doc long, est_ord int, other string")).collect()}
    assert got == {(d, i): max(r, key=lambda e: (ratio(x, e[2]), -e[1]))[1] for d, i, x in l if d == 1}
    tokens = lambda x: sorted({x[i : i + 2] for i in range(len(x) - 1)})
    asked = spark.createDataFrame([(d, i, tokens(x)) for d, i, x in l], "doc long, req_ord int, tokens array<string>")
    got = {(x.doc, x.req_ord): x.est_ord for x in match.containing(asked, spark.createDataFrame(r, "doc long, est_ord int, other string")).collect()}
    want = {(d, i): next((e for _, e, y in r if all(t in y for t in tokens(x))), None) for d, i, x in l if d == 1}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_cascade_of_each_kind(spark):
    req = [(1, 1, "掘削工", 1.0, "m"), (1, 2, "掘削", 1.0, "m"), (1, 3, "掘削工事", 1.0, "m"), (1, 4, "舗", 1.0, "m"), (1, 5, "装x工y路", 1.0, "m"), (1, 6, "ω-ψ", 1.0, "m"), (2, 1, "掘削工", 1.0, "m"), (1, 7, "舗装工", 2.0, "m")]
    est = [(1, 1, "盛土工", 1.0, "m"), (1, 2, "掘削工", 1.0, "m"), (1, 3, "掘削工", 9.0, "m"), (1, 4, "舗装工", 1.0, "m"), (3, 1, "掘削工", 1.0, "m")]
    got = {(r.doc, r.req_ord): (r.est_ord, r.how, r.status) for r in match.cascade(spark.createDataFrame(req, ITEMS), spark.createDataFrame(est, ITEMS)).collect()}
    assert got[1, 1] == (2, "exact", "OK") and got[1, 7] == (4, "exact", "QUANTITY_MISMATCH")
    assert got[1, 2] == (2, "all", "NAME_MISMATCH") and got[1, 3] == (2, "any", "NAME_MISMATCH")
    assert got[1, 4] == (1, "all", "NAME_MISMATCH")  # no tokens: the first row
    assert got[1, 5] == (4, "missing", "MISSING") and got[1, 6] == (1, "missing", "MISSING") and got[2, 1] == (None, "missing", "MISSING")

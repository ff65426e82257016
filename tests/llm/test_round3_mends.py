"""Forms that run out of surrogates; pages that are copies of each other."""

import re
from collections import defaultdict

import pytest

from gridrecon.llm import html, pii

PAGES = "page_id long, url string, html string"


def one_to_one(rows):
    """{entity: surrogate} of dictionary rows; every entity has one, no two share one, none keeps its own."""
    of = {}
    for r in rows:
        assert of.setdefault(r.ent, r.replacement) == r.replacement != r.ent
    assert len(set(of.values())) == len(of)
    return of


def ents(spark, texts, given=False):
    return spark.createDataFrame([(t, given) for t in texts], "ent string, is_given boolean")


def test_short_mailboxes_grow(spark):
    texts = [f"{i}@{j}.com" for i in range(10) for j in range(10)]
    of = one_to_one(pii.dictionary(ents(spark, texts), "k").collect())
    assert set(of) == set(texts) and not set(of) & set(of.values())
    assert all(re.fullmatch(pii.KINDS["email"].split("++")[0].replace(r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]", r"[\w.%+-]+") + r"@\d\.com", v) for v in of.values())


def test_a_full_range_of_addresses_changes_places(spark):
    texts = [f"192.168.{i}.{j}" for i in range(256) for j in range(256)]
    e = spark.range(65536).selectExpr("concat('192.168.', id div 256, '.', id % 256) as ent", "false as is_given")
    e = e.unionByName(ents(spark, ["10.1.2.3", "8.8.8.8"]))
    of = one_to_one(pii.dictionary(e, "k", draws=3).collect())
    assert set(texts) | {"10.1.2.3", "8.8.8.8"} == set(of)
    assert all(v.startswith("192.168.") for k, v in of.items() if k.startswith("192.168.")) and of["10.1.2.3"].startswith("10.") and not of["8.8.8.8"].startswith("192.168.")


def test_many_short_names(spark):
    n = 200_000
    e = spark.range(n).selectExpr("concat('Mr. ', initcap(translate(lpad(conv(id, 10, 16), 5, '0'), '0123456789ABCDEF', 'abdefghiklmnoprs'))) as ent", "true as is_given")
    d = pii.dictionary(e, "k")
    got = d.selectExpr("count(*) n", "count(distinct ent) e", "count(distinct replacement) r", "count_if(ent = replacement) same", "count_if(not replacement rlike '^Mr[.] [A-Z][a-z]+$') odd").first()
    assert (got.n, got.e, got.r, got.same, got.odd) == (n, n, n, 0, 0)


def test_full_forms_in_texts(spark):
    """The whole way: a text with every address of a small form, in one document and over several."""
    every = [f"{i}@{j}.de" for i in range(10) for j in range(10)]
    d = spark.createDataFrame([(0, " ".join(every)), (1, every[7] + " and " + every[7]), (2, None), (3, "Mr. A " * 3)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace(d, "k").collect()}
    new = got[0].split()
    assert len(set(new)) == 100 and not set(new) & set(every) and got[1] == f"{new[7]} and {new[7]}" and got[2] is None


# --- pages -----------------------------------------------------------------------------------------------------------------


def text_of(spark, pages):
    got = defaultdict(list)
    for r in html.extract(spark.createDataFrame(pages, PAGES)).collect():
        got[r.page_id].append((r.text, r.n_shared))
    return got


def page(*lines):
    return "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"


def test_equal_and_nearly_equal_pages_keep_their_text(spark):
    story = [f"sentence {i} of a story that is told twice" for i in range(12)]
    pages = [
        (1, "http://h/x/1", page(*story)), (2, "http://h/x/2", page(*story)),  # a mirror
        (3, "http://n/x/1", page("Monday", *story)), (4, "http://n/x/2", page("Tuesday", *story)), (5, "http://n/x/3", page("Friday", *story)),  # fetched again
        (6, "http://e/", ""), (7, "http://e/a", ""),
        (8, "http://s/a", page("Menu", "x" * 40)), (9, "http://s/b", page("Menu", "y" * 40)),  # the bulk stays: template goes
        (10, "http://p/a", page("Menu of a site", "x" * 9)), (11, "http://p/b", page("Menu of a site", "y" * 9)),  # two pages only: it may be text
    ]
    got = text_of(spark, pages)
    assert got[1] == got[2] == [(" ".join(story), 0)]
    assert got[3] == [("Monday " + " ".join(story), 0)] and got[5] == [("Friday " + " ".join(story), 0)] and got[6] == [("", 0)]
    assert got[8] == [("x" * 40, 1)] and got[9] == [("y" * 40, 1)]
    assert got[10] == [("Menu of a site " + "x" * 9, 0)]


def test_a_third_page_tells_template(spark):
    pages = [(i, f"http://h/{c}", page("Menu of a long-winded site", c * 9)) for i, c in enumerate("xyz")]
    assert text_of(spark, pages) == {i: [(c * 9, 1)] for i, c in enumerate("xyz")}
    # the same page thrice is one page
    pages = [(i, f"http://h/{c}", page("Menu of a long-winded site", "x" * 9)) for i, c in enumerate("xxy")] + [(9, "http://h/z", page("Menu of a long-winded site", "z" * 9))]
    assert len(text_of(spark, pages)) == 4


def test_only_the_aligned_line_goes(spark):
    pages = [(1, "http://h/a", page("Menu", "a" * 30, "Menu")), (2, "http://h/b", page("Menu", "b" * 30))]
    assert text_of(spark, pages)[1] == [("a" * 30 + " Menu", 1)] or text_of(spark, pages)[1] == [("Menu " + "a" * 30, 1)]


@pytest.mark.parametrize("found", [True, False])
def test_template(found):
    got = [(False, False, 10), (True, False, 99), (False, True, 5), (False, False, 90)]
    assert html.template(got, found, [0, 1, 2]) == ([0, 2], True)
    assert html.template(got, found, [0, 1, 2, 3]) == (([0, 2, 3], True) if found else ([2], True))
    assert html.template(got, found, [2, 3]) == ([2, 3], found)


def test_clashing_columns_and_repeats(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1, "http://h/a", page("a"))] * 2 + [(None, "http://h/a", page("b")), (1, "http://h/a", page("c"))], PAGES)
    for c in ("h", "host", "path", "shared", "found", "at", "hash", "sure"):
        d = d.withColumn(c, F.lit("clash"))
    assert sorted(r.text for r in html.extract(d).collect()) == ["a", "a", "b", "c"]

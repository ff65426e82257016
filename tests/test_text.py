import pytest
from pyspark.sql import functions as F

from gridrecon.functions import rules, text


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_units(spark):
    assert apply(spark, text.unit, ["m", "ｍ", "t", "ｔ", "kg", "ｋｇ", "m2", "m²", "㎡", " ", None, "リットル"]) == ["m", "m", "t", "t", "kg", "kg", "㎡", "㎡", "㎡", "", "", "l"]


def test_names(spark):
    got = apply(spark, text.name, ["ﾌﾟﾚｰﾄ", "ＡＢＣ　１", "a + b", "第1号側溝", "舗装工当り", "1.5", None, ""])
    assert got == ["プレート", "abc1", "ab", "側溝", "舗装工", "15", "", ""]
    assert apply(spark, text.item_name, ["A| |b", "A"]) == ["a|b", "a"]


def test_tokens(spark):
    assert apply(spark, text.tokens, ["ab12", "x", None]) == [["12", "ab", "b1"], [], []]


def test_references(spark):
    assert apply(spark, text.ref_key, ["内1号", "単 3 号", "第3号明", "明3号", "内1号-2", None, "x"]) == ["内:1", "単:3", "明:3", "明:3", "内:1", "", "x"]
    assert apply(spark, text.title_ref_key, ["内1号-2"]) == ["内1号-2"]
    assert apply(spark, text.is_reference, ["内1号", "内-1号", "内１号", "計", None]) == [True, True, True, False, False]


def test_numbers(spark):
    assert apply(spark, text.quantity, ["1,234", "1.2.3", "１２", "x", None]) == [1234.0, 0.0, 12.0, 0.0, 0.0]
    assert apply(spark, text.amount, ["1,234.5", "nan", "1_000", "", None]) == [1234.5, 0.0, 0.0, 0.0, 0.0]
    assert apply(spark, text.quantity_text, ["1,200.50", "100", "7.0", None]) == ["1200.5", "100", "7", ""]
    df = spark.createDataFrame([("1", None, ".5"), ("0", None, "0.06"), ("6", "x", None), ("1", "25", "3")], "w string, l string, r string")
    assert [r.y for r in df.select(text.split_quantity(F.col("w"), F.col("l"), F.col("r")).alias("y")).collect()] == [1.5, 0.06, 6.0, 1.25]


def test_levels(spark):
    assert apply(spark, text.level, ["　　a　b", "a", None]) == [2, 0, 0]
    assert apply(spark, text.level_total, ["　　a　b"]) == [3]
    assert apply(spark, text.dotted_level, ["・a", " ・・b", "・・・c", "・・・・d", "＊e", None]) == [1, 2, 3, 0, 0, 0]


@pytest.mark.parametrize(
    "req, est, differs",
    [(None, None, True), (None, 1.0, False), (1.0, None, True), (0.0, None, False), (1.0, 1.0009, False), (1.0, 1.0011, True)],
)
def test_quantity_rule(spark, req, est, differs):
    df = spark.createDataFrame([(req, est)], "r double, e double")
    assert df.select(rules.quantity_differs(F.col("r"), F.col("e")).alias("d")).first().d is differs


def test_title(spark):
    df = spark.createDataFrame([("側溝 1,000m2当り", "1000", "㎡"), ("側溝 10m当り", "10", "m"), ("側溝", "10", "m"), ("側溝 10m", None, "m")], "t string, q string, u string")
    assert [r.y for r in df.select(text.title_has(F.col("t"), F.col("q"), F.col("u")).alias("y")).collect()] == [True, True, False, False]

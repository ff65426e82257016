"""Requested and estimated items derived from orders: one document per order, the estimate perturbed by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lines of one document in a fixed order.
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, ord, item_key, unit, quantity, ref, price, k (what the perturbation goes by)."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    d = li.join(part, li["l_partkey"] == part["p_partkey"])
    d = d.withColumn("ord", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER)))
    unit = F.element_at(F.array(*map(F.lit, ("m", "m2", "kg", "t", "式"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    return d.select(
        F.col("l_orderkey").alias("doc"), "ord", F.col("p_name").alias("item_key"), unit.alias("unit"), F.col("l_quantity").alias("quantity"),
        F.concat(F.lit("内"), F.col("l_suppkey").cast("string"), F.lit("号")).alias("ref"), F.col("l_extendedprice").alias("price"), (F.col("l_orderkey") * 31 + F.col("ord") * 17).alias("k"),
    )


def estimated(req: DataFrame) -> DataFrame:
    """The estimate: some rows changed, some left out, some added; kept and added rows come from one pass over req."""
    k = F.col("k")
    name = F.when(k % 19 == 0, "ヰヱヲ").when(k % 29 == 0, F.concat("item_key", F.lit("甲"))).otherwise(F.col("item_key"))
    wide = F.translate("unit", "mkgt2", "ｍｋｇｔ２")
    unit = F.when(k % 17 == 0, "本").when(k % 11 == 0, wide).otherwise(F.col("unit"))
    qty = F.when(k % 23 == 0, F.lit(None).cast("double")).when(k % 7 == 0, F.col("quantity") + 1).otherwise(F.col("quantity"))
    kept = F.when(k % 13 != 0, F.struct(F.col("ord").alias("o"), name.alias("item_key"), unit.alias("unit"), qty.alias("quantity")))
    added = F.when((F.col("doc") % 10 == 0) & (F.col("ord") == 1), F.struct(F.lit(1000).alias("o"), F.lit("追加工").alias("item_key"), F.lit("式").alias("unit"), F.lit(1.0).alias("quantity")))
    both = req.select("doc", "ref", F.explode(F.filter(F.array(kept, added), lambda x: x.isNotNull())).alias("x")).select("doc", "x.*", "ref")
    return both.withColumn("ord", F.row_number().over(W.partitionBy("doc").orderBy("o"))).drop("o")


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    req = requested(spark, sf_dir)
    return req, estimated(req)

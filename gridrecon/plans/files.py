"""Registered queries over workbook files: the orders written as workbooks, some of them damaged, and read back."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridrecon.plans.catalogue import query
from gridrecon.plans.items import ORDER, table
from gridrecon.sources import xlsx


def _files(spark, sf):
    """(doc, content): of each order a workbook with a sheet of its head and one of its lines; every fiftieth is cut short."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    cell = lambda sheet, row, col, value: F.struct(F.lit(sheet).alias("sheet"), row.cast("int").alias("row"), F.lit(col).alias("col"), value.cast("string").alias("value"))
    head = o.select(F.col("o_orderkey").alias("doc"), F.lit(0).alias("sheet_idx"), F.explode(F.array(cell("表紙", F.lit(1), 1, F.col("o_orderpriority")), cell("表紙", F.lit(3), 28, F.col("o_orderstatus")))).alias("x"))
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER))
    li = li.withColumn("n", n)
    lines = li.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("sheet_idx"), F.explode(F.array(cell("内訳 & 明細", F.col("n") + 1, 2, F.col("l_partkey")), cell("内訳 & 明細", F.col("n") + 1, 5, F.col("l_quantity").cast("int")))).alias("x"))
    books = xlsx.workbooks(head.unionByName(lines).select("doc", "sheet_idx", "x.*"))
    return books.withColumn("content", F.when(F.col("doc").cast("long") % 50 == 0, F.substring("content", 1, 400)).otherwise(F.col("content")))


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS n FROM lineitem),
c AS (SELECT o_orderkey AS doc, '表紙' AS sheet, 0 AS sheet_idx, 1 AS row, 1 AS col, o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, '表紙', 0, 3, 28, o_orderstatus FROM orders
  UNION ALL SELECT l_orderkey, '内訳 & 明細', 1, n + 1, 2, CAST(l_partkey AS VARCHAR) FROM l UNION ALL SELECT l_orderkey, '内訳 & 明細', 1, n + 1, 5, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) FROM l)
SELECT CAST(doc AS VARCHAR) AS doc, sheet, CAST(CASE WHEN doc IN (SELECT o_orderkey FROM orders) OR sheet_idx = 0 THEN sheet_idx ELSE 0 END AS INTEGER) AS sheet_idx, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, value, false AS damaged FROM c WHERE doc % 50 <> 0
UNION ALL SELECT DISTINCT CAST(doc AS VARCHAR), NULL, NULL, NULL, NULL, NULL, true FROM c WHERE doc % 50 = 0""")
def workbook_files(spark, sf):
    return xlsx.parse(_files(spark, sf)).select("doc", "sheet", "sheet_idx", "row", "col", "value", F.col("error").isNotNull().alias("damaged"))

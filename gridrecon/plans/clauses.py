"""Registered queries of the articles' tables: an order's lines are dealt over one to three tables of an article."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridrecon.operators import articles
from gridrecon.plans.catalogue import query
from gridrecon.plans.items import table
from gridrecon.plans.sheets import _LINES, _lines


def _rows(lines, article, at, head, cells):
    """Rows of the tables at (of each document those where its column is not null): the heading as row 0, unless it is None, then its lines."""
    s = lambda xs: F.array(*(F.lit(x).cast("string") if x is None or isinstance(x, str) else x.cast("string") for x in xs))
    own = lines.select("doc", at.cast("int").alias("table_idx"), F.col("n").cast("long").alias("row_idx"), s(cells).alias("cells"))
    if head is not None:
        own = own.unionByName(own.select("doc", "table_idx").distinct().select("doc", "table_idx", F.lit(0).cast("long").alias("row_idx"), s(head).alias("cells")))
    return own.where("table_idx is not null").select("doc", F.lit(article).alias("article"), "table_idx", "row_idx", "cells")


@query(f"""WITH {_LINES} SELECT doc, n AS row_idx, CASE WHEN n % 2 = 0 THEN '高炉BB' WHEN n % 5 <> 0 THEN '普通N' ELSE '' END AS kind, p_type AS spec, CAST(q AS VARCHAR) AS ratio, '' AS cement
FROM l WHERE n % 3 <> 0""")
def concrete_rows(spark, sf):
    n = F.col("n")
    head = ["", "適用 工種", "セメント\n種類", "高炉BB", "普通N", "規格", "最大水セメント比", "最小セメント使用量"]
    cells = [F.when(n % 3 != 0, "■").otherwise("□"), F.col("p_name"), None, F.when(n % 2 == 0, "■"), F.when(n % 5 != 0, "\n■").otherwise("□"), F.col("p_type"), F.col("q"), None]
    out = articles.concrete(_rows(_lines(spark, sf), "第4条", F.lit(0), head, cells))
    return out.select("doc", "row_idx", F.col("セメント種類").alias("kind"), F.col("規格").alias("spec"), F.col("最大水セメント比").alias("ratio"), F.col("最小セメント使用量").alias("cement"))


@query(f"WITH {_LINES} SELECT doc, n AS row_idx, p_name AS name, p_type AS form, CAST(q AS VARCHAR) AS work, '' AS note FROM l WHERE doc % 3 <> 0 AND doc % 2 = 0 AND n % 4 <> 0")
def other_material_rows(spark, sf):
    """A table with the same heading before the question does not count; documents without the question have no rows."""
    li, head = _lines(spark, sf), ["材料名", "規格・寸法\n・材質", "適用工種", "備考"]
    filled = lambda c: F.when(F.col("n") % 4 != 0, c.cast("string")).otherwise(" ")
    cells = [filled(F.col("p_name")), filled(F.col("p_type")), filled(F.col("q")), None]
    before = _rows(li, "第4条", F.lit(0), head, cells)
    asked = _rows(li, "第4条", F.when(F.col("doc") % 3 != 0, 1), None, ["その他の使用材料の有無", "有"])
    after = _rows(li, "第4条", F.when(F.col("doc") % 2 == 0, 2), head, cells)
    out = articles.other_materials(before.unionByName(asked).unionByName(after))
    return out.select("doc", "row_idx", F.col("材料名").alias("name"), F.col("規格・寸法・材質").alias("form"), F.col("適用工種").alias("work"), F.col("備考").alias("note"))


@query(f"""WITH {_LINES}, t AS (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY n % 3) AS k FROM l)
SELECT doc, n AS row_idx, CASE k WHEN 1 THEN '任意仮設' ELSE '指定仮設' END AS section, p_name AS work, p_type AS kind, CAST(q AS VARCHAR) AS quantity FROM t WHERE k < 3 AND n % 5 <> 0""")
def temporary_work_rows(spark, sf):
    """A third table with the six headings is left out, as are rows of blank cells."""
    filled = lambda c: F.when(F.col("n") % 5 != 0, c.cast("string")).otherwise(" ")
    cells = [filled(F.col("p_name")), filled(F.col("p_type")), None, None, filled(F.col("q")), None]
    out = articles.temporary_works(_rows(_lines(spark, sf), "第10条", F.col("n") % 3, list(articles.TEMPORARY), cells))
    return out.select("doc", "row_idx", "section", F.col("工種").alias("work"), F.col("種別").alias("kind"), F.col("数量").alias("quantity"))


@query(f"""WITH {_LINES}, c AS (SELECT doc, arg_min(p_name, (n % 2) * 1000000 + n) AS detail FROM l WHERE n % 3 = 0 GROUP BY doc)
SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 THEN '有' ELSE '無' END AS labour, CASE WHEN o_orderkey % 3 = 0 THEN '有' ELSE '無' END AS scattered,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS method, detail FROM orders LEFT JOIN c ON doc = o_orderkey""")
def article_14_fields(spark, sf):
    """Every fifth order leaves the first answer blank: what follows then stands for it and says nothing."""
    k, lit = F.col("o_orderkey"), F.lit
    answer = lambda yes: F.when(yes, "有").otherwise("無")
    said = F.concat(
        lit("労働者確保に要する間接費の実績変更\n対象の有無 "), F.when(k % 5 != 0, answer(k % 2 == 0)).otherwise(""),
        lit("\n施工箇所が点在する工事の積算方法 "), F.col("o_orderpriority"), lit("\n 対象の有無 "), answer(k % 3 == 0), lit("\n"),
    )
    texts = table(spark, sf, "orders").select(k.alias("doc"), lit("第14条").alias("article"), said.alias("text"))
    rows = _rows(_lines(spark, sf), "第14条", F.col("n") % 2, None, [F.when(F.col("n") % 3 == 0, " ○ ").otherwise("△"), F.col("p_name")])
    return articles.article_14(texts, rows).select("doc", "labour", "scattered", "method", "detail")

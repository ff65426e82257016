"""Articles of a specification, estimate fields and management fees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridrecon.functions import text

# Labels of the estimate fields.
LABELS = ("工種区分", "工事中止日数", "単価地区", "単価使用年月", "歩掛適用年月", "総日数")


def article_spans(words: DataFrame) -> DataFrame:
    """(doc, article, start_page, end_page): an article starts on the first page with its heading at the upper left.

    words: doc, page, text, x0, top. It ends before the next article's start (null: the last); by article number.
    """
    no = F.regexp_extract(F.translate("text", "０１２３４５６７８９", "0123456789"), "^第(\\d+)条", 1)
    heads = words.where((F.col("x0") < 100) & (F.col("top") < 150)).withColumn("article", no).where("article <> ''")
    first = heads.groupBy("doc", F.col("article").cast("int").alias("article")).agg(F.min("page").alias("start_page"))
    w = W.partitionBy("doc").orderBy("article")
    return first.withColumn("end_page", F.lead("start_page").over(w))


def article_pages(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """pages (doc, page, ...) with the article whose span they lie in: a range join within a document."""
    on = (spans["doc"] == pages["doc"]) & (pages["page"] >= spans["start_page"]) & (spans["end_page"].isNull() | (pages["page"] < spans["end_page"]))
    return pages.join(spans, on).select(pages["*"], spans["article"])


def article_text(pages: DataFrame) -> DataFrame:
    """Text of each article, its pages in order without a break."""
    return pages.groupBy("doc", "article").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "").alias("text"))


def estimate_fields(page_text: Column) -> list[Column]:
    """The six fields of an estimate's reference page; null where not found.

    Labels may be spaced out. Most fields are the word behind the label; of days the first number behind it that 日
    follows; of months year and month, or else the word; the total is the first 日間 of the page, its digits as written.
    """
    t = F.trim(F.regexp_replace(F.coalesce(page_text, F.lit("")), "(?U)\\s+", " "))

    def label(i: int) -> str:
        return " *".join(LABELS[i])

    def found(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, group), F.lit(""))

    def digits(x: Column) -> Column:
        return F.translate(x, "０１２３４５６７８９", "0123456789")

    def word(i: int) -> Column:
        return found(f"{label(i)} *[:：]? *([^ ]+)")

    def month(i: int) -> Column:
        p = f"{label(i)} *[:：]? *([0-9０-９]{{4}})年 *([0-9０-９]{{1,2}})月"
        return F.coalesce(F.concat(digits(found(p)), F.lit("年 "), digits(found(p, 2)), F.lit("月")), word(i))

    days = F.concat(digits(found(f"{label(1)}.*?([0-9０-９]+) *日")), F.lit("日"))
    total = F.concat(found("([0-9０-９]+) *日 *間"), F.lit("日間"))
    return [c.alias(k) for k, c in zip(LABELS, (word(0), days, word(2), month(3), month(4), total))]


def checked_rows(rows: DataFrame, first: str) -> DataFrame:
    """Rows of a table whose first cell is ticked."""
    return rows.where(F.contains(first, F.lit("■")))


def fee_rows(rows: DataFrame, note: str) -> DataFrame:
    """Rows with a management fee category other than none; category is added."""
    c = F.regexp_extract(F.coalesce(note, F.lit("")), "管理費区分\\s*[:：]\\s*(\\S+)", 1)
    return rows.withColumn("category", c).where((F.col("category") != "") & ~F.col("category").isin("0", "０", "O", "Ｏ", "o", "ｏ"))


def presence(x: Column) -> Column:
    """有 or 無; anything without 有 is 無."""
    return F.when(F.contains(F.coalesce(x, F.lit("")), F.lit("有")), "有").otherwise("無")

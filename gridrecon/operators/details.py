"""Subtables of sheets to detail rows and items: a general name takes in the detail row below it. by: columns of one sheet; order: its row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridrecon.functions import text
from gridrecon.operators.blocks import numbered, opened
from gridrecon.operators.grid import over

#: Columns of a sheet's rows, as text.
FIELDS = ("general", "name", "unit", "quantity", "price", "amount", "note")
# Cells of a header that is repeated inside a subtable.
NAMES, UNIT, QUANTITY, PRICE, AMOUNT = ("名称", "名称／規格", "名称/規格", "規格"), "単位", "数量", "単価", "金額"
SPACED_NAME, SPACED_AMOUNT = "規　格", "金　額"


def is_header_row(name: Column, unit: Column, quantity: Column, price: Column, amount: Column) -> Column:
    """Whether a row repeats a header: one of its cells is a header's word."""
    own = text.compact(name).isin(*NAMES) | (text.compact(unit) == UNIT) | (text.compact(quantity) == QUANTITY)
    own = own | (text.compact(price) == PRICE) | (text.compact(amount) == AMOUNT)
    return own | F.contains(name, F.lit(SPACED_NAME)) | F.contains(amount, F.lit(SPACED_AMOUNT))


def sheet_details(rows: DataFrame, by: list, order: list, reference: Column, total: Column, skip: int = 3) -> DataFrame:
    """by, ref, line, name, unit, quantity, price, amount, note: the detail rows of a sheet's subtables, blank fields empty.

    rows: by, order and FIELDS. A subtable begins skip rows below its reference (null: the row has none) and ends before a total or another
    reference. A row of only a general name takes in the next one if that has more than a general name: names are put together, the
    note stays. A row taken in is not looked at again, so a total taken in ends nothing and a general name taken in takes in none. Rows
    that repeat the header and rows without name, quantity, price and amount go. line counts what is left of the subtable; the k-th
    subtable of one reference with rows is called ref-k. A subtable ends at the next one's opening at the latest. by: no nulls.

    Which row is taken in depends on the one before, but only an unbroken run of taking rows matters, so a row is taken in where the
    run above it is of odd length: counting replaces the walk, and a sheet needs one sort.
    """
    w = over(by, order)
    more = ("name", "unit", "quantity", "price", "amount")
    df = rows.withColumns({c: text.cell(F.col(c)) for c in FIELDS})
    lone = (F.col("general") != "") & (F.concat("name", "unit", "quantity", "amount") == "")
    below = F.lead(F.struct(*more)).over(w)
    df = df.withColumn("_below", below).withColumn("_joins", lone & F.coalesce(F.concat(*(F.col("_below")[c] for c in more)) != "", F.lit(False)))
    df = opened(df, by, order, reference, total, skip).withColumn("_takes", F.col("_joins") & ~F.col("_stop"))
    at = over([*by, "_start"], ["_n"])
    fresh = F.max(F.when(~F.col("_takes"), F.col("_n"))).over(at.rowsBetween(W.unboundedPreceding, -1))
    run = F.col("_n") - 1 - F.coalesce(fresh, F.col("_start") + (skip - 1))
    df = df.withColumn("_taken", run % 2 == 1).withColumn("_end", (F.col("_stop") & ~F.col("_taken")).cast("long"))
    df = df.withColumn("_ended", F.sum("_end").over(at.rowsBetween(W.unboundedPreceding, W.currentRow))).where("_ended = 0 and not _taken")
    own = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("general"))
    joined = F.concat_ws(" ", "general", F.nullif(F.col("_below")["name"], F.lit("")))
    value = {c: F.when(F.col("_takes"), F.col("_below")[c]).otherwise(F.col(c)) for c in more[1:]}
    df = df.withColumns({"name": F.when(F.col("_takes"), joined).otherwise(own), **value})
    df = df.where((F.concat("name", "quantity", "price", "amount") != "") & ~is_header_row(*(F.col(c) for c in more)))
    df = df.withColumn("line", F.row_number().over(at)).withColumn("ref", numbered(by))
    return df.select(*by, "ref", "line", *more, "note")


def items(details: DataFrame, by: list) -> DataFrame:
    """by, ref, ord, item_key, unit, quantity: the named detail rows as items; ord counts unnamed ones too."""
    return details.where("name <> ''").select(*by, "ref", F.col("line").alias("ord"), F.col("name").alias("item_key"), "unit", text.quantity(F.col("quantity")).alias("quantity"))


def nested(details: DataFrame, by: list, title: str | None = None) -> DataFrame:
    """One row per subtable: by, ref, row_count, rows (array of its detail rows in order), and the title's column where there is one.

    A subtable's rows meet in one array; a sheet of a workbook has at most 1,048,576 rows.
    """
    cols = [c for c in details.columns if c not in (*by, "ref", title)]
    extra = [F.first(title, ignorenulls=True).alias(title)] if title else []
    return details.groupBy(*by, "ref").agg(F.count("*").alias("row_count"), F.array_sort(F.collect_list(F.struct(*cols))).alias("rows"), *extra)

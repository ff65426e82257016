"""Ordered cells to logical rows: segmentation by running sums, fills, cuts. by: partition columns; order: order columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridrecon.functions import text

_UP = (W.unboundedPreceding, W.currentRow)


def over(by: list, order: list):
    return W.partitionBy(*by).orderBy(*order)


def forward_fill(c: Column, by: list, order: list) -> Column:
    return F.last(c, ignorenulls=True).over(over(by, order).rowsBetween(*_UP))


def lookahead_fill(c: Column, by: list, order: list, rows: int = 4) -> Column:
    """c, or its first value in the next rows."""
    return F.coalesce(c, F.first(c, ignorenulls=True).over(over(by, order).rowsBetween(1, rows)))


def named_rows(rows: DataFrame, by: list, order: list, named: Column, total: Column, fields: list[str], ahead: int = 4) -> DataFrame:
    """The named rows, blank fields filled from the next rows (at most ahead of them) before the next name or total."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    df = rows.withColumn("_named", yes(named)).withColumn("_total", yes(total))
    df = df.withColumn("_group", segment(F.col("_named") | F.col("_total"), by, order))
    w = over([*by, "_group"], order).rowsBetween(0, ahead)
    filled = {c: F.first(F.nullif(F.col(c).cast("string"), F.lit("")), ignorenulls=True).over(w) for c in fields}
    return df.withColumns(filled).where("_named and not _total").drop("_named", "_total", "_group")


def segment(opens: Column, by: list, order: list) -> Column:
    """Number of rows so far that open a segment."""
    return F.sum(F.coalesce(opens, F.lit(False)).cast("long")).over(over(by, order).rowsBetween(*_UP))


def segment_after(ends: Column, by: list, order: list) -> Column:
    """Segment number where a segment ends with its terminator."""
    w = over(by, order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.coalesce(ends, F.lit(False)).cast("long")).over(w), F.lit(0))


def before_marker(marker: Column, by: list, order: list) -> Column:
    """Whether no row up to and including this one is a marker: the part kept when a stop sign ends a document."""
    return segment(marker, by, order) == 0


def nearest_before(marker: Column, value: Column, by: list, order: list) -> Column:
    w = over(by, order).rowsBetween(W.unboundedPreceding, -1)
    return F.last(F.when(marker, value), ignorenulls=True).over(w)


def nearest_after(marker: Column, value: Column, by: list, order: list) -> Column:
    return F.first(F.when(marker, value), ignorenulls=True).over(over(by, order).rowsBetween(0, W.unboundedFollowing))


def repeat_suffix(ref: str, by: list, order: list) -> Column:
    """ref, with -k behind its k-th occurrence from the second on."""
    n = F.row_number().over(W.partitionBy(*by, ref).orderBy(*order))
    return F.when(n == 1, F.col(ref)).otherwise(F.concat(F.col(ref), F.lit("-"), n.cast("string")))


def pair_rows(rows: DataFrame, by: list, order: list, name: Column, quantity: Column, unit: Column) -> DataFrame:
    """Rows with a name open an item; rows with only a quantity or unit complete it if it has no quantity yet."""
    named = F.coalesce(F.trim(name) != "", F.lit(False))
    df = rows.withColumn("_q", F.coalesce(quantity, F.lit(0.0))).withColumn("_u", F.nullif(F.trim(unit), F.lit(""))).withColumn("_name", name)
    df = df.withColumn("_item", segment(named, by, order)).where("_item > 0").withColumn("_at", F.row_number().over(over([*by, "_item"], order)))
    return df.groupBy(*by, "_item").agg(
        F.min_by("_name", "_at").alias("item_name"),
        F.coalesce(F.min_by("_q", F.when(F.col("_q") > 0, F.col("_at"))), F.lit(0.0)).alias("quantity"),
        F.min_by("_u", F.when(F.col("_u").isNotNull(), F.col("_at"))).alias("unit"),
    ).withColumnRenamed("_item", "item")


def dotted_blocks(rows: DataFrame, by: list, order: list, cell: Column) -> DataFrame:
    """Blocks of a dotted list: a three-dot row opens one, any dotted or blank row ends it; blocks with rows are numbered."""
    dots = text.dotted_level(cell)
    blank = F.trim(F.coalesce(cell, F.lit(""))) == ""
    df = rows.withColumn("_open", dots == 3).withColumn("_edge", (dots > 0) | blank)
    df = df.withColumn("_part", segment(F.col("_edge"), by, order)).withColumn("_in", F.max(F.col("_open").cast("int")).over(W.partitionBy(*by, "_part")))
    df = df.where((F.col("_in") == 1) & ~F.col("_edge") & ~F.trim(cell).rlike("^[*＊]"))
    block = F.dense_rank().over(over(by, ["_part"]))
    return df.withColumn("ref", F.concat(F.lit("内"), block.cast("string"), F.lit("号"))).drop("_open", "_edge", "_part", "_in")


def column_map(header: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(doc, logical, col): the first header cell that contains a synonym of each logical column.

    header: doc, col, value; synonyms: logical, pattern, priority - a vocabulary written in code, so it is broadcast.
    """
    hits = header.join(F.broadcast(synonyms), F.contains(text.compact(F.col("value")), F.col("pattern")))
    return hits.groupBy("doc", "logical").agg(F.min(F.struct("priority", "col")).alias("x")).select("doc", "logical", F.col("x.col").alias("col"))


def hair_border_rows(cells: DataFrame, by: list) -> DataFrame:
    """Logical rows of a bordered sheet: a dotted top border opens one, a row with a solid border ends the table.

    cells: by, row, col, value, b_top, b_bottom. Returns by, logical, col, value (non-blank cells joined by a space).
    """
    solid, dotted = ("thin", "medium", "thick", "double"), ("hair", "dotted", "dashed", "dashDot", "dashDotDot")
    per_row = cells.groupBy(*by, "row").agg(
        F.bool_or(F.coalesce(F.col("b_top").isin(*solid) | F.col("b_bottom").isin(*solid), F.lit(False))).alias("solid"),
        F.bool_or(F.coalesce(F.col("b_top").isin(*dotted), F.lit(False))).alias("dotted"),
    )
    per_row = per_row.withColumn("_stop", segment(F.col("solid"), by, ["row"])).where("_stop = 0")
    per_row = per_row.withColumn("logical", segment(F.col("dotted"), by, ["row"])).select(*by, "row", "logical")
    joined = cells.join(per_row, [*by, "row"]).withColumn("value", text.clean_cell(F.col("value"))).where("value <> ''")
    rows = joined.groupBy(*by, "logical", "col").agg(F.sort_array(F.collect_list(F.struct("row", "value"))).alias("x"))
    return rows.select(*by, "logical", "col", F.array_join("x.value", " ").alias("value"))


def rowspan_merge(rows: DataFrame, by: list, order: list, key: str, others: list[str]) -> DataFrame:
    """Rows of which only key is filled take the other values of the next row, which goes."""
    only = F.col(key).isNotNull()
    for c in others:
        only = only & F.col(c).isNull()
    w = over(by, order)
    df = rows.withColumn("_only", only).withColumn("_used", F.coalesce(F.lag("_only").over(w), F.lit(False)))
    for c in others:
        df = df.withColumn(c, F.when(F.col("_only"), F.lead(c).over(w)).otherwise(F.col(c)))
    return df.where(~F.col("_used") | F.col("_only")).drop("_only", "_used")

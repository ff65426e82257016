"""Subtables of pages and sheets: the rows that open, end, number and title them. by: columns of one table; order: its row order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridrecon.functions import text
from gridrecon.operators import jumps
from gridrecon.operators.grid import over, segment, segment_after
from gridrecon.operators.stored import has_group_over


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def table_blocks(rows: DataFrame, by: list, order: list, reference: Column, header: Column, total: Column, ahead: int = 3) -> DataFrame:
    """rows with block: number of the row whose reference opened the subtable they lie in, its total included (null: none).

    A reference opens one if a header follows in the next rows; a total closes it; references inside are not looked at.
    Up to the next total only the first able reference counts, so counting totals finds all blocks without state.
    """
    w = over(by, order)
    df = rows.withColumn("_n", F.row_number().over(w).cast("long")).withColumn("_head", _yes(header).cast("int"))
    able = _yes(reference) & (F.coalesce(F.max("_head").over(w.rowsBetween(1, ahead)), F.lit(0)) == 1)
    df = df.withColumn("_able", able).withColumn("_part", segment_after(_yes(total), by, order))
    df = df.withColumn("_first", F.min(F.when(F.col("_able"), F.col("_n"))).over(W.partitionBy(*by, "_part")))
    return df.withColumn("block", F.when(F.col("_n") >= F.col("_first"), F.col("_first"))).drop("_n", "_head", "_able", "_part", "_first")


#: Marks of a table that one task may walk through; a larger table goes by pointers.
LARGEST = 1_000_000


def spaced(marks: DataFrame, by: list, at: str, gap: int, largest: int = LARGEST, parts: int | None = None) -> DataFrame:
    """Of the marks of each table, in order, those at least gap rows after the last one taken.

    Which mark counts depends on the one taken before: sorted marks stream through Arrow, one position held at a time, or, where a
    table has more than largest marks, pointers double.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, free = None, 0
        for b in batches:
            taken = []
            for *key, n in zip(*(c.to_pylist() for c in b.columns)):
                taken.append(ok := key != last or n >= free)
                if ok:
                    last, free = key, n + gap
            yield b.filter(pa.array(taken, pa.bool_()))

    marks = marks.select(*by, at)
    if has_group_over(marks, by, largest):
        return jumps.spaced(marks, by, at, gap, parts=parts)
    return marks.repartition(*by).sortWithinPartitions(*by, at).mapInArrow(run, marks.schema)


def sheet_blocks(rows: DataFrame, by: list, order: list, reference: Column, stop: Column, keep: Column, skip: int = 3) -> DataFrame:
    """Kept data rows of a sheet's subtables, with ref: the reference above them, its k-th subtable with rows called ref-k.

    A subtable's data begin skip rows below its reference (null: the row has none) and end before a stop row or another
    reference; references in the rows between open nothing. by: columns without nulls.
    """
    df = opened(rows, by, order, reference, stop, skip).withColumn("_keep", _yes(keep))
    df = df.withColumn("_cut", segment(F.col("_stop"), [*by, "_start"], ["_n"])).where("_cut = 0 and _keep")
    return df.withColumn("ref", numbered(by)).drop("_n", "_stop", "_keep", "_start", "_label", "_cut")


def opened(rows: DataFrame, by: list, order: list, reference: Column, stop: Column, skip: int) -> DataFrame:
    """The rows from skip rows below a sheet's open references on, with _n (place in the sheet), _stop (stop row or reference), and
    _start and _label (place and text) of the open reference above. References fewer than skip rows below an open one open nothing."""
    df = rows.withColumn("_n", F.row_number().over(over(by, order)).cast("long")).withColumn("_ref", reference)
    df = df.withColumn("_stop", _yes(stop) | F.col("_ref").isNotNull())
    opens = spaced(df.where("_ref is not null"), by, "_n", skip).withColumn("_opens", F.lit(True))
    df = df.join(opens, [*by, "_n"], "left")
    up = over(by, ["_n"]).rowsBetween(W.unboundedPreceding, W.currentRow)
    open_row = F.when(F.col("_opens"), F.struct("_n", "_ref"))
    df = df.withColumn("_block", F.last(open_row, ignorenulls=True).over(up)).where("_block is not null and _n >= _block._n + %d" % skip)
    return df.withColumn("_start", F.col("_block._n")).withColumn("_label", F.col("_block._ref")).drop("_ref", "_opens", "_block")


def numbered(by: list) -> Column:
    """_label of opened(), from its second subtable with rows on with its number: ref-2, ref-3."""
    k = F.dense_rank().over(over([*by, "_label"], ["_start"]))
    return F.when(k == 1, F.col("_label")).otherwise(F.concat("_label", F.lit("-"), k.cast("string")))


def table_titles(rows: DataFrame, by: list, order: list, reference: Column, number: Column, sentence: Column, ahead: int = 9) -> DataFrame:
    """Rows with a reference, with title: the last sentence but one (or the only one) since the row of the previous table's
    number, else the first one up to the next number row, else the first of the next rows.

    sentence: text of a row that is one, else null.
    """
    w = over(by, order)
    df = rows.withColumn("_isref", _yes(reference)).withColumn("_s", F.when(~_yes(number), sentence)).withColumn("_part", segment_after(_yes(number), by, order))
    df = df.withColumn("_is", F.col("_s").isNotNull())
    before = F.lag("_s").over(over([*by, "_part", "_is"], order))
    df = df.withColumn("_two", F.when(F.col("_is"), F.struct(F.coalesce(before, F.col("_s")).alias("title"))))
    part = over([*by, "_part"], order)
    above = F.last("_two", ignorenulls=True).over(part.rowsBetween(W.unboundedPreceding, -1))["title"]
    below = F.first("_s", ignorenulls=True).over(part.rowsBetween(1, W.unboundedFollowing))
    near = F.first("_s", ignorenulls=True).over(w.rowsBetween(1, ahead))
    df = df.withColumn("title", F.coalesce(above, below, near)).where("_isref")
    return df.drop("_isref", "_s", "_part", "_is", "_two")


def table_number(number: Column, by: list, order: list) -> Column:
    """Number of the table a row belongs to: one more than the last number row's (null: the row is none), 1 before any."""
    return F.coalesce(F.last(number, ignorenulls=True).over(over(by, order).rowsBetween(W.unboundedPreceding, W.currentRow)) + 1, F.lit(1))


def first_reference(reference: Column, by: list, order: list) -> Column:
    """The first reference of a table, for all its rows."""
    return F.first(reference, ignorenulls=True).over(over(by, order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))


def row_pairs(rows: DataFrame, by: list, order: list, joins: Column, values: list[str]) -> DataFrame:
    """Rows merged in pairs: a row takes in the next one where that joins; of each value the later non-blank stays.

    Whether a row is taken in depends on the one before, but in a run of joining rows every other one is, counted
    from the row above the run, so its place in the run decides. The first row's order columns stand for the pair.
    """
    w = over(by, order)
    df = rows.withColumn("_n", F.row_number().over(w)).withColumn("_alone", ~_yes(joins) | (F.col("_n") == 1))
    df = df.withColumn("_run", segment(F.col("_alone"), by, order))
    df = df.withColumn("_at", F.row_number().over(over([*by, "_run"], order)) - 1)
    df = df.withColumn("_pair", F.col("_n") - F.col("_at") % 2)
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")).isNull()
    return df.groupBy(*by, "_pair").agg(
        *(F.min_by(c, "_n").alias(c) for c in order), *(F.max_by(c, F.when(~blank(c), F.col("_n"))).alias(c) for c in values), F.count("*").alias("rows")
    ).drop("_pair")


def between_sum(amount: Column, first: Column, second: Column, rows: DataFrame, by: list, order: list) -> DataFrame:
    """by, between: exact sum of the rows after a table's first first-marker and before the next second-marker."""
    w = over(by, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = rows.withColumn("_a", amount.cast("decimal(18,2)")).withColumn("_on", F.sum(_yes(first).cast("long")).over(w)).withColumn("_mark", _yes(first)).withColumn("_end", _yes(second))
    df = df.where("_on > 0").withColumn("_over", F.sum(F.col("_end").cast("long")).over(w))
    opener = F.row_number().over(over(by, order)) == 1
    df = df.withColumn("_opener", opener).where("_over = 0 and not _opener")
    return df.groupBy(*by).agg(F.sum("_a").alias("between"))


def ordinal_titles(dotted: DataFrame, items: DataFrame, order: list) -> DataFrame:
    """items (doc, ref, ...) with title: that of the k-th three-dot row of the document where ref is 内k号.

    dotted: doc, order columns, title, of the three-dot rows only.
    """
    k = F.row_number().over(over(["doc"], order))
    names = dotted.select("doc", F.concat(F.lit("内:"), k.cast("string")).alias("_key"), "title")
    return items.withColumn("_key", text.title_ref_key(F.col("ref"))).join(names, ["doc", "_key"], "left").drop("_key")


def sheets_of_references(notes: DataFrame, cells: DataFrame) -> DataFrame:
    """(sheet, key): reference cells of the sheets that some remark of the main sheet names.

    notes: note; cells: sheet, value. The remarks' distinct references are the right side of a semi-join.
    """
    named = notes.select(F.explode(text.references(F.col("note"))).alias("ref")).select(text.ref_key(F.col("ref")).alias("key")).distinct()
    return cells.where(text.is_reference(F.col("value"))).select("sheet", text.ref_key(text.compact(F.col("value"))).alias("key")).distinct().join(named, "key", "left_semi")

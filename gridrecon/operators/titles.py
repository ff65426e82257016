"""Titles of page tables: what is built, in which unit and for which quantity (1 m 当り), from a table's reference row or what lies near it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridrecon.operators.grid import over, segment_after

# Words that only header cells hold; the last one does not count in whole lines.
HEADER = ("名称", "数 量", "数量", "単位", "単 価", "金 額", "明細単価番号", "基 準")
# A number, "per", and references within a cell.
_NUMBER, _PER = r"(-?(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d+)?)", "(?:当り|当たり)"
_ORDINAL = r"第\s*[0-9０-９]+\s*号"
_REFERENCE = rf"{_ORDINAL}\s*[一-龯]|[一-龯々]+\s*[0-9０-９]+\s*号"
# Number and unit of a cell, title before them in a line, number and unit in running text; each with its closer form.
_IN_CELL = (rf"^{_NUMBER}\s+(\S+?)\s*{_PER}(?:.*)?$", rf"^{_NUMBER}\s*([^×\s]{{1,6}})\s*{_PER}(?:.*)?$")
_IN_LINE = (rf"^(.+?)\s{{2,}}{_NUMBER}\s+(\S+)\s*{_PER}(?:\s+.*)?$", rf"^(.+?)\s+{_NUMBER}\s*([^×\s]{{1,6}})\s*{_PER}(?:\s+.*)?$")
_IN_TEXT = (rf"(-?\d+(?:,\d{{3}})*(?:\.\d+)?)\s+(\S+?)\s*{_PER}", rf"(-?\d+(?:,\d{{3}})*(?:\.\d+)?)\s*([^×\s]{{1,6}})\s*{_PER}")
#: Characters of the page's text looked at before and after the place of the reference.
BEFORE, AFTER = 50, 200

_FLAGS = "(?Ud)"  # white space of any script; only a line feed ends a line


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _digits(x: Column) -> Column:
    return F.translate(x, "０１２３４５６７８９　", "0123456789 ")


def _undimensioned(x: Column) -> Column:
    """Sizes such as 800×590×2000 made a space; texts without the sign are not searched."""
    return F.when(F.contains(x, F.lit("×")), F.regexp_replace(x, rf"{_FLAGS}\S*×\S*(?:×\S*)+", " ")).otherwise(x)


def _has(x: Column, words: tuple) -> Column:
    return x.rlike("|".join(words))


def _untailed(title: Column) -> Column:
    return F.regexp_replace(title, rf"{_FLAGS}\s*{_PER}?\s*(?:明細書|単価表)?\s*$", "")


def _unit(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)[\s。、，,.]+$", "")


def _first_of(x: Column, patterns: tuple, made) -> Column:
    """made(the groups of the first pattern that x matches), null if none does."""
    out = None
    for p in patterns:
        hit = x.rlike(_FLAGS + p), made(lambda g, p=p: F.regexp_extract(x, _FLAGS + p, g))
        out = F.when(*hit) if out is None else out.when(*hit)
    return out


def _title(rule: int, name: Column, unit: Column, quantity: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), name.alias("item_name"), unit.alias("unit"), quantity.alias("unit_quantity"))


def _line(x: Column, rule: int) -> Column:
    """Title of a line that holds name, number, unit and "per", null if it does not or has a header's word."""
    n = _digits(x)
    got = _first_of(_undimensioned(n), _IN_LINE, lambda g: _title(rule, _untailed(_trim(g(1))), _unit(g(3)), g(2)))
    whole = (got["item_name"] != "") & (got["unit"] != "")
    return F.when(n.rlike(_PER) & ~_has(n, HEADER[:-1]) & whole, got)


def labelled(cells: Column) -> Column:
    """Title of a reference row whose cells say 単位 and 単位数量: the value is the cell behind the label, the name lies before the first."""
    unit, quantity = _label(cells)
    at = lambda p: _trim(F.coalesce(F.get(cells, p + 1), F.lit("")))
    name = F.array_join(F.transform(F.filter(F.slice(cells, F.lit(2), F.greatest(unit - 1, F.lit(0))), lambda c: c != ""), _trim), " ")
    return F.when((at(unit) != "") & (at(quantity) != ""), _title(0, name, at(unit), at(quantity)))


def _label(cells: Column) -> tuple[Column, Column]:
    """Places (from 0) of the last cells that hold 単位 and 単位数量."""
    last = lambda test: F.array_max(F.transform(cells, lambda c, i: F.when(test(c), i)))
    amount = lambda c: F.contains(c, F.lit("単位数量"))
    return last(lambda c: F.contains(c, F.lit("単位")) & ~amount(c)), last(amount)


def by_cells(cells: Column) -> Column:
    """Title from separate cells: the last one with number and unit, the longest of the others, the first of equals."""
    free = F.filter(F.transform(cells, _trim), lambda c: (c != "") & ~c.rlike("(?U)" + _ORDINAL) & ~_has(c, HEADER))
    value = lambda c: _first_of(_undimensioned(_digits(c)), _IN_CELL, lambda g: F.struct(g(1).alias("q"), F.regexp_replace(_unit(g(2)), _PER + "$", "").alias("u")))
    read = F.transform(free, lambda c, i: F.struct(c.alias("c"), i.alias("i"), value(c).alias("v")))
    names, values = F.filter(read, lambda x: x["v"].isNull()), F.filter(read, lambda x: x["v"].isNotNull())
    longest = F.array_max(F.transform(names, lambda x: F.struct(F.length(x["c"]).alias("n"), (-x["i"]).alias("i"), x["c"].alias("c"))))["c"]
    last = F.get(values, F.size(values) - 1)["v"]
    return F.when(longest.isNotNull() & (last["u"] != ""), _title(1, _untailed(longest), last["u"], last["q"]))


def by_lines(cells: Column) -> Column:
    """Title from the whole row as a line, else the lines below the reference in its cell, else the lines of other cells."""
    is_ref = lambda c: c.rlike("(?U)" + _REFERENCE)
    own = F.get(F.filter(cells, is_ref), 0)
    lines = F.split(own, r"\R")
    below = F.slice(lines, F.array_position(F.transform(lines, is_ref), True).cast("int") + 1, F.size(lines))
    others = F.flatten(F.transform(F.filter(cells, lambda c: c != own), lambda c: F.split(c, r"\R")))
    found = F.filter(F.transform(F.concat(F.array(F.array_join(cells, "   ")), below, others), lambda x: _line(x, 2)), lambda x: x.isNotNull())
    return F.when(own.isNotNull(), F.get(found, 0))


def by_text(page: Column, reference: Column) -> Column:
    """Title from the page's text around the reference (all of it if it does not hold the reference): the line before number and unit.

    Sizes are dropped before the search, but the line is cut from the text with them, at the same count of characters.
    """
    at = F.coalesce(F.instr(page, F.replace(reference, F.lit(" "), F.lit(""))), F.lit(0))
    start = F.greatest(at - BEFORE, F.lit(1))
    window = _digits(F.when(at > 0, F.substring(page, start, at + AFTER - start)).otherwise(page))
    plain = _undimensioned(window)

    def cut(p):
        head = F.substring(window, F.lit(1), F.length(F.get(F.split(plain, _FLAGS + p, 2), 0)))
        lines = F.filter(F.transform(F.split(head, "[\n\r]"), _trim), lambda x: x != "")
        name = _untailed(F.coalesce(F.get(lines, F.size(lines) - 1), F.lit("")))
        return _title(5, name, F.regexp_extract(plain, _FLAGS + p, 2), F.regexp_extract(plain, _FLAGS + p, 1))

    near, close = (_FLAGS + p for p in _IN_TEXT)
    got = F.when(plain.rlike(near), cut(_IN_TEXT[0])).when(plain.rlike(close), cut(_IN_TEXT[1]))
    return F.when(got["item_name"] != "", got)


def page_titles(rows: DataFrame, by: list, order: list, reference: str, header: Column, page_text: str | None = None, wide: bool = True) -> DataFrame:
    """The rows with a reference (column, null: none), with title: rule, item_name, unit, unit_quantity (null: no title).

    rows: by (one table of a page), order, cells array<string>, and page_text where the page's text is to be searched. The first rule
    that holds counts: 0 labels in the reference row, 1 its cells, 2 its lines, 3 the rows down to the next header (none below: no rows),
    4 the three rows above, the farthest first, 5 the page's text. Rows of fewer than seven cells, and labels without a value, have no
    title; wide=False: rule 0 alone. A number of over three digits that touches its unit needs commas (1036m gives 103 and 6m). A null cell is blank. A table without references has no rows. Equal rows count each.
    """
    w = over(by, order)
    cells = F.coalesce(F.col("cells"), F.array().cast("array<string>"))
    df = rows.withColumn("_head", F.coalesce(header, F.lit(False)))
    title = labelled(cells)
    if wide:
        line = lambda rule: _line(F.array_join(cells, "   "), rule)
        df = df.withColumn("_between", F.when(~F.col("_head"), line(3))).withColumn("_above", line(4))
        df = df.withColumn("_above", F.coalesce(*(F.lag("_above", k).over(w) for k in (3, 2, 1)))).withColumn("_seg", segment_after(F.col("_head"), by, order))
        part = W.partitionBy(*by, "_seg")
        up = part.orderBy(*(F.col(c).desc() for c in order)).rowsBetween(W.unboundedPreceding, -1)
        df = df.withColumn("_between", F.when(F.max("_head").over(part), F.last("_between", ignorenulls=True).over(up)))
        rules = [by_cells(cells), by_lines(cells), F.col("_between"), F.col("_above")]
        if page_text:
            rules.append(by_text(F.col(page_text), F.col(reference)))
        unit, quantity = _label(cells)
        title = F.when(unit.isNotNull() & quantity.isNotNull(), title).otherwise(F.coalesce(*rules))
    out = df.where(F.col(reference).isNotNull()).withColumn("title", F.when(F.size(cells) >= 7, title))
    return out.drop("_head", "_between", "_above", "_seg")


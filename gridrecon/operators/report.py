"""Counts, breakdowns and report rows over comparison results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The statuses of a compared row.
STATUSES = ("OK", "QUANTITY_MISMATCH", "UNIT_MISMATCH", "NAME_MISMATCH", "MISSING", "EXTRA")


def summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES))


def breakdown(results: DataFrame, by: str) -> DataFrame:
    """Counts and shares of each status for each value of by and overall (by null); shares are half-even at one decimal."""
    g = results.rollup(by).agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES))
    pct = [F.when(F.col("total") > 0, F.bround((F.col(s.lower()) * 100).cast("decimal(20,4)") / F.col("total"), 1)).otherwise(0).cast("double").alias(f"{s.lower()}_pct") for s in STATUSES]
    return g.select("*", *pct)


def side_breakdown(results: DataFrame) -> DataFrame:
    """Counts and shares of each status by document side (requested, estimated) and kind of table, and over all kinds (kind null).

    results: kind, status. A row counts for the requested side unless it is extra, for the estimated side unless missing.
    """
    sides = F.filter(F.array(F.when(F.col("status") != "EXTRA", F.lit("requested")), F.when(F.col("status") != "MISSING", F.lit("estimated"))), lambda s: s.isNotNull())
    g = results.select("kind", "status", F.explode(sides).alias("side")).groupingSets([["side", "kind"], ["side"]], "side", "kind")
    g = g.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES))
    return g.select("*", *(F.bround((F.col(s.lower()) * 100).cast("decimal(20,4)") / F.col("total"), 1).cast("double").alias(f"{s.lower()}_pct") for s in STATUSES))


def checklist_table(sections: DataFrame) -> DataFrame:
    """Checklist cells of sections that are lists: a heading row, the first row's keys, then a row for each entry by these keys.

    sections: section_no, title, rows array<map<string,string>>; a null or empty list gives no section.
    """
    s = sections.where(F.size("rows") > 0).withColumn("keys", F.map_keys(F.get("rows", F.lit(0))))
    head = s.select("section_no", F.lit(0).alias("row_no"), F.lit(0).alias("col_no"), F.col("title").alias("value"))
    names = s.select("section_no", F.lit(1).alias("row_no"), F.posexplode("keys").alias("col_no", "value"))
    body = s.select("section_no", "keys", F.posexplode("rows").alias("pos", "row"))
    body = body.select("section_no", (F.col("pos") + 2).alias("row_no"), F.posexplode(F.transform("keys", lambda k: F.coalesce(F.col("row")[k], F.lit("")))).alias("col_no", "value"))
    return head.unionByName(names).unionByName(body)


def pattern_histogram(refs: DataFrame) -> DataFrame:
    """Subtables by kind of reference, for each sheet and overall (sheet null, overall true)."""
    kind = F.coalesce(*(F.when(F.startswith("ref", F.lit(p)), p) for p in ("内", "単", "代", "施")), F.lit("Other"))
    sets = refs.select("sheet", kind.alias("pattern")).groupingSets([["sheet", "pattern"], ["pattern"]], "sheet", "pattern")
    return sets.agg((F.grouping("sheet") == 1).alias("overall"), F.count("*").alias("n"))


def union_report(**parts: DataFrame) -> DataFrame:
    """The parts one below the other, each tagged with its name."""
    out = None
    for kind, df in parts.items():
        df = df.withColumn("report", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def tagged(rows: DataFrame, **parts: Column) -> DataFrame:
    """A row for each of the reports (by name) whose condition it meets: one pass over rows, however many reports."""
    tags = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in parts.items())), lambda t: t.isNotNull())
    return rows.select(F.explode(tags).alias("report"), "*")


def checklist(sections: DataFrame) -> DataFrame:
    """Checklist cells (section_no, row_no, col_no, value): a heading row, then key and value of each field in order.

    sections: section_no, title, fields map<string,string>; a null or empty map gives no section.
    """
    s = sections.where(F.size("fields") > 0).withColumn("f", F.array_sort(F.map_entries("fields")))
    head = s.select("section_no", F.lit(0).alias("row_no"), F.lit(0).alias("col_no"), F.col("title").alias("value"))
    body = s.select("section_no", F.posexplode("f").alias("pos", "kv"))
    cells = body.select("section_no", (F.col("pos") + 1).alias("row_no"), F.posexplode(F.array("kv.key", F.coalesce("kv.value", F.lit("Not Found")))).alias("col_no", "value"))
    return head.unionByName(cells)


def verdicts(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """by, old_n, new_n, verdict: findings of two ways of reporting, for each value of by."""
    o, n = (d.groupBy(by).agg(F.count("*").alias(c)) for d, c in ((old, "old_n"), (new, "new_n")))
    both = o.join(n, by, "full_outer").select(by, F.coalesce("old_n", F.lit(0)).alias("old_n"), F.coalesce("new_n", F.lit(0)).alias("new_n"))
    return both.withColumn("verdict", F.when(F.col("new_n") < F.col("old_n"), "FIXED").when(F.col("new_n") > F.col("old_n"), "REGRESSION").otherwise("NO_CHANGE"))


def match_rate(rows: DataFrame, by: str, hit: Column) -> DataFrame:
    """Share of hits in percent; 0 where there is no row."""
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(hit).alias("matches")).withColumn("rate", F.when(F.col("total") > 0, F.col("matches") * 100.0 / F.col("total")).otherwise(0.0))


def examples(results: DataFrame, n: int, by: str, order: list) -> DataFrame:
    """The first n rows of each status; Spark cuts each partition to n before the shuffle."""
    return results.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)


def longest(rows: DataFrame, by: list, value: str, at: str) -> DataFrame:
    """The longest value of each group, the first of equals."""
    return rows.groupBy(*by).agg(F.max_by(value, F.struct(F.length(value), -F.col(at))).alias("longest"))


def term_search(rows: DataFrame, value: str, terms: list[str]) -> DataFrame:
    """A row for each of the terms that value contains."""
    return rows.withColumn("term", F.explode(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(value, t))))


def sheet_counts(rows: DataFrame, sheet: str, ref: str) -> DataFrame:
    """Subtables and rows of each sheet; rows are counted by subtable before the sheets meet."""
    return rows.groupBy(sheet, ref).agg(F.count("*").alias("n")).groupBy(sheet).agg(F.count("*").alias("subtables"), F.sum("n").alias("rows"))


def without_terms(rows: DataFrame, left: str, right: str, terms: tuple[str, ...]) -> DataFrame:
    """Rows that bear none of the names on either side; a null is no such name."""
    return rows.where(~F.coalesce(F.col(left).isin(*terms), F.lit(False)) & ~F.coalesce(F.col(right).isin(*terms), F.lit(False)))

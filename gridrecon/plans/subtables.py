"""Registered queries of subtables in detail: general and detail rows, nested subtables, titles of page tables by their fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridrecon.operators import details, titles
from gridrecon.plans.catalogue import _BY, _ORDER, _events, query
from gridrecon.plans.items import table

# Events as rows of a sheet: views carry general names (some with a price), clicks names (some of them a header's word), purchases
# values, errors are totals (some with an amount, so that a general name above takes them in), signups references.
_DETAILS = """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
  CASE WHEN event_type = 'view' THEN props ELSE '' END AS general, CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 7 = 0 THEN '名　称' ELSE props END ELSE '' END AS name,
  CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'm' ELSE '' END AS unit, CASE WHEN event_type = 'purchase' THEN CAST(event_id % 50 AS VARCHAR) ELSE '' END AS quantity,
  CASE WHEN event_type = 'view' AND event_id % 4 = 0 THEN '10' ELSE '' END AS price, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN '計' ELSE '' END AS amount,
  CASE WHEN event_type = 'signup' THEN '内' || (event_id % 3) || '号' END AS ref FROM events),
l AS (SELECT *, event_type IN ('error', 'signup') AS stop, general <> '' AND name || unit || quantity || amount = '' AS lone, lead(name) OVER v AS name2, lead(unit) OVER v AS unit2,
  lead(quantity) OVER v AS quantity2, lead(price) OVER v AS price2, lead(amount) OVER v AS amount2,
  min(CASE WHEN ref IS NOT NULL THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 3 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM r WINDOW v AS (PARTITION BY user_id ORDER BY n)),
s AS (SELECT *, lone AND NOT stop AND coalesce(name2 || unit2 || quantity2 || price2 || amount2 <> '', false) AS takes FROM l),
o AS (SELECT user_id, n, ref, later FROM s WHERE ref IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n) = 1
  UNION ALL SELECT s.user_id, s.n, s.ref, s.later FROM o JOIN s ON s.user_id = o.user_id AND s.n = o.later),
w AS (SELECT user_id, n AS start, ref AS label, later AS until, n + 3 AS n FROM o
  UNION ALL SELECT w.user_id, w.start, w.label, w.until, w.n + CASE WHEN s.takes THEN 2 ELSE 1 END FROM w JOIN s ON s.user_id = w.user_id AND s.n = w.n WHERE NOT s.stop AND (w.until IS NULL OR w.n < w.until)),
g AS (SELECT w.user_id, w.start, w.label, w.n, CASE WHEN takes THEN general || CASE WHEN name2 <> '' THEN ' ' || name2 ELSE '' END WHEN name <> '' THEN name ELSE general END AS name,
  CASE WHEN takes THEN unit2 ELSE unit END AS unit, CASE WHEN takes THEN quantity2 ELSE quantity END AS quantity, CASE WHEN takes THEN price2 ELSE price END AS price,
  CASE WHEN takes THEN amount2 ELSE amount END AS amount FROM w JOIN s ON s.user_id = w.user_id AND s.n = w.n WHERE NOT s.stop AND (w.until IS NULL OR w.n < w.until)),
h AS (SELECT * FROM g WHERE name || quantity || price || amount <> '' AND name <> '名　称'),
d AS (SELECT user_id, label, CAST(row_number() OVER (PARTITION BY user_id, start ORDER BY n) AS INTEGER) AS line, name, unit, quantity, price, amount,
  dense_rank() OVER (PARTITION BY user_id, label ORDER BY start) AS k FROM h),
x AS (SELECT user_id, CASE WHEN k = 1 THEN label ELSE label || '-' || k END AS ref, line, name, unit, quantity, price, amount FROM d)"""


def _details(spark, sf):
    is_, id_ = (lambda t: F.col("event_type") == t), F.col("event_id")
    rows = _events(spark, sf).select(
        *_BY, *(c for c in _ORDER if c not in _BY), "event_type",
        F.when(is_("view"), F.col("props")).alias("general"), F.when(is_("click"), F.when(id_ % 7 == 0, "名　称").otherwise(F.col("props"))).alias("name"),
        F.when(is_("purchase") & (id_ % 3 == 0), "m").alias("unit"), F.when(is_("purchase"), (id_ % 50).cast("string")).alias("quantity"),
        F.when(is_("view") & (id_ % 4 == 0), "10").alias("price"), F.when(is_("error") & (id_ % 3 == 0), "計").alias("amount"), F.lit(None).cast("string").alias("note"),
    )
    ref = F.when(is_("signup"), F.concat(F.lit("内"), (id_ % 3).cast("string"), F.lit("号")))
    return details.sheet_details(rows, _BY, _ORDER, ref, is_("error"))


@query(f"{_DETAILS} SELECT * FROM x")
def sheet_details(spark, sf):
    return _details(spark, sf).drop("note")


@query(f"{_DETAILS} SELECT user_id, ref, line AS ord, name AS item_key, unit, CAST(CASE WHEN quantity = '' THEN '0' ELSE quantity END AS DOUBLE) AS quantity FROM x WHERE name <> ''")
def sheet_items(spark, sf):
    return details.items(_details(spark, sf), _BY)


@query(f"{_DETAILS} SELECT user_id, ref, count(*) AS row_count, string_agg(name, '|' ORDER BY line) AS names FROM x GROUP BY ALL")
def nested_subtables(spark, sf):
    return details.nested(_details(spark, sf), _BY).select(*_BY, "ref", "row_count", F.array_join(F.col("rows.name"), "|").alias("names"))


# An order as a table of a page, its priority as title, the last three digits of its customer's number as quantity; where they stand
# goes by the order's key.
@query("""SELECT o_orderkey AS doc, CAST(CASE o_orderkey % 8 WHEN 6 THEN 1 WHEN 7 THEN NULL ELSE o_orderkey % 8 END AS INTEGER) AS rule,
 CASE o_orderkey % 8 WHEN 7 THEN NULL WHEN 6 THEN o_orderpriority || ' B1000×W500×H20' ELSE o_orderpriority END AS item_name,
 CASE WHEN o_orderkey % 8 <> 7 THEN 'm' END AS unit, CASE WHEN o_orderkey % 8 <> 7 THEN CAST(o_custkey % 1000 AS VARCHAR) END AS unit_quantity FROM orders""")
def page_titles(spark, sf):
    o = table(spark, sf, "orders")
    title, qty, key, none = F.col("o_orderpriority"), (F.col("o_custkey") % 1000).cast("string"), F.col("o_orderkey"), F.lit("")
    ref, per = F.concat(F.lit("第"), (key % 90 + 1).cast("string"), F.lit("号明")), F.concat(qty, F.lit(" m 当り"))
    line = F.concat(title, F.lit("   "), per)
    own = (
        F.when(key % 8 == 0, F.array(ref, title, F.lit("単位"), F.lit("m"), F.lit("単位数量"), qty, F.lit("単価")))
        .when(key % 8 == 1, F.array(ref, none, title, per, none, none, none))
        .when(key % 8 == 2, F.array(F.concat(ref, F.lit("\n"), line), *[none] * 6))
        .when(key % 8 == 6, F.array(ref, F.concat(title, F.lit(" B1000×W500×H20")), F.concat(qty, F.lit("m当り")), *[none] * 4))
        .when(key % 16 == 7, F.array(ref, line))
        .when(key % 16 == 15, F.array(ref, title, F.lit("単位"), none, F.lit("単位数量"), qty, F.lit("単価")))
        .otherwise(F.array(ref, *[none] * 6))
    )
    row = lambda n, cells, ref=None: F.struct(F.lit(n).alias("n"), cells.alias("cells"), (F.lit(None).cast("string") if ref is None else ref).alias("ref"))
    rows = F.array(
        row(1, F.when(key % 8 == 4, F.array(title, per)).otherwise(F.array(F.lit("工事")))), row(2, F.array(none)), row(3, own, ref),
        row(4, F.when(key % 8 == 3, F.array(F.lit(None).cast("string"), title, qty, F.lit("m"), F.lit("当り"))).otherwise(F.array(none))),
        row(5, F.array(F.lit("名称"), F.lit("単位"), F.lit("数量"))),
    )
    page = F.when(key % 8 == 5, F.concat(F.lit("表\n"), ref, F.lit("\n"), title, F.lit(" "), per)).otherwise(ref)
    df = o.select(key.alias("doc"), page.alias("page"), F.explode(rows).alias("x")).select("doc", "page", "x.*")
    out = titles.page_titles(df, ["doc"], ["n"], "ref", F.get("cells", F.lit(0)) == "名称", "page")
    return out.select("doc", "title.rule", "title.item_name", "title.unit", "title.unit_quantity")

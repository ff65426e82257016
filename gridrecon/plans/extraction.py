"""Registered queries of the subtable, title, tree and report operators; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridrecon.functions import text
from gridrecon.operators import blocks, grid, match, report, spec, tree
from gridrecon.plans.catalogue import _BY, _CHAIN, _COMPARE, _ITEMS, _ORDER, _SHEET, _compared, _events, _name, _sheet, _tree, query
from gridrecon.plans.items import ORDER, pair, requested, table

_ROWS = "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
_P = "OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN"


def _is(*kinds: str):
    return F.col("event_type").isin(*kinds)


@query(f"""WITH {_ROWS}, s AS (SELECT *, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 END) {_P} 1 FOLLOWING AND 3 FOLLOWING), 0) AS soon,
 coalesce(max(CASE WHEN event_type = 'error' THEN n END) {_P} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM r)
SELECT e.event_id, min(c.n) AS block FROM s e LEFT JOIN s c ON c.user_id = e.user_id AND c.event_type = 'signup' AND c.soon = 1 AND c.n > e.closed AND c.n <= e.n GROUP BY e.event_id""")
def subtable_blocks(spark, sf):
    return blocks.table_blocks(_events(spark, sf), _BY, _ORDER, _is("signup"), _is("purchase"), _is("error")).select("event_id", "block")


@query(f"""WITH RECURSIVE {_ROWS},
s AS (SELECT *, CASE WHEN event_type = 'signup' THEN '内' || (event_id % 3) || '号' END AS ref, min(CASE WHEN event_type = 'signup' THEN n END) {_P} 3 FOLLOWING AND UNBOUNDED FOLLOWING) AS later,
  min(CASE WHEN event_type IN ('signup', 'error') THEN n END) {_P} 3 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM r),
o AS (SELECT user_id, n, ref, later, stop FROM s WHERE ref IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n) = 1
  UNION ALL SELECT s.user_id, s.n, s.ref, s.later, s.stop FROM o JOIN s ON s.user_id = o.user_id AND s.n = o.later),
d AS (SELECT r.event_id, o.user_id, o.n, o.ref FROM o JOIN r ON r.user_id = o.user_id AND r.n >= o.n + 3 AND (o.stop IS NULL OR r.n < o.stop) AND r.value >= 10),
k AS (SELECT *, dense_rank() OVER (PARTITION BY user_id, ref ORDER BY n) AS k FROM d)
SELECT event_id, CASE WHEN k = 1 THEN ref ELSE ref || '-' || k END AS ref FROM k""")
def sheet_subtables(spark, sf):
    e = _events(spark, sf)
    ref = F.when(_is("signup"), F.concat(F.lit("内"), (F.col("event_id") % 3).cast("string"), F.lit("号")))
    return blocks.sheet_blocks(e, _BY, _ORDER, ref, _is("error"), F.col("value") >= 10).select("event_id", "ref")


@query(f"""WITH {_ROWS}, m AS (SELECT *, coalesce(max(CASE WHEN event_type = 'error' THEN n END) {_P} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
  coalesce(min(CASE WHEN event_type = 'error' THEN n END) {_P} CURRENT ROW AND UNBOUNDED FOLLOWING), 1000000000) AS hi FROM r),
t AS (SELECT m.event_id, list(s.props ORDER BY s.n) FILTER (s.n > m.lo AND s.n < m.n) AS above, min_by(s.props, s.n) FILTER (s.n > m.n AND s.n < m.hi) AS below,
  min_by(s.props, s.n) FILTER (s.n > m.n AND s.n <= m.n + 9) AS near FROM m LEFT JOIN r s ON s.user_id = m.user_id AND s.event_type IN ('view', 'click') WHERE m.event_type = 'signup' GROUP BY m.event_id)
SELECT event_id, coalesce(CASE WHEN len(above) >= 2 THEN above[-2] ELSE above[1] END, below, near) AS title FROM t""")
def sheet_titles(spark, sf):
    sentence = F.when(_is("view", "click"), F.col("props"))
    return blocks.table_titles(_events(spark, sf), _BY, _ORDER, _is("signup"), _is("error"), sentence).select("event_id", "title")


@query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'error' THEN CAST(value AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1, 1) AS table_number FROM events")
def running_table_number(spark, sf):
    n = F.when(_is("error"), F.bround("value").cast("long"))
    return _events(spark, sf).select("event_id", blocks.table_number(n, _BY, _ORDER).alias("table_number"))


@query("""SELECT o_orderkey, CAST(o_orderkey % 4 AS VARCHAR) AS category, first_value(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END IGNORE NULLS)
 OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ref FROM orders QUALIFY o_orderkey % 4 <> 0""")
def fee_table_reference(spark, sf):
    ref = blocks.first_reference(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")), ["o_custkey"], ["o_orderkey"])
    o = table(spark, sf, "orders").withColumn("ref", ref).withColumn("note", F.concat(F.lit("管理費区分:"), (F.col("o_orderkey") % 4).cast("string")))
    return spec.fee_rows(o, "note").select("o_orderkey", "category", "ref")


@query(f"""WITH RECURSIVE {_ROWS}, j AS (SELECT *, event_type IN ('click', 'purchase') AS joins FROM r), l AS (SELECT *, coalesce(lead(joins) OVER (PARTITION BY user_id ORDER BY n), false) AS next_joins FROM j),
s AS (SELECT user_id, n, next_joins FROM l WHERE n = 1 UNION ALL SELECT l.user_id, l.n, l.next_joins FROM s JOIN l ON l.user_id = s.user_id AND l.n = s.n + CASE WHEN s.next_joins THEN 2 ELSE 1 END)
SELECT a.event_id, CASE WHEN s.next_joins THEN 2 ELSE 1 END AS rows, CASE WHEN s.next_joins AND b.event_type IN ('click', 'purchase') THEN b.props ELSE coalesce(CASE WHEN a.event_type <> 'view' THEN a.props END, CASE WHEN s.next_joins THEN b.props END) END AS props
FROM s JOIN r a ON a.user_id = s.user_id AND a.n = s.n LEFT JOIN r b ON b.user_id = s.user_id AND b.n = s.n + 1""")
def row_pair_merge(spark, sf):
    e = _events(spark, sf).withColumn("props", F.when(~_is("view"), F.col("props")).otherwise(""))
    out = blocks.row_pairs(e, _BY, _ORDER, _is("click", "purchase"), ["props"])
    return out.select("event_id", F.col("rows").cast("int").alias("rows"), "props")


@query(f"""WITH {_ROWS}, a AS (SELECT user_id, min(n) AS lo FROM r WHERE event_type = 'signup' GROUP BY 1),
b AS (SELECT a.user_id, lo, min(n) AS hi FROM a LEFT JOIN r ON r.user_id = a.user_id AND r.n > lo AND event_type = 'error' GROUP BY ALL)
SELECT b.user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS between FROM b JOIN r ON r.user_id = b.user_id AND n > lo AND (hi IS NULL OR n < hi) GROUP BY 1""")
def between_markers_sum(spark, sf):
    out = blocks.between_sum(F.col("value"), _is("signup"), _is("error"), _events(spark, sf), _BY, _ORDER)
    return out.withColumn("between", F.col("between").cast("double"))


@query("""WITH w AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('view', 'click') THEN props END AS place, CASE WHEN event_type IN ('click', 'purchase') THEN value END AS amount FROM events),
x AS (SELECT *, place IS NOT NULL AND amount IS NULL AS lone, lag(place IS NOT NULL AND amount IS NULL, 1, false) OVER v AS used, lead(amount) OVER v AS next_amount FROM w WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, place, CASE WHEN lone THEN next_amount ELSE amount END AS amount FROM x WHERE lone OR NOT used""")
def rowspan_merge(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "ts", F.when(_is("view", "click"), F.col("props")).alias("place"), F.when(_is("click", "purchase"), F.col("value")).alias("amount"))
    return grid.rowspan_merge(e, _BY, _ORDER, "place", ["amount"]).select("event_id", "place", "amount")


@query(f"""WITH {_ITEMS}, k AS (SELECT l_orderkey AS doc, p_type AS title, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 20)
SELECT req.doc, ord, ref, title FROM req LEFT JOIN k ON k.doc = req.doc AND req.ref = '内' || k.k || '号'""")
def ordinal_titles(spark, sf):
    li, part = table(spark, sf, "lineitem").where("l_quantity > 20"), table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("title"))
    dotted = li.join(part, li["l_partkey"] == part["p_partkey"]).withColumn("doc", F.col("l_orderkey"))
    return blocks.ordinal_titles(dotted, requested(spark, sf).select("doc", "ord", "ref"), list(ORDER)).select("doc", "ord", "ref", "title")


@query("SELECT DISTINCT CAST(s_nationkey AS INTEGER) AS sheet, '明:' || s_suppkey AS key FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 40 AND l_discount >= 0.05)")
def sheets_of_references(spark, sf):
    k = lambda c: F.col(c).cast("string")
    notes = table(spark, sf, "lineitem").where("l_quantity > 40 and l_discount >= 0.05").select(F.concat(F.lit("摘要 第"), k("l_suppkey"), F.lit("号明 参照")).alias("note"))
    cells = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("sheet"), F.concat(F.lit("明 "), k("s_suppkey"), F.lit("号")).alias("value"))
    return blocks.sheets_of_references(notes, cells)


_VERDICTS = f"""WITH {_ITEMS}, {_COMPARE}, o AS (SELECT doc, count(*) AS old_n FROM c WHERE status = 'EXTRA' GROUP BY 1),
r2 AS (SELECT doc, name AS n, u, coalesce(quantity, 0) AS q FROM n), e2 AS (SELECT doc, name AS n, u, coalesce(quantity, 0) AS q FROM m),
w AS (SELECT doc, count(*) AS new_n FROM e2 e WHERE NOT EXISTS (SELECT 1 FROM r2 r WHERE r.doc = e.doc AND r.u = e.u AND abs(r.q - e.q) < 0.001
  AND (contains(r.n, e.n) OR contains(e.n, r.n) OR (len(r.n) > 10 AND len(e.n) > 10 AND abs(len(r.n) - len(e.n)) <= 2 AND substr(r.n, 1, 10) = substr(e.n, 1, 10)))) GROUP BY 1),
v AS (SELECT coalesce(o.doc, w.doc) AS doc, coalesce(old_n, 0) AS old_n, coalesce(new_n, 0) AS new_n FROM o FULL JOIN w ON o.doc = w.doc),
z AS (SELECT *, CASE WHEN new_n < old_n THEN 'FIXED' WHEN new_n > old_n THEN 'REGRESSION' ELSE 'NO_CHANGE' END AS verdict FROM v)"""


def _verdicts(spark, sf):
    return report.verdicts(_compared(spark, sf).where("status = 'EXTRA'"), match.extra_simplified(*pair(spark, sf)), "doc")


@query(f"{_VERDICTS} SELECT * FROM z")
def extra_ab_diff(spark, sf):
    return _verdicts(spark, sf)


@query(f"{_VERDICTS} SELECT verdict, count(*) AS documents FROM z GROUP BY 1")
def improvement_summary(spark, sf):
    return _verdicts(spark, sf).groupBy("verdict").agg(F.count("*").alias("documents"))


@query("SELECT p_size, count(*) AS total, count(*) FILTER (p_partkey % 3 <> 0) AS matches, count(*) FILTER (p_partkey % 3 <> 0) * 100.0::DOUBLE / count(*) AS rate FROM part GROUP BY 1")
def title_match_rate(spark, sf):
    size = F.col("p_size").cast("string")
    title = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(size), F.lit("m2 当り"))
    return report.match_rate(table(spark, sf, "part"), "p_size", text.title_has(title, size, F.lit("㎡")))


@query(f"WITH {_ITEMS}, {_COMPARE} SELECT status, doc, ord, CAST(row_number() OVER (PARTITION BY status ORDER BY doc, ord) AS INTEGER) AS place FROM c QUALIFY place <= 10")
def status_examples(spark, sf):
    return report.examples(_compared(spark, sf), 10, "status", ["doc", "ord"]).select("status", "doc", "ord", "place")


@query(f"WITH {_ITEMS} SELECT doc, arg_max(item_key, len(item_key) * 1000000 - ord) AS longest FROM req GROUP BY doc")
def longest_cell(spark, sf):
    return report.longest(requested(spark, sf), ["doc"], "item_key", "ord")


@query("SELECT p_partkey, term FROM part, (VALUES ('red'), ('widget'), ('ring')) t(term) WHERE contains(p_name, term)")
def term_search(spark, sf):
    return report.term_search(table(spark, sf, "part"), "p_name", ["red", "widget", "ring"]).select("p_partkey", "term")


@query("SELECT sheet, count(*) AS subtables, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT l_suppkey AS sheet, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def sheet_summary(spark, sf):
    return report.sheet_counts(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "sheet"), "sheet", "l_partkey")


@query(f"WITH {_ITEMS}, {_COMPARE} SELECT doc, ord, req_item_key, est_item_key FROM c WHERE status = 'QUANTITY_MISMATCH' AND coalesce(req_item_key, '') NOT IN ('red widget', '追加工') AND coalesce(est_item_key, '') NOT IN ('red widget', '追加工')")
def quantity_mismatches_kept(spark, sf):
    c = _compared(spark, sf).where("status = 'QUANTITY_MISMATCH'")
    return report.without_terms(c, "req_item_key", "est_item_key", ("red widget", "追加工")).select("doc", "ord", "req_item_key", "est_item_key")


@query("SELECT p_partkey, CAST(len(list_filter(string_split(p_name, ''), lambda c: contains(p_type, upper(c)))) AS DOUBLE) / greatest(len(p_name), len(p_type)) AS score FROM part")
def similarity_score(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.similarity(F.upper("p_name"), F.col("p_type")).alias("score"))


@query("SELECT p_partkey, replace(p_name, ' ', '') || 'A1' AS compact, p_name || ' x' AS clean, '1' || p_size AS qty FROM part")
def scalar_forms(spark, sf):
    size = F.col("p_size").cast("string")
    return table(spark, sf, "part").select(
        "p_partkey", text.compact(F.concat("p_name", F.lit("　Ａ１"))).alias("compact"), text.clean_cell(F.concat(F.lit("　"), "p_name", F.lit("​　 x "))).alias("clean"),
        text.quantity_text(F.concat(F.lit("1,"), size, F.lit(".00"))).alias("qty"),
    )


@query("SELECT conv_id AS doc, role AS article, string_agg(coalesce(text, ''), '' ORDER BY turn, text) AS text FROM conversations GROUP BY ALL")
def article_text_concat(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("role").alias("article"), F.col("turn").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return spec.article_text(c)


@query(f"""WITH RECURSIVE {_SHEET}, u AS (SELECT doc, seq AS found, parent_seq AS seq, 1 AS depth FROM t WHERE quantity > 45 AND parent_seq IS NOT NULL
  UNION ALL SELECT u.doc, u.found, t.parent_seq, depth + 1 FROM u JOIN t ON t.doc = u.doc AND t.seq = u.seq WHERE t.parent_seq IS NOT NULL)
SELECT doc, seq, arg_min(found, depth * 10000000000 + found) AS found FROM u GROUP BY ALL""")
def descendant_reference(spark, sf):
    return tree.nearest_descendant(_tree(spark, sf), F.col("quantity") > 45)


@query(f"""WITH {_SHEET} SELECT doc, seq, '{{"level":' || level || CASE WHEN parent_seq IS NULL THEN '' ELSE ',"parent_seq":' || parent_seq END || ',"item_name":"' || item_name || '"}}' AS json FROM t""")
def tree_json(spark, sf):
    return tree.as_json(_tree(spark, sf), ["level", "parent_seq", "item_name"])


@query(f"""WITH {_CHAIN},
b AS (SELECT DISTINCT doc, item_name, level FROM s WHERE level > 0 AND NOT abs(round(unit_price * quantity, 4) - amount) <= 0.01 + 1e-9
  UNION ALL SELECT doc, item_name, 0 FROM (SELECT DISTINCT doc, item_name FROM z JOIN t USING (doc, seq) WHERE abs(actual - expected) > 0.01)),
n AS (SELECT count(*) AS total FROM s WHERE level = 0), m AS (SELECT count(*) AS mismatches FROM b)
SELECT total, mismatches, total - mismatches AS verified FROM n, m""")
def verification_totals(spark, sf):
    rows = _tree(spark, sf)
    cols = ["doc", "seq", "item_name", "level"]
    top = tree.check_amounts(rows).where("not ok").withColumn("level", F.lit(0)).select(*cols)
    bad = top.unionByName(tree.check_rows(rows).where("level > 0 and not ok").select(*cols))
    return tree.totals(rows, bad.withColumn("reference_number", F.lit(None).cast("string")).withColumn("table_number", F.lit(None).cast("string")))

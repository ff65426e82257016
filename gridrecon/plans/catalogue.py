"""Registered queries of the reconciliation operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridrecon.functions import text
from gridrecon.operators import grid, match, report, session, spec, tree
from gridrecon.plans.items import ORDER, pair, requested, table
from gridrecon.streaming import limiter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_ITEMS = f"""
req AS (
  SELECT l_orderkey AS doc, o AS ord, p_name AS item_key, ['m', 'm2', 'kg', 't', '式'][CAST(l_partkey % 5 + 1 AS INTEGER)] AS unit, l_quantity AS quantity,
         '内' || l_suppkey || '号' AS ref, l_extendedprice AS price, l_orderkey * 31 + o * 17 AS k
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS INTEGER) AS o FROM lineitem) l JOIN part ON l_partkey = p_partkey),
est AS (
  SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY o) AS INTEGER) AS ord, item_key, unit, quantity, ref FROM (
    SELECT doc, ord AS o, CASE WHEN k % 19 = 0 THEN 'ヰヱヲ' WHEN k % 29 = 0 THEN item_key || '甲' ELSE item_key END AS item_key,
           CASE WHEN k % 17 = 0 THEN '本' WHEN k % 11 = 0 THEN translate(unit, 'mkgt2', 'ｍｋｇｔ２') ELSE unit END AS unit,
           CASE WHEN k % 23 = 0 THEN NULL WHEN k % 7 = 0 THEN quantity + 1 ELSE quantity END AS quantity, ref
    FROM req WHERE k % 13 <> 0
    UNION ALL SELECT doc, 1000, '追加工', '式', 1.0, ref FROM req WHERE doc % 10 = 0 AND ord = 1))"""


def _name(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


def _unit(c: str) -> str:
    return f"(CASE translate(lower(trim(coalesce({c}, ''))), 'ｍｋｇｔ２', 'mkgt2') WHEN 'm2' THEN '㎡' ELSE translate(lower(trim(coalesce({c}, ''))), 'ｍｋｇｔ２', 'mkgt2') END)"


def _pairs(n: str) -> str:
    return f"list_transform(range(1, greatest(len({n}), 1)), lambda i: substr({n}, i, 2))"


_COMPARE = f"""
n AS (SELECT doc, ord, item_key, unit, quantity, ref, {_name("item_key")} AS name, {_unit("unit")} AS u FROM req),
m AS (SELECT doc, ord, item_key, unit, quantity, ref, {_name("item_key")} AS name, {_unit("unit")} AS u FROM est),
j AS (
  SELECT coalesce(n.doc, m.doc) AS doc, coalesce(n.ord, m.ord) AS ord, n.item_key AS req_item_key, n.quantity AS req_quantity, n.unit AS req_unit,
         m.item_key AS est_item_key, m.quantity AS est_quantity, m.unit AS est_unit, n.name = m.name AS exact, n.u <> m.u AS unit_differs,
         CASE WHEN n.ord IS NULL THEN 'EXTRA' WHEN m.ord IS NULL THEN 'MISSING'
              WHEN n.name <> m.name AND NOT coalesce(list_bool_or(list_transform({_pairs("n.name")}, lambda t: contains(m.name, t))), false) THEN 'MISSING'
              WHEN CASE WHEN n.quantity IS NULL THEN m.quantity IS NULL ELSE abs(coalesce(m.quantity, 0) - coalesce(n.quantity, 0)) >= 0.001 END THEN 'QUANTITY_MISMATCH'
              WHEN n.u <> m.u THEN 'UNIT_MISMATCH' WHEN n.name <> m.name THEN 'NAME_MISMATCH' ELSE 'OK' END AS status
  FROM n FULL JOIN m ON n.doc = m.doc AND n.ord = m.ord),
c AS (
  SELECT doc, ord, req_item_key, req_quantity, req_unit, est_item_key, est_quantity, est_unit, status,
         CASE WHEN status IN ('OK', 'QUANTITY_MISMATCH', 'UNIT_MISMATCH') AND exact THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS match_confidence,
         CASE WHEN status = 'QUANTITY_MISMATCH' THEN coalesce(est_quantity, 0) - coalesce(req_quantity, 0) END AS quantity_difference,
         CASE WHEN status IN ('OK', 'QUANTITY_MISMATCH', 'UNIT_MISMATCH') THEN unit_differs END AS unit_mismatch
  FROM j)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _compared(spark, sf):
    return match.positional(*pair(spark, sf))


@query(f"WITH {_ITEMS}, {_COMPARE} SELECT * FROM c")
def compare_main_positional(spark, sf):
    return _compared(spark, sf)


_COUNTS = ", ".join(f"CAST(count(*) FILTER (status = '{s}') AS BIGINT) AS {s.lower()}" for s in report.STATUSES)


@query(f"WITH {_ITEMS}, {_COMPARE} SELECT count(*) AS total, {_COUNTS} FROM c")
def main_status_summary(spark, sf):
    return report.summary(_compared(spark, sf))


_PCT = ", ".join(f"CAST(round_even(CAST({s.lower()} * 100 AS DECIMAL(20,4)) / total, 1) AS DOUBLE) AS {s.lower()}_pct" for s in report.STATUSES)


@query(f"WITH {_ITEMS}, {_COMPARE}, g AS (SELECT u AS unit, count(*) AS total, {_COUNTS} FROM (SELECT *, coalesce(req_unit, est_unit) AS u FROM c) GROUP BY ROLLUP (u)) SELECT *, {_PCT} FROM g")
def main_breakdown_pct(spark, sf):
    return report.breakdown(_compared(spark, sf).withColumn("unit", F.coalesce("req_unit", "est_unit")), "unit")


def _status(name: str, condition: str, columns: str):
    @query(f"WITH {_ITEMS}, {_COMPARE} SELECT {columns} FROM c WHERE {condition}")
    def run(spark, sf):
        return _compared(spark, sf).where(condition).selectExpr(*columns.split(", "))

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


_status("missing_rows", "status = 'MISSING'", "doc, ord, req_item_key, est_item_key")
_status("extra_rows", "status = 'EXTRA'", "doc, ord, est_item_key, est_quantity")
_status("quantity_mismatches", "status = 'QUANTITY_MISMATCH'", "doc, ord, req_quantity, est_quantity, quantity_difference")
_status("unit_mismatches", "status = 'UNIT_MISMATCH' OR (status = 'QUANTITY_MISMATCH' AND unit_mismatch)", "doc, ord, req_unit, est_unit, status")


@query(f"""WITH {_ITEMS}, {_COMPARE} SELECT doc, ord, req_item_key, est_item_key,
  CASE WHEN list_bool_and(list_transform({_pairs(_name("req_item_key"))}, lambda t: contains({_name("est_item_key")}, t))) THEN 2 ELSE 3 END AS category FROM c WHERE status = 'NAME_MISMATCH'""")
def name_mismatch_categories(spark, sf):
    c = _compared(spark, sf).where("status = 'NAME_MISMATCH'")
    every = F.forall(text.tokens(F.col("req_item_key")), lambda t: F.contains(text.item_name(F.col("est_item_key")), t))
    return c.select("doc", "ord", "req_item_key", "est_item_key", F.when(every, 2).otherwise(3).alias("category"))


@query(f"WITH {_ITEMS} SELECT doc, ord, item_key, quantity FROM req WHERE {_name('item_key')} <> '' AND NOT EXISTS (SELECT 1 FROM est WHERE est.doc = req.doc AND {_name('est.item_key')} = {_name('req.item_key')})")
def missing_by_name(spark, sf):
    return match.missing_by_name(*pair(spark, sf)).select("doc", "ord", "item_key", "quantity")


@query(f"""WITH {_ITEMS}, r AS (SELECT doc, {_name("item_key")} AS n, {_unit("unit")} AS u, coalesce(quantity, 0) AS q FROM req),
e AS (SELECT *, {_name("item_key")} AS n, {_unit("unit")} AS u, coalesce(quantity, 0) AS q FROM est)
SELECT doc, ord, item_key, unit, quantity FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc = e.doc AND r.u = e.u AND abs(r.q - e.q) < 0.001
  AND (contains(r.n, e.n) OR contains(e.n, r.n) OR (len(r.n) > 10 AND len(e.n) > 10 AND abs(len(r.n) - len(e.n)) <= 2 AND substr(r.n, 1, 10) = substr(e.n, 1, 10))))""")
def extra_simplified(spark, sf):
    return match.extra_simplified(*pair(spark, sf)).select("doc", "ord", "item_key", "unit", "quantity")


_KEY = "regexp_replace(ref, '^(.)(\\d+)号$', '\\1:\\2') AS key"
#: The walk row by row: each step takes the next requested row of a subtable and the list of rows used so far.
_GREEDY = f"""WITH RECURSIVE {_ITEMS},
rr AS (SELECT doc, {_KEY}, ord, quantity, unit, {_name("item_key")} AS n FROM req),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc, key ORDER BY ord) AS i, list_concat({_pairs("n")}, list_filter(regexp_extract_all(n, '\\d+|\\D+'), lambda t: len(t) >= 2)) AS tokens FROM rr),
ee AS (SELECT doc, {_KEY}, ord, quantity, unit, {_name("item_key")} AS n FROM est),
es AS (SELECT doc, key, list({{'o': ord, 'n': n}} ORDER BY ord) AS es FROM ee GROUP BY ALL),
g AS (SELECT doc, key, es FROM (SELECT DISTINCT doc, key FROM rk) FULL JOIN es USING (doc, key)),
s AS (
  SELECT doc, key, coalesce(es, []) AS es, 0 AS i, CAST([] AS INTEGER[]) AS used, CAST(NULL AS INTEGER) AS req_ord, CAST(NULL AS INTEGER) AS est_ord, CAST(NULL AS VARCHAR) AS how FROM g
  UNION ALL
  SELECT doc, key, es, i, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, req_ord, coalesce(hit, own), how FROM (
    SELECT *, coalesce(x, y, z) AS hit, CASE WHEN x IS NOT NULL THEN 'exact' WHEN y IS NOT NULL THEN 'all' WHEN z IS NOT NULL THEN 'any' ELSE 'missing' END AS how,
           CASE WHEN list_contains(list_transform(free, lambda f: f.o), es[i].o) THEN es[i].o ELSE free[1].o END AS own
    FROM (SELECT doc, key, es, rk_i AS i, used, ord AS req_ord, free, list_filter(free, lambda f: f.n = n)[1].o AS x,
                 list_filter(free, lambda f: coalesce(list_bool_and(list_transform(tokens, lambda t: contains(f.n, t))), true))[1].o AS y,
                 list_filter(free, lambda f: coalesce(list_bool_or(list_transform(tokens, lambda t: contains(f.n, t))), false))[1].o AS z
          FROM (SELECT s.doc, s.key, s.es, s.used, rk.i AS rk_i, rk.ord, rk.n, rk.tokens, list_filter(s.es, lambda f: NOT list_contains(s.used, f.o)) AS free
                FROM s JOIN rk ON rk.doc = s.doc AND rk.key = s.key AND rk.i = s.i + 1)))),
last AS (SELECT doc, key, arg_max(used, i) AS used, any_value(es) AS es FROM s GROUP BY ALL),
pairs AS (
  SELECT doc, key, req_ord, est_ord, how FROM s WHERE i > 0
  UNION ALL SELECT doc, key, NULL, unnest(list_transform(list_filter(es, lambda f: NOT list_contains(used, f.o)), lambda f: f.o)), 'extra' FROM last),
gm AS (SELECT p.doc, p.key, CAST(req_ord AS BIGINT) AS req_ord, CAST(est_ord AS BIGINT) AS est_ord, how, r.quantity AS req_quantity, r.unit AS req_unit, e.quantity AS est_quantity, e.unit AS est_unit
      FROM pairs p LEFT JOIN rr r ON r.doc = p.doc AND r.ord = p.req_ord LEFT JOIN ee e ON e.doc = p.doc AND e.ord = p.est_ord)"""


@query(f"{_GREEDY} SELECT * FROM gm")
def subtable_greedy_match(spark, sf):
    return match.greedy(*pair(spark, sf))


@query(f"""{_GREEDY} SELECT doc, key, req_ord, est_ord, how, CASE WHEN how IN ('missing', 'extra') THEN upper(how)
  WHEN CASE WHEN req_quantity IS NULL THEN est_quantity IS NULL ELSE abs(coalesce(est_quantity, 0) - req_quantity) >= 0.001 END THEN 'QUANTITY_MISMATCH'
  WHEN {_unit("req_unit")} <> {_unit("est_unit")} THEN 'UNIT_MISMATCH' WHEN how <> 'exact' THEN 'NAME_MISMATCH' ELSE 'OK' END AS status,
  CASE WHEN how = 'exact' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS match_confidence FROM gm""")
def subtable_status(spark, sf):
    return match.subtable_status(match.greedy(*pair(spark, sf)))


_OVERLAP = f"""WITH {_ITEMS}, r AS (SELECT doc, ord AS req_ord, unnest(list_distinct({_pairs(_name("item_key"))})) AS p FROM req),
e AS (SELECT doc, ord AS est_ord, unnest(list_distinct({_pairs(_name("item_key"))})) AS p FROM est),
s AS (SELECT doc, req_ord, est_ord, count(*) AS shared FROM r JOIN e USING (doc, p) GROUP BY ALL)"""


@query(f"{_OVERLAP} SELECT * FROM s")
def token_overlap_join(spark, sf):
    return match.token_overlap(*pair(spark, sf))


@query(f"{_OVERLAP} SELECT *, CAST(row_number() OVER (PARTITION BY doc, req_ord ORDER BY shared DESC, est_ord) AS INTEGER) AS rank FROM s QUALIFY rank <= 2")
def best_candidate_topk(spark, sf):
    return match.best_candidate(*pair(spark, sf), k=2)


def _ratio(a: str, b: str) -> str:
    """Twice the longest common subsequence over both lengths, in percent; a bit of v that is 0 marks a place of b where it grows."""
    full = f"((1::BIGINT << len({b})::INTEGER) - 1)"
    masks = f"list_transform(string_split({a}, ''), lambda c: CAST(list_sum(list_transform(range(len({b})), lambda j: CASE WHEN substr({b}, j + 1, 1) = c THEN 1::BIGINT << j::INTEGER ELSE 0 END)) AS BIGINT))"
    v = f"list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v & ~m)) & {full})"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE 200.0::DOUBLE * (len({b}) - bit_count({v})) / (len({a}) + len({b})) END)"


@query(f"""WITH {_ITEMS}, r AS (SELECT doc, ord AS req_ord, {_name("item_key")} AS n FROM req), e AS (SELECT doc, ord AS est_ord, {_name("item_key")} AS o FROM est),
x AS (SELECT r.doc, req_ord, est_ord, {_ratio("n", "o")} AS ratio FROM r JOIN e ON r.doc = e.doc WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.doc = r.doc AND f.o = r.n))
SELECT * FROM x WHERE ratio >= 80 QUALIFY row_number() OVER (PARTITION BY doc, req_ord ORDER BY ratio DESC, est_ord) = 1""")
def fuzzy_best_match(spark, sf):
    return match.fuzzy_best(*pair(spark, sf))


@query(f"""WITH {_ITEMS}, k AS (SELECT doc, ord, {_name("item_key")} AS n FROM req)
SELECT doc, ord, CASE WHEN i = 1 THEN n ELSE n || '_dup_' || (i - 1) END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY doc, n ORDER BY ord) AS i FROM k)""")
def duplicate_keys(spark, sf):
    return match.number_duplicates(requested(spark, sf))


@query(f"SELECT p_partkey, {_name('p_name')} AS normalized, array_to_string(list_sort(list_distinct({_pairs(_name('p_name'))})), ' ') AS pairs FROM part")
def normalize_name(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.name(F.col("p_name")).alias("normalized"), F.array_join(F.filter(text.tokens(F.col("p_name")), lambda t: F.length(t) == 2), " ").alias("pairs"))


@query(f"WITH {_ITEMS} SELECT doc, ord, {_unit('unit')} AS unit FROM est")
def normalize_unit(spark, sf):
    return pair(spark, sf)[1].select("doc", "ord", text.unit(F.col("unit")).alias("unit"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN '内' || s_suppkey || '号施' ELSE '明:' || s_suppkey END AS ref_key FROM supplier")
def ref_key(spark, sf):
    k = F.col("s_suppkey").cast("string")
    ref = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("明 "), k, F.lit("号"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("第"), k, F.lit("号明-2"))).otherwise(F.concat(F.lit("内"), k, F.lit("号施")))
    return table(spark, sf, "supplier").select("s_suppkey", text.ref_key(ref).alias("ref_key"))


@query("SELECT o_orderkey, o_totalprice AS amount, CAST(regexp_extract(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '^\\d+') AS DOUBLE) AS whole FROM orders")
def parse_quantity(spark, sf):
    t = F.concat(F.format_number("o_totalprice", 2), F.lit(" 円"))
    whole = text.split_quantity(F.regexp_extract(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), "^\\d+", 0), F.lit("x"), F.lit(None).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", text.quantity(t).alias("amount"), whole.alias("whole"))


@query("SELECT p_partkey, CAST(p_retailprice AS BIGINT) || CASE WHEN p_partkey % 2 = 0 THEN 'm2' ELSE '本' END AS title, p_partkey % 3 <> 0 AS hit FROM part WHERE CAST(p_retailprice AS BIGINT) >= 0")
def title_qty_unit_match(spark, sf):
    q = F.bround("p_retailprice").cast("long").cast("string")
    u = F.when(F.col("p_partkey") % 2 == 0, "m2").otherwise("本")
    asked = F.when(F.col("p_partkey") % 3 == 0, F.concat(q, F.lit("9999"))).otherwise(q)
    return table(spark, sf, "part").select("p_partkey", F.concat(q, u).alias("title"), text.title_has(F.concat(q, u), asked, u).alias("hit"))


_REFS = f"""WITH {_ITEMS}, l AS (SELECT DISTINCT doc, ref FROM req), r AS (SELECT DISTINCT doc, ref FROM est),
f AS (SELECT coalesce(l.doc, r.doc) AS doc, regexp_replace(coalesce(l.ref, r.ref), '^(.)(\\d+)号$', '\\1:\\2') AS key,
  CASE WHEN r.doc IS NULL THEN 'left' WHEN l.doc IS NULL THEN 'right' ELSE 'both' END AS side FROM l FULL JOIN r ON l.doc = r.doc AND l.ref = r.ref)"""


def _titles(spark, sf):
    req, est = (x.withColumn("title", F.lit(None).cast("string")).withColumn("quantity", F.col("quantity").cast("string")) for x in pair(spark, sf))
    return match.titles(req, est).select("doc", "key", "side")


@query(f"{_REFS} SELECT * FROM f")
def ref_full_outer(spark, sf):
    return _titles(spark, sf)


@query(f"{_REFS} SELECT doc, key FROM f WHERE side = 'left'")
def left_only_refs(spark, sf):
    return _titles(spark, sf).where("side = 'left'").select("doc", "key")


@query(f"{_REFS} SELECT doc, key FROM f WHERE side = 'right'")
def right_only_refs(spark, sf):
    return _titles(spark, sf).where("side = 'right'").select("doc", "key")


@query(f"WITH {_ITEMS} SELECT ref, min(doc) AS first_page, count(*) AS n_rows FROM req GROUP BY ref")
def first_page_per_ref(spark, sf):
    return requested(spark, sf).groupBy("ref").agg(F.min("doc").alias("first_page"), F.count("*").alias("n_rows"))


@query("""SELECT CAST(s_nationkey AS INTEGER) AS sheet, pattern, grouping(s_nationkey) = 1 AS overall, count(*) AS n FROM (SELECT *, ['内', '単', '代', '施', 'Other'][CAST(s_suppkey % 5 + 1 AS INTEGER)] AS pattern FROM supplier)
GROUP BY GROUPING SETS ((s_nationkey, pattern), (pattern))""")
def ref_pattern_rollup(spark, sf):
    ref = F.concat(F.element_at(F.array(*map(F.lit, ("内", "単", "代", "施", "明"))), (F.col("s_suppkey") % 5 + 1).cast("int")), F.col("s_suppkey").cast("string"), F.lit("号"))
    return report.pattern_histogram(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("sheet"), ref.alias("ref")))


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("purchase", F.when(F.col("event_type") == "purchase", F.col("value")))


_BY, _ORDER = ["user_id"], ["ts", "event_id"]
_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN"


@query(f"SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) {_W} UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events")
def forward_fill(spark, sf):
    return _events(spark, sf).select("event_id", grid.forward_fill(F.col("purchase"), _BY, _ORDER).alias("filled"))


@query(f"""SELECT event_id, coalesce(CASE WHEN event_type = 'purchase' THEN value END, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
 {_W} 1 FOLLOWING AND 4 FOLLOWING)) AS filled FROM events""")
def bounded_lookahead(spark, sf):
    return _events(spark, sf).select("event_id", grid.lookahead_fill(F.col("purchase"), _BY, _ORDER).alias("filled"))


@query(f"""SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) {_W} UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment,
 CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) {_W} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment_after FROM events""")
def segment_by_marker(spark, sf):
    kind = F.col("event_type")
    return _events(spark, sf).select("event_id", grid.segment(kind == "signup", _BY, _ORDER).alias("segment"), grid.segment_after(kind == "error", _BY, _ORDER).alias("segment_after"))


@query(f"""SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS before_marker FROM (
 SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) {_W} UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM events) WHERE m = 0 GROUP BY user_id""")
def prefix_sum_before_marker(spark, sf):
    kept = _events(spark, sf).withColumn("keep", grid.before_marker(F.col("event_type") == "signup", _BY, _ORDER)).where("keep")
    return kept.groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("before_marker"))


@query(f"""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) {_W} UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
 first_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) {_W} CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM events""")
def nearest_marker(spark, sf):
    m, v = F.col("event_type") == "signup", F.col("event_id")
    return _events(spark, sf).select("event_id", grid.nearest_before(m, v, _BY, _ORDER).alias("before"), grid.nearest_after(m, v, _BY, _ORDER).alias("after"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 2")
def nth_from_end(spark, sf):
    w = W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return _events(spark, sf).withColumn("n", F.row_number().over(w)).where("n = 2").select("user_id", "event_id")


@query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS ordinal,
 CASE WHEN n = 1 THEN event_type ELSE event_type || '-' || n END AS label FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)""")
def repeat_suffix(spark, sf):
    w = W.partitionBy("user_id").orderBy(*_ORDER)
    return _events(spark, sf).select("event_id", F.row_number().over(w).alias("ordinal"), grid.repeat_suffix("event_type", _BY, _ORDER).alias("label"))


@query("""WITH s AS (SELECT user_id, ts AS t0, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t1, event_id AS article FROM events WHERE event_type = 'signup')
SELECT e.event_id, s.article FROM events e JOIN s ON e.user_id = s.user_id AND e.ts >= t0 AND (t1 IS NULL OR e.ts < t1)""")
def article_intervals(spark, sf):
    e = _events(spark, sf)
    w = W.partitionBy("doc").orderBy("start_page", "article")
    heads = e.where("event_type = 'signup'").select(F.col("user_id").alias("doc"), F.col("ts").alias("start_page"), F.col("event_id").alias("article"))
    spans = heads.withColumn("end_page", F.lead("start_page").over(w))
    return spec.article_pages(spans, e.select(F.col("user_id").alias("doc"), F.col("ts").alias("page"), "event_id")).select("event_id", "article")


#: Names of a customer's orders in turn, the totals of an estimate among them, and of an order's lines.
TOPS = ("工種", "工種", tree.DIRECT, "工種", tree.NET, tree.COST, tree.PRICE, tree.TAX_ALT, tree.TOTAL)
KIDS = ("　" + tree.SITE, "　細別", "　細別", "　" + tree.GENERAL, "　細別")


def _list(names: tuple[str, ...]) -> str:
    return "['" + "', '".join(names) + "']"


def _sheet(spark, sf):
    """Orders and their lines as the rows of one estimate sheet per customer: level by position."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    a = o.select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") * 100).alias("seq"), F.element_at(F.array(*map(F.lit, TOPS)), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) % len(TOPS) + 1).alias("item_name"), F.lit(0).alias("level"), F.col("o_totalprice").alias("amount"), F.lit(None).cast("double").alias("unit_price"), F.lit(None).cast("double").alias("quantity"))
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER))
    b = li.withColumn("n", n).join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    b = b.select(F.col("o_custkey").alias("doc"), (F.col("l_orderkey") * 100 + F.col("n")).alias("seq"), F.element_at(F.array(*map(F.lit, KIDS)), F.col("n") % len(KIDS) + 1).alias("item_name"), (F.col("n") % 3 + 1).alias("level"), F.col("l_extendedprice").alias("amount"), price.alias("unit_price"), F.col("l_quantity").alias("quantity"))
    return a.unionByName(b)


_SHEET = f"""s AS (
  SELECT o_custkey AS doc, o_orderkey * 100 AS seq, {_list(TOPS)}[CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) % {len(TOPS)} + 1 AS INTEGER)] AS item_name, 0 AS level, o_totalprice AS amount, NULL::DOUBLE AS unit_price, NULL::DOUBLE AS quantity FROM orders
  UNION ALL SELECT o_custkey, l_orderkey * 100 + n, {_list(KIDS)}[CAST(n % {len(KIDS)} + 1 AS INTEGER)], CAST(n % 3 + 1 AS INTEGER), l_extendedprice, round(l_extendedprice / l_quantity, 2), l_quantity
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS n FROM lineitem) JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT *, greatest({", ".join(f"CASE WHEN level > {k} THEN last_value(CASE WHEN level = {k} THEN seq END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END" for k in range(4))}) AS parent_seq FROM s)"""


def _tree(spark, sf):
    return tree.with_parent(_sheet(spark, sf), F.col("level"))


@query(f"WITH {_SHEET} SELECT doc, seq, level, parent_seq FROM t")
def tree_parent(spark, sf):
    return _tree(spark, sf).select("doc", "seq", "level", "parent_seq")


@query(f"WITH {_SHEET} SELECT doc, parent_seq, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS children_sum, count(*) AS children FROM t WHERE parent_seq IS NOT NULL GROUP BY ALL")
def children_sum_check(spark, sf):
    return tree.children_sums(_tree(spark, sf)).withColumn("children_sum", F.col("children_sum").cast("double"))


@query(f"WITH {_SHEET} SELECT doc, seq, abs(round(unit_price * quantity, 4) - amount) <= 0.01 + 1e-9 AS ok FROM s WHERE level > 0")
def row_amount_check(spark, sf):
    return tree.check_rows(_sheet(spark, sf)).where("level > 0").select("doc", "seq", "ok")


#: z: level-0 rows with what they should be; each segment ends with its total, whose parts are looked up by name.
_CHAIN = f"""{_SHEET}, a AS (SELECT *, CAST(amount AS DECIMAL(18,2)) AS m FROM t),
k AS (SELECT doc, parent_seq AS seq, sum(m) AS c, max(m) FILTER (item_name = '　{tree.SITE}') AS site, max(m) FILTER (item_name = '　{tree.GENERAL}') AS general FROM a WHERE parent_seq IS NOT NULL GROUP BY ALL),
z0 AS (SELECT a.doc, a.seq, item_name AS name, m, c, coalesce(site, 0) AS site, coalesce(general, 0) AS general,
         (SELECT count(*) FROM a b WHERE b.doc = a.doc AND b.level = 0 AND b.item_name = '{tree.TOTAL}' AND b.seq < a.seq) AS seg FROM a LEFT JOIN k ON a.doc = k.doc AND a.seq = k.seq WHERE level = 0),
z1 AS (SELECT *, coalesce((SELECT sum(m) FROM z0 b WHERE b.doc = z0.doc AND b.seg = z0.seg AND b.seq < z0.seq), 0) AS before FROM z0),
g AS (SELECT doc, seg, {", ".join(f"max(m) FILTER (name = '{x}') AS {y}" for x, y in ((tree.DIRECT, "direct"), (tree.NET, "net"), (tree.COST, "cost"), (tree.PRICE, "price"), (tree.TAX_ALT, "tax")))},
        max(before) FILTER (name = '{tree.DIRECT}') AS bd FROM z1 GROUP BY ALL),
z AS (SELECT z1.doc, z1.seq, m AS actual, CASE name WHEN '{tree.DIRECT}' THEN before WHEN '{tree.NET}' THEN direct + (before - bd - direct) WHEN '{tree.COST}' THEN net + site
        WHEN '{tree.PRICE}' THEN cost + general WHEN '{tree.TOTAL}' THEN price + coalesce(tax, 0) WHEN '{tree.TAX_ALT}' THEN m ELSE coalesce(c, m) END AS expected FROM z1 JOIN g USING (doc, seg))"""


@query(f"WITH {_CHAIN} SELECT doc, seq, CAST(actual AS DOUBLE) AS actual, CAST(expected AS DOUBLE) AS expected FROM z")
def grand_total_chain(spark, sf):
    c = tree.check_amounts(_tree(spark, sf))
    return c.select("doc", "seq", F.col("actual").cast("double").alias("actual"), F.col("expected").cast("double").alias("expected"))


@query(f"WITH {_SHEET} SELECT doc, min(seq) AS seq, level FROM s WHERE level > 0 AND NOT abs(round(unit_price * quantity, 4) - amount) <= 0.01 + 1e-9 GROUP BY doc, level, item_name")
def mismatch_dedupe(spark, sf):
    bad = tree.check_rows(_sheet(spark, sf)).where("level > 0 and not ok").withColumn("reference_number", F.lit(None).cast("string")).withColumn("table_number", F.lit(None).cast("string"))
    return tree.first_mismatches(bad).select("doc", "seq", "level")


@query("""WITH RECURSIVE n AS (
 SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
p AS (SELECT id, name AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, p.path || '/' || n.name FROM n JOIN p ON n.parent = p.id) SELECT * FROM p""")
def tree_paths(spark, sf):
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, sf, "region").select(F.lit(1).alias("doc"), k("r", "r_regionkey").alias("seq"), F.lit(None).cast("string").alias("parent_seq"), F.col("r_name").alias("item_name"))
    n = table(spark, sf, "nation").select(F.lit(1).alias("doc"), k("n", "n_nationkey").alias("seq"), k("r", "n_regionkey").alias("parent_seq"), F.col("n_name").alias("item_name"))
    c = table(spark, sf, "customer").select(F.lit(1).alias("doc"), k("c", "c_custkey").alias("seq"), k("n", "c_nationkey").alias("parent_seq"), F.col("c_name").alias("item_name"))
    return tree.with_path(r.unionByName(n).unionByName(c)).select(F.col("seq").alias("id"), "path")


@query("""SELECT doc_id, nullif(regexp_extract(text, 'token = "([0-9a-f]+)"', 1), '') AS token FROM documents WHERE contains(text, 'token = ')""")
def field_regex_extract(spark, sf):
    d = table(spark, sf, "documents").where(F.contains("text", F.lit("token = ")))
    return d.select("doc_id", text.field(F.col("text"), 'token = "([0-9a-f]+)"').alias("token"))


@query("SELECT o_orderkey, CAST(o_orderkey % 4 AS VARCHAR) AS category FROM orders WHERE o_orderkey % 4 <> 0")
def fee_rows_filter(spark, sf):
    o = table(spark, sf, "orders").withColumn("note", F.concat(F.lit("摘要 管理費区分："), (F.col("o_orderkey") % 4).cast("string")))
    return spec.fee_rows(o, "note").select("o_orderkey", "category")


@query("""SELECT count(*) FILTER (epoch(TIMESTAMP '2024-01-02') <= c + 1800) AS active, count(*) FILTER (epoch(TIMESTAMP '2024-01-02') > c + 1800) AS expired,
 CAST(coalesce(sum(n) FILTER (epoch(TIMESTAMP '2024-01-02') <= c + 1800), 0) AS BIGINT) AS items FROM (SELECT user_id, epoch(max(ts)) AS c, count(*) AS n FROM events GROUP BY user_id)""")
def session_ttl_stats(spark, sf):
    s = _events(spark, sf).groupBy("user_id").agg(F.max("ts").cast("timestamp").cast("double").alias("created"), F.count("*").alias("items"))
    return session.stats(s, F.lit(1704153600.0))


@query("""WITH RECURSIVE h AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
w AS (SELECT key, min(ts) AS t0 FROM h GROUP BY 1 UNION ALL SELECT w.key, min(h.ts) FROM w JOIN h ON h.key = w.key AND h.ts > w.t0 + 3600 GROUP BY w.key, w.t0),
r AS (SELECT h.key, h.ts, row_number() OVER (PARTITION BY h.key, w.t0 ORDER BY h.n) AS place FROM h JOIN (SELECT *, lead(t0) OVER (PARTITION BY key ORDER BY t0) AS t1 FROM w) w ON h.key = w.key AND h.ts >= t0 AND (t1 IS NULL OR h.ts < t1))
SELECT key, ts, place <= 5 AS allowed, CAST(least(place, 5) AS INTEGER) AS used FROM r""")
def rate_limit_fixed_window(spark, sf):
    return limiter.limit_batch(_events(spark, sf).select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("ts")), window=3600.0)


@query(f"""WITH {_ITEMS}, {_COMPARE} SELECT 'extra' AS report, doc, ord, est_item_key AS name, NULL AS status FROM c WHERE status = 'EXTRA'
UNION ALL SELECT 'missing', doc, ord, req_item_key, NULL FROM c WHERE status = 'MISSING' UNION ALL SELECT 'unit', doc, ord, req_item_key, status FROM c WHERE status = 'UNIT_MISMATCH'""")
def union_report(spark, sf):
    s = F.col("status")
    out = report.tagged(_compared(spark, sf), extra=s == "EXTRA", missing=s == "MISSING", unit=s == "UNIT_MISMATCH")
    name = F.when(F.col("report") == "extra", F.col("est_item_key")).otherwise(F.col("req_item_key"))
    return out.select("report", "doc", "ord", name.alias("name"), F.when(F.col("report") == "unit", s).alias("status"))


@query("""SELECT o_orderkey AS section_no, r AS row_no, c AS col_no, CASE WHEN r = 0 THEN o_orderpriority WHEN r = 1 AND c = 0 THEN 'price' WHEN r = 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
 WHEN c = 0 THEN 'status' ELSE o_orderstatus END AS value FROM orders, (VALUES (0, 0), (1, 0), (1, 1), (2, 0), (2, 1)) v(r, c)""")
def checklist_rows(spark, sf):
    o = table(spark, sf, "orders")
    fields = F.create_map(F.lit("price"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("status"), F.col("o_orderstatus"))
    return report.checklist(o.select(F.col("o_orderkey").alias("section_no"), F.col("o_orderpriority").alias("title"), fields.alias("fields")))


@query("""SELECT l_orderkey AS doc, count(*) FILTER (l_linenumber % 2 = 1) AS items FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber % 2 = 1) > 0""")
def spanning_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    odd = F.col("l_linenumber") % 2 == 1
    rows = li.select(F.col("l_orderkey").alias("doc"), *ORDER, F.when(odd, F.lit("名称")).otherwise(F.lit("")).alias("name"))
    items = grid.pair_rows(rows, ["doc"], list(ORDER), F.col("name"), F.col("l_quantity"), F.lit("m"))
    return items.groupBy("doc").agg(F.count("*").alias("items"))

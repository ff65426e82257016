"""Mixing sources to target weights by hierarchical budgets over a domain-language-source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridrecon.llm.common import written

LEVELS = ("domain", "lang", "source")
#: Hash prefixes (hex digits) into which a leaf's epoch order is cut, so that no leaf's documents meet in one task.
PREFIX = 3
BIG = "decimal(38,0)"


def tokens(text: Column) -> Column:
    """Words of the whole text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def share(nodes: DataFrame, parent: list[str], budget: str, cap: str, weight: str, out: str) -> DataFrame:
    """nodes with out: what each gets of its parent's budget, at most its cap, in proportion to its weight.

    Water filling in closed form: in order of cap per weight a node is full if the budget, were every later
    sibling filled to the same level, still covers it; the rest share what is left. Quotas are floored. Nodes of
    weight 0 get nothing unless all siblings have 0; then each counts as 1.
    """
    among = W.partitionBy(*parent)
    nodes = nodes.withColumn("_w", F.when(F.sum(weight).over(among) > 0, F.col(weight)).otherwise(F.lit(1)).cast("long"))
    name = [c for c in LEVELS if c in nodes.columns]
    order = among.orderBy(F.when(F.col("_w") > 0, F.col(cap) / F.col("_w")).asc_nulls_last(), *name)
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    big = lambda c: F.col(c).cast(BIG)
    nodes = nodes.withColumn("_before", F.coalesce(F.sum(cap).over(before), F.lit(0)).cast("long")).withColumn("_rest", F.sum("_w").over(rest))
    nodes = nodes.withColumn("_full", (F.col("_w") > 0) & (big("_before") * big("_w") + big(cap) * big("_rest") <= big(budget) * big("_w")))
    nodes = nodes.withColumn("_left", (F.col(budget) - F.sum(F.when(F.col("_full"), F.col(cap)).otherwise(0)).over(among)).cast("long"))
    nodes = nodes.withColumn("_share", F.sum(F.when(~F.col("_full"), F.col("_w")).otherwise(0)).over(among).cast("long"))
    part = F.expr(f"cast(floor(cast(_left as {BIG}) * cast(_w as {BIG}) / cast(_share as {BIG})) as long)")
    got = F.when(F.col("_full"), F.col(cap)).when(F.col("_w") == 0, F.lit(0).cast("long")).otherwise(F.least(F.col(cap), part))
    return nodes.withColumn(out, got.cast("long")).drop("_w", "_before", "_rest", "_full", "_left", "_share")


def budgets(leaves: DataFrame, total: Column, epochs: int, weights: dict[tuple[str, ...], int] | None = None) -> DataFrame:
    """leaves (domain, lang, source, available) with quota: tokens to take of each.

    A node can give at most epochs times its tokens, and nothing if its weight is 0 and a sibling's is not. Each level's
    budgets are dealt to the children by weight; what a child can't use goes to its siblings first, as only what a whole
    node can't use was left above.
    weights: path of names -> integer weight, 1 where not named.
    """
    weights = weights or {}

    def weight(depth: int) -> Column:
        at = {k: v for k, v in weights.items() if len(k) == depth}
        if not at:
            return F.lit(1).cast("long")
        path = F.concat_ws("\u0001", *(F.coalesce(c, F.lit("\u0002")) for c in LEVELS[:depth]))
        table = F.create_map(*(F.lit(x) for k, v in at.items() for x in ("\u0001".join("\u0002" if p is None else p for p in k), int(v))))
        return F.coalesce(F.element_at(table, path), F.lit(1)).cast("long")

    def usable(nodes: DataFrame, depth: int, parent: list[str]) -> DataFrame:
        nodes = nodes.withColumn("weight", weight(depth))
        idle = (F.col("weight") <= 0) & (F.sum("weight").over(W.partitionBy(*parent)) > 0)
        return nodes.withColumn("cap", F.when(idle, F.lit(0)).otherwise(F.col("cap")).cast("long"))

    leaves = leaves.withColumn("cap", (F.col("available") * epochs).cast("long"))
    asked = leaves.agg(total.cast("long").alias("total"))  # one row
    leaves = usable(leaves, 3, ["domain", "lang"])
    two = usable(leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")), 2, ["domain"])
    one = usable(two.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("top", F.lit(0)), 1, ["top"])
    one = one.crossJoin(F.broadcast(asked)).withColumn("budget", F.least(F.sum("cap").over(W.partitionBy("top")), F.col("total")))
    one = share(one, ["top"], "budget", "cap", "weight", "quota")
    same = lambda a, b, on: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in on))
    two = two.alias("l").join(one.select("domain", F.col("quota").alias("budget")).alias("r"), same("l", "r", ["domain"])).select("l.*", "r.budget")
    two = share(two, ["domain"], "budget", "cap", "weight", "quota")
    out = leaves.alias("l").join(two.select("domain", "lang", F.col("quota").alias("budget")).alias("r"), same("l", "r", ["domain", "lang"])).select("l.*", "r.budget")
    return share(out, ["domain", "lang"], "budget", "cap", "weight", "quota").drop("budget", "weight")


def select(docs: DataFrame, domain: Column, fraction: float, epochs: int = 2, seed: int = 7, weights: dict | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies): how often each document is taken; rows never taken are left out.

    The budget is fraction of all tokens. A leaf takes whole epochs as often as its quota allows, then of the next
    epoch's order (by a keyed hash of the id; ties by id) the longest prefix whose tokens fit the rest. The order is cut by
    hash prefix: sums of the cuts find the one in which the prefix ends, and only its documents are put in line.
    Null names are names of their own, a null text has no tokens; rows repeating an id stand in line together;
    rows with a null id come first. Empty input: no rows. Other columns are ignored.
    """
    d = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), domain.cast("string").alias("domain"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), tokens(F.col("text").cast("string")).alias("n_tokens"),
    )
    d = written(d, "mix")
    leaves = d.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("available"))
    total = F.floor(F.sum("cap") / epochs * F.lit(fraction))
    quota = budgets(leaves, total, epochs, weights)
    quota = quota.select(
        *LEVELS, F.expr("if(available > 0, quota div available, 0)").alias("whole"), F.expr("if(available > 0, quota % available, 0)").alias("part")
    )
    quota = written(quota, "quota")
    on = F.expr(" and ".join(f"l.{c} <=> r.{c}" for c in LEVELS))
    d = d.alias("l").join(quota.alias("r"), on).select("l.*", "r.whole", "r.part")
    d = d.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    d = d.withColumn("cut", F.substring("h", 1, PREFIX))
    cuts = d.groupBy(*LEVELS, "cut").agg(F.sum("n_tokens").alias("size"), F.first("part").alias("part"))
    w = W.partitionBy(*LEVELS).orderBy("cut").rowsBetween(W.unboundedPreceding, 0)
    cuts = cuts.withColumn("upto", F.sum("size").over(w))
    cuts = written(cuts.select(*LEVELS, "cut", F.expr("upto <= part").alias("all"), F.expr("part - upto + size").alias("rest")), "cuts")
    on = F.expr(" and ".join(f"l.{c} <=> r.{c}" for c in (*LEVELS, "cut")))
    d = d.alias("l").join(cuts.where("rest >= 0").alias("r"), on, "left").select("l.*", F.coalesce("r.all", F.lit(False)).alias("all"), "r.rest")
    sure = d.where("all or rest is null").select("*", F.col("all").cast("int").alias("more"))
    line = W.partitionBy(*LEVELS, "cut").orderBy(F.struct("h", "doc_id")).rangeBetween(W.unboundedPreceding, W.currentRow)
    edge = d.where("not all and rest is not null").withColumn("run", F.sum("n_tokens").over(line))
    edge = edge.select(*(c for c in edge.columns if c != "run"), F.expr("cast(run <= rest as int)").alias("more"))
    both = sure.unionByName(edge)
    return both.select("doc_id", *LEVELS, "n_tokens", (F.col("whole") + F.col("more")).cast("long").alias("copies")).where("copies > 0")

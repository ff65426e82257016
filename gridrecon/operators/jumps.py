"""Marks that are spaced by a gap, found by pointers that double: each mark points to the first one far enough behind it.

Which mark counts depends on the one taken before, so a walk would need all marks of a group in one task. Here a group is any number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrecon.operators import scan
from gridrecon.operators.stored import written


def successors(marks: DataFrame, by: list[str], at: str, gap: float, strict: bool, parts: int | None = None) -> DataFrame:
    """by, at, next: the first mark of the group more than gap (not strict: at least gap) behind each; null: none.

    A search in the sorted marks: each mark and the place from which its next one is looked for go into one order.
    """
    probe = F.struct((F.col(at) + gap).alias("t"), F.lit(1 if strict else 0).alias("kind"), F.col(at).alias("own"))
    mark = F.struct(F.col(at).alias("t"), F.lit(0 if strict else 1).alias("kind"), F.lit(None).cast(marks.schema[at].dataType).alias("own"))
    both = marks.select(*by, F.explode(F.array(mark, probe)).alias("x")).select(*by, "x.*")
    out = scan.running(both, by, ["t", "kind"], parts, next=scan.following(F.when(F.col("own").isNull(), F.col("t")), own=False))
    return out.where("own is not null").select(*by, F.col("own").alias(at), "next")


def spaced(marks: DataFrame, by: list[str], at: str, gap: float, strict: bool = False, parts: int | None = None) -> DataFrame:
    """(by, at) of the marks taken: a group's first one, and after each taken one the first that is at least gap (strict: more) behind it.

    The k-th round adds what 2^k pointers lead to from the marks so far, then pointers are joined with themselves, so n taken marks of a
    group need about log2(n) rounds, each a table of the shared folder. Repeated marks count once; rows with a null are left out; gap > 0.
    """
    marks = marks.select(*by, at).where(" and ".join(f"`{c}` is not null" for c in (*by, at))).distinct()
    jump = written(successors(marks, by, at, gap, strict, parts), "jumps")
    new = written(marks.groupBy(*by).agg(F.min(at).alias(at)), "taken")
    taken = new
    while True:
        new = written(taken.join(jump.where("next is not null"), [*by, at]).select(*by, F.col("next").alias(at)), "taken")
        if not new.head(1):
            return taken
        taken = taken.unionByName(new)
        far = jump.select(*by, F.col(at).alias("next"), F.col("next").alias("_far"))
        jump = written(jump.where("next is not null").join(far, [*by, "next"]).select(*by, at, F.col("_far").alias("next")), "jumps")

"""Running values along groups of any size: a group may lie over many tasks.

Rows are cut into ranges of (by, order). Each range gives a summary of each of its groups, the summaries of a group are put together in order,
and what comes before a range is handed to it. A cut divides one group at most, so what is handed on has at most a row a range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridrecon.operators.stored import written

PART = "_part"


@dataclass(frozen=True)
class Running:
    """A running value. kind: last (non-null value so far), next (first non-null value from here on) or total (sum so far, 0 without any).

    own: whether the row itself counts.
    """

    kind: str
    value: Column
    own: bool = True


def last(value: Column, own: bool = True) -> Running:
    return Running("last", value, own)


def following(value: Column, own: bool = True) -> Running:
    return Running("next", value, own)


def total(value: Column, own: bool = True) -> Running:
    return Running("total", value, own)


def count_if(condition: Column, own: bool = True) -> Running:
    return total(F.coalesce(condition, F.lit(False)).cast("long"), own)


def ranges(df: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df with PART, the number of its range of (by, order), in a table of the shared folder; parts defaults to the session's shuffle partitions."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *by, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def running(df: DataFrame, by: list[str], order: list[str], parts: int | None = None, **values: Running) -> DataFrame:
    """df with the running values added under their names. order must tell the rows of a group apart, or ties are in any order.

    Null keys are a group of their own; columns of these names are replaced; an empty table gives an empty table.
    """
    df = df.drop(*values)
    names = df.columns
    for k, v in values.items():
        df = df.withColumn(f"_v_{k}", v.value)
    t = ranges(df, by, order, parts)
    at = F.struct(*order)
    ends = {"last": F.max_by, "next": F.min_by}
    whole = t.groupBy(*by, PART).agg(
        *(F.sum(f"_v_{k}").alias(f"_s_{k}") if v.kind == "total" else ends[v.kind](f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), at)).alias(f"_s_{k}") for k, v in values.items())
    )
    earlier = W.partitionBy(*by).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*by).orderBy(PART).rowsBetween(1, W.unboundedFollowing)
    handed = {
        "last": lambda c: F.last(c, ignorenulls=True).over(earlier), "next": lambda c: F.first(c, ignorenulls=True).over(later), "total": lambda c: F.sum(c).over(earlier),
    }
    carry = whole.withColumn("_n", F.count("*").over(W.partitionBy(*by))).where("_n > 1")
    carry = carry.select(*(F.col(c).alias(f"_b_{i}") for i, c in enumerate(by)), F.col(PART).alias("_b_part"), *(handed[v.kind](F.col(f"_s_{k}")).alias(f"_c_{k}") for k, v in values.items()))
    on = [F.col(c).eqNullSafe(F.col(f"_b_{i}")) for i, c in enumerate(by)] + [F.col(PART) == F.col("_b_part")]
    t = t.join(F.broadcast(carry), on, "left")  # at most two rows a range
    w = W.partitionBy(*by, PART).orderBy(*order)
    up = {own: w.rowsBetween(W.unboundedPreceding, W.currentRow if own else -1) for own in (True, False)}
    down = {own: w.rowsBetween(W.currentRow if own else 1, W.unboundedFollowing) for own in (True, False)}
    out = {}
    for k, v in values.items():
        c, before = F.col(f"_v_{k}"), F.col(f"_c_{k}")
        if v.kind == "total":
            out[k] = F.coalesce(F.sum(c).over(up[v.own]), F.lit(0)) + F.coalesce(before, F.lit(0))
        elif v.kind == "last":
            out[k] = F.coalesce(F.last(c, ignorenulls=True).over(up[v.own]), before)
        else:
            out[k] = F.coalesce(F.first(c, ignorenulls=True).over(down[v.own]), before)
    return t.select(*names, *(c.alias(k) for k, c in out.items()))


# --- positions in trees ----------------------------------------------------------------------------------------------------

_OPEN = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("seq", T.LongType())]))


def ancestors(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows (doc, seq, level) with ancestors: the seqs of the rows that are open above each, from the root down.

    A range's summary of a document is its lowest level and the rows open at its end; those handed on are open still below that level.
    """
    df = rows.drop("ancestors", "_open", "_floor")
    names = df.columns
    t = ranges(df.withColumn("level", F.col("level").cast("int")), ["doc"], ["seq"], parts)
    at = {c: t.columns.index(c) for c in ("doc", "seq", "level", PART)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, above, floor = None, [], 0
        for b in batches:
            opens, floors = [], []
            for d, p, s, n in zip(*(b.column(at[c]).to_pylist() for c in ("doc", PART, "seq", "level"))):
                if (d, p) != key:
                    key, above, floor = (d, p), [], n
                while above and above[-1]["level"] >= n:
                    above.pop()
                floor = min(floor, n)
                opens.append(list(above))
                floors.append(floor)
                above.append({"level": n, "seq": s})
            new = [pa.array(opens, pa.list_(pa.struct([("level", pa.int32()), ("seq", pa.int64())]))), pa.array(floors, pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "_open", "_floor"])

    schema = T.StructType([*t.schema.fields, T.StructField("_open", _OPEN), T.StructField("_floor", T.IntegerType())])
    t = written(t.repartition(PART, "doc").sortWithinPartitions(PART, "doc", "seq").mapInArrow(run, schema), "open")
    end = F.concat("_open", F.array(F.struct("level", F.col("seq").cast("long").alias("seq"))))
    whole = t.groupBy("doc", PART).agg(F.max_by(end, "seq").alias("open"), F.min("level").alias("low"))
    spread = whole.withColumn("n", F.count("*").over(W.partitionBy("doc"))).where("n > 1").select("doc", PART, "open", "low")
    handed, before = [], {}
    for r in sorted(spread.collect(), key=lambda r: r[PART]):  # at most two rows a range, each with one row a level
        held = before.get(r.doc, [])
        handed.append((r.doc, r[PART], held))
        before[r.doc] = [x for x in held if x[0] < r.low] + [(x.level, x.seq) for x in r.open]
    carry = t.sparkSession.createDataFrame(handed, T.StructType([T.StructField("_doc", t.schema["doc"].dataType), T.StructField("_p", T.IntegerType()), T.StructField("_held", _OPEN)]))
    t = t.join(F.broadcast(carry), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col(PART) == F.col("_p")), "left")
    held = F.filter(F.coalesce("_held", F.array().cast(_OPEN)), lambda x: x["level"] < F.col("_floor"))
    return t.select(*names, F.transform(F.concat(held, "_open"), lambda x: x["seq"]).alias("ancestors"))

"""Fixed-window rate limiting anchored at a key's first hit, on batches and on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridrecon.operators import jumps, scan
from gridrecon.operators.stored import has_group_over

LIMIT, WINDOW = 5, 60.0
#: Hits of a key that one task may walk through; a larger key goes by pointers.
LARGEST = 1_000_000
OUT = "key string, ts double, allowed boolean, used int"


def _step(start: float | None, used: int, ts: float, limit: int, window: float) -> tuple[float, int, bool]:
    if start is None or ts > start + window:
        return ts, 1, True
    return (start, used + 1, True) if used < limit else (start, used, False)


def limit_batch(hits: DataFrame, limit: int = LIMIT, window: float = WINDOW, largest: int = LARGEST, parts: int | None = None) -> DataFrame:
    """hits (key, ts seconds) with allowed and used: the window opens at a key's first hit and anew after it has passed.

    Whether a hit opens a window depends on the window before. Hits go by key in order, with one window's start and count held, or, where a
    key has more than largest hits, by ranges and doubling pointers (parts of them), so that no key is one task. Hits with a null are left
    out; of equal hits the first ones are allowed.
    """
    rows = hits.select("key", F.col("ts").cast("double").alias("ts")).where("key is not null and ts is not null")
    return _by_pointers(rows, limit, window, parts) if has_group_over(rows, ["key"], largest) else _by_key(rows, limit, window)


def _by_pointers(rows: DataFrame, limit: int, window: float, parts: int | None) -> DataFrame:
    at = rows.groupBy("key", "ts").agg(F.count("*").alias("n"))
    opens = jumps.spaced(at, ["key"], "ts", window, strict=True, parts=parts).withColumn("opens", F.lit(True))
    at = scan.running(at.join(opens, ["key", "ts"], "left"), ["key"], ["ts"], parts, before=scan.total(F.col("n"), own=False))
    at = scan.running(at, ["key"], ["ts"], parts, start=scan.last(F.when(F.col("opens"), F.col("before"))))
    place = F.col("before") - F.col("start") + F.col("k")
    each = at.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return each.select("key", "ts", (place <= limit).alias("allowed"), F.least(place, F.lit(limit)).cast("int").alias("used"))


def _by_key(rows: DataFrame, limit: int, window: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, start, used = None, None, 0
        for b in batches:
            ok, count = [], []
            for key, ts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key != at:
                    at, start, used = key, None, 0
                start, used, allowed = _step(start, used, ts, limit, window)
                ok.append(allowed)
                count.append(used)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_()), pa.array(count, pa.int32())], ["key", "ts", "allowed", "used"])

    return rows.repartition("key").sortWithinPartitions("key", "ts").mapInArrow(run, OUT)


def limit_stream(hits: DataFrame, limit: int = LIMIT, window: float = WINDOW, late: float = 60.0) -> DataFrame:
    """The same on a stream: start and count of the open window are the key's state.

    hits: key, ts. Hits may come up to late seconds behind; a key's state goes once the watermark has passed its window.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        out = []
        for ts in sorted(t for b in batches for t in b["ts"]):
            start, used, ok = _step(start, used, ts, limit, window)
            out.append((key[0], ts, ok, used))
        state.update((start, used))
        state.setTimeoutTimestamp(max(int((start + window) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["key", "ts", "allowed", "used"])

    timed = hits.select("key", F.col("ts").cast("double").alias("ts")).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", f"{int(late * 1000)} milliseconds")
    return timed.groupBy("key").applyInPandasWithState(run, OUT, "start double, used int", "append", GroupStateTimeout.EventTimeTimeout)


def over_limit(hits: DataFrame, limit: int = LIMIT, seconds: int = 60, late: str = "60 seconds") -> DataFrame:
    """Keys and aligned windows with more than limit hits; on a stream hits may come late, up to the watermark."""
    if hits.isStreaming:
        hits = hits.withWatermark("ts", late)
    return hits.groupBy("key", F.window("ts", f"{seconds} seconds")).count().where(F.col("count") > limit)

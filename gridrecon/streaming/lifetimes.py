"""Lifetimes of sessions from their events (put, extend, get): state with a time to live, over tables and over streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridrecon.operators.session import TTL

ACTIONS = ("put", "extend", "get")
OUT = "session string, created double, expires double, items long, reads long, how string"
_OPEN = "created double, expires double, items long, reads long"
_TYPES = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.string())


def _fold(live: tuple | None, events: Iterable[tuple], ttl: float) -> tuple[list[tuple], tuple | None]:
    """What closed, and the session (created, expires, items, reads) that still lives, after (at, action, seconds, items) in order."""
    closed = []
    for at, action, seconds, items in events:
        if live and at > live[1]:
            closed.append((*live, "expired"))
            live = None
        if action == "put":
            if live:
                closed.append((*live, "replaced"))
            live = (at, at + ttl, items, 0)
        elif live and action == "extend":
            live = (live[0], max(live[1], at + seconds), *live[2:])
        elif live:
            live = (*live[:3], live[3] + 1)
    return closed, live


def _clean(events: DataFrame) -> DataFrame:
    """session, at, rank, seconds, items of the events that count: a known action of a session at a time; blank numbers are 0."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action")).cast("int") - 1
    num = lambda c, t: F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)).alias(c)
    known = events.where(F.col("session").isNotNull() & F.col("at").isNotNull() & F.col("action").isin(*ACTIONS))
    return known.select("session", F.col("at").cast("double").alias("at"), rank.alias("rank"), num("seconds", "double"), num("items", "long"))


def replay(events: DataFrame, ttl: float = TTL) -> DataFrame:
    """One row per life of a session: session, created, expires, items, reads, how (expired, replaced by a later put, or open at the end).

    events: session, at (seconds), action, seconds (of extend), items (of put). A put lives for ttl from its time; extend lets it live
    until seconds from its own time if that is later; get counts as read and extends nothing; both do nothing once it has expired
    (after expires). Events of one time count in the order put, extend, get. Others than these actions, and events without session or
    time, are left out. Sorted events stream through Arrow with one session held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, live, out = None, None, []
        for b in batches:
            for session, at, rank, seconds, items in zip(*(c.to_pylist() for c in b.columns)):
                if session != key:
                    if live:
                        out.append((key, *live, "open"))
                    key, live = session, None
                closed, live = _fold(live, [(at, ACTIONS[rank], seconds, items)], ttl)
                out += [(key, *c) for c in closed]
            if out:
                yield _batch(out)
                out = []
        if live:
            yield _batch([(key, *live, "open")])

    return _clean(events).repartition("session").sortWithinPartitions("session", "at", "rank", "seconds", "items").mapInArrow(run, OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], [x.split()[0] for x in OUT.split(", ")])


def closed_stream(events: DataFrame, ttl: float = TTL, late: float = 60.0) -> DataFrame:
    """The closed lives of replay() on a stream: one comes out when its session is put again, or when the watermark passes its end.

    Events may come up to late seconds behind. A session's state is its open life, and goes with it, so state holds live sessions only.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            closed, live = [(*live, "expired")], None
        else:
            rows = sorted((r.at, r.rank, r.seconds, r.items_) for b in batches for r in b.itertuples(index=False))
            closed, live = _fold(live, ((at, ACTIONS[rank], s, n) for at, rank, s, n in rows), ttl)
        if live:
            state.update(live)
            state.setTimeoutTimestamp(max(int(live[1] * 1000), state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *c) for c in closed], columns=[x.split()[0] for x in OUT.split(", ")])

    timed = _clean(events).withColumnRenamed("items", "items_").withColumn("time", F.col("at").cast("timestamp")).withWatermark("time", f"{int(late * 1000)} milliseconds")
    return timed.groupBy("session").applyInPandasWithState(run, OUT, _OPEN, "append", GroupStateTimeout.EventTimeTimeout)

"""Extraction sessions: tables by session under one folder, with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TTL = 1800.0


def is_live(created: Column, now: Column, ttl: float = TTL) -> Column:
    return now <= created + F.lit(ttl)


def stats(sessions: DataFrame, now: Column) -> DataFrame:
    """active, expired, items: items of active sessions only."""
    live = is_live(F.col("created"), now)
    return sessions.agg(F.count_if(live).alias("active"), F.count_if(~live).alias("expired"), F.coalesce(F.sum(F.when(live, F.col("items"))), F.lit(0)).alias("items"))


class Store:
    """Stores the tables of a session as parquet under root/session; a read past the time to live raises KeyError."""

    def __init__(self, spark: SparkSession, root: str, ttl: float = TTL):
        self.spark, self.root, self.ttl = spark, root.rstrip("/"), ttl

    def put(self, session: str, now: float, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{session}/{name}")
        meta = self.spark.range(1).select(F.lit(session).alias("session"), F.lit(float(now)).alias("created"), F.lit(float(now) + self.ttl).alias("expires"))
        meta.write.mode("overwrite").parquet(f"{self.root}/{session}/_meta_")

    def _meta(self, session: str):
        return self.spark.read.parquet(f"{self.root}/{session}/_meta_").first()

    def get(self, session: str, name: str, now: float) -> DataFrame:
        if now > self._meta(session).expires:
            raise KeyError(f"session {session} has expired")
        self.spark.range(1).select(F.lit(float(now)).alias("at")).write.mode("append").parquet(f"{self.root}/{session}/_reads_")
        return self.spark.read.parquet(f"{self.root}/{session}/{name}")

    def reads(self, session: str) -> int:
        """How often tables of the session were read; a read does not extend it."""
        folder = self._path(f"{self.root}/{session}/_reads_")
        return self.spark.read.parquet(f"{self.root}/{session}/_reads_").count() if folder[1].exists(folder[0]) else 0

    def extend(self, session: str, now: float, seconds: float) -> float:
        """Let the session live until seconds from now, if that is later than it would; returns when it expires."""
        m = self._meta(session)
        until = max(m.expires, float(now) + seconds)
        meta = self.spark.range(1).select(F.lit(session).alias("session"), F.lit(m.created).alias("created"), F.lit(until).alias("expires"))
        meta.write.mode("overwrite").parquet(f"{self.root}/{session}/_meta_")
        return until

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def clean(self, now: float) -> int:
        """Delete the sessions that have expired; returns how many."""
        root, fs = self._path(self.root)
        gone = 0
        for entry in fs.listStatus(root) if fs.exists(root) else ():
            if now > self._meta(entry.getPath().getName()).expires:
                gone += bool(fs.delete(entry.getPath(), True))
        return gone

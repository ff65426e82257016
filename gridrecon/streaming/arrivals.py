"""Documents that arrive in two parts: pairs as soon as both are there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs(req: DataFrame, est: DataFrame, wait: str = "30 minutes") -> DataFrame:
    """session, req_path, est_path, at: streams of arrivals (session, path, at timestamp) joined where both parts come within wait of each other.

    Each side is kept no longer than the watermark allows, so sessions of which one part never comes leave no state.
    """
    r = req.select("session", F.col("path").alias("req_path"), F.col("at").alias("req_at")).withWatermark("req_at", wait).alias("r")
    e = est.select("session", F.col("path").alias("est_path"), F.col("at").alias("est_at")).withWatermark("est_at", wait).alias("e")
    near = F.expr(f"r.session = e.session and est_at between req_at - interval {wait} and req_at + interval {wait}")
    return r.join(e, near).select("r.session", "req_path", "est_path", F.greatest("req_at", "est_at").alias("at"))

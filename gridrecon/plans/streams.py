"""Registered queries of streaming operators, their batches taken one after the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridrecon.operators.stored import written
from gridrecon.plans.catalogue import query
from gridrecon.plans.items import table
from gridrecon.streaming import landing, lifetimes

BATCHES = 4


@query(f"""WITH a AS (SELECT CAST(user_id AS VARCHAR) AS session, event_type, ts, CAST(event_id AS VARCHAR) AS path, event_id % {BATCHES} AS b FROM events WHERE event_type IN ('view', 'click')),
p AS (SELECT k.batch, a.* FROM range({BATCHES}) k(batch) JOIN a ON a.b <= k.batch QUALIFY row_number() OVER (PARTITION BY k.batch, session, event_type ORDER BY ts DESC, path DESC) = 1)
SELECT CAST(r.batch AS INTEGER) AS batch, r.session, r.path AS req_path, e.path AS est_path FROM p r JOIN p e ON e.batch = r.batch AND e.session = r.session AND e.event_type = 'click'
WHERE r.event_type = 'view' AND (r.b = r.batch OR e.b = e.batch)""")
def arrival_pairs(spark, sf):
    e = table(spark, sf, "events").where("event_type in ('view', 'click')")
    side = F.when(F.col("event_type") == "view", landing.SIDES[0]).otherwise(landing.SIDES[1])
    e = e.select("event_id", F.col("user_id").cast("string").alias("session"), side.alias("side"), F.col("ts").alias("at"), F.col("event_id").cast("string").alias("path"), F.lit(None).cast("binary").alias("content"))
    held, out = None, None
    for batch in range(BATCHES):  # the stream's micro-batches, each merged with what the last one left
        held = written(landing.merge(held, e.where(F.col("event_id") % BATCHES == batch).drop("event_id")), "held")
        found = landing.pairs(held).select(F.lit(batch).alias("batch"), "session", "req_path", "est_path")
        out = found if out is None else out.unionByName(found)
    return out


# Signups put a session, purchases extend it by 600 seconds a unit of value, views and clicks read it; it lives for two days.
_TTL = 172_800


@query(f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS session, CAST(floor(epoch(ts)) AS BIGINT) AS t, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS rank,
  CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) * 600 ELSE 0 END AS seconds, CASE WHEN event_type = 'signup' THEN event_id % 10 ELSE 0 END AS items FROM events WHERE event_type <> 'error'),
r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, rank, seconds, items) AS n FROM e),
x AS (SELECT DISTINCT session, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS created, CAST(NULL AS BIGINT) AS expires, CAST(NULL AS BIGINT) AS items, CAST(NULL AS BIGINT) AS reads,
    CAST(NULL AS BIGINT) AS c, CAST(NULL AS BIGINT) AS u, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS g, CAST(NULL AS VARCHAR) AS how FROM r
  UNION ALL SELECT r.session, r.n, CASE WHEN rank = 0 THEN r.t WHEN x.expires >= r.t THEN x.created END,
    CASE WHEN rank = 0 THEN r.t + {_TTL} WHEN x.expires >= r.t THEN CASE WHEN rank = 1 THEN greatest(x.expires, r.t + r.seconds) ELSE x.expires END END,
    CASE WHEN rank = 0 THEN r.items WHEN x.expires >= r.t THEN x.items END, CASE WHEN rank = 0 THEN 0 WHEN x.expires >= r.t THEN x.reads + CASE WHEN rank = 2 THEN 1 ELSE 0 END END,
    x.created, x.expires, x.items, x.reads, CASE WHEN x.expires < r.t THEN 'expired' WHEN x.expires IS NOT NULL AND rank = 0 THEN 'replaced' END
  FROM x JOIN r ON r.session = x.session AND r.n = x.n + 1)
SELECT session, c AS created, u AS expires, i AS items, g AS reads, how FROM x WHERE how IS NOT NULL
UNION ALL SELECT session, created, expires, items, reads, 'open' FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY session ORDER BY n DESC) = 1) WHERE expires IS NOT NULL""")
def session_lifetimes(spark, sf):
    is_ = lambda t: F.col("event_type") == t
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session"), F.unix_timestamp("ts").alias("at"),
        F.when(is_("signup"), "put").when(is_("purchase"), "extend").when(~is_("error"), "get").alias("action"),
        (F.floor("value") * 600).alias("seconds"), (F.col("event_id") % 10).alias("items"),
    )
    e = e.withColumn("seconds", F.when(F.col("action") == "extend", F.col("seconds"))).withColumn("items", F.when(F.col("action") == "put", F.col("items")))
    out = lifetimes.replay(e, float(_TTL))
    return out.withColumn("created", F.col("created").cast("long")).withColumn("expires", F.col("expires").cast("long"))

"""Documents that land in a folder in two parts: each batch pairs the new ones with those that wait; a batch that runs again changes nothing."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

SIDES = ("requested", "estimated")


def landed(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the files folder/<session>/<side>...: session, side, at, path, content. Files of other names
    are left alone, and so are empty ones, which Spark's listing leaves out."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    part = lambda g: F.regexp_extract("path", f"([^/]+)/({'|'.join(SIDES)})[^/]*$", g)
    return files.select(part(1).alias("session"), part(2).alias("side"), F.col("modificationTime").alias("at"), "path", "content").where("side <> ''")


def merge(held: DataFrame | None, new: DataFrame) -> DataFrame:
    """session, requested, estimated (struct at, path, content, fresh; null: not there): of each part the latest, ties to the greater path.

    held: what an earlier call gave (null: nothing yet); new: session, side, at, path, content. fresh: the part came with new.
    Rows without session or at are left out, and so are other sides; repeated rows count once.
    """
    new = new.where(F.col("session").isNotNull() & F.col("at").isNotNull() & F.col("side").isin(*SIDES))
    parts = new.select("session", "side", F.struct("at", "path", "content", F.lit(True).alias("fresh")).alias("file"))
    for side in SIDES if held is not None else ():
        old = held.where(F.col(side).isNotNull()).select("session", F.lit(side).alias("side"), F.col(side).withField("fresh", F.lit(False)).alias("file"))
        parts = parts.unionByName(old)
    latest = [F.max_by("file", F.when(F.col("side") == s, F.struct("file.at", "file.path", "file.fresh"))).alias(s) for s in SIDES]
    return parts.groupBy("session").agg(*latest)


def pairs(held: DataFrame) -> DataFrame:
    """session, at, req_path, req_content, est_path, est_content of the sessions whose two parts are there, one of them fresh."""
    df = held.where("requested is not null and estimated is not null and (requested.fresh or estimated.fresh)")
    cols = [F.col(f"{s}.{c}").alias(f"{s[:3]}_{c}") for s in SIDES for c in ("path", "content")]
    return df.select("session", F.greatest("requested.at", "estimated.at").alias("at"), *cols)


class Reconciler:
    """Writes compare(pairs) of each batch to out/results/batch=<id>, and what waits to out/held/batch=<id>.

    A batch reads what the one before left and overwrites its own two folders, so a batch that runs again after a failure writes the
    same rows once. A part waits for the other, or for a later version of it, until a part arrives that is more than wait younger.
    Of the waiting parts the last two states are kept. One writer per out.
    """

    def __init__(self, out: str, compare: Callable[[DataFrame], DataFrame], wait: timedelta = timedelta(minutes=30)):
        self.out, self.compare, self.wait = out.rstrip("/"), compare, wait

    def __call__(self, new: DataFrame, batch: int) -> None:
        spark, here = new.sparkSession, f"{self.out}/held/batch={batch}"
        states = self._states(spark)
        before = max((n for n in states if n < batch), default=None)
        held = None
        if before is not None:
            held = spark.read.parquet(f"{self.out}/held/batch={before}")
            newest = new.agg(F.max("at").alias("at")).first().at
            if newest is not None:
                held = held.where(F.greatest("requested.at", "estimated.at") >= F.lit(newest - self.wait))
        merged = merge(held, new)
        merged.write.mode("overwrite").parquet(here)
        ready = pairs(spark.read.schema(merged.schema).parquet(here))
        self.compare(ready).write.mode("overwrite").parquet(f"{self.out}/results/batch={batch}")
        for n in states:
            if before is not None and n < before:
                path, fs = self._path(spark, f"{self.out}/held/batch={n}")
                fs.delete(path, True)

    def writer(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)

    def results(self, spark: SparkSession) -> DataFrame:
        """All batches' results, with batch."""
        return spark.read.parquet(f"{self.out}/results")

    def _path(self, spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(spark._jsc.hadoopConfiguration())

    def _states(self, spark: SparkSession) -> list[int]:
        """Batches whose state was written to the end."""
        root, fs = self._path(spark, f"{self.out}/held")
        names = [e.getPath().getName() for e in fs.listStatus(root)] if fs.exists(root) else []
        return [int(x[6:]) for x in names if x.startswith("batch=") and fs.exists(self._path(spark, f"{self.out}/held/{x}/_SUCCESS")[0])]

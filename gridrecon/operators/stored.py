"""Tables in the folder that driver and executors share, where long plans are cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of this machine only where it is unset in local mode (tests)."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="gridrecon-")
        folder = _own[sc.applicationId]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a parquet table in the shared folder: lineage ends there and outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def has_group_over(df: DataFrame, by: list[str], limit: int) -> bool:
    """Whether a group has more than limit rows; a table that is no larger than that is not grouped to find out."""
    if df.count() <= limit:
        return False
    return bool(df.groupBy(*by).count().where(f"count > {limit}").head(1))


def purge(spark: SparkSession) -> int:
    """Delete all folders that operators of this process wrote; to be called once their results are stored. Returns how many."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n

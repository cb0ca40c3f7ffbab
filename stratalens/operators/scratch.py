"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one partition where tables are dealt by key.
PART_ROWS = 500_000

_made: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where Spark runs on this machine alone a temporary folder stands in for an unset one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="stratalens-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of about so many rows, dealt by keys to partitions of about PART_ROWS: what a task sorts or counts then doesn't
    grow with the table, whatever the session's number of partitions. Small tables are left as they are."""
    if rows <= PART_ROWS:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)), *keys)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``spread``, but small tables are dealt by keys as well: what groups or sorts by keys and more then stays where it is."""
    return spread(df, rows, *keys) if rows > PART_ROWS else df.repartition(*keys)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage and survives lost executors. Spark removes the shuffle
    files of the plan that made it at once. The table goes with ``deleted``, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratalens/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    had = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if had is None else spark.conf.set(_CLEANUP, had)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def deleted(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more, through Hadoop's file system."""
    for df in tables:
        if df is not None and (path := df.__dict__.pop("_scratch", None)):
            _delete(_made.pop(path, df.sparkSession), path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return

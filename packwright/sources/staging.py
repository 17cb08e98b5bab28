"""Durable stage tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; only on one machine, where that is unset, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame, kind: str) -> DataFrame:
    """Writes the rows and reads them back: computed once for all later uses, and safe from lost executors."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stage_folder = path
    return table


#: Spark's own setting; versions that don't know it keep the files until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged_lean(df: DataFrame, kind: str) -> DataFrame:
    """As ``staged``; the shuffle files behind the rows are deleted as soon as these are written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return staged(df, kind)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def released(*tables: DataFrame) -> None:
    """Deletes the folders of stage tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stage_folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

"""Shared folder for checkpoints and tables written along the way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder in the warehouse.

    On a cluster a warehouse without a scheme, or on ``file:``, is each machine's own: there the setting
    is asked for.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and warehouse.split(":", 1)[0] in (warehouse, "file"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return f"{warehouse}/scratch"


def application_folder(spark: SparkSession) -> str:
    """Where this application's scratch tables are."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def cleaned(spark: SparkSession) -> bool:
    """Remove all scratch tables of this application; results that were not written elsewhere go with them."""
    return removed(spark, application_folder(spark))


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder of any file system; none where there is no such folder."""
    path, files = _path(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder of that name, on any file system."""
    path, files = _path(spark, path)
    return files.exists(path) and files.getFileStatus(path).isDirectory()


def removed(spark: SparkSession, folder: str) -> bool:
    """Remove a folder of ours on any file system; whether it was there."""
    path, files = _path(spark, folder)
    return files.delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors see."""
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its plan ends here, and no executor holds it."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

"""Parquet tables, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder. Missing numbers come as null, never as NaN."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    reals = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c in reals}) if reals else df


def read_parts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The Parquet parts of a folder whose names fit a pattern, as one table; names like year=2010 give a column."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/{pattern}")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one if all tasks run on this
    machine (tests), else an error: a cluster must name a folder that all its machines share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.shared.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset, and tasks of {master} share no temporary folder")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", folder)
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


def drop_stored(spark: SparkSession) -> None:
    """Delete all that stored has written for this application; results that read it must be done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, so it survives the
    loss of executors and is computed once however often it is used. An application's tables lie in
    one folder; drop_stored deletes it."""
    path = f"{_own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

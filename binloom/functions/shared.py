"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all executors share; one for local runs where it is unset, an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: the executors of a cluster need a shared folder")
        shared = "/tmp/binloom-checkpoints"
    return f"{shared.rstrip('/')}/binloom/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Cut a long plan by writing an intermediate table to the cluster's shared checkpoint folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = getattr(spark, "_scanledger_stage", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="spark-stage-")
        spark._scanledger_stage = folder
    return folder


def staged(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet and read back: columns are still pruned and filters pushed down."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

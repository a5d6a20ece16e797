"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where that is unset and the master is this machine."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    now = context._jsc.sc().getCheckpointDir()
    if where is None and now.isDefined():
        return now.get().rstrip("/")
    if where is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    if where is None:
        where = f"file://{tempfile.mkdtemp(prefix='threadloom-')}"
    if not now.isDefined():
        context.setCheckpointDir(where)
    return where.rstrip("/")


#: Into how many parts rows go whose work is far larger than their bytes: small files would come as few tasks.
PARTS = 96


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows in many parts by ``by``, for costly work on each of them."""
    return df.repartition(PARTS, *by)


def held(df: DataFrame) -> DataFrame:
    """The frame, computed once, written to the shared folder and read back: many branches read it, and a lost executor loses nothing.

    Its files stay for as long as the folder keeps them; the folder is scratch, and whoever owns it clears it.
    """
    path = f"{shared_dir(df.sparkSession)}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

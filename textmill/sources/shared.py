"""Tables between the steps of an operator, in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A session on one machine that names none gets a local folder; others an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the machines of {master or 'the cluster'} share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="textmill-"))
    return spark.conf.get("spark.checkpoint.dir")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; what is there goes when the driver ends."""
    root = f"{shared_folder(spark)}/steps/{spark.sparkContext.applicationId}"
    if root not in _made:
        _made.add(root)
        atexit.register(_delete, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df computed once, as a Parquet table that outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(path: str) -> None:
    if SparkContext._jvm is not None and SparkContext._gateway is not None:
        where = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(SparkContext._jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)

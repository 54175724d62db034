"""Written tables that cut lineage, in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder of this session. Only a session on one machine that names none (as in tests) gets a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir names no folder that the machines of {master or 'this cluster'} share")
        named = tempfile.mkdtemp(prefix="textmill-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: it outlives lost executors and is computed once. What is left
    of an application's tables goes when its driver ends; discard() deletes one earlier."""
    spark = df.sparkSession
    root = f"{folder(spark).rstrip('/')}/textmill/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_delete, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_roots: set[str] = set()


def _delete(path: str) -> None:
    jvm = SparkContext._jvm
    if jvm is not None and SparkContext._gateway is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns of df as one struct: beside it, an operator's own names can't clash with theirs."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns]).alias(name)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of df but these, whatever their case."""
    return [c for c in df.columns if c.lower() not in {n.lower() for n in names}]


def discard(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        parent = jvm.org.apache.hadoop.fs.Path(file).getParent()
        parent.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches sent to Python hold about `size` bytes in what is written meanwhile; Spark's default is 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Let the cluster drop shuffle files that no table needs any more, once what they fed is written."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()

"""Tables written to the folder that driver and executors share, to cut lineage in iterations.

Reading such a table gives the optimizer its true size; a checkpoint() keeps the estimates of the
plan it came from, which grow with every round of joins.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and one JVM does all the work."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="latticework-"))
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop_cut(*tables: DataFrame | None) -> None:
    """Remove tables written by ``cut`` that nothing reads any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "_cut_at", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

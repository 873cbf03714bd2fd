"""The folder that driver and executors share, for what has to be written on the way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a session in a single process (local[..]), as in tests, gets a folder of
    its own. On a cluster, where executors would not see such a folder, this is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="recollect-"))
    return _OWN[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A place in it that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what is read several times: computed once, safe when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """df, to be broadcast only if a count shows at most most_rows rows (of fixed width); else Spark shuffles it."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df

"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it names none, a folder of our own, but on a local master only:
    elsewhere executors would write to disks that nobody else reads."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path or own_dir(spark.sparkContext.applicationId)


@lru_cache(maxsize=None)
def own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"ledgerline-{application}-")


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ledgerline-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, is computed once however
    often it is used, and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete what ``written`` left for this application, once no result needs it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""Tables handed from one Spark job to the next, in the folder that the cluster shares.

``stage`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads it back. That cuts the lineage,
lets the next job plan from real sizes, and survives the loss of any executor. ``spark.checkpoint.dir`` is read
from the session; a folder of its own is used only where the setting is missing and the master is local (tests).
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-shared-"))
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: every later use reads the files instead of running the plan again."""
    path = f"{shared_dir(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Empty a staged table that no later step reads, so that its space is free before the job ends."""
    files = df.inputFiles()
    if files:
        folder = files[0].rsplit("/", 1)[0]
        df.sparkSession.range(0).write.mode("overwrite").parquet(folder)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of one or two 64-bit numbers that may be broadcast once they are counted.
FEW = 2_000_000


def few(df: DataFrame) -> DataFrame:
    """A staged table of ids, marked for a broadcast if it is counted to have no more than ``FEW`` rows, else for a shuffle."""
    return F.broadcast(df) if df.count() <= FEW else df.hint("merge")


def told_apart(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """The rows, and a column that no two of them share: the id where it is one, else a new column with a row number.

    Usually ids are unique and nothing moves but their counts. Where some repeat or are null, the rows are written once
    with numbers of their own in the order of the ids (null last), so that every later step sees the same ones.
    """
    ids = docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n"))
    if ids.where("n > 1 or id is null").isEmpty():
        return docs, id_col
    name = spare(docs, "__row")
    number = F.monotonically_increasing_id()
    ordered = docs.withColumn(name, number).orderBy(F.col(id_col).cast("long").asc_nulls_last(), name)
    return stage(ordered.withColumn(name, number), "numbered"), name


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name

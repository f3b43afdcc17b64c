"""Incremental, resumable ingest of raw records with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.raw import RAW, keyed, parse_lines


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = RAW) -> None:
    """Append records of new files whose key the target lacks; finished files are never read again.

    Lines that are no record are passed over. Each batch is made unique by key and held against the target by an anti
    join; a batch that is run again after a failure writes its folder anew instead of appending twice.
    """
    lines = spark.readStream.schema("value STRING").text(source)

    def append(batch: DataFrame, batch_id: int) -> None:
        fresh = keyed(parse_lines(batch, schema).where("state = 'good'")).drop("value", "state").dropDuplicates(["key"])
        known = read_target(batch.sparkSession, target, schema)
        if known is not None:
            fresh = fresh.join(known.where(F.col("batch") < batch_id).select("key"), "key", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_target(spark: SparkSession, target: str, schema: str = RAW) -> DataFrame | None:
    """The ingested records, or None before the first batch."""
    try:
        return spark.read.schema(f"key STRING, {schema}, batch LONG").option("basePath", target).parquet(f"{target}/batch=*")
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise

"""A catalog table that a stream keeps up to date: batches of records are merged into it, a version at a time.

Rows lie in ``buckets`` folders by a hash of their key. A batch reads, merges and writes the buckets that it has keys of,
and no others, into folders of a new version; then a commit, one small file that says which version of each bucket counts,
makes them current. Until the commit is there readers see the version before; what a failed batch has written is
overwritten when it is run again. A commit also names the stream and batch that it came from, so a batch that is run
again after its commit changes nothing. Old versions stay readable until ``prune`` takes them away.

How it scales: the work of a batch goes by the buckets that it touches; with a bucket for each gigabyte or so a batch of
recent keys leaves most of a large table alone. The driver sees the buckets' versions, as many rows as there are buckets.
One stream writes to a table at a time, as with any table without locks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import upsert
from ..sources.raw import RAW, keyed, parse_lines

_COMMIT = "version LONG, bucket INT, at LONG, stream STRING, batch LONG"
#: Columns that the merge makes besides those of the records.
RECORD = f"key STRING, {RAW}"


def _bucket(buckets: int) -> F.Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


def commits(spark: SparkSession, target: str) -> DataFrame | None:
    """version, bucket, at (the version whose folder counts), stream, batch of every commit; None before the first."""
    try:
        return spark.read.schema(_COMMIT).option("basePath", f"{target}/commits").parquet(f"{target}/commits/version=*")
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise


def _current(spark: SparkSession, target: str) -> tuple[int, dict[int, int]]:
    """The newest version and the version of each bucket that has rows."""
    known = commits(spark, target)
    if known is None:
        return -1, {}
    last = known.agg(F.max("version")).first()[0]
    return last, {r["bucket"]: r["at"] for r in known.where((F.col("version") == last) & (F.col("bucket") >= 0)).collect()}


def _read(spark: SparkSession, target: str, schema: str, places: dict[int, int]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], schema)
    folders = [f"{target}/data/at={at}/bucket={bucket}" for bucket, at in sorted(places.items())]
    return spark.read.schema(schema).parquet(*folders)


def read_catalog(spark: SparkSession, target: str, schema: str = RECORD, version: int | None = None) -> DataFrame:
    """The table as the newest commit, or a given one, has it; empty before the first."""
    last, places = _current(spark, target)
    if version is not None and version != last:
        known = commits(spark, target)
        rows = [] if known is None else known.where((F.col("version") == version) & (F.col("bucket") >= 0)).collect()
        places = {r["bucket"]: r["at"] for r in rows}
    return _read(spark, target, schema, places)


def _commit(spark: SparkSession, target: str, version: int, places: dict[int, int], stream: str, batch: int) -> None:
    rows = [(b, at, stream, batch) for b, at in sorted(places.items())] or [(-1, -1, stream, batch)]
    told = spark.createDataFrame(rows, "bucket INT, at LONG, stream STRING, batch LONG")
    told.coalesce(1).write.mode("overwrite").parquet(f"{target}/commits/version={version}")


def merge_batch(fresh: DataFrame, target: str, stream: str, batch: int, schema: str = RECORD, buckets: int = 64, order: str | None = None) -> None:
    """Merge records with a key into the table (as ``operators.merge.upsert`` does) and commit; nothing if that batch is committed.

    Of a key that a batch repeats, the last in ``order`` counts (of equal ones, and without an order, the greatest row).
    """
    spark = fresh.sparkSession
    known = commits(spark, target)
    if known is not None and not known.where((F.col("stream") == stream) & (F.col("batch") >= batch)).isEmpty():
        return
    last, places = _current(spark, target)
    fresh = fresh.where("key is not null")
    touched = [r[0] for r in fresh.select(_bucket(buckets).alias("b")).distinct().collect()]  # at most ``buckets``
    version = last + 1
    if touched:
        before = _read(spark, target, schema, {b: at for b, at in places.items() if b in set(touched)})
        merged = upsert(before, fresh, order).drop("change", "repeats").withColumn("bucket", _bucket(buckets))
        merged.repartition("bucket").write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).partitionBy("bucket").parquet(f"{target}/data/at={version}")
    _commit(spark, target, version, places | dict.fromkeys(touched, version), stream, batch)


def ingest_upserts(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = RAW, buckets: int = 64, order: str | None = None) -> None:
    """Merge the records of new files (lines of JSON) into the table; finished files are never read again.

    Lines that are no record are passed over. ``checkpoint`` names the stream as well: with a new one all files are
    merged again.
    """
    lines = spark.readStream.schema("value STRING").text(source)

    def merge(batch: DataFrame, batch_id: int) -> None:
        records = keyed(parse_lines(batch, schema).where("state = 'good'")).drop("value", "state").persist()
        try:
            merge_batch(records, target, checkpoint, batch_id, f"key STRING, {schema}", buckets, order)
        finally:
            records.unpersist()

    query = lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def prune(spark: SparkSession, target: str) -> int:
    """Empty the folders of buckets that the newest commit doesn't name; how many there were. Run while nothing reads older versions."""
    known = commits(spark, target)
    if known is None:
        return 0
    last = known.agg(F.max("version")).first()[0]
    named = known.where("bucket >= 0").select("bucket", "at").distinct()
    gone = named.join(known.where((F.col("version") == last) & (F.col("bucket") >= 0)).select("bucket", "at"), ["bucket", "at"], "left_anti")
    n = 0
    fs = spark._jvm.org.apache.hadoop.fs
    for row in gone.toLocalIterator():
        path = fs.Path(f"{target}/data/at={row['at']}/bucket={row['bucket']}")
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n

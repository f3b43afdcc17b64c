"""Catalog files: dictionary-coded rows, partitioned details, flat rows, CSV and dated snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import slugify

#: Labels of rows without one; rows that a part of the details is meant to hold, and bytes that it may; characters of a hook.
DEFAULTS = {"language": "Other", "domain": "Other / General", "subsystem": "General Components", "artifact": "Application / Service", "license": "Unknown"}
TARGET_ROWS = 12_000
MAX_PART_BYTES = 48 * 1024 * 1024
#: Parts of a table up to which each has a folder of its own; with more, LOTS folders a slug hold them.
MOST_FOLDERS, LOTS = 1_000, 16
HOOK = 90
SNAPSHOT = "full_name STRING, stars LONG, snapshot_date STRING"


def label_codes(df: DataFrame, col: str, ord_col: str = "ord") -> DataFrame:
    """label, code: numbers from 0 in the order of first appearance. A label table is small: one row per label."""
    first = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("label")).agg(F.min(ord_col).alias("first"))
    return first.select("label", (F.row_number().over(Window.orderBy("first")) - 1).alias("code"))


def encode(df: DataFrame, cols: tuple[str, ...], ord_col: str = "ord") -> tuple[DataFrame, dict[str, DataFrame]]:
    tables = {c: label_codes(df, c, ord_col) for c in cols}
    for c, t in tables.items():
        df = df.join(t.select(F.col("label").alias(c), F.col("code").alias(f"{c}_code")), c, "left").drop(c)
    return df, tables


def decode(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Labels for codes; a code without a label gets the column's default."""
    for c, t in tables.items():
        df = df.join(t.select(F.col("code").alias(f"{c}_code"), F.col("label").alias(c)), f"{c}_code", "left")
        df = df.withColumn(c, F.coalesce(c, F.lit(DEFAULTS.get(c, "")))).drop(f"{c}_code")
    return df


def part_count(rows: Column, target: int = TARGET_ROWS) -> Column:
    """A power of two: 1 shifted by the bits of (rows - 1) // target."""
    x = F.floor((rows - 1) / target)
    return F.pow(F.lit(2), F.when(x <= 0, 0).otherwise(F.length(F.bin(x)))).cast("long")


def parts_by_slug(df: DataFrame, target: int = TARGET_ROWS) -> DataFrame:
    """slug, rows, parts. A row per domain, so it is small."""
    return df.groupBy(slugify(F.col("domain")).alias("slug")).agg(F.count("*").alias("rows")).withColumn("parts", part_count(F.col("rows"), target))


def part_number(df: DataFrame, parts: DataFrame) -> DataFrame:
    """The table with slug and part = id modulo the slug's parts."""
    return df.withColumn("slug", slugify(F.col("domain"))).join(parts.select("slug", "parts"), "slug", "left").withColumn("part", F.pmod("id", F.coalesce("parts", F.lit(1)))).drop("parts")


def details_bytes(df: DataFrame) -> Column:
    """Bytes of a row's details as one JSON line."""
    return (F.octet_length(F.to_json(F.struct(*[c for c in df.columns if c not in ("slug", "part", "lot")]))) + 1).cast("long")


def part_bytes(routed: DataFrame) -> DataFrame:
    """slug, part, rows, bytes (as JSON lines) of details that have a slug and part."""
    sized = routed.withColumn("__bytes", details_bytes(routed))
    return sized.groupBy("slug", "part").agg(F.count("*").alias("rows"), F.sum("__bytes").alias("bytes"))


def write_details(df: DataFrame, path: str, target: int = TARGET_ROWS, max_rows: int = 2_000_000, max_bytes: int | None = MAX_PART_BYTES) -> None:
    """Details by slug and part; what earlier runs left is replaced.

    Each part has its folder, ``slug=.../part=...``. A table of more than ``MOST_FOLDERS`` parts has folders
    ``slug=.../lot=...`` instead, lot being part modulo ``LOTS``, and its parts lie in these in order, with ``part`` as a column:
    small parts then don't make as many files, and a part is found by its lot and the bounds in the files.

    A part above ``max_bytes`` as JSON lines is an error, raised before anything is written (None: no such limit).
    """
    parts = parts_by_slug(df, target)
    routed = part_number(df, parts)
    if max_bytes is not None:
        large = part_bytes(routed).where(F.col("bytes") > max_bytes).orderBy(F.col("bytes").desc()).limit(3).collect()
        if large:
            raise ValueError(f"parts above {max_bytes} bytes: " + ", ".join(f"{r.slug}/{r.part} ({r.bytes})" for r in large))
    folder = "part"
    if (parts.agg(F.sum("parts")).first()[0] or 0) > MOST_FOLDERS:
        routed, folder = routed.withColumn("lot", lot(F.col("part"))), "lot"
    routed = routed.repartition("slug", folder)
    routed = routed.sortWithinPartitions("slug", "lot", "part") if folder == "lot" else routed
    routed.write.mode("overwrite").option("maxRecordsPerFile", max_rows).partitionBy("slug", folder).parquet(path)


def lot(part: Column) -> Column:
    """The folder of a part in a table of many parts."""
    return F.pmod(part, F.lit(LOTS)).cast("long")


def read_details(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Details by id; if several files hold an id, the last by slug and part counts."""
    rows = spark.read.schema(f"{schema}, slug STRING, part LONG").parquet(path)
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.col("slug").desc(), F.col("part").desc()))
    return rows.withColumn("__n", last).where("__n = 1").drop("__n", "lot")


def read_details_of(spark: SparkSession, path: str, schema: str, slug: str, part: int) -> DataFrame:
    """One partition only: the filter prunes the others."""
    rows = spark.read.schema(f"{schema}, slug STRING, part LONG").parquet(path).where((F.col("slug") == slug) & (F.col("part") == part))
    return rows.where(F.col("lot") == part % LOTS).drop("lot") if "lot" in rows.columns else rows


def flat_rows(df: DataFrame) -> DataFrame:
    """The light columns, description cut to a hook's length."""
    wanted = ("id", "name", "owner", "full_name", "stars", "forks", "language", "license", "domain", "subsystem", "artifact", "topics", "primitives", "pushed_at", "is_archived")
    return df.select(*[c for c in wanted if c in df.columns], F.substring(F.coalesce("description", F.lit("")), 1, HOOK).alias("description"))


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180: a header, quotes doubled inside quotes, null as nothing."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One record per line."""
    df.write.mode("overwrite").json(path)


def write_snapshots(rows: DataFrame, path: str) -> None:
    """Stars by snapshot_date; days that are there already are replaced, no others."""
    rows.select("full_name", "stars", "snapshot_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def write_snapshot(df: DataFrame, path: str, day: str) -> None:
    write_snapshots(df.withColumn("snapshot_date", F.lit(day)), path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All days; the date stays text; unreadable files are passed over."""
    return spark.read.schema(SNAPSHOT).option("ignoreCorruptFiles", True).parquet(path)

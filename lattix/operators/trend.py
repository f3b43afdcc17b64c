"""Differences between dated snapshots: added, removed, movers and their series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_STARS = 500
TOP = 100


def _at(snapshots: DataFrame, date: str, prefix: str) -> DataFrame:
    """One row per lower-cased name; the last entry of a name counts (by ``pos`` where the snapshot has it)."""
    day = snapshots.where(F.col("snapshot_date") == date).withColumn("k", F.lower("full_name"))
    last = F.col("pos") if "pos" in snapshots.columns else F.struct("full_name", "stars")
    return day.groupBy("k").agg(F.max_by(F.struct("full_name", "stars"), last).alias("r")).select("k", F.col("r.full_name").alias(f"{prefix}_name"), F.col("r.stars").alias(f"{prefix}_stars"))


def snapshot_diff(snapshots: DataFrame, old_date: str, new_date: str, labels: DataFrame | None = None) -> DataFrame:
    """change (added, removed, both), full_name, old_stars, new_stars and the labels of the current catalog."""
    both = _at(snapshots, old_date, "old").join(_at(snapshots, new_date, "new"), "k", "full_outer")
    change = F.when(F.col("old_name").isNull(), "added").when(F.col("new_name").isNull(), "removed").otherwise("both")
    out = both.select("k", change.alias("change"), F.coalesce("new_name", "old_name").alias("full_name"), "old_stars", "new_stars")
    if labels is None:
        return out.withColumns({"language": F.lit(None).cast("string"), "domain": F.lit(None).cast("string")})
    named = labels.groupBy(F.lower("full_name").alias("k")).agg(F.max_by("language", "full_name").alias("language"), F.max_by("domain", "full_name").alias("domain"))
    return out.join(named, "k", "left")


def movers(snapshots: DataFrame, old_date: str, new_date: str, labels: DataFrame | None = None, min_stars: int = MIN_STARS, top: int | None = TOP) -> DataFrame:
    """Rows whose stars changed, with delta and per cent; the ``top`` by size of the change, then name."""
    delta = F.col("new_stars") - F.col("old_stars")
    pct = F.when(F.col("old_stars") > 0, delta / F.col("old_stars") * 100.0).otherwise(100.0)
    out = (
        snapshot_diff(snapshots, old_date, new_date, labels).where("change = 'both'")
        .where((delta != 0) & (F.greatest("new_stars", "old_stars") >= min_stars))
        .select("k", "full_name", "old_stars", "new_stars", delta.alias("delta"), F.bround(pct, 1).alias("pct"), "language", "domain")
    )
    return out if top is None else out.orderBy(F.abs("delta").desc(), "full_name").limit(top)


def mover_series(moved: DataFrame, snapshots: DataFrame) -> DataFrame:
    """full_name, snapshot_date, stars of every mover over all snapshots."""
    days = snapshots.withColumn("k", F.lower("full_name")).groupBy("k", "snapshot_date").agg(F.max_by("stars", F.struct("full_name", "stars")).alias("stars"))
    return moved.select("k", "full_name").join(days, "k").select("full_name", "snapshot_date", "stars")


def consecutive_changes(snapshots: DataFrame) -> DataFrame:
    """Change of each name from the snapshot before, over all dates at once."""
    w = Window.partitionBy(F.lower("full_name")).orderBy("snapshot_date")
    return snapshots.withColumn("delta", F.col("stars") - F.lag("stars").over(w)).where("delta is not null")


def rising(moved: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """Movers that gained and are still in the catalog, the first ``k`` in the movers' order."""
    names = catalog.select(F.lower("full_name").alias("k")).distinct()
    return moved.where("delta > 0").join(names, "k", "left_semi").orderBy(F.abs("delta").desc(), "full_name").limit(k)


def by_stars(df: DataFrame, stars: str = "stars") -> DataFrame:
    """Order of added and removed rows; never cut."""
    return df.orderBy(F.col(stars).desc(), "full_name")

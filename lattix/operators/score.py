"""Ordinals, percentile ranks, the composite signal, and sort orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY
from ..functions.text import has_install
from ..sources.shared import settled

#: Weights of the signal's terms, scale of the decay in days, recency of rows without a date.
WEIGHTS = {"stars_pct": 45.0, "push_recency": 25.0, "fork_ratio_pct": 20.0, "has_release": 10.0}
DECAY_DAYS = 548.0
UNKNOWN_RECENCY = 0.5


def _ranged(df: DataFrame, *order: Column) -> DataFrame:
    """The rows in range partitions of the order, with the partition's number, written once.

    Bounds are sampled and small partitions joined when the plan runs, so two runs don't agree on who is where; sizes and
    rows are both taken from the written table.
    """
    return settled(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")


def global_ordinal(df: DataFrame, *order: Column, name: str = "ord") -> DataFrame:
    """Position from 0 in a total order, without one task that sorts everything.

    Rows are range-partitioned by the order and numbered inside each partition; the partitions' sizes (a row each, so
    the running sum over them is small) give the offsets.
    """
    ranged = _ranged(df, *order)
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    # a row for each partition: a setting, not a count of rows
    return ranged.withColumn("__nth", nth).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__nth") - 1).cast("long")).drop("__part", "__nth", "__before")


def ranked_within(df: DataFrame, by: str, *order: Column, name: str = "rank") -> DataFrame:
    """Rank from 1 inside each value of ``by``, however many rows a value has: positions in the order of all, less the first."""
    placed = settled(global_ordinal(df, F.col(by), *order, name="__at"), "ranked")
    first = placed.groupBy(F.col(by).alias("__by")).agg(F.min("__at").alias("__first"))
    return placed.join(first, F.col(by).eqNullSafe(F.col("__by"))).withColumn(name, (F.col("__at") - F.col("__first") + 1).cast("int")).drop("__at", "__by", "__first")


def percentile_rank_avg(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Rank in (0, 1], ties sharing the mean rank: (mean rank from 0, plus 1) / N.

    Ranks are running sums over distinct values; those are ranged into partitions, so no task sees all of them.
    """
    df = df.withColumn("__v", value.cast("double"))
    ranged = _ranged(df.groupBy("__v").agg(F.count("*").alias("n")), F.col("__v"))
    sums = ranged.groupBy("__part").agg(F.sum("n").alias("s"))
    before = sums.select("__part", F.coalesce(F.sum("s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("s").over(Window.partitionBy()).alias("__all"))
    upto = F.sum("n").over(Window.partitionBy("__part").orderBy("__v"))
    ranks = ranged.withColumn("upto", upto).join(F.broadcast(before), "__part")
    first = F.col("__before") + F.col("upto") - F.col("n")
    ranks = ranks.select(F.col("__v").alias("__w"), ((first + (F.col("n") - 1) / 2.0 + 1.0) / F.col("__all")).alias(out))
    return df.join(ranks, F.col("__v").eqNullSafe(F.col("__w"))).drop("__v", "__w")


def signal(df: DataFrame, as_of: int, quickstart: Column | None = None, breakdown: bool = False) -> DataFrame:
    """``signal`` (0 to 100) from stars, forks and pushed_epoch; with ``breakdown`` also each term's share."""
    stars, forks = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("stars", "forks"))
    ranked = percentile_rank_avg(percentile_rank_avg(df, stars, "__stars"), (forks + 1) / (stars + 1), "__forks")
    age = F.greatest(F.lit(0.0), (F.lit(as_of) - F.col("pushed_epoch")) / float(DAY))
    recency = F.when(F.coalesce(F.col("pushed_epoch"), F.lit(0)) == 0, UNKNOWN_RECENCY).otherwise(F.exp(-age / DECAY_DAYS))
    terms = {
        "stars_pct": WEIGHTS["stars_pct"] * F.col("__stars"),
        "push_recency": WEIGHTS["push_recency"] * recency,
        "fork_ratio_pct": WEIGHTS["fork_ratio_pct"] * F.col("__forks"),
        "has_release": WEIGHTS["has_release"] * (has_install(quickstart) if quickstart is not None else F.lit(0)),
    }
    total = terms["stars_pct"] + terms["push_recency"] + terms["fork_ratio_pct"] + terms["has_release"]
    out = ranked.withColumn("signal", F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))).cast("int"))
    if breakdown:
        out = out.withColumns({f"term_{k}": v for k, v in terms.items()})
    return out.drop("__stars", "__forks")


def ordered(df: DataFrame, by: str = "stars") -> DataFrame:
    """Catalog order ("stars"), most recently pushed first ("recent") or highest signal first ("signal")."""
    tail = [F.col("stars").desc(), F.col("full_name")]
    first = {"stars": [], "recent": [F.coalesce("pushed_epoch", F.lit(0)).desc()], "signal": [F.col("signal").desc()]}[by]
    return df.orderBy(*first, *tail)


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(limit) if offset else df.limit(limit)

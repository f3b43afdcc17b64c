"""Counts by facet, topics by domain, long tail, distinct values, summaries and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import array_or_empty
from ..sources.shared import settled
from .score import ranked_within

SINGLE = ("domain", "artifact", "language", "license", "license_tier")
ARRAYS = {"topic": "topics", "primitive": "primitives", "compatibility": "compatibility"}
LIMITS = {"topic": 60, "license": 40}


def facet_counts(df: DataFrame, limits: dict[str, int] = LIMITS, ord_col: str = "ord") -> DataFrame:
    """dimension, name, parent, count, rank over all facets in one pass; ties by the first row in catalog order."""
    no = F.lit(None).cast("string")

    def entry(dim: str, name, parent=no):
        return F.struct(F.lit(dim).alias("dimension"), name.alias("name"), parent.alias("parent"))

    have = set(df.columns)
    lists = [F.array(*[entry(c, F.col(c)) for c in SINGLE if c in have], entry("total", F.lit("total")), *([entry("subsystem", F.col("subsystem"), F.col("domain") if "domain" in have else no)] if "subsystem" in have else []))]
    def entries(dim: str, c: str):
        return F.transform(array_or_empty(F.array_distinct(F.col(c))), lambda x: entry(dim, x))

    lists += [entries(d, c) for d, c in ARRAYS.items() if c in have]
    tall = df.select(F.col(ord_col).alias("__ord"), F.inline(F.concat(*lists))).where("name is not null")
    counts = tall.groupBy("dimension", "name", "parent").agg(F.count("*").alias("count"), F.min("__ord").alias("first"))
    kept = [(F.col("dimension") != d) | (F.col("rank") <= k) for d, k in limits.items()]
    out = ranked_within(counts, "dimension", F.col("count").desc(), F.col("first"), F.col("name"), F.col("parent"))
    for cond in kept:
        out = out.where(cond)
    return out.drop("first")


def topics_by_domain(df: DataFrame, k: int = 20, ord_col: str = "ord") -> DataFrame:
    """domain, topic, count, rank, weight (count over the domain's largest)."""
    tall = df.select("domain", F.col(ord_col).alias("__ord"), F.explode(F.array_distinct("topics")).alias("topic"))
    counts = tall.groupBy("domain", "topic").agg(F.count("*").alias("count"), F.min("__ord").alias("first"))
    w = Window.partitionBy("domain")
    out = counts.withColumn("rank", F.row_number().over(w.orderBy(F.col("count").desc(), "first", "topic"))).where(F.col("rank") <= k)
    return out.withColumn("weight", F.col("count") / F.max("count").over(w)).drop("first")


def major_values(df: DataFrame, col: str, min_count: int = 50) -> DataFrame:
    """value, count, major, tail_rank (by count, then value, among the others) and tail_rows, their rows in all."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("count")).withColumn("major", F.col("count") >= min_count)
    ranked = settled(ranked_within(counts, "major", F.col("count").desc(), F.col("value"), name="tail_rank"), "tail")
    rows = ranked.where("not major").agg(F.sum("count").alias("tail_rows"))  # one row
    tail = ~F.col("major")
    return ranked.crossJoin(F.broadcast(rows)).withColumns({"tail_rank": F.when(tail, F.col("tail_rank")), "tail_rows": F.when(tail, F.col("tail_rows"))})


def facet_values(df: DataFrame, col: str, domain: str | None = None) -> DataFrame:
    if domain not in (None, "all"):
        df = df.where(F.col("domain") == domain)
    return df.select(F.col(col).alias("value")).where("value is not null").distinct()


def catalog_summary(df: DataFrame) -> DataFrame:
    """One row: totals, distinct labels, rows with topics, and rows by status."""
    status = F.coalesce(F.col("activity_status"), F.lit("unknown"))
    n = F.count("*")
    with_topics = F.count_if(F.size(array_or_empty(F.col("topics"))) > 0)
    return df.agg(
        n.alias("rows"), F.sum("stars").alias("stars"), F.min("stars").alias("min_stars"), F.sum("forks").alias("forks"),
        F.countDistinct("domain").alias("domains"), F.countDistinct("language").alias("languages"), with_topics.alias("with_topics"),
        (100.0 * with_topics / n).alias("with_topics_pct"),
        *[F.count_if(status == s).alias(f"status_{s}") for s in ("active", "idle", "archived", "unknown")],
    )


def histogram(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("label")).agg(F.count("*").alias("count"))

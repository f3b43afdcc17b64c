"""Predicates of the explorer: floors, facets, arrays, long tail, presets and substring search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facets import major_values

#: Named filter sets; what a set does not name is reset.
PRESETS = {
    "Local AI & LLMs": {"domain": "AI & Machine Learning", "query": "llm"},
    "Columnar OLAP": {"domain": "Databases & Storage", "query": "olap"},
    "Zero-Copy Systems": {"primitive": "Zero-Copy"},
    "Rust Systems": {"language": "Rust"},
    "Cloud & K8s": {"domain": "Cloud & Infrastructure"},
    "Kernel & OS": {"domain": "Operating Systems & Low-Level"},
}
#: Language choice that stands for all languages that are not major ones.
LONG_TAIL = "__long_tail__"


def star_floor(df: DataFrame, min_stars: int = 500) -> DataFrame:
    return df.where(F.coalesce(F.col("stars"), F.lit(0)) >= min_stars)


def not_dormant(status: Column) -> Column:
    return status.isNull() | ~status.isin("idle", "archived")


def facet_filter(
    df: DataFrame, domain: str | None = None, subsystem: str | None = None, artifact: str | None = None, language: str | None = None,
    license_tier: str | None = None, primitive: str | None = None, topic: str | None = None, min_signal: int = 0,
    hide_dormant: bool = False, majors: DataFrame | None = None,
) -> DataFrame:
    """All given facets at once; None and "all" are off. ``majors`` (one column, ``value``) serves the long-tail choice."""
    for col, value in (("domain", domain), ("subsystem", subsystem), ("artifact", artifact), ("license_tier", license_tier)):
        if value not in (None, "all"):
            df = df.where(F.col(col) == value)
    if language == LONG_TAIL:
        majors = majors if majors is not None else major_values(df, "language").where("major").select("value")
        df = df.join(majors.select(F.col("value").alias("language")), "language", "left_anti")
    elif language not in (None, "all"):
        df = df.where(F.col("language") == language)
    for col, value in (("primitives", primitive), ("topics", topic)):
        if value not in (None, "all"):
            df = df.where(F.array_contains(col, value))
    if min_signal > 0:
        df = df.where(F.coalesce(F.col("signal"), F.lit(0)) >= min_signal)
    return df.where(not_dormant(F.col("activity_status"))) if hide_dormant else df


def substring_search(df: DataFrame, query: str, corpus: str = "search_corpus") -> DataFrame:
    """Rows whose corpus has every white-space separated part of the query as a substring."""
    for part in query.lower().split():
        df = df.where(F.contains(F.col(corpus), F.lit(part)))
    return df


def preset_filter(df: DataFrame, name: str, presets: dict[str, dict] = PRESETS) -> DataFrame:
    chosen = dict(presets[name])
    query = chosen.pop("query", "")
    found = facet_filter(df, **chosen)
    return substring_search(found, query) if query else found

"""The SQL console: a view of 15 columns, a read-only guard, and a preview."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("id", "name", "owner", "full_name", "stars", "forks", "language", "license", "domain", "subsystem", "artifact", "hook", "topics", "primitives", "compatibility")
PREVIEW = 200
_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)


def repos_view(df: DataFrame, name: str | None = "repos") -> DataFrame:
    """The 15 text and number columns; arrays joined by commas, absent columns null. Registered as a view if named."""
    kind = {f.name: f.dataType.typeName() for f in df.schema}
    out = [
        F.lit(None).cast("string").alias(c) if c not in kind else F.array_join(F.col(c), ", ").alias(c) if kind[c] == "array" else F.col(c)
        for c in COLUMNS
    ]
    view = df.select(*out)
    if name:
        view.createOrReplaceTempView(name)
    return view


def read_only(statement: Column) -> Column:
    """The shape of a single SELECT or WITH query, as an expression: for tables of statements.

    Text literals and comments don't count. ``is_read_only`` also has Spark parse the statement.
    """
    bare = F.regexp_replace(F.coalesce(statement, F.lit("")), r"'(?:[^']|'')*'|--[^\n]*|(?s:/\*.*?\*/)", " x ")
    bare = F.regexp_replace(F.trim(bare), r"(?:\s|;|\bx\s*$)*$", " ")
    command = r"(?i)(?:^|\)|;)\s*(?:insert|update|delete|merge|drop|alter|create|truncate|replace)\b"
    return bare.rlike(r"(?i)^\s*(?:x\s+)*(?:select|with)\b") & ~F.contains(bare, F.lit(";")) & ~bare.rlike(command)


def is_read_only(spark: SparkSession, sql: str) -> bool:
    """True for a single SELECT or WITH that plans a query and no command."""
    text = _COMMENT.sub(" ", sql).strip().rstrip(";").strip()
    if not re.match(r"(?i)(select|with)\b", text):
        return False
    try:
        plan = spark.sql(f"EXPLAIN EXTENDED {text}").first()[0]
    except Exception:  # anything that Spark can't parse is no query
        return False
    parsed = plan.split("== Analyzed Logical Plan ==")[0]
    return not re.search(r"(?m)^[\s:+\-']*(InsertInto|DeleteFrom|UpdateTable|MergeInto|Create|Drop|Alter|Replace|Truncate|Set|Cache|Refresh|Load|Overwrite|Append)", parsed)


def assert_read_only(spark: SparkSession, sql: str) -> None:
    if not is_read_only(spark, sql):
        raise ValueError("only a single SELECT or WITH query is allowed")


def run_sql(spark: SparkSession, sql: str, preview: int | None = PREVIEW) -> DataFrame:
    assert_read_only(spark, sql)
    df = spark.sql(_COMMENT.sub(" ", sql).strip().rstrip(";"))
    return df if preview is None else df.limit(preview)

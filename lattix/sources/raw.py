"""Raw records from JSON lines, JSON arrays and CSV files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, record_key

RAW = (
    "id LONG, name STRING, owner STRING, description STRING, stars LONG, forks LONG, language STRING, license STRING, topics ARRAY<STRING>, "
    "pushed_at STRING, created_at STRING, is_archived BOOLEAN"
)


def parse_lines(lines: DataFrame, schema: str = RAW) -> DataFrame:
    """Records of a text table (``value``) with ``state``: good, incomplete (no owner or name) or bad (no JSON object)."""
    text = F.trim("value")
    rec = F.from_json(text, f"{schema}, __bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = lines.where(text != "").select("value", rec.alias("r"))
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull() | ~F.trim("value").startswith("{") | ~F.trim("value").endswith("}")
    incomplete = blank_to_null(F.col("r.owner")).isNull() | blank_to_null(F.col("r.name")).isNull()
    state = F.when(bad, "bad").when(incomplete, "incomplete").otherwise("good")
    # a line that is no record has no fields, even where a parser would take some
    return rows.select("value", state.alias("state"), F.when(~bad, F.col("r")).alias("r")).select("value", "state", "r.*").drop("__bad")


def scan_jsonl(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    return parse_lines(spark.read.text(path), schema)


def scan_json_array(spark: SparkSession, path: str | list[str], schema: str = RAW) -> DataFrame:
    """Records of files that each hold one JSON array of any layout. A file is parsed by one task."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    incomplete = blank_to_null(F.col("owner")).isNull() | blank_to_null(F.col("name")).isNull()
    return rows.withColumn("state", F.when(incomplete, "incomplete").otherwise("good"))


def parse_array_lines(lines: DataFrame, schema: str = RAW) -> DataFrame:
    """As ``parse_lines`` for the lines of arrays: brackets and commas around a line's records are cut off; a line may hold several."""
    text = F.regexp_replace(F.regexp_replace("value", r"^\s*\[", ""), r"\s*[,\]]?\s*$", "")
    text = F.regexp_replace(text, r"^\s*,|\s+$", "")
    rows = lines.select(F.trim(text).alias("value")).where("value <> ''")
    several = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<string>")
    # a line that is no list of values stays as it is and is counted as bad
    return parse_lines(rows.select(F.explode(F.coalesce(several, F.array("value"))).alias("value")).where("value is not null"), schema)


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """file, layout: lines, array (records with brackets and commas at the ends of lines) or nested (any other array).

    A file whose first character that is not blank is a bracket is an array. It is taken line by line if at least half of
    its lines hold whole records. One pass over the text, with sums per task.
    """
    m = F.col("_metadata")
    lines = spark.read.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("at"), F.monotonically_increasing_id().alias("nth"), F.trim("value").alias("value")).where("value <> ''")
    whole = F.col("value").rlike(r"^\[?\s*\{.*\}\s*[,\]]?$")
    found = lines.groupBy("file").agg(F.min_by(F.substring("value", 1, 1), F.struct("at", "nth")).alias("first"), F.count_if(whole).alias("whole"), F.count("*").alias("n"))
    by_line = 2 * F.col("whole") >= F.greatest(F.col("n") - 2, F.lit(1))  # brackets alone may be on two of the lines
    return found.select("file", F.when(F.col("first") != "[", "lines").when(by_line, "array").otherwise("nested").alias("layout"))


def scan_records(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """Records with their ``state`` from a folder of JSON lines and JSON arrays, told apart by each file's first character.

    Lines, and arrays with whole records on their lines, are read as text, so large files are split over tasks; other
    arrays are parsed by one task a file. The names of array files go through the driver, which lists the files anyway.
    """
    kinds = layouts(spark, path).where("layout <> 'lines'").collect()
    by = {k: [r["file"] for r in kinds if r["layout"] == k] for k in ("array", "nested")}
    arrays = [f for files in by.values() for f in files]
    text = spark.read.text(path)
    plain = text.where(~F.col("_metadata.file_path").isin(arrays)) if arrays else text
    out = parse_lines(plain.select("value"), schema)
    if by["array"]:
        out = out.unionByName(parse_array_lines(spark.read.text(by["array"]), schema))
    if by["nested"]:
        out = out.unionByName(scan_json_array(spark, by["nested"], schema).withColumn("value", F.lit(None).cast("string")))
    return out


def number(c: Column) -> Column:
    """A whole number with or without thousands separators; 0 if it is none."""
    return F.coalesce(F.regexp_replace(c.cast("string"), "[, ]", "").try_cast("double").cast("long"), F.lit(0))


def from_url(url: Column) -> tuple[Column, Column]:
    """Owner and name: the last two parts of a repository's address."""
    parts = F.split(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", ""), "/")
    return F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))


def union_sources(sources: list[tuple[DataFrame, dict[str, Column]]], floor: int = 500) -> DataFrame:
    """One table of several with a mapping each; earlier sources win per lower-cased address.

    A mapping gives url, stars and any further columns. The floor on stars is not applied to the first source; within
    that one the last row of an address (by ``pos`` where it is mapped) counts, elsewhere the first.
    """
    parts = []
    for prio, (df, mapping) in enumerate(sources):
        part = df.select(*[c.alias(k) for k, c in mapping.items()]).withColumn("prio", F.lit(prio))
        if "pos" not in mapping:
            part = part.withColumn("pos", F.monotonically_increasing_id())
        parts.append(part if prio == 0 else part.where(F.col("stars") >= floor))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    nth = F.row_number().over(Window.partitionBy(F.lower("url")).orderBy("prio", F.when(F.col("prio") == 0, -F.col("pos")).otherwise(F.col("pos"))))
    return rows.withColumn("__n", nth).where("__n = 1").drop("__n", "pos")


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("key", record_key(F.col("owner"), F.col("name")))

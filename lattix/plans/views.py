"""Catalog-shaped views of the star-schema tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: "Now" for everything that depends on age: 2002-01-02, after the last ship date.
AS_OF = 1_010_000_000

_VIEWS = {
    "C": """SELECT CAST(p_partkey AS BIGINT) AS id, concat(replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING)) AS name, p_brand AS owner,
    concat(p_brand, '/', replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING)) AS full_name,
    lower(concat(p_brand, '/', replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING))) AS key,
    stars, forks, p_type AS language, concat('Domain-', CAST(p_size % 10 AS STRING)) AS domain,
    CASE WHEN p_size % 4 = 0 THEN 'General Components' ELSE concat('Sub-', CAST(p_size % 7 AS STRING)) END AS subsystem,
    split_part(p_name, ' ', 2) AS artifact,
    CASE p_partkey % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL-3.0' WHEN 2 THEN 'SSPL-1.0' WHEN 3 THEN 'NOASSERTION' ELSE 'Apache-2.0' END AS license,
    concat('A ', p_name, ' by ', p_brand) AS description,
    split_part(p_name, ' ', 1) AS t1, split_part(p_name, ' ', 2) AS t2, lower(p_type) AS t3,
    CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST({EPOCH}(pushed_at) AS BIGINT) END AS pushed_epoch, (p_partkey % 13 = 0) AS is_archived
  FROM {part} JOIN (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS stars, count(DISTINCT l_orderkey) AS forks, max(l_shipdate) AS pushed_at
    FROM {lineitem} GROUP BY l_partkey) li ON p_partkey = l_partkey""",
    "T": "SELECT id, t1 AS topic FROM C UNION SELECT id, t2 FROM C UNION SELECT id, t3 FROM C",
    "K": "SELECT id, key, full_name, stars, forks, description, license FROM C WHERE id % 10 <> 0",
    "H": """SELECT id + 1000000 AS id, key, full_name, stars + id % 5 AS stars, forks,
    CASE WHEN id % 3 = 0 THEN '' ELSE description END AS description, license FROM C WHERE id % 7 <> 0""",
    "S": """SELECT CAST(d AS STRING) AS snapshot_date, concat('user/', CAST(user_id AS STRING)) AS full_name,
    CAST(sum(n) OVER (PARTITION BY user_id ORDER BY d) AS BIGINT) AS stars
  FROM (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM {events} GROUP BY user_id, CAST(ts AS DATE)) e""",
    "D": "SELECT doc_id AS id, concat('doc-', CAST(doc_id AS STRING)) AS name, source AS owner, lang AS language, n_chars AS stars, text AS description FROM {documents}",
    "Q": "SELECT item_id AS qid, concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3), ' ', split_part(text, ' ', 4)) AS q FROM {benchmark}",
    "P": "SELECT DISTINCT l_orderkey AS pool, l_partkey AS id FROM {lineitem}",
}
_NEEDS = {"T": ("C",), "K": ("C",), "H": ("C",)}
_TABLES = ("part", "lineitem", "events", "documents", "benchmark")


def _with(names: tuple[str, ...]) -> str:
    wanted = [v for v in _VIEWS if v in names or any(v in _NEEDS.get(n, ()) for n in names)]
    return "WITH " + ",\n".join(f"{v} AS ({_VIEWS[v]})" for v in wanted)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _with((name,)) + f"\nSELECT * FROM {name}"
    sql = sql.replace("{EPOCH}", "unix_timestamp")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in sql})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def oracle(sql: str, *names: str) -> str:
    """DuckDB SQL over the views that it names; further CTEs may follow a leading comma."""
    head = _with(names or ("C",)).replace("{EPOCH}", "epoch")
    for t in _TABLES:
        head = head.replace("{" + t + "}", t)
    return head + ("" if sql.startswith(",") else "\n") + sql

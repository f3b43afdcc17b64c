"""Queries of sources, scalar functions, filters and facets (operators 01 to 48, 58 to 68, 86 to 90)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..functions.lexicons import ARTIFACT_EVIDENCE, ARTIFACTS
from ..operators import classify, facets, filters, score, sql
from ..sources import catalog as files
from ..sources import raw, variants
from ..sources.shared import shared_path
from ..streaming import upsert as upserts
from ..streaming.ingest import ingest, read_target
from .registry import register
from .views import AS_OF, oracle, table, view

#: Words of a small rule set over part names and types.
LEXICON = {"Warm": [r"\bred\b", r"\bhot\b"], "Cool": [r"\bblue\b", r"\bcold\b"], "Round": [r"\bring\b", r"\bplate\b"], "Metal": [r"\banvil\b", r"\bbolt\b", r"\brod\b"], "Age": [r"\bold\b", r"\bnew\b"]}
TYPED = "CASE id % 8 WHEN 0 THEN 'a cli tool' WHEN 1 THEN 'client library' WHEN 2 THEN 'query engines' WHEN 3 THEN 'web framework template' WHEN 4 THEN 'in memory store' WHEN 5 THEN 'language extension' WHEN 6 THEN 'curated list of sdk' ELSE 'thing' END"
#: Order and position of catalog rows in SQL.
ORD = "row_number() OVER (ORDER BY stars DESC, full_name) - 1"


def C(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "C")


def cat(spark: SparkSession, d: str) -> DataFrame:
    """View C with tags, primitives, licence tier, activity and hook."""
    c = C(spark, d)
    return c.withColumns({
        "topics": F.array_distinct(F.array("t1", "t2", "t3")), "primitives": F.array("t1"), "license_tier": scalars.license_tier(F.col("license")),
        "activity_status": scalars.activity(F.col("pushed_epoch"), F.col("is_archived"), AS_OF), "hook": text.hook(F.col("description")),
    })


#: The same in DuckDB, but for arrays.
STATUS = f"CASE WHEN is_archived THEN 'archived' WHEN pushed_epoch IS NULL THEN NULL WHEN {AS_OF} - pushed_epoch <= 31536000 THEN 'active' ELSE 'idle' END"
TIER = "CASE license WHEN 'MIT' THEN 'permissive' WHEN 'Apache-2.0' THEN 'permissive' WHEN 'GPL-3.0' THEN 'copyleft' WHEN 'SSPL-1.0' THEN 'source-available' ELSE 'unknown' END"
SIGNAL = f"""SELECT *, CAST(round_even(least(100.0, greatest(0.0, 45.0 * sp + 25.0 * rec + 20.0 * fp)), 0) AS INTEGER) AS signal FROM (
  SELECT *, (rank() OVER (ORDER BY CAST(stars AS DOUBLE)) + (count(*) OVER (PARTITION BY stars) - 1) / 2.0) / count(*) OVER () AS sp,
    (rank() OVER (ORDER BY (forks + 1.0) / (stars + 1.0)) + (count(*) OVER (PARTITION BY (forks + 1.0) / (stars + 1.0)) - 1) / 2.0) / count(*) OVER () AS fp,
    CASE WHEN coalesce(pushed_epoch, 0) = 0 THEN 0.5 ELSE exp(-greatest(0.0, ({AS_OF} - pushed_epoch) / 86400.0) / 548.0) END AS rec FROM C) s"""


# Sources and sinks.


def raw_scan(spark, d):
    c = C(spark, d)
    rec = F.to_json(F.struct("id", "name", F.when(F.col("id") % 49 == 0, "").otherwise(F.col("owner")).alias("owner"), "stars"))
    lines = c.select(F.when(F.col("id") % 50 == 0, F.substring(rec, 1, 10)).otherwise(rec).alias("value"))
    return raw.parse_lines(lines).select("id", "name", "stars", "state")


register("op_01_raw_scan", raw_scan, oracle(
    """SELECT CASE WHEN id % 50 <> 0 THEN id END AS id, CASE WHEN id % 50 <> 0 THEN name END AS name, CASE WHEN id % 50 <> 0 THEN stars END AS stars,
    CASE WHEN id % 50 = 0 THEN 'bad' WHEN id % 49 = 0 THEN 'incomplete' ELSE 'good' END AS state FROM C"""))


def record_files(rows: int) -> int:
    """Files of a layout of arrays: 64, and one more for each 50,000 rows."""
    return 64 + rows // 50_000


def records_scan(spark, d):
    """A folder of JSON lines, arrays by line, arrays in one line and nested arrays, with bad lines, blanks and incomplete records."""
    path = shared_path(spark, "records")
    c = C(spark, d)
    rec = F.to_json(F.struct("id", "name", F.when(F.col("id") % 49 == 0, "").otherwise(F.col("owner")).alias("owner"), "stars"))
    row = F.when(F.col("id") % 50 == 1, F.substring(rec, 1, 10)).otherwise(rec)
    c.where("id % 4 = 0").select(F.explode(F.array(row, F.lit("  "))).alias("value")).write.text(f"{path}/lines")
    # runs of 100 ids dealt to files, so that a large table gets files of some 50,000 ids and not one for each run
    file = F.pmod(F.floor(F.col("id") / 100), F.lit(record_files(table(spark, d, "part").count()))).alias("f")
    # brackets on lines of their own or beside a record, commas at the ends
    few = c.where("id % 4 = 1").groupBy(file).agg(F.sort_array(F.collect_list(row)).alias("r"))
    few.select(F.concat(F.when(F.col("f") % 2 == 0, "[\n").otherwise("["), F.array_join("r", ",\n\n"), F.lit("\n]\n")).alias("value"), "f").write.partitionBy("f").text(f"{path}/arrays")
    whole = c.where("id % 4 = 2 and id % 50 <> 1").groupBy(file).agg(F.collect_list(rec).alias("r"))
    whole.select(F.concat(F.lit("[ "), F.array_join("r", ", "), F.lit("]")).alias("value"), "f").write.partitionBy("f").text(f"{path}/one-line")
    nested = c.where("id % 4 = 3 and id % 50 <> 1").groupBy(file).agg(F.collect_list(F.regexp_replace(rec, ",", ",\n")).alias("r"))
    nested.select(F.concat(F.lit("[\n"), F.array_join("r", ",\n"), F.lit("\n]")).alias("value"), "f").write.partitionBy("f").text(f"{path}/nested")
    spark_paths = [f"{path}/{k}" for k in ("lines", "arrays/*", "one-line/*", "nested/*")]
    return functools.reduce(DataFrame.unionByName, [raw.scan_records(spark, p) for p in spark_paths]).select("id", "name", "stars", "state")


register("op_01_records_scan", records_scan, oracle(
    """SELECT CASE WHEN id % 50 <> 1 OR id % 4 > 1 THEN id END AS id, CASE WHEN id % 50 <> 1 OR id % 4 > 1 THEN name END AS name, CASE WHEN id % 50 <> 1 OR id % 4 > 1 THEN stars END AS stars,
    CASE WHEN id % 50 = 1 THEN 'bad' WHEN id % 49 = 0 THEN 'incomplete' ELSE 'good' END AS state FROM C WHERE id % 4 < 2 OR id % 50 <> 1"""))


def decoded(spark, d):
    coded, tables = files.encode(C(spark, d).withColumn("ord", F.col("id")), ("language", "domain", "artifact"))
    return files.decode(coded.select("id", "language_code", "domain_code", "artifact_code"), tables)


register("op_02_decode", decoded, oracle("SELECT id, language, domain, artifact FROM C"))


def _details(spark, d, target=100):
    path = shared_path(spark, "details")
    files.write_details(C(spark, d).select("id", "domain", "description"), path, target)
    return path


register("op_03_details_scan", lambda s, d: files.read_details(s, _details(s, d), "id LONG, domain STRING, description STRING").select("id", "description", "slug"),
         oracle("SELECT id, description, lower(domain) AS slug FROM C"))


def sources(spark, d):
    def side(df, key, nation, amount):
        return df, {"url": F.concat(F.lit("https://Host/"), F.col(nation), F.lit("/"), F.col(key) % 40), "stars": raw.number(F.format_number(F.floor(amount), 0)), "pos": F.col(key)}

    rows = raw.union_sources([side(table(spark, d, "customer"), "c_custkey", "c_nationkey", "c_acctbal"), side(table(spark, d, "supplier"), "s_suppkey", "s_nationkey", "s_acctbal")])
    return rows.select(F.lower("url").alias("url"), "stars", "prio")


register("op_04_union_sources", sources,
         """WITH a AS (SELECT concat('https://host/', c_nationkey, '/', c_custkey % 40) AS url, CAST(floor(c_acctbal) AS BIGINT) AS stars, 0 AS prio, -c_custkey AS pos FROM customer
    UNION ALL SELECT concat('https://host/', s_nationkey, '/', s_suppkey % 40), CAST(floor(s_acctbal) AS BIGINT), 1, s_suppkey FROM supplier WHERE floor(s_acctbal) >= 500)
    SELECT url, stars, prio FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY prio, pos) AS n FROM a) x WHERE n = 1""")

_PARTS = """, p AS (SELECT lower(domain) AS slug, count(*) AS rows, CAST(CASE WHEN (count(*) - 1) // 100 <= 0 THEN 1 ELSE 2 ^ (floor(log2((count(*) - 1) // 100)) + 1) END AS BIGINT) AS parts FROM C GROUP BY 1)"""


def detail_parts(spark, d):
    """Parts as they were written, with their rows and their bytes as JSON lines."""
    kept = spark.read.schema("id LONG, domain STRING, description STRING, slug STRING, part LONG").parquet(_details(spark, d))
    return files.part_bytes(kept)


register("op_05_details_sink", detail_parts, oracle(_PARTS + """ SELECT slug, id % parts AS part, count(*) AS rows, CAST(sum(octet_length(encode(concat('{"id":', id, ',"domain":"', domain, '","description":"', description, '"}'))) + 1) AS BIGINT) AS bytes
    FROM (SELECT id, domain, description, lower(domain) AS slug FROM C) c JOIN p USING (slug) GROUP BY 1, 2"""))
register("op_06_part_fanout", lambda s, d: files.parts_by_slug(C(s, d), 100), oracle(_PARTS + " SELECT slug, rows, parts FROM p"))


def flat(spark, d):
    path = shared_path(spark, "flat")
    files.flat_rows(C(spark, d)).write.parquet(path)
    return spark.read.parquet(path).select("id", "full_name", "stars", "language", "domain", "description")


register("op_07_flat_sink", flat, oracle("SELECT id, full_name, stars, language, domain, description FROM C"))
register("op_08_label_codes", lambda s, d: files.label_codes(C(s, d).withColumn("ord", F.col("id")), "language").select("label", F.col("code").cast("long").alias("code")),
         oracle("SELECT language AS label, row_number() OVER (ORDER BY min(id)) - 1 AS code FROM C GROUP BY language"))


def csv_export(spark, d):
    path = shared_path(spark, "csv")
    quoted = F.concat(F.lit('say "'), F.col("name"), F.lit('", twice'))
    files.write_csv(C(spark, d).select("id", "full_name", quoted.alias("text"), "pushed_epoch"), path)
    return spark.read.schema("id LONG, full_name STRING, text STRING, pushed_epoch LONG").option("header", True).option("escape", '"').csv(path)


register("op_09_csv_export", csv_export, oracle("""SELECT id, full_name, concat('say "', name, '", twice') AS text, pushed_epoch FROM C"""))


def _snapshots(spark, d):
    path = shared_path(spark, "snapshots")
    days = view(spark, d, "S")
    files.write_snapshots(days, path)
    last = days.agg(F.max("snapshot_date")).first()[0]
    files.write_snapshot(days.where(F.col("snapshot_date") == last).withColumn("stars", F.col("stars") + 1), path, last)
    return files.read_snapshots(spark, path)


_S = ", m AS (SELECT snapshot_date, full_name, stars + CAST(snapshot_date = (SELECT max(snapshot_date) FROM S) AS INT) AS stars FROM S)"
register("op_10_snapshot_sink", lambda s, d: _snapshots(s, d).select("snapshot_date", "full_name", "stars", F.count("*").over(Window.partitionBy("snapshot_date")).alias("of_day")),
         oracle(_S + " SELECT snapshot_date, full_name, CAST(stars AS BIGINT) AS stars, count(*) OVER (PARTITION BY snapshot_date) AS of_day FROM m", "S"))
register("op_11_snapshot_scan", lambda s, d: _snapshots(s, d).select("snapshot_date", "full_name", "stars"), oracle(_S + " SELECT snapshot_date, full_name, CAST(stars AS BIGINT) AS stars FROM m", "S"))


def incremental(spark, d):
    source, target, state = (shared_path(spark, n) for n in ("drops", "ingested", "state"))
    c = C(spark, d).select("id", "name", "owner", "stars")
    lines = c.select(F.to_json(F.struct("*")).alias("value"))
    broken = c.where("id % 100 = 1").select(F.lit('{"name": ').alias("value"))
    c.where("id % 2 = 0").select(F.to_json(F.struct("*")).alias("value")).unionByName(broken).write.mode("append").text(source)
    ingest(spark, source, target, state)
    lines.unionByName(lines).write.mode("append").text(source)
    ingest(spark, source, target, state)
    ingest(spark, source, target, state)
    return read_target(spark, target).select("key", "stars", (F.col("batch") > 0).alias("later"))


register("op_12_incremental_ingest", incremental, oracle("SELECT key, stars, id % 2 <> 0 AS later FROM C"))


def streamed_upserts(spark, d):
    """Three drops of files: some rows, all with refreshed counts, and a repetition with blank descriptions for some."""
    source, target, state = (shared_path(spark, n) for n in ("drops", "catalog", "state"))
    c = C(spark, d).select("id", "name", "owner", "stars", "forks", "description", "license", "language")
    broken = c.where("id % 100 = 1").select(F.lit('{"name": ').alias("value"))
    third = c.where("id % 3 = 0").withColumns({"id": F.col("id") + 5_000_000, "stars": F.col("stars") + 100, "description": F.when(F.col("id") % 2 == 0, "").otherwise(F.col("description"))})
    for drop in (c.where("id % 2 = 0"), c.withColumn("stars", F.col("stars") + F.col("id") % 5), third.unionByName(third.withColumn("stars", F.col("stars") - 1))):
        drop.select(F.to_json(F.struct("*")).alias("value")).unionByName(broken).write.mode("append").text(source)
        upserts.ingest_upserts(spark, source, target, state, buckets=8, order="stars")
    upserts.ingest_upserts(spark, source, target, state, buckets=8, order="stars")
    return upserts.read_catalog(spark, target).select("key", "id", "stars", "forks", "description", "license", "language")


register("op_12_streaming_upsert", streamed_upserts, oracle(
    """SELECT key, id, stars + CASE WHEN id % 3 = 0 THEN 100 ELSE id % 5 END AS stars, forks, CASE WHEN id % 6 = 0 THEN '' ELSE description END AS description,
    CASE WHEN license = 'NOASSERTION' THEN 'Unknown' ELSE license END AS license, language FROM C"""))


def json_lines(spark, d):
    path = shared_path(spark, "json")
    files.write_json_lines(C(spark, d).select("id", "name", "owner", "stars"), path)
    return raw.scan_jsonl(spark, path).select("id", "name", "owner", "stars", "state")


register("op_13_json_lines", json_lines, oracle("SELECT id, name, owner, stars, 'good' AS state FROM C"))

# Scalar functions.

register("op_14_record_key", lambda s, d: C(s, d).select("id", text.record_key(F.col("owner"), F.col("name")).alias("key")), oracle("SELECT id, key FROM C"))
register("op_15_slugify", lambda s, d: table(s, d, "pages").select("page_id", text.slugify(F.col("url")).alias("slug")),
         """WITH x AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '&', 'and', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages)
    SELECT page_id, CASE WHEN slug = '' THEN 'other-general' ELSE slug END AS slug FROM x""")


def tags(spark, d):
    pair = F.concat(F.lit('["'), F.col("t1"), F.lit('", "'), F.col("t2"), F.lit('"]'))
    given = F.array(pair, F.concat(F.lit("  "), F.upper("t1")), F.lit(" "), F.col("t3"))
    return C(spark, d).select("id", F.explode(text.normalise_tags(given)).alias("topic"))


register("op_16_normalise_tags", tags, oracle("SELECT id, topic FROM T", "T"))
register("op_17_normalize_license", lambda s, d: C(s, d).select("id", scalars.normalize_license(F.col("license")).alias("license")),
         oracle("SELECT id, CASE WHEN license = 'NOASSERTION' THEN 'Unknown' ELSE license END AS license FROM C"))
register("op_18_license_terms", lambda s, d: C(s, d).select("id", scalars.license_terms(F.col("license")).alias("t")).select("id", "t.tier", "t.commercial", "t.desc"), oracle(
    """SELECT id, CASE WHEN license IN ('MIT', 'Apache-2.0') THEN 'Permissive' WHEN license = 'GPL-3.0' THEN 'Copyleft' WHEN license = 'SSPL-1.0' THEN 'Fair-Core / Source-Available' ELSE 'Unknown / Unspecified' END AS tier,
    CASE WHEN license IN ('MIT', 'Apache-2.0') THEN 'Commercially Friendly' WHEN license = 'GPL-3.0' THEN 'Source-Reciprocal (Caution)' WHEN license = 'SSPL-1.0' THEN 'Cloud Restriction' ELSE 'Custom Terms' END AS commercial,
    CASE WHEN license IN ('MIT', 'Apache-2.0') THEN 'Permissive license allowing proprietary commercial usage and modification without source redistribution.' WHEN license = 'GPL-3.0' THEN 'Copyleft license requiring derivative works or hosted modifications to make source available.'
    WHEN license = 'SSPL-1.0' THEN 'Source-available license restricting competitive hosted cloud-service offerings.' ELSE 'Custom or unspecified license. Review the repository LICENSE file for explicit commercial terms.' END AS "desc" FROM C"""))
register("op_19_license_tier", lambda s, d: C(s, d).select("id", scalars.license_tier(F.col("license")).alias("tier")), oracle(f"SELECT id, {TIER} AS tier FROM C"))
register("op_20_parse_epoch", lambda s, d: table(s, d, "events").select("event_id", scalars.parse_epoch(F.when(F.col("event_id") % 7 == 0, "no date").otherwise(F.col("ts").cast("string"))).alias("epoch")),
         "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS epoch FROM events")
register("op_21_real_date", lambda s, d: table(s, d, "events").select("event_id", scalars.real_date(F.when(F.col("event_id") % 5 == 0, scalars.MISSING_DATE).otherwise(F.col("ts").cast("date").cast("string"))).alias("day")),
         "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day FROM events")
register("op_22_activity", lambda s, d: C(s, d).select("id", scalars.activity(F.col("pushed_epoch"), F.col("is_archived"), AS_OF).alias("status")), oracle(f"SELECT id, {STATUS} AS status FROM C"))
_LATER = AS_OF + 1300 * 86_400
register("op_23_maturity", lambda s, d: C(s, d).select("id", scalars.maturity(F.col("stars") * 50, F.col("forks") * 50, F.col("pushed_epoch"), _LATER).alias("m")).select("id", "m.rating", "m.level"), oracle(
    f""", x AS (SELECT id, stars * 50 AS s, forks * 50 AS f, floor(({_LATER} - pushed_epoch) / 86400.0) / 365.25 >= 4 AS old, year(make_timestamp(pushed_epoch * 1000000)) AS y FROM C)
    SELECT id, CASE WHEN old THEN concat('Dormant Legacy (last push ', y, ')') WHEN s >= 50000 THEN 'Hyper-Scale / Industry Standard' WHEN s >= 20000 AND f >= 1000 THEN 'Production Battle-Tested'
      WHEN s >= 20000 THEN 'High Adoption / Low Fork Traction' WHEN s >= 5000 THEN 'Rapid Growth / Emerging Core' ELSE 'Promising / Specialized' END AS rating,
    CASE WHEN old THEN 'tier-4' WHEN s >= 50000 THEN 'tier-1' WHEN s >= 20000 AND f >= 1000 THEN 'tier-2' WHEN s >= 5000 THEN 'tier-3' ELSE 'tier-4' END AS level FROM x"""))
register("op_24_tokenize", lambda s, d: view(s, d, "D").select("id", text.tokens(F.col("description")).alias("t")).select("id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("in_order")), oracle(
    ", x AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(description, '')), '[^a-z0-9]+'), lambda t: t <> '') AS t FROM D) SELECT id, CAST(len(t) AS BIGINT) AS tokens, CAST(len(list_distinct(t)) AS BIGINT) AS distinct_tokens, md5(array_to_string(t, ' ')) AS in_order FROM x", "D"))
_WORDS = ("the", "tion", "key-value", "que")
register("op_25_keyword_match", lambda s, d: view(s, d, "D").select("id", *[text.has_keyword(F.lower("description"), w).alias(f"k{i}") for i, w in enumerate(_WORDS)]), oracle(
    "SELECT id, " + ", ".join(f"regexp_matches(lower(description), '{text.keyword_pattern(w)}') AS k{i}" for i, w in enumerate(_WORDS)) + " FROM D", "D"))


def _lexicon_sql(lexicon: dict, corpus: str, most: int = 4) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({corpus}, '(?i){'|'.join(p)}') THEN '{label}' END" for label, p in lexicon.items())
    return f"list_slice(list_filter([{cases}], lambda x: x IS NOT NULL), 1, {most})"


register("op_26_lexicon_tags", lambda s, d: C(s, d).select("id", F.array_join(text.lexicon_tags(F.col("description"), LEXICON, 2), "|").alias("labels")),
         oracle(f"SELECT id, array_to_string({_lexicon_sql(LEXICON, 'description', 2)}, '|') AS labels FROM C"))


def _artifact_sql() -> str:
    """The scores of all labels over (low, corpus), written out from the evidence table."""
    sums = {}
    for label, rules in ARTIFACT_EVIDENCE.items():
        sums[label] = " + ".join(f"CASE WHEN regexp_matches(low, '{text.keyword_pattern(w)}') THEN {a} WHEN regexp_matches(corpus, '{text.keyword_pattern(w)}') THEN {b} ELSE 0 END" for words, a, b in rules for w in words)
    best = "greatest(" + ", ".join(f"s{ARTIFACTS.index(label)}" for label in sums) + ")"
    cols = ", ".join(f"{total} AS s{ARTIFACTS.index(label)}" for label, total in sums.items())
    pick = " ".join(f"WHEN s{ARTIFACTS.index(label)} = {best} THEN '{label}'" for label in sums)
    return f""", x AS (SELECT id, lower(name) AS low, concat(lower(name), chr(10), lower({TYPED}), chr(10)) AS corpus, {TYPED} AS descr FROM C), y AS (SELECT id, descr, {cols} FROM x)
    SELECT id, CASE WHEN regexp_matches(descr, 'curated list') THEN '{ARTIFACTS[0]}' WHEN {best} <= 0 THEN '{ARTIFACTS[-1]}' {pick} END AS artifact FROM y"""


register("op_27_artifact", lambda s, d: C(s, d).select("id", classify.artifact(F.col("name"), F.expr(TYPED), F.array().cast("array<string>")).alias("artifact")), oracle(_artifact_sql()))

#: A small rule set over part names and types.
RULES = [
    {"domain": "Hardware & Tools", "keywords": ["anvil", "bolt", "gear", "rod"], "strong": ["anvil", "bolt"], "subsystems": {"Fixings": ["bolt", "ring"], "Shop": ["anvil"]}},
    {"domain": "Colours", "keywords": ["red", "blue", "red-ring", "economy"], "strong": ["red"], "subsystems": {"Warm": ["red"], "Cold": ["blue", "cold"]}},
    {"domain": "Things", "keywords": ["gizmo", "widget", "plate", "small", "standard"], "strong": ["widget"], "subsystems": {"Little": ["small"], "Big": ["large"]}},
]


def labelled(spark, d):
    return classify.domains(cat(spark, d), RULES)


def _domain_sql() -> str:
    tag, body = "concat_ws(chr(10), t1, t2, t3)", "lower(concat_ws(' ', name, description, concat_ws(' ', t1, t2, t3), language))"
    hit = lambda where, w: f"regexp_matches({where}, '{text.keyword_pattern(w)}')"
    out, subs = [], []
    for r in RULES:
        strong, weak = [k for k in r["keywords"] if k in r["strong"]], [k for k in r["keywords"] if k not in r["strong"]]
        score_ = " + ".join([f"CASE WHEN {hit('tags', k)} THEN 6 WHEN {hit('body', k)} THEN 1 ELSE 0 END" for k in strong] + [f"CASE WHEN NOT {hit('tags', k)} AND {hit('body', k)} THEN 1 ELSE 0 END" for k in weak])
        score_ += f" + CASE WHEN {' OR '.join(hit('tags', k) for k in weak)} THEN 3 ELSE 0 END"
        out.append(f"SELECT id, '{r['domain']}' AS domain, {score_} AS score, {' + '.join(f'CAST({hit('tags', k)} AS INT)' for k in r['keywords'])} AS hits FROM x")
        for name, words in r["subsystems"].items():
            subs.append(f"SELECT id, '{r['domain']}' AS domain, '{name}' AS subsystem, {' + '.join(f'CASE WHEN {hit('tags', k)} THEN 4 WHEN {hit('body', k)} THEN 1 ELSE 0 END' for k in words)} AS score, {' + '.join(f'CAST({hit('tags', k)} AS INT)' for k in words)} AS hits FROM x")
    return f""", x AS (SELECT id, {tag} AS tags, {body} AS body FROM C), d AS ({' UNION ALL '.join(out)}), s AS ({' UNION ALL '.join(subs)}),
    b AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM d WINDOW w AS (PARTITION BY id ORDER BY score DESC, hits DESC, domain)),
    p AS (SELECT id, domain, score, least(9, greatest(0, score - second)) AS margin, score >= 3 AND score - second >= 2 AS sure FROM b WHERE n = 1),
    q AS (SELECT s.*, row_number() OVER (PARTITION BY id ORDER BY score DESC, hits DESC, subsystem) AS n FROM s JOIN (SELECT id, domain FROM p WHERE sure) k USING (id, domain)),
    lab AS (SELECT p.id, CASE WHEN sure THEN p.domain ELSE 'Other / General' END AS domain,
      CASE WHEN NOT sure THEN 'General Components' WHEN q.score = 0 THEN concat('General ', trim(split_part(p.domain, '&', 1))) ELSE q.subsystem END AS subsystem, CAST(margin AS INT) AS domain_margin
      FROM p LEFT JOIN q ON p.id = q.id AND q.n = 1)"""


register("op_28_domain_classifier", labelled, oracle(_domain_sql() + " SELECT * FROM lab"))
_CARD = ("what_it_does", "why_it_matters", "when_to_use", "alternatives", "key_superpowers")


def _fields(card: str):
    return [F.array_join(f"{card}.{f}", "|").alias(f) if f in _CARD[3:] else F.col(f"{card}.{f}") for f in _CARD]


register("op_29_context_card", lambda s, d: C(s, d).select("id", classify.context_card(F.col("domain"), F.col("subsystem"), F.col("language")).alias("c")).select("id", *_fields("c")), oracle(
    """SELECT id, concat('A foundational ', language, ' project in the ', domain, ' ecosystem specialized for ', subsystem, '.') AS what_it_does, concat('It solves complex ', lower(subsystem), ' challenges without requiring teams to reinvent low-level primitives.') AS why_it_matters,
    concat('Use when your application demands reliable, high-performance ', lower(subsystem), ' with active community support.') AS when_to_use, 'Standard library solutions|Cloud managed services|Alternative open source engines' AS alternatives,
    'High throughput|Low resource overhead|Battle-tested community stability' AS key_superpowers FROM C"""))
register("op_29_default_card", lambda s, d: C(s, d).select("id", classify.default_card(text.hook(F.col("description")), F.when(F.col("id") % 5 != 0, F.col("subsystem"))).alias("c")).select("id", *_fields("c")), oracle(
    """SELECT id, description AS what_it_does, 'A notable open source project with significant community adoption.' AS why_it_matters, concat('Use when building systems that require high performance in ', CASE WHEN id % 5 = 0 THEN 'its domain' ELSE subsystem END, '.') AS when_to_use,
    'Standard library solutions|Cloud managed services' AS alternatives, 'High performance|Active community|Open architecture' AS key_superpowers FROM C"""))
register("op_31_hook", lambda s, d: C(s, d).select("id", text.hook(F.when(F.col("id") % 4 == 0, " ").otherwise(F.repeat("description", 6)), None, F.concat(F.lit("card "), F.col("name"))).alias("hook")),
         oracle("SELECT id, CASE WHEN id % 4 = 0 THEN concat('card ', name) ELSE substr(repeat(description, 6), 1, 90) END AS hook FROM C"))
register("op_32_keyword_list", lambda s, d: C(s, d).select("id", F.array_join(text.keyword_list(F.col("subsystem"), F.col("artifact"), F.col("domain"), F.array("t1"), topics=F.array("t1", "t2", "t3")), "|").alias("keywords")),
         oracle("SELECT id, concat_ws('|', subsystem, artifact, domain, t1, CASE WHEN t1 <> t3 THEN t3 END) AS keywords FROM C"))
register("op_33_has_install", lambda s, d: C(s, d).select("id", text.has_install(F.when(F.col("id") % 3 == 0, F.concat(F.lit("PIP install "), F.col("name"))).when(F.col("id") % 3 == 1, F.concat(F.lit("git clone "), F.col("name")))).alias("has_install")),
         oracle("SELECT id, CAST(id % 3 = 0 AS INT) AS has_install FROM C"))


def enriched(spark, d):
    base = cat(spark, d).select("id", "name", "owner", "description", "stars", "forks", "language", "license", "topics", "pushed_epoch")
    e = classify.enrich(base, RULES, AS_OF)
    return e.select("id", "domain", "subsystem", "domain_margin", F.col("license_intel.tier").alias("tier"), F.col("maturity.level").alias("level"), F.array_join("keywords", "|").alias("keywords"), "url")


register("op_34_enrich", enriched, oracle(_domain_sql() + """ SELECT id, l.domain, l.subsystem, domain_margin,
    CASE WHEN license IN ('MIT', 'Apache-2.0') THEN 'Permissive' WHEN license = 'GPL-3.0' THEN 'Copyleft' WHEN license = 'SSPL-1.0' THEN 'Fair-Core / Source-Available' ELSE 'Unknown / Unspecified' END AS tier, 'tier-4' AS level,
    concat_ws('|', l.subsystem, 'Application / Service', l.domain, t1, t2, CASE WHEN t1 <> t3 THEN t3 END) AS keywords, concat('https://github.com/', full_name) AS url FROM C JOIN lab l USING (id)"""))


def enriched_variants(spark, d):
    """Records of four shapes in one VARIANT column, brought to plain columns and enriched."""
    c = cat(spark, d)
    i = F.col("id")
    common = [i, F.col("name"), F.col("description"), F.col("topics"), F.col("language")]
    at = F.date_format(F.timestamp_seconds("pushed_epoch"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    plain = F.struct(*common, "owner", "license", "stars", "forks", at.alias("pushed_at"))
    nested = F.struct(*common, F.struct(F.col("owner").alias("login"), i.alias("id")).alias("owner"), F.struct(F.lit("x").alias("name"), F.col("license").alias("spdx_id")).alias("license"), F.col("stars").alias("stargazers_count"), F.col("forks").alias("forks_count"), at.alias("updated_at"))
    named = F.struct(*common, F.struct(F.col("owner").alias("login")).alias("owner"), F.struct(F.col("license").alias("name")).alias("license"), F.lit(0).alias("stargazers_count"), "stars", F.lit(0).alias("forks_count"), "forks", F.lit("").alias("pushed_at"), at.alias("updated_at"))
    loose = F.struct(*common, "owner", "license", F.col("stars").cast("string").alias("stargazers_count"), F.col("forks").cast("double").alias("forks"), at.alias("pushed_at"), F.lit("2001-01-01").alias("updated_at"))
    record = F.when(i % 4 == 0, F.to_json(plain)).when(i % 4 == 1, F.to_json(nested)).when(i % 4 == 2, F.to_json(named)).otherwise(F.to_json(loose))
    rows = variants.from_variants(c.select(F.parse_json(record).alias("record"))).drop("record")
    e = classify.enrich(rows, RULES, AS_OF)
    return e.select("id", "full_name", "stars", "forks", "license", "pushed_epoch", "domain", "subsystem", F.col("license_intel.tier").alias("tier"), F.array_join("keywords", "|").alias("keywords"), "quickstart_code")


register("op_34_variant_shapes", enriched_variants, oracle(_domain_sql() + """ SELECT id, full_name, stars, forks, license, CASE WHEN id % 4 = 3 THEN coalesce(pushed_epoch, 978307200) ELSE pushed_epoch END AS pushed_epoch, l.domain, l.subsystem,
    CASE WHEN license IN ('MIT', 'Apache-2.0') THEN 'Permissive' WHEN license = 'GPL-3.0' THEN 'Copyleft' WHEN license = 'SSPL-1.0' THEN 'Fair-Core / Source-Available' ELSE 'Unknown / Unspecified' END AS tier,
    concat_ws('|', l.subsystem, 'Application / Service', l.domain, t1, t2, CASE WHEN t1 <> t3 THEN t3 END) AS keywords, concat('git clone https://github.com/', full_name, '.git') AS quickstart_code FROM C JOIN lab l USING (id)"""))
register("op_35_search_corpus", lambda s, d: C(s, d).select("id", text.search_corpus(F.col("name"), F.col("owner"), F.col("description"), F.array("t1", "t2")).alias("corpus")),
         oracle("SELECT id, lower(concat_ws(' ', name, owner, description, t1, t2)) AS corpus FROM C"))
register("op_39_sql_projection", lambda s, d: sql.repos_view(cat(s, d), None).select("id", "full_name", "topics", "compatibility", "hook"),
         oracle("SELECT id, full_name, CASE WHEN t1 = t3 OR t2 = t3 THEN concat_ws(', ', t1, t2) ELSE concat_ws(', ', t1, t2, t3) END AS topics, CAST(NULL AS VARCHAR) AS compatibility, description AS hook FROM C"))

# Filters.

register("op_40_star_floor", lambda s, d: filters.star_floor(C(s, d), 800).select("id", "stars"), oracle("SELECT id, stars FROM C WHERE stars >= 800"))
register("op_41_facet_filter", lambda s, d: filters.facet_filter(cat(s, d), domain="Domain-3", language="PROMO", license_tier="permissive").select("id", "domain", "language"),
         oracle(f"SELECT id, domain, language FROM C WHERE domain = 'Domain-3' AND language = 'PROMO' AND {TIER} = 'permissive'"))
register("op_42_array_contains", lambda s, d: filters.facet_filter(cat(s, d), primitive="red", topic="ring").select("id"), oracle("SELECT id FROM C WHERE t1 = 'red' AND t2 = 'ring'"))
register("op_43_long_tail", lambda s, d: filters.facet_filter(C(s, d).withColumn("language", F.concat_ws("-", "artifact", "owner")), language=filters.LONG_TAIL, majors=facets.major_values(C(s, d).withColumn("language", F.concat_ws("-", "artifact", "owner")), "language", 12).where("major")).select("id", "language"),
         oracle(", x AS (SELECT id, concat_ws('-', artifact, owner) AS language FROM C) SELECT id, language FROM x WHERE language NOT IN (SELECT language FROM x GROUP BY 1 HAVING count(*) >= 12)"))
register("op_44_min_signal", lambda s, d: filters.facet_filter(score.signal(C(s, d), AS_OF), min_signal=60).select("id", "signal"), oracle(f", x AS ({SIGNAL}) SELECT id, signal FROM x WHERE signal >= 60"))
register("op_45_hide_dormant", lambda s, d: filters.facet_filter(cat(s, d), hide_dormant=True).select("id", "activity_status"), oracle(f", x AS (SELECT id, {STATUS} AS activity_status FROM C) SELECT * FROM x WHERE activity_status IS NULL OR activity_status = 'active'"))
register("op_46_substring_search", lambda s, d: filters.substring_search(view(s, d, "D").withColumn("search_corpus", F.lower("description")), "The ther ION").select("id"),
         oracle("SELECT id FROM D WHERE contains(lower(description), 'the') AND contains(lower(description), 'ther') AND contains(lower(description), 'ion')", "D"))
_PRESETS = {"Promo rings": {"language": "PROMO", "query": "ring"}, "Reds": {"primitive": "red"}}
register("op_47_presets", lambda s, d: filters.preset_filter(cat(s, d).withColumn("search_corpus", F.lower("description")), "Promo rings", _PRESETS).select("id").unionByName(filters.preset_filter(cat(s, d), "Reds", _PRESETS).select("id")),
         oracle("SELECT id FROM C WHERE language = 'PROMO' AND contains(description, 'ring') UNION ALL SELECT id FROM C WHERE t1 = 'red'"))


def guarded(spark, d):
    """A statement about each catalog row, told apart by the guard."""
    make = ("SELECT id FROM repos WHERE owner = '%s; drop'", "WITH x AS (SELECT * FROM repos) SELECT count(*) FROM x -- %s;", "DROP TABLE %s", "SELECT 1; DROP TABLE `%s`", "WITH x AS (SELECT 1 AS a) INSERT INTO %s SELECT * FROM x")
    kind = F.array(*[F.format_string(m, "name") for m in make])
    return C(spark, d).select("id", sql.read_only(F.get(kind, (F.col("id") % 5).cast("int"))).alias("allowed"))


register("op_48_read_only_guard", guarded, oracle("SELECT id, id % 5 < 2 AS allowed FROM C"))

# Facets, summaries, orders.


def _ranked(spark, d):
    return cat(spark, d).withColumn("ord", F.col("id"))


register("op_58_facet_counts", lambda s, d: facets.facet_counts(_ranked(s, d).select("ord", "domain", "subsystem", "language", "license", "license_tier", "topics"), {"topic": 12}).withColumn("rank", F.col("rank").cast("int")), oracle(
    f""", x AS (SELECT 'domain' AS dimension, domain AS name, NULL AS parent, id FROM C UNION ALL SELECT 'language', language, NULL, id FROM C UNION ALL SELECT 'license', license, NULL, id FROM C
      UNION ALL SELECT 'license_tier', {TIER}, NULL, id FROM C UNION ALL SELECT 'total', 'total', NULL, id FROM C UNION ALL SELECT 'subsystem', subsystem, domain, id FROM C UNION ALL SELECT 'topic', topic, NULL, id FROM T),
    g AS (SELECT dimension, name, parent, count(*) AS count, min(id) AS f FROM x GROUP BY 1, 2, 3)
    SELECT * FROM (SELECT dimension, name, parent, count, CAST(row_number() OVER (PARTITION BY dimension ORDER BY count DESC, f, name) AS INT) AS rank FROM g) r WHERE dimension <> 'topic' OR rank <= 12""", "C", "T"))
register("op_59_major_values", lambda s, d: facets.major_values(C(s, d).withColumn("k", F.concat_ws("-", "artifact", "owner")), "k", 12).withColumn("tail_rank", F.col("tail_rank").cast("int")), oracle(
    """, g AS (SELECT concat_ws('-', artifact, owner) AS value, count(*) AS count, count(*) >= 12 AS major FROM C GROUP BY 1)
    SELECT value, count, major, CASE WHEN NOT major THEN CAST(row_number() OVER (PARTITION BY major ORDER BY count DESC, value) AS INT) END AS tail_rank, CASE WHEN NOT major THEN CAST(sum(count) OVER (PARTITION BY major) AS BIGINT) END AS tail_rows FROM g"""))
register("op_60_topics_by_domain", lambda s, d: facets.topics_by_domain(_ranked(s, d), 5).withColumn("rank", F.col("rank").cast("int")), oracle(
    """, g AS (SELECT domain, topic, count(*) AS count, min(id) AS f FROM C JOIN T USING (id) GROUP BY 1, 2), r AS (SELECT domain, topic, count, CAST(row_number() OVER (PARTITION BY domain ORDER BY count DESC, f, topic) AS INT) AS rank, max(count) OVER (PARTITION BY domain) AS m FROM g)
    SELECT domain, topic, count, rank, count / m AS weight FROM r WHERE rank <= 5""", "C", "T"))
register("op_61_facet_values", lambda s, d: facets.facet_values(C(s, d), "subsystem", "Domain-4"), oracle("SELECT DISTINCT subsystem AS value FROM C WHERE domain = 'Domain-4'"))
register("op_62_catalog_summary", lambda s, d: facets.catalog_summary(cat(s, d)), oracle(
    f"""SELECT count(*) AS rows, CAST(sum(stars) AS BIGINT) AS stars, min(stars) AS min_stars, CAST(sum(forks) AS BIGINT) AS forks, count(DISTINCT domain) AS domains, count(DISTINCT language) AS languages, count(*) AS with_topics, 100.0::DOUBLE AS with_topics_pct,
    count(*) FILTER (st = 'active') AS status_active, count(*) FILTER (st = 'idle') AS status_idle, count(*) FILTER (st = 'archived') AS status_archived, count(*) FILTER (st IS NULL) AS status_unknown FROM (SELECT *, {STATUS} AS st FROM C) x"""))
register("op_65_histogram", lambda s, d: facets.histogram(C(s, d), "language"), oracle("SELECT language AS label, count(*) AS count FROM C GROUP BY 1"))
register("op_66_global_ordinal", lambda s, d: score.global_ordinal(C(s, d).select("id", "stars", "full_name"), F.col("stars").desc(), F.col("full_name")).select("id", "ord"), oracle(f"SELECT id, {ORD} AS ord FROM C"))
register("op_67_percentile_rank", lambda s, d: score.percentile_rank_avg(C(s, d).select("id", "stars"), F.col("stars"), "pct").select("id", F.bround("pct", 9).alias("pct")),
         oracle("SELECT id, round((rank() OVER (ORDER BY stars) + (count(*) OVER (PARTITION BY stars) - 1) / 2.0) / count(*) OVER (), 9) AS pct FROM C"))
register("op_68_signal", lambda s, d: score.signal(C(s, d), AS_OF).select("id", "signal"), oracle(f", x AS ({SIGNAL}) SELECT id, signal FROM x"))


def signal_top(spark, d):
    """The flagship: the twenty rows with the highest signal among those with 500 stars, by signal, stars and name."""
    ranked = filters.star_floor(score.signal(cat(spark, d), AS_OF), 500)
    return score.page(score.ordered(ranked, "signal"), 20).select("id", "full_name", "stars", "signal", "activity_status")


register("op_68_signal_top", signal_top, oracle(f", x AS ({SIGNAL}) SELECT id, full_name, stars, signal, {STATUS} AS activity_status FROM x WHERE stars >= 500 ORDER BY signal DESC, stars DESC, full_name LIMIT 20"))
register("op_86_catalog_order", lambda s, d: score.page(score.ordered(C(s, d)), 100).select("id", "stars"), oracle("SELECT id, stars FROM C ORDER BY stars DESC, full_name LIMIT 100"))
register("op_87_recent_first", lambda s, d: score.page(score.ordered(C(s, d), "recent"), 100).select("id", "pushed_epoch"), oracle("SELECT id, pushed_epoch FROM C ORDER BY coalesce(pushed_epoch, 0) DESC, stars DESC, full_name LIMIT 100"))
register("op_88_signal_order", lambda s, d: score.page(score.ordered(score.signal(C(s, d), AS_OF), "signal"), 100).select("id", "signal"), oracle(f", x AS ({SIGNAL}) SELECT id, signal FROM x ORDER BY signal DESC, stars DESC, full_name LIMIT 100"))
register("op_89_page", lambda s, d: score.page(score.ordered(C(s, d)), 36, 36).select("id"), oracle("SELECT id FROM C ORDER BY stars DESC, full_name LIMIT 36 OFFSET 36"))

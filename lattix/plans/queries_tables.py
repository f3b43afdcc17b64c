"""Queries of merges, trends, search, graphs, recommendations, gates and the SQL console (operators 30, 36 to 38, 49 to 57, 63, 64, 69 to 85, 90 to 98)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import classify, facets, graph, merge, quality, recommend, score, search, sql, trend
from ..sources import catalog as files
from ..sources import raw
from ..sources.shared import settled, shared_path
from .queries_core import _PARTS, RULES, C, _domain_sql, cat
from .registry import register
from .views import oracle, table, view

#: The least five keys of a failing check, in SQL: rows (k, num, key).
_REPORT = """, g AS (SELECT k, count(*) AS failures, array_to_string((list(coalesce(key, 'null') ORDER BY num, key NULLS LAST))[1:5], ', ') AS detail FROM fa GROUP BY k)
    SELECT k AS "check", coalesce(failures, 0) AS failures, coalesce(detail, '') AS detail FROM nm LEFT JOIN g USING (k)"""

# Merges.


def _base_and_details(spark, d):
    c = C(spark, d)
    base = c.select("id", "key", "full_name", "stars", F.when(F.col("id") % 2 == 0, F.col("description")).otherwise("").alias("description"), F.lit("old").alias("quickstart_code"), F.array().cast("array<string>").alias("topics"))
    details = c.where("id % 3 <> 0").select("id", F.when(F.col("id") % 5 == 0, " ").otherwise(F.concat(F.lit("long "), "description")).alias("description"), F.when(F.col("id") % 4 == 0, "").otherwise("new").alias("quickstart_code"), F.array("t1", "t2").alias("topics"))
    return base, details


def attached(spark, d):
    out = merge.attach_details(*_base_and_details(spark, d))
    return out.select("id", "description", "quickstart_code", F.array_join("topics", ",").alias("topics"), "attached")


register("op_50_attach_details", attached, oracle(
    """SELECT id, CASE WHEN id % 3 <> 0 AND id % 5 <> 0 THEN concat('long ', description) WHEN id % 2 = 0 THEN description ELSE '' END AS description,
    CASE WHEN id % 3 <> 0 AND id % 4 <> 0 THEN 'new' ELSE 'old' END AS quickstart_code, CASE WHEN id % 3 <> 0 THEN concat(t1, ',', t2) ELSE '' END AS topics, id % 3 <> 0 AS attached FROM C"""))
_MERGED = """, u AS (SELECT coalesce(K.key, H.key) AS key, coalesce(K.id, H.id) AS id, CASE WHEN H.key IS NULL THEN K.stars ELSE H.stars END AS stars, CASE WHEN H.key IS NULL THEN K.description ELSE trim(H.description) END AS description,
    CASE WHEN H.key IS NULL THEN K.license WHEN H.license = 'NOASSERTION' THEN 'Unknown' ELSE H.license END AS license, CASE WHEN H.key IS NULL THEN 'kept' WHEN K.key IS NULL THEN 'new' ELSE 'refreshed' END AS change FROM K FULL JOIN H ON K.key = H.key)"""


def merged(spark, d):
    return merge.upsert(view(spark, d, "K"), view(spark, d, "H"))


register("op_51_upsert", lambda s, d: merged(s, d).select("key", "id", "stars", "description", "license", "change"), oracle(_MERGED + " SELECT * FROM u", "K", "H"))
register("op_52_unmatched", lambda s, d: merge.unmatched(view(s, d, "K"), view(s, d, "H")).select("key"), oracle("SELECT key FROM K WHERE key NOT IN (SELECT key FROM H)", "K", "H"))


def _lookups(known, fresh):
    k = merge.unmatched(known, fresh)
    m = F.floor(F.col("id") / 7) % 8
    return k.select(
        "key", F.when(m == 0, 404).when(m == 1, 451).when(m == 6, 409).otherwise(200).alias("status"), (m == 2).alias("private"), F.when(m == 3, F.lit(10)).otherwise(F.col("stars") + 7).alias("stars"),
        F.when(m == 4, F.concat(F.col("key"), F.lit("-NEW"))).when(m == 5, F.lit("brand#2/small-ring-1")).otherwise(F.col("key")).alias("current_name"))


_LOOK = """, m AS (SELECT id, key, stars, (id // 7) % 8 AS m FROM K WHERE key NOT IN (SELECT key FROM H)),
  p AS (SELECT key, m, stars + 7 AS stars, CASE m WHEN 4 THEN concat(key, '-new') WHEN 5 THEN 'brand#2/small-ring-1' ELSE key END AS current, CASE m WHEN 0 THEN 'deleted' WHEN 1 THEN 'blocked' WHEN 2 THEN 'blocked' WHEN 3 THEN 'below_threshold' WHEN 6 THEN 'empty_repo'
    WHEN 4 THEN 'renamed' WHEN 5 THEN 'renamed' ELSE 'live_unindexed' END AS verdict FROM m),
  a AS (SELECT *, CASE WHEN verdict = 'renamed' AND current IN (SELECT key FROM H) THEN 'renamed_duplicate_dropped' WHEN verdict = 'renamed' AND current IN (SELECT key FROM K) THEN 'renamed_already_in_catalog_dropped' ELSE verdict END AS reason FROM p),
  q AS (SELECT *, CASE WHEN verdict = 'live_unindexed' OR reason = 'renamed' THEN 'update' ELSE 'drop' END AS action FROM a)"""


def patch(spark, d):
    """The patch from both sides' keys, which are written once: every use of a view would join and group its tables again."""
    known, fresh = settled(view(spark, d, "K").select("id", "key", "stars"), "known"), settled(view(spark, d, "H").select("key"), "fresh")
    return merge.reconcile_patch(known, fresh, _lookups(known, fresh), 100)


register("op_53_reconcile_patch", lambda s, d: patch(s, d).select("key", "action", "reason", "current"), oracle(_LOOK + " SELECT key, action, reason, current FROM q", "K", "H"))
register("op_54_apply_patch", lambda s, d: merge.apply_patch(view(s, d, "K").select("id", "key", "stars"), patch(s, d)), oracle(
    _LOOK + """ SELECT K.id, CASE WHEN q.action = 'update' THEN q.current ELSE K.key END AS key, CASE WHEN q.action = 'update' THEN q.stars ELSE K.stars END AS stars
    FROM K LEFT JOIN q ON K.key = q.key WHERE q.action IS NULL OR q.action = 'update'""", "K", "H"))


def overlay(spark, d):
    base = C(spark, d).select("key", "id", F.col("t1").alias("beginner_intel"), F.col("t2").alias("quickstart_code"))
    seeds = base.where("id % 97 = 3").select(F.when(F.col("id") % 3 == 0, F.concat("key", F.lit("-gone"))).otherwise(F.col("key")).alias("key"), "beginner_intel", F.when(F.col("id") % 3 == 1, "other").otherwise(F.col("quickstart_code")).alias("quickstart_code"))
    table_, status = merge.overlay_curated(base, seeds)
    return table_.where("quickstart_code = 'other'").select("key", F.lit("changed").alias("status")).unionByName(status)


register("op_56_overlay_curated", overlay, oracle(
    """, s AS (SELECT CASE WHEN id % 3 = 0 THEN concat(key, '-gone') ELSE key END AS key, id % 3 AS m FROM C WHERE id % 97 = 3)
    SELECT key, 'changed' AS status FROM s WHERE m = 1 UNION ALL SELECT key, CASE m WHEN 0 THEN 'missing' WHEN 1 THEN 'updated' ELSE 'in_sync' END FROM s"""))


def looked_up(spark, d):
    c = C(spark, d)
    names = c.where("id % 50 = 7").select(F.when(F.col("id") % 2 == 0, F.upper("full_name")).otherwise(F.col("name")).alias("name")).unionByName(c.where("id % 50 = 8").select(F.concat("full_name", F.lit("-x")).alias("name")))
    return merge.lookup_details(c.select("id", "key", "name", "full_name", "stars"), c.where("id % 3 = 0").select("id", F.col("description").alias("detail")), names).select("wanted", "id", "detail")


register("op_57_lookup_details", looked_up, oracle("SELECT CASE WHEN id % 2 = 0 THEN upper(full_name) ELSE name END AS wanted, id, CASE WHEN id % 3 = 0 THEN description END AS detail FROM C WHERE id % 50 = 7"))
register("op_64_merge_counts", lambda s, d: merge.merge_counts(merged(s, d)), oracle(_MERGED + " SELECT count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'refreshed') AS refreshed, count(*) AS final FROM u", "K", "H"))


def looked_up_in_parts(spark, d):
    """The same names looked up in details that lie by slug and part, with the defaults of rows that lack something."""
    c = C(spark, d).withColumns({"url": F.concat(F.lit("https://host/"), "full_name"), "hook": F.when(F.col("id") % 4 != 1, F.col("name"))})
    details = c.where("id % 3 <> 1").select("id", "domain", F.when(F.col("id") % 5 == 0, " ").otherwise(F.concat(F.lit("run "), "name")).alias("quickstart_code"), F.when(
        F.col("id") % 2 == 0, classify.context_card(F.col("domain"), F.col("subsystem"), F.col("language"))).alias("beginner_intel"))
    path = shared_path(spark, "details")
    files.write_details(details, path, 20)
    stored = spark.read.schema(details.schema.add("slug", "string").add("part", "long")).parquet(path)
    names = c.where("id % 50 = 7").select(F.when(F.col("id") % 2 == 0, F.upper("full_name")).otherwise(F.col("name")).alias("name")).unionByName(c.where("id % 50 = 8").select(F.concat("full_name", F.lit("-x")).alias("name")))
    out = merge.lookup_details(c.select("id", "key", "name", "full_name", "stars", "domain", "subsystem", "hook", "description", "url"), stored, names, files.parts_by_slug(details, 20))
    return out.select("wanted", "id", "quickstart_code", "beginner_intel.what_it_does", "beginner_intel.when_to_use", F.array_join("beginner_intel.alternatives", "|").alias("alternatives"))


register("op_57_lookup_in_parts", looked_up_in_parts, oracle(
    """SELECT CASE WHEN id % 2 = 0 THEN upper(full_name) ELSE name END AS wanted, id, CASE WHEN id % 3 <> 1 AND id % 5 <> 0 THEN concat('run ', name) ELSE concat('git clone https://host/', full_name, '.git') END AS quickstart_code,
    CASE WHEN id % 3 <> 1 AND id % 2 = 0 THEN concat('A foundational ', language, ' project in the ', domain, ' ecosystem specialized for ', subsystem, '.') WHEN id % 4 <> 1 THEN name ELSE description END AS what_it_does,
    CASE WHEN id % 3 <> 1 AND id % 2 = 0 THEN concat('Use when your application demands reliable, high-performance ', lower(subsystem), ' with active community support.') ELSE concat('Best suited for production applications requiring high performance in ', subsystem, '.') END AS when_to_use,
    CASE WHEN id % 3 <> 1 AND id % 2 = 0 THEN 'Standard library solutions|Cloud managed services|Alternative open source engines' ELSE 'Standard libraries|Cloud services|Alternative open source engines' END AS alternatives
    FROM C WHERE id % 50 = 7"""))


def merge_written(spark, d):
    """The counters of a merge of JSON lines and a patch that is written once, and of what it wrote."""
    c = settled(C(spark, d).select("key", "id", "owner", "name", "full_name", "stars", "forks", "description", "language", "domain", "subsystem"), "catalog")
    base = c.where("id % 10 <> 0").select(
        "key", "id", "owner", "name", "full_name", "stars", "forks", F.when(F.col("id") % 4 != 1, F.col("description")).otherwise("").alias("description"), "language", "domain", "subsystem",
        F.when(F.col("id") % 8 != 1, F.col("name")).otherwise("").alias("hook"))
    h = c.where("id % 7 <> 0")
    rec = F.to_json(F.struct("id", "name", F.when(F.col("id") % 49 == 3, "").otherwise(F.col("owner")).alias("owner"), (F.col("stars") + F.col("id") % 5).alias("stars"), "forks", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("description")).alias("description"), "language"))
    lines = h.select(F.when(F.col("id") % 50 == 4, F.substring(rec, 1, 10)).otherwise(rec).alias("value"))
    lines = lines.unionByName(h.where("id % 20 = 5").select(rec.alias("value")))
    path = shared_path(spark, "merged")
    found = merge.write_merged(base, raw.parse_lines(lines), path, patch(spark, d))
    out = spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("stars").alias("stars"), F.countDistinct("key").alias("keys"), F.sum(F.length("hook")).alias("hooks"))
    return found.unionByName(out.select(F.inline(F.array(*[F.struct(F.lit(f"written_{k}").alias("counter"), F.col(k).alias("n")) for k in ("n", "stars", "keys", "hooks")]))))


register("op_64_merge_written", merge_written, oracle(
    _LOOK + """, b AS (SELECT *, CASE WHEN id % 4 <> 1 THEN description ELSE '' END AS de, CASE WHEN id % 8 <> 1 THEN name ELSE '' END AS ho FROM C WHERE id % 10 <> 0),
    l AS (SELECT *, id % 50 = 4 AS bad, id % 49 = 3 AS inc FROM C WHERE id % 7 <> 0), g AS (SELECT *, CASE WHEN id % 20 = 5 THEN 2 ELSE 1 END AS reps FROM l WHERE NOT inc AND (NOT bad OR id % 20 = 5)),
    u AS (SELECT coalesce(b.key, g.key) AS key, coalesce(b.id, g.id) AS id, g.key IS NOT NULL AS hit, b.key IS NULL AS new, CASE WHEN g.key IS NULL THEN b.stars ELSE g.stars + g.id % 5 END AS stars, coalesce(g.reps, 0) AS reps,
      CASE WHEN g.key IS NULL THEN b.de WHEN g.id % 3 = 0 THEN '' ELSE g.description END AS de, CASE WHEN g.key IS NULL THEN b.ho WHEN g.id % 3 = 0 THEN '' ELSE substr(g.description, 1, 90) END AS ho,
      CASE WHEN b.key IS NULL THEN NULL ELSE b.domain END AS domain, CASE WHEN b.key IS NULL THEN NULL ELSE b.subsystem END AS subsystem, coalesce(g.language, b.language) AS language FROM b FULL JOIN g ON b.key = g.key),
    w AS (SELECT u.*, q.action, q.current, q.stars AS new_stars, coalesce(q.action = 'update' AND q.current <> u.key, false) AS moves FROM u LEFT JOIN q ON u.key = q.key),
    kk AS (SELECT *, CASE WHEN action = 'drop' THEN 'drop' WHEN moves AND (current IN (SELECT key FROM w WHERE action IS DISTINCT FROM 'drop') OR row_number() OVER (PARTITION BY moves, current ORDER BY key) > 1) THEN 'collision' WHEN action = 'update' THEN 'update' ELSE 'keep' END AS fate FROM w),
    o AS (SELECT *, trim(ho) = '' AND trim(de) = '' AS made FROM kk WHERE fate IN ('keep', 'update')), cc(counter, n) AS (
    SELECT 'bad_lines', count(*) FILTER (bad) FROM l UNION ALL SELECT 'incomplete', count(*) FILTER (inc AND NOT bad) + count(*) FILTER (inc AND id % 20 = 5) FROM l UNION ALL SELECT 'new', count(*) FILTER (new) FROM u
    UNION ALL SELECT 'refreshed', sum(CASE WHEN bad_one THEN reps - 1 ELSE reps END) - count(*) FILTER (new) FROM (SELECT u.*, coalesce(id % 50 = 4, false) AND hit AS bad_one FROM u) z
    UNION ALL SELECT 'dropped', count(*) FILTER (fate = 'drop') FROM kk UNION ALL SELECT 'updated', count(*) FILTER (fate = 'update') FROM kk UNION ALL SELECT 'collisions', count(*) FILTER (fate = 'collision') FROM kk
    UNION ALL SELECT 'hook_synthesized', count(*) FILTER (made) FROM o UNION ALL SELECT 'final', count(*) FROM o UNION ALL SELECT 'written_n', count(*) FROM o UNION ALL SELECT 'written_stars', sum(coalesce(new_stars, stars)) FROM o
    UNION ALL SELECT 'written_keys', count(DISTINCT CASE WHEN fate = 'update' THEN current ELSE key END) FROM o
    UNION ALL SELECT 'written_hooks', sum(length(CASE WHEN made THEN concat('A foundational ', language, ' project in the ', coalesce(domain, 'General'), ' ecosystem specialized for ', coalesce(subsystem, 'General Components'), '.') ELSE ho END)) FROM o)
    SELECT counter, CAST(n AS BIGINT) AS n FROM cc""", "K", "H"))
register("op_91_union_by_key", lambda s, d: merge.latest(view(s, d, "K").select("key", "stars").unionByName(view(s, d, "H").select("key", "stars")), "stars").select("key", "stars"),
         oracle("SELECT key, max(stars) AS stars FROM (SELECT key, stars FROM K UNION ALL SELECT key, stars FROM H) x GROUP BY key", "K", "H"))
register("op_92_key_parity", lambda s, d: merge.id_parity(view(s, d, "K"), view(s, d, "H"), "key"), oracle(
    "SELECT key AS value, 'left' AS side FROM K WHERE key NOT IN (SELECT key FROM H) UNION ALL SELECT key, 'right' FROM H WHERE key NOT IN (SELECT key FROM K)", "K", "H"))
register("op_93_array_sets", lambda s, d: cat(s, d).select("id", F.array("t1", "t2").alias("x"), F.array("t3", "t1").alias("y")).select(
    "id", F.array_join(F.array_intersect("x", "y"), "|").alias("both"), F.size(F.array_union("x", "y")).alias("n"), F.array_join(F.array_except("x", "y"), "|").alias("only")),
    oracle("SELECT id, t1 AS both, CAST(CASE WHEN t3 IN (t1, t2) THEN 2 ELSE 3 END AS INT) AS n, CASE WHEN t2 <> t3 THEN t2 ELSE '' END AS only FROM C"))


def rekeyed(spark, d):
    """Every row: whether it was re-keyed, the id it kept, and whether its id is in range and its own."""
    c = C(spark, d).select("full_name", "stars", F.when(F.col("id") % 9 == 0, F.col("id") + 1).when(F.col("id") % 17 == 0, F.lit(1 << 53) + F.col("id")).otherwise(F.col("id")).alias("id"))
    out = settled(merge.stable_ids(c), "rekeyed")
    own = out.groupBy("id").agg(F.count("*").alias("n"))
    fresh = F.col("id").between(merge.SYNTHETIC_ID, 2 * merge.SYNTHETIC_ID)
    sound = (F.col("n") == 1) & F.when(F.col("rekeyed"), fresh).otherwise((F.col("id") > 0) & (F.col("id") < merge.SAFE_ID))
    return out.join(own, "id").select("full_name", "rekeyed", F.when(~F.col("rekeyed"), F.col("id")).alias("kept_id"), sound.alias("sound"))


register("op_30_stable_ids", rekeyed, oracle(
    """, x AS (SELECT full_name, stars, CASE WHEN id % 9 = 0 THEN id + 1 WHEN id % 17 = 0 THEN 9007199254740992 + id ELSE id END AS id FROM C),
    y AS (SELECT full_name, id, row_number() OVER (PARTITION BY id ORDER BY stars DESC, full_name) > 1 OR id <= 0 OR id >= 9007199254740991 AS rekeyed FROM x)
    SELECT full_name, rekeyed, CASE WHEN NOT rekeyed THEN id END AS kept_id, true AS sound FROM y"""))

# Trends.


def _dates(s: DataFrame) -> tuple[str, str]:
    last = [r[0] for r in s.select("snapshot_date").distinct().orderBy(F.col("snapshot_date").desc()).limit(2).collect()]
    return last[1], last[0]


def _labels(spark, d):
    return table(spark, d, "events").groupBy(F.concat(F.lit("user/"), F.col("user_id")).alias("full_name")).agg(F.min("event_type").alias("language"), F.max("event_type").alias("domain"))


def diff(spark, d):
    s = view(spark, d, "S")
    return trend.snapshot_diff(s, *_dates(s), _labels(spark, d)).select("change", "full_name", "old_stars", "new_stars", "language", "domain")


_DIFF = """, d AS (SELECT max(snapshot_date) AS b, (SELECT max(snapshot_date) FROM S WHERE snapshot_date < (SELECT max(snapshot_date) FROM S)) AS a FROM S),
  l AS (SELECT concat('user/', user_id) AS full_name, min(event_type) AS language, max(event_type) AS domain FROM events GROUP BY 1),
  o AS (SELECT full_name, stars FROM S, d WHERE snapshot_date = a), n AS (SELECT full_name, stars FROM S, d WHERE snapshot_date = b),
  f AS (SELECT CASE WHEN o.full_name IS NULL THEN 'added' WHEN n.full_name IS NULL THEN 'removed' ELSE 'both' END AS change, coalesce(n.full_name, o.full_name) AS full_name, o.stars AS old_stars, n.stars AS new_stars FROM o FULL JOIN n ON o.full_name = n.full_name),
  mv AS (SELECT full_name, old_stars, new_stars, new_stars - old_stars AS delta, round_even((new_stars - old_stars) / old_stars * 100.0, 1) AS pct FROM f WHERE change = 'both' AND new_stars <> old_stars ORDER BY abs(new_stars - old_stars) DESC, full_name LIMIT 100)"""


def moved(spark, d):
    s = view(spark, d, "S")
    return trend.movers(s, *_dates(s), _labels(spark, d), min_stars=0), s


register("op_55_snapshot_diff", diff, oracle(_DIFF + " SELECT f.*, language, domain FROM f LEFT JOIN l USING (full_name)", "S"))
register("op_69_mover_series", lambda s, d: trend.mover_series(*moved(s, d)), oracle(_DIFF + " SELECT full_name, snapshot_date, S.stars FROM mv JOIN S USING (full_name)", "S"))
register("op_70_movers", lambda s, d: moved(s, d)[0].drop("k"), oracle(_DIFF + " SELECT mv.*, language, domain FROM mv LEFT JOIN l USING (full_name)", "S"))
register("op_70_consecutive_changes", lambda s, d: trend.consecutive_changes(view(s, d, "S")).select("full_name", "snapshot_date", "delta"),
         oracle("SELECT * FROM (SELECT full_name, snapshot_date, stars - lag(stars) OVER (PARTITION BY full_name ORDER BY snapshot_date) AS delta FROM S) x WHERE delta IS NOT NULL", "S"))


def buyers(spark, d):
    """A catalog that some names have left: users with at least as many purchases as errors."""
    per = table(spark, d, "events").groupBy(F.concat(F.lit("user/"), F.col("user_id")).alias("full_name"))
    return per.agg(F.count_if(F.col("event_type") == "purchase").alias("p"), F.count_if(F.col("event_type") == "error").alias("e")).where("p >= e").select("full_name")


register("op_84_rising", lambda s, d: trend.rising(moved(s, d)[0], buyers(s, d)).select("full_name", "delta"), oracle(
    _DIFF + """, c AS (SELECT concat('user/', user_id) AS full_name FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase') >= count(*) FILTER (event_type = 'error'))
  SELECT full_name, delta FROM mv WHERE delta > 0 AND full_name IN (SELECT full_name FROM c) ORDER BY abs(delta) DESC, full_name LIMIT 10""", "S"))
register("op_90_added_removed", lambda s, d: trend.by_stars(diff(s, d).where("change <> 'both'").select("change", "full_name", F.coalesce("new_stars", "old_stars").alias("stars"))),
         oracle(_DIFF + " SELECT change, full_name, coalesce(new_stars, old_stars) AS stars FROM f WHERE change <> 'both'", "S"))

# Search. The index is over whole texts' first 400 characters, names and sources of documents.


def _docs(spark, d):
    return view(spark, d, "D").withColumn("ord", F.col("id"))


def _index_sql(names: str = "D") -> str:
    tok = lambda c: f"unnest(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda t: t <> ''))"
    return f""", tk AS (SELECT id AS ord, {tok('name')} AS token, 1 AS bit FROM D UNION ALL SELECT id, {tok('owner')}, 2 FROM D UNION ALL SELECT id, {tok('substr(description, 1, 400)')}, 128 FROM D UNION ALL SELECT id, {tok('language')}, 256 FROM D),
  oc AS (SELECT ord, token, CAST(least(count(*), 7) AS INT) AS tf, bit_or(bit) AS field_mask FROM tk GROUP BY 1, 2),
  tm AS (SELECT token, count(*) AS df, bool_or(field_mask & 3 > 0) AS named FROM oc GROUP BY 1), terms AS (SELECT token, df FROM tm WHERE df <= greatest(1, (SELECT count(*) FROM D) // 10) AND (df >= 2 OR named)),
  po AS (SELECT oc.* FROM oc SEMI JOIN terms USING (token))"""


_WEIGHT = " + ".join(f"CASE WHEN field_mask & {1 << i} <> 0 THEN {w} ELSE 0 END" for i, w in enumerate(search.WEIGHTS))
register("op_72_index_build", lambda s, d: search.build_index(_docs(s, d))[0].select("ord", "token", "tf", "field_mask"), oracle(_index_sql() + " SELECT ord, token, tf, field_mask FROM po", "D"))
register("op_71_export_postings", lambda s, d: search.export_postings(search.build_index(_docs(s, d))[0]).select("token", "block", F.array_join(F.transform("postings", lambda x: F.concat_ws(":", x["gap"], x["code"])), ",").alias("postings")), oracle(
    _index_sql() + """, g AS (SELECT token, ord, concat(ord - coalesce(lag(ord) OVER (PARTITION BY token ORDER BY ord), 0), ':', tf * 1024 + field_mask) AS pair FROM po)
    SELECT token, ord // 1048576 AS block, string_agg(pair, ',' ORDER BY ord) AS postings FROM g GROUP BY 1, 2""", "D"))


def searched(spark, d):
    docs = _docs(spark, d)
    postings, terms = search.build_index(docs)
    return search.search(postings, terms, docs.count(), view(spark, d, "Q"), docs, top=10).select("qid", "ord", "matched", F.bround("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


register("op_73_ranked_search", searched, oracle(_index_sql() + f""", qt AS (SELECT qid, token, count(*) AS times FROM (SELECT qid, unnest(list_filter(regexp_split_to_array(lower(q), '[^a-z0-9]+'), lambda t: t <> '')) AS token FROM Q) x GROUP BY 1, 2),
  h AS (SELECT qid, ord, CAST(sum(times) AS BIGINT) AS matched, sum(ln(1.0 + (SELECT count(*) FROM D)::DOUBLE / df) * (tf / (1.0 + tf)) * ({_WEIGHT}) * times) AS s FROM qt JOIN terms USING (token) JOIN po USING (token) GROUP BY 1, 2),
  r AS (SELECT qid, ord, matched, s * (1.0 + 0.5 * (matched - 1)) AS score, D.stars FROM h JOIN D ON D.id = ord), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY matched DESC, round_even(score, 9) DESC, stars DESC, ord) AS rank FROM r)
  SELECT qid, ord, matched, round_even(score, 6) AS score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10""", "D", "Q"))

# Graphs. Tags are the words of the name, and two finer ones that grow in number with the table, so that evidence stays rare enough for candidates.


def _nodes(spark, d):
    c = cat(spark, d).withColumn("topics", F.array("t1", "t2", F.concat_ws("-", "t1", "owner"), F.concat_ws("-", "t2", F.floor(F.col("id") / 40))))
    return score.global_ordinal(c.select("id", "full_name", "stars", "topics", "primitives", "subsystem", "language", "artifact"), F.col("stars").desc(), F.col("full_name"))


_KNN = """, nd AS (SELECT row_number() OVER (ORDER BY stars DESC, full_name) - 1 AS ord, id, t1, t2, concat_ws('-', t1, owner) AS t3, concat_ws('-', t2, id // 40) AS t4, subsystem, language, artifact, [t1, t2, concat_ws('-', t1, owner), concat_ws('-', t2, id // 40)] AS topics FROM C),
  ft AS (SELECT ord, concat('t:', unnest(topics)) AS f FROM nd UNION ALL SELECT ord, concat('p:', t1) FROM nd UNION ALL SELECT ord, concat('s:', subsystem) FROM nd WHERE NOT starts_with(subsystem, 'General') UNION ALL SELECT ord, concat('l:', language) FROM nd UNION ALL SELECT ord, concat('a:', artifact) FROM nd),
  rf AS (SELECT ft.* FROM ft SEMI JOIN (SELECT f FROM ft GROUP BY 1 HAVING count(*) BETWEEN 2 AND 1500) k USING (f)),
  sh AS (SELECT a.ord AS src, b.ord AS dst, count(*) AS n FROM rf a JOIN rf b USING (f) WHERE a.ord <> b.ord GROUP BY 1, 2),
  cd AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM sh) x WHERE k <= 64),
  sc AS (SELECT src, dst, a.topics AS ta, b.topics AS tb, len(list_intersect(a.topics, b.topics)) AS it, CAST(a.t1 = b.t1 AS INT) AS ip, NOT starts_with(a.subsystem, 'General') AND NOT starts_with(b.subsystem, 'General') AS gs, CAST(a.subsystem = b.subsystem AS INT) AS es,
    CAST(a.language = b.language AS INT) AS el, CAST(a.artifact = b.artifact AS INT) AS ea FROM cd JOIN nd a ON a.ord = src JOIN nd b ON b.ord = dst),
  ss AS (SELECT src, dst, (3.0 * it + 2.0 * ip + CASE WHEN gs THEN 1.5 * es ELSE 0 END + el + ea) / (3.0 * (len(ta) + len(tb) - it) + 2.0 * (2 - ip) + CASE WHEN gs THEN 1.5 * (2 - es) ELSE 0 END + (2 - el) + (2 - ea)) AS score FROM sc),
  kn AS (SELECT src, dst, round_even(score, 2) AS weight, CAST(k AS INT) AS rank, false AS is_fallback FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS k FROM ss WHERE score > 0) x WHERE k <= 8 AND score >= 0.05)"""
_FILL = """,
  dg AS (SELECT ord AS src, count(kn.src) AS degree FROM nd LEFT JOIN kn ON kn.src = nd.ord GROUP BY 1),
  nr AS (SELECT dg.src, nd.ord AS dst, degree, row_number() OVER (PARTITION BY dg.src ORDER BY nd.ord) AS k FROM dg JOIN nd ON nd.ord BETWEEN dg.src - 8 AND dg.src + 8 AND nd.ord <> dg.src LEFT JOIN kn ON kn.src = dg.src AND kn.dst = nd.ord WHERE degree < 8 AND kn.src IS NULL),
  ed AS (SELECT * FROM kn UNION ALL SELECT src, dst, 0.1, CAST(degree + k AS INT), true FROM nr WHERE degree + k <= 8)"""
_EDGES = _KNN + _FILL


def edges(spark, d):
    n = settled(_nodes(spark, d), "nodes")
    return n, settled(graph.window_fill(settled(graph.knn_edges(n), "knn"), n), "edges")


_TYPED = lambda df: df.withColumn("rank", F.col("rank").cast("int"))
register("op_74_knn_edges", lambda s, d: _TYPED(graph.knn_edges(settled(_nodes(s, d), "nodes"))), oracle(_EDGES + " SELECT * FROM kn"))


def thin_edges(spark, d):
    """Rows whose only evidence is a tag that a handful of rows share, so that most of their neighbours are fallbacks."""
    c = C(spark, d).select("id", "full_name", "stars", F.array(F.concat_ws("-", "owner", F.floor(F.col("id") / 100))).alias("topics"))
    n = settled(score.global_ordinal(c, F.col("stars").desc(), F.col("full_name")), "nodes")
    return _TYPED(graph.window_fill(settled(graph.knn_edges(n), "knn"), n))


register("op_75_window_fill", thin_edges, oracle(""", nd AS (SELECT row_number() OVER (ORDER BY stars DESC, full_name) - 1 AS ord, concat_ws('-', owner, id // 100) AS t FROM C),
  kn AS (SELECT * FROM (SELECT a.ord AS src, b.ord AS dst, 1.0 AS weight, CAST(row_number() OVER (PARTITION BY a.ord ORDER BY b.ord) AS INT) AS rank, false AS is_fallback FROM nd a JOIN nd b USING (t) WHERE a.ord <> b.ord) x WHERE rank <= 8)"""
  + _FILL + " SELECT src, dst, CAST(weight AS DOUBLE) AS weight, rank, is_fallback FROM ed"))
register("op_76_edge_report", lambda s, d: graph.edge_report(*edges(s, d)[::-1]), oracle(_EDGES + """, tp AS (SELECT subsystem, count(*) AS k FROM ed JOIN nd ON nd.ord = dst GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
  SELECT (SELECT count(*) FROM nd) AS n, 0::BIGINT AS rows_no_evidence, count(*) AS total_edges, count(*) FILTER (is_fallback) AS fallback_edges, (SELECT min(c) FROM (SELECT count(*) AS c FROM ed GROUP BY src) x) AS min_degree,
  (SELECT subsystem FROM tp) AS top_subsystem, (SELECT k FROM tp) AS top_edges, round_even(100.0 * count(*) FILTER (is_fallback) / count(*), 2) AS fallback_pct, round_even(100.0 * (SELECT k FROM tp) / count(*), 2) AS top_pct FROM ed"""))
_WHY = """CASE WHEN a.subsystem = b.subsystem AND NOT starts_with(a.subsystem, 'General') THEN concat('Shared Subsystem (', a.subsystem, ')') WHEN a.t1 = b.t1 THEN concat('Shared Primitive (', a.t1, ')')
  WHEN list_contains(b.topics, a.t1) THEN concat('Shared Topic (', a.t1, ')') WHEN list_contains(b.topics, a.t2) THEN concat('Shared Topic (', a.t2, ')') WHEN list_contains(b.topics, a.t3) THEN concat('Shared Topic (', a.t3, ')') WHEN list_contains(b.topics, a.t4) THEN concat('Shared Topic (', a.t4, ')')
  WHEN a.language = b.language THEN concat('Same Language (', a.language, ')') ELSE 'Nearby catalog entry (no shared signals)' END"""
register("op_36_similarity_reason", lambda s, d: graph.with_reasons(*edges(s, d)).select("src", "dst", "reason"), oracle(_EDGES + f" SELECT src, dst, {_WHY} AS reason FROM ed JOIN nd a ON a.ord = src JOIN nd b ON b.ord = dst"))
register("op_78_similar", lambda s, d: _TYPED(graph.similar(*edges(s, d), k=5)).select("src", "dst", "rank", "reason"), oracle(_EDGES + f" SELECT src, dst, rank, {_WHY} AS reason FROM ed JOIN nd a ON a.ord = src JOIN nd b ON b.ord = dst WHERE rank <= 5"))
register("op_77_cooccurrence", lambda s, d: _TYPED(graph.cooccurrence(view(s, d, "T"))), oracle(
    """, k AS (SELECT topic, count(*) AS count FROM T GROUP BY 1 HAVING count(*) >= 25), pr AS (SELECT a.topic AS x, b.topic AS y, count(*) AS n FROM T a JOIN T b USING (id) WHERE a.topic <> b.topic AND a.topic IN (SELECT topic FROM k) AND b.topic IN (SELECT topic FROM k) GROUP BY 1, 2 HAVING count(*) >= 10),
    r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY n DESC, y) AS rank FROM pr) SELECT topic, count, y AS other, n AS pair_count, CAST(rank AS INT) AS rank FROM k LEFT JOIN r ON x = topic AND rank <= 10""", "T"))
register("op_77_pairs_considered", lambda s, d: graph.pairs_considered(view(s, d, "T")), oracle("SELECT count(*) AS pairs FROM (SELECT DISTINCT a.topic, b.topic FROM T a JOIN T b USING (id) WHERE a.topic < b.topic) x", "T"))
_SAMPLE = _EDGES + """, ins AS (SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY src, rank) AS k FROM ed WHERE src < 1600 AND dst < 1600), lk AS (SELECT src, dst, CAST(weight AS DOUBLE) AS weight FROM ins WHERE k = 1),
  lo AS (SELECT ord FROM nd WHERE ord < 1600 AND ord NOT IN (SELECT src FROM lk) AND ord NOT IN (SELECT dst FROM lk)), ti AS (SELECT DISTINCT least(ord, CASE WHEN ord = 0 THEN 1 ELSE ord - 1 END) AS a, greatest(ord, CASE WHEN ord = 0 THEN 1 ELSE ord - 1 END) AS b, max(ord) AS src FROM lo GROUP BY 1, 2),
  sg AS (SELECT * FROM lk UNION ALL SELECT ord, CASE WHEN ord = 0 THEN 1 ELSE ord - 1 END, 0.1 FROM lo WHERE NOT (ord = 1 AND 0 IN (SELECT ord FROM lo)))"""
register("op_79_sample_graph", lambda s, d: graph.sample_graph(*edges(s, d)), oracle(_SAMPLE + " SELECT * FROM sg"))


def hops(spark, d):
    links = settled(graph.sample_graph(*edges(spark, d)), "links")
    return graph.k_hop(links, links.select(F.col("src").alias("start")).distinct(), 2).select("start", "node", F.col("hop").cast("int").alias("hop"))


register("op_79_k_hop", hops, oracle(_SAMPLE + """, bo AS (SELECT src AS a, dst AS b FROM sg UNION SELECT dst, src FROM sg), st AS (SELECT DISTINCT src AS s FROM sg), h1 AS (SELECT s, b FROM st JOIN bo ON a = s), h2 AS (SELECT s, bo.b FROM h1 JOIN bo ON bo.a = h1.b)
  SELECT s AS start, n AS node, CAST(min(h) AS INT) AS hop FROM (SELECT s, s AS n, 0 AS h FROM st UNION ALL SELECT s, b, 1 FROM h1 UNION ALL SELECT s, b, 2 FROM h2) x GROUP BY 1, 2"""))

# Recommendations.


def _pairs(spark, d):
    return recommend.pair_synergy(recommend.pool_pairs(view(spark, d, "P"), cat(spark, d).withColumn("language", F.expr("CASE t2 WHEN 'ring' THEN 'Python' WHEN 'rod' THEN 'Rust' WHEN 'bolt' THEN 'C++' WHEN 'gear' THEN 'C' ELSE language END"))))


_PAIR = """, pm AS (SELECT pool, id, lower(CASE t2 WHEN 'ring' THEN 'Python' WHEN 'rod' THEN 'Rust' WHEN 'bolt' THEN 'C++' WHEN 'gear' THEN 'C' ELSE language END) AS l, t1, license = 'GPL-3.0' AS cl FROM P JOIN C USING (id)),
  ps AS (SELECT a.pool, a.id AS x, b.id AS y, CAST(greatest(10, least(100, 50 + CASE WHEN a.l = b.l THEN 18 WHEN (a.l, b.l) IN (('c++', 'c'), ('c', 'c++')) THEN 15 WHEN (a.l = 'python' AND b.l IN ('rust', 'c++', 'c')) OR (b.l = 'python' AND a.l IN ('rust', 'c++', 'c')) THEN 12 ELSE -5 END
    + CASE WHEN a.t1 = b.t1 THEN 18 ELSE 0 END - CASE WHEN a.cl <> b.cl THEN 15 ELSE 0 END)) AS INT) AS score FROM pm a JOIN pm b ON a.pool = b.pool AND a.id < b.id)"""
register("op_80_pair_synergy", lambda s, d: _pairs(s, d).select("pool", "x", "y", "score", "status"), oracle(
    _PAIR + " SELECT *, CASE WHEN score >= 75 THEN 'High Synergy' WHEN score >= 50 THEN 'Compatible' ELSE 'Friction Warning' END AS status FROM ps", "C", "P"))
register("op_81_pool_synergy", lambda s, d: recommend.pool_synergy(_pairs(s, d), view(s, d, "P")), oracle(
    _PAIR + """, av AS (SELECT pool, CAST(greatest(15, least(98, floor(avg(score) + 0.5))) AS INT) AS score FROM ps GROUP BY 1)
  SELECT pool, coalesce(score, 50) AS score, CASE WHEN score IS NULL THEN 'Awaiting Second Component' WHEN score >= 80 THEN 'High Architectural Synergy' WHEN score >= 60 THEN 'Production Viable (Standard IPC)' WHEN score >= 40 THEN 'Architectural Friction Detected' ELSE 'High Coupling / License Conflict' END AS grade
  FROM (SELECT DISTINCT pool FROM P) p LEFT JOIN av USING (pool)""", "C", "P"))


def slots(spark, d):
    c = cat(spark, d)
    plan = c.where("id in (3, 5, 7)").select((F.col("id").cast("int")).alias("slot"), F.when(F.col("id") != 7, F.col("domain")).alias("domain"), F.when(F.col("id") == 5, F.col("subsystem")).alias("subsystem"))
    picks = c.where("id in (10, 11)").select(F.lit(3).alias("slot"), "id").unionByName(c.where("id = 12").select(F.lit(7).alias("slot"), "id"))
    return recommend.slot_candidates(c, plan, picks).select("slot", "id", F.bround("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


register("op_82_slot_candidates", slots, oracle(""", sl AS (SELECT CAST(id AS INT) AS slot, CASE WHEN id <> 7 THEN domain END AS wd, CASE WHEN id = 5 THEN subsystem END AS ws FROM C WHERE id IN (3, 5, 7)), pk AS (SELECT CASE WHEN id = 12 THEN 7 ELSE 3 END AS slot, language, t1 FROM C WHERE id IN (10, 11, 12)),
  bs AS (SELECT sl.slot, C.*, coalesce(C.subsystem = ws, false) AS m FROM C JOIN sl ON wd IS NULL OR wd = domain),
  sr AS (SELECT bs.slot, bs.id, any_value(m) AS m, any_value(stars) AS stars, any_value(full_name) AS full_name, count(pk.slot) AS n, sum(CASE WHEN pk.language = bs.language THEN 30 ELSE 0 END + CASE WHEN pk.t1 = bs.t1 THEN 25 ELSE 0 END) + 2 * log10(any_value(stars)) AS score FROM bs LEFT JOIN pk ON pk.slot = bs.slot GROUP BY 1, 2),
  rk AS (SELECT slot, id, CASE WHEN n > 0 THEN score END AS score, row_number() OVER (PARTITION BY slot ORDER BY round_even(CASE WHEN n > 0 THEN score ELSE 0 END, 9) DESC, m DESC, stars DESC, full_name) AS rank FROM sr)
  SELECT slot, id, round_even(score, 6) AS score, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 45"""))
_CATS = {"small": ("language = 'SMALL'"), "ring": ("artifact = 'ring'"), "popular": ("stars >= 1000"), "free": ("license IN ('MIT', 'Apache-2.0')")}
register("op_37_role_categories", lambda s, d: recommend.role_categories(C(s, d).select("id", "language", "artifact", "stars", "license"), {k: F.expr(v) for k, v in _CATS.items()}).select("id", "category"),
         oracle(" UNION ALL ".join(f"SELECT id, '{k}' AS category FROM C WHERE {v}" for k, v in _CATS.items())))


def seeded(spark, d):
    """The first two draws of every owner as a seed."""
    owners = C(spark, d).select("owner").distinct()
    seed = scalars.text_seed(F.col("owner"))
    return owners.select("owner", seed.alias("seed"), scalars.draw(seed, F.lit(0)).alias("first"), scalars.pick_index(seed, F.lit(1), F.lit(10)).alias("second"))


#: The same arithmetic in DuckDB's 128-bit integers.
_MUL = "(({a}) * ({b})) % 4294967296"
_DRAW = """{p}0 AS (SELECT owner, seed, (seed + {k}::HUGEINT * 1831565813) % 4294967296 AS a FROM sd), {p}1 AS (SELECT *, (xor(a, a >> 15) * (a | 1)) % 4294967296 AS t FROM {p}0),
  {p}2 AS (SELECT *, xor((t + (xor(t, t >> 7) * (t | 61)) % 4294967296) % 4294967296, t) AS u FROM {p}1), {p} AS (SELECT owner, seed, CAST(xor(u, u >> 14) AS DOUBLE) / 4294967296.0 AS v FROM {p}2)"""
register("op_38_seeded_pick", seeded, oracle(
    ", ow AS (SELECT DISTINCT owner FROM C), sd AS (SELECT owner, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(owner, ''), lambda x: ord(x)::HUGEINT)), lambda h, x: (xor(h, x) * 16777619) % 4294967296) AS seed FROM ow), "
    + _DRAW.format(p="f", k=1) + ", " + _DRAW.format(p="g", k=2) + " SELECT f.owner, CAST(f.seed AS BIGINT) AS seed, f.v AS first, CAST(floor(g.v * 10) AS INT) AS second FROM f JOIN g USING (owner)"))


def blueprints(spark, d):
    """One completed blueprint for each brand as a seed."""
    c = C(spark, d)
    prints = c.where("id < 6").select(F.concat(F.lit("bp-"), "id").alias("blueprint_id"), F.when(F.col("id") % 2 == 0, "data").otherwise("web").alias("goal"), F.col("id").alias("pos"))
    roles = c.where("id < 24").select(
        F.concat(F.lit("bp-"), F.col("id") % 6).alias("blueprint_id"), F.floor(F.col("id") / 6).alias("pos"), F.concat(F.lit("role-"), "id").alias("role"), F.when(F.col("id") % 7 == 6, "none").otherwise(F.col("language")).alias("category"),
        F.when(F.col("id") % 3 != 0, F.col("subsystem")).alias("subsystem"), F.when(F.col("id") % 5 == 0, F.array(F.upper("full_name"), F.lit("no/such"))).otherwise(F.array(F.lit("no/such"))).alias("seeds"))
    asked = c.select(F.col("owner").alias("request"), F.col("owner").alias("seed"), F.when(F.length("owner") == 7, "data").otherwise("any").alias("goal")).distinct()
    return recommend.complete_blueprints(c.withColumn("category", F.col("language")), roles, recommend.choose_blueprints(prints, asked)).withColumn("pos", F.col("pos").cast("int"))


register("op_83_complete_blueprints", blueprints, oracle(
    """, bp AS (SELECT concat('bp-', id) AS blueprint_id, CASE WHEN id % 2 = 0 THEN 'data' ELSE 'web' END AS goal, id AS pos FROM C WHERE id < 6),
  ro AS (SELECT concat('bp-', id % 6) AS blueprint_id, CAST(id // 6 AS INT) AS pos, concat('role-', id) AS role, CASE WHEN id % 7 = 6 THEN 'none' ELSE language END AS category, CASE WHEN id % 3 <> 0 THEN subsystem END AS want, CASE WHEN id % 5 = 0 THEN key END AS seed_key FROM C WHERE id < 24),
  ow AS (SELECT DISTINCT owner, CASE WHEN length(owner) = 7 THEN 'data' ELSE 'any' END AS goal FROM C),
  sd AS (SELECT owner, goal, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(owner, ''), lambda x: ord(x)::HUGEINT)), lambda h, x: (xor(h, x) * 16777619) % 4294967296) AS seed FROM ow), """
    + _DRAW.replace("owner, seed,", "owner, goal, seed,").format(p="f", k=1) + """,
  po AS (SELECT goal, list(blueprint_id ORDER BY pos, blueprint_id) AS own FROM bp GROUP BY 1), al AS (SELECT list(blueprint_id ORDER BY pos, blueprint_id) AS every FROM bp),
  ch AS (SELECT f.owner, f.seed, coalesce(own, every)[1 + CAST(floor(v * len(coalesce(own, every))) AS INT)] AS blueprint_id FROM f CROSS JOIN al LEFT JOIN po ON po.goal = f.goal),
  cd AS (SELECT ro.blueprint_id, ro.pos, C.id, C.name, C.stars, 1 AS tier FROM ro JOIN C ON C.key = ro.seed_key
    UNION ALL SELECT ro.blueprint_id, ro.pos, C.id, C.name, C.stars, CASE WHEN want IS NOT NULL AND C.subsystem = want THEN 2 ELSE 3 END FROM ro JOIN C ON C.language = ro.category),
  rk AS (SELECT *, row_number() OVER (PARTITION BY blueprint_id, pos ORDER BY tier, stars DESC, name, id) AS n, min(tier) OVER (PARTITION BY blueprint_id, pos) AS best FROM cd),
  tp AS (SELECT blueprint_id, pos, best AS tier, list(id ORDER BY n) AS c FROM rk WHERE n <= 3 AND tier = best GROUP BY 1, 2, 3),
  ev AS (SELECT ch.owner, ch.seed, ch.blueprint_id, ro.pos, ro.role, tier, c, count(c) OVER (PARTITION BY ch.owner ORDER BY ro.pos) AS turn FROM ch JOIN ro USING (blueprint_id) LEFT JOIN tp USING (blueprint_id, pos)),
  e0 AS (SELECT *, (seed + (turn + 1)::HUGEINT * 1831565813) % 4294967296 AS a FROM ev), e1 AS (SELECT *, (xor(a, a >> 15) * (a | 1)) % 4294967296 AS t FROM e0),
  e2 AS (SELECT *, xor((t + (xor(t, t >> 7) * (t | 61)) % 4294967296) % 4294967296, t) AS u FROM e1), e3 AS (SELECT *, CAST(xor(u, u >> 14) AS DOUBLE) / 4294967296.0 AS v FROM e2)
  SELECT owner AS request, blueprint_id, pos, role, CASE WHEN c IS NULL THEN 'missing' WHEN tier = 1 THEN 'seed' WHEN tier = 2 THEN 'subsystem' ELSE 'category' END AS via, c[1 + CAST(floor(v * len(c)) AS INT)] AS id FROM e3"""))


def topic_view(spark, d):
    """The topic map over five kinds of tags, more topics than the view has places for."""
    c = C(spark, d)
    tags = c.select("id", F.explode(F.array("t1", "t2", F.lower("owner"), F.lower("domain"), F.lower("subsystem"), F.concat(F.lit("size-"), F.col("forks") % 12))).alias("topic"))
    return graph.topic_map(graph.cooccurrence(tags, min_count=5, min_pair=2))


register("op_79_topic_map", topic_view, oracle(
    """, tg AS (SELECT DISTINCT id, unnest([t1, t2, lower(owner), lower(domain), lower(subsystem), concat('size-', forks % 12)]) AS t FROM C), ct AS (SELECT t, count(*) AS n FROM tg GROUP BY t HAVING count(*) >= 5),
    pr AS (SELECT a.t AS a, b.t AS b, count(*) AS n FROM tg a JOIN tg b ON a.id = b.id AND a.t <> b.t WHERE a.t IN (SELECT t FROM ct) AND b.t IN (SELECT t FROM ct) GROUP BY ALL HAVING count(*) >= 2),
    rk AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM pr), sp AS (SELECT t, n, row_number() OVER (ORDER BY n DESC, t) AS place FROM ct ORDER BY n DESC, t LIMIT 48),
    li AS (SELECT a, b, rk.n, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY x.place) AS k FROM rk JOIN sp x ON x.t = a JOIN sp y ON y.t = b WHERE r <= 5)
    SELECT CAST(place AS INT) AS place, sp.t AS topic, sp.n AS count, li.b AS other, li.n AS pair_count FROM sp LEFT JOIN li ON li.a = sp.t AND k = 1"""))


def linked_topics(spark, d):
    """The gate of topic maps on one with planted faults of every kind."""
    m = settled(graph.cooccurrence(view(spark, d, "T"), min_count=5, min_pair=2, top=5), "topics")
    a = F.col("topic")
    links = m.withColumns({"pair_count": F.when((a == "ring") & (F.col("rank") == 1), F.col("count") + 9).when((a == "gear") & (F.col("rank") == 5), 1).otherwise(F.col("pair_count")), "other": F.when((a == "bolt") & (F.col("rank") == 2), "nowhere").otherwise(F.col("other"))})
    links = links.where("not (topic = 'red' and rank = 3)")
    links = links.unionByName(links.where("topic = 'blue'").withColumn("rank", F.col("rank") + 5)).unionByName(m.where("topic = 'ring' and rank = 1").select(F.lit("rare").alias("topic"), F.lit(1).cast("long").alias("count"), F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("pair_count"), F.lit(None).cast("int").alias("rank")))
    return links


register("op_96_topic_links", lambda s, d: quality.verify_topics(linked_topics(s, d), 5, 2, 5), oracle(
    """, ct AS (SELECT topic AS t, count(*) AS n FROM T GROUP BY 1 HAVING count(*) >= 5),
    pr AS (SELECT a.topic AS a, b.topic AS b, count(*) AS n FROM T a JOIN T b ON a.id = b.id AND a.topic <> b.topic WHERE a.topic IN (SELECT t FROM ct) AND b.topic IN (SELECT t FROM ct) GROUP BY ALL HAVING count(*) >= 2),
    rk AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM pr), l0 AS (SELECT a AS topic, ct.n AS cnt, CASE WHEN a = 'bolt' AND r = 2 THEN 'nowhere' ELSE b END AS other, CASE WHEN a = 'ring' AND r = 1 THEN ct.n + 9 WHEN a = 'gear' AND r = 5 THEN 1 ELSE rk.n END AS pn, r
      FROM rk JOIN ct ON t = a WHERE r <= 5 AND NOT (a = 'red' AND r = 3)), lk AS (SELECT * FROM l0 UNION ALL SELECT topic, cnt, other, pn, r + 5 FROM l0 WHERE topic = 'blue'),
    tp AS (SELECT t AS topic, n AS cnt, (SELECT count(*) FROM lk WHERE lk.topic = t) AS links, (SELECT min(pn) FROM lk WHERE lk.topic = t) AS weakest FROM ct WHERE t IN (SELECT a FROM rk) UNION ALL SELECT 'rare', 1, 0, NULL WHERE EXISTS (FROM rk WHERE a = 'ring')),
    bo AS (SELECT lk.*, tp.cnt AS oc, tp.links AS ol, tp.weakest AS ow, bk.pn AS back FROM lk LEFT JOIN tp ON tp.topic = lk.other LEFT JOIN lk bk ON bk.topic = lk.other AND bk.other = lk.topic),
    nm(k) AS (VALUES ('topic_link_to_nothing'), ('topic_link_above_topic'), ('topic_link_below_floor'), ('topic_link_one_sided'), ('topic_link_differs'), ('topic_below_floor'), ('topic_links_too_many'), ('topic_links_out_of_order')),
    fa(k, num, key) AS (SELECT 'topic_link_to_nothing', 0, concat(topic, '>', other) FROM bo WHERE oc IS NULL UNION ALL SELECT 'topic_link_above_topic', 0, concat(topic, '>', other) FROM bo WHERE pn > least(cnt, oc)
      UNION ALL SELECT 'topic_link_below_floor', 0, concat(topic, '>', other) FROM bo WHERE pn < 2 UNION ALL SELECT 'topic_link_one_sided', 0, concat(topic, '>', other) FROM bo WHERE oc IS NOT NULL AND back IS NULL AND NOT (ol >= 5 AND ow >= pn)
      UNION ALL SELECT 'topic_link_differs', 0, concat(topic, '>', other) FROM bo WHERE back <> pn UNION ALL SELECT 'topic_below_floor', 0, topic FROM tp WHERE cnt < 5 UNION ALL SELECT 'topic_links_too_many', 0, topic FROM tp WHERE links > 5
      UNION ALL SELECT 'topic_links_out_of_order', 0, concat(x.topic, '>', x.other) FROM lk x JOIN lk y ON y.topic = x.topic AND y.r = x.r + 1 WHERE x.pn < y.pn)""" + _REPORT, "T"))


# Reclassification, gates, scans, windows and SQL.


def reclassified(spark, d):
    base = cat(spark, d).select("id", "name", "description", "topics", "language", "domain", "subsystem", "artifact")
    base = base.withColumns({"keywords": F.array("domain", "subsystem", F.lit("own"), "artifact"), "beginner_intel": F.when(F.col("id") % 2 == 0, classify.context_card(F.col("domain"), F.col("subsystem"), F.col("language")))})
    return classify.reclassify(base, RULES)


register("op_85_reclassify", lambda s, d: reclassified(s, d).select("id", "domain", "subsystem", "old_domain", F.array_join("keywords", "|").alias("keywords"), F.col("beginner_intel.what_it_does").alias("card")), oracle(
    _domain_sql() + """ SELECT id, l.domain, l.subsystem, C.domain AS old_domain, concat_ws('|', l.subsystem, 'Application / Service', l.domain, 'own') AS keywords,
    CASE WHEN id % 2 = 0 THEN concat('A foundational ', language, ' project in the ', l.domain, ' ecosystem specialized for ', l.subsystem, '.') END AS card FROM C JOIN lab l USING (id)"""))


def _churned(spark, d):
    return C(spark, d).select(F.col("domain").alias("old_domain"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("Domain-"), F.col("id") % 10)).otherwise(F.col("domain")).alias("domain"), (F.col("id") % 8).cast("int").alias("domain_margin"))


_CHURN = """, x AS (SELECT domain AS o, CASE WHEN id % 3 = 0 THEN concat('Domain-', id % 10) ELSE domain END AS n, id % 8 AS m FROM C), nm AS (SELECT o AS name FROM x UNION SELECT n FROM x),
  st AS (SELECT concat(o, ' -> ', n) AS name, count(*) AS k FROM x WHERE o <> n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15),
  rp AS (SELECT 'changed' AS section, 'domain' AS name, count(*) FILTER (o <> n) AS n, NULL::BIGINT AS "out", NULL::BIGINT AS "in", round_even(100.0 * count(*) FILTER (o <> n) / count(*), 2) AS pct FROM x
    UNION ALL SELECT 'label', name, (SELECT count(*) FROM x WHERE o = name AND o = n), (SELECT count(*) FROM x WHERE o = name AND o <> n), (SELECT count(*) FROM x WHERE n = name AND o <> n), NULL FROM nm
    UNION ALL SELECT 'transition', name, k, NULL, NULL, NULL FROM st UNION ALL SELECT 'margin', CAST(i AS VARCHAR), (SELECT count(*) FROM x WHERE m = i), NULL, NULL, NULL FROM range(10) r(i))"""
register("op_63_churn_report", lambda s, d: classify.churn_report(_churned(s, d)), oracle(_CHURN + " SELECT * FROM rp"))


def gated(spark, d):
    """Whether the churn gate lets the report pass at 10 and 50 per cent."""
    report = classify.churn_report(_churned(spark, d))

    def passes(limit: float) -> bool:
        try:
            quality.gate(report, limit)
        except ValueError:
            return False
        return True

    return report.where("section = 'changed'").select("n", F.lit(passes(10.0)).alias("at_10"), F.lit(passes(50.0)).alias("at_50"))


def covered(spark, d):
    """Topic coverage above a star floor, where every fourth row has none, and whether the gate lets it pass at 50 and 90 per cent."""
    c = cat(spark, d).withColumn("topics", F.when(F.col("id") % 4 != 0, F.col("topics")))

    def passes(least: float) -> bool:
        try:
            quality.coverage_gate(c, least, 400)
        except ValueError:
            return False
        return True

    return quality.coverage(c, 400).select("rows", "with_topics", F.bround("pct", 6).alias("pct"), F.lit(passes(50.0)).alias("at_50"), F.lit(passes(90.0)).alias("at_90"))


register("op_95_coverage_gate", covered, oracle(""", x AS (SELECT count(*) AS rows, count(*) FILTER (id % 4 <> 0) AS with_topics FROM C WHERE stars >= 400)
  SELECT rows, with_topics, round_even(100.0 * with_topics / greatest(rows, 1), 6) AS pct, 100.0 * with_topics / greatest(rows, 1) >= 50 AS at_50, 100.0 * with_topics / greatest(rows, 1) >= 90 AS at_90 FROM x"""))
register("op_95_churn_gate", gated, oracle(_CHURN + " SELECT n, pct <= 10 AS at_10, pct <= 50 AS at_50 FROM rp WHERE section = 'changed'"))


def checked(spark, d):
    """Both gates as checks, at limits that they pass and that they fail."""
    report = settled(classify.churn_report(_churned(spark, d)), "churn")
    c = cat(spark, d).withColumn("topics", F.when(F.col("id") % 4 != 0, F.col("topics")))
    parts = [quality.churn_check(report, 10.0), quality.churn_check(report, 50.0), quality.coverage_check(c, 90.0, 400), quality.coverage_check(c, 50.0, 400)]
    return functools.reduce(DataFrame.unionByName, [p.withColumn("at", F.lit(k)) for k, p in enumerate(parts)])


register("op_95_checks", checked, oracle(_CHURN + """, ch AS (SELECT n, pct FROM rp WHERE section = 'changed'), cv AS (SELECT count(*) AS n, count(*) FILTER (id % 4 <> 0) AS w FROM C WHERE stars >= 400)
  SELECT 'churn' AS "check", n AS failures, format('{:.2f} % of domain labels changed; the limit is 10.00 %', pct) AS detail, 0 AS at FROM ch UNION ALL SELECT 'churn', 0, '', 1 FROM ch
  UNION ALL SELECT 'topic_coverage', n - w, format('{:.2f} % of rows have topics; the least is 90.00 %', 100.0 * w / greatest(n, 1)), 2 FROM cv UNION ALL SELECT 'topic_coverage', 0, '', 3 FROM cv"""))


def verified(spark, d):
    """A catalog with planted faults of every kind that the gate looks for."""
    i = F.col("id")
    c = C(spark, d).withColumns({
        "hook": F.when(i % 40 == 0, F.repeat("description", 9)).otherwise(F.col("description")), "domain_margin": F.when(i % 90 == 1, 11).otherwise(3), "owner": F.when(i % 70 == 2, "").otherwise(F.col("owner")),
        "topics": F.when(i % 50 == 3, F.array("t1", F.lit(None).cast("string"))).when(i % 110 != 7, F.array("t1", "t2")), "subsystem": F.when(i % 80 == 8, " ").otherwise(F.col("subsystem")),
        "artifact": F.when(i % 75 != 9, F.col("artifact")),
    })
    codes = files.label_codes(c.withColumn("ord", i), "language")
    c = c.join(codes.select(F.col("label").alias("language"), F.col("code").alias("language_code")), "language", "left")
    # the faults of ids, domains and languages go on top of what the codes and parts were made from
    c = settled(c.withColumn("language", F.when(i % 85 != 10, F.col("language"))), "catalog")
    own = files.parts_by_slug(c, 100)
    details = files.part_number(c, own).select("id", "slug", F.when(i % 60 == 5, F.col("part") + 1).otherwise(F.col("part")).alias("part"), F.octet_length("description").alias("bytes")).where("id % 33 <> 4")
    details = details.unionByName(details.where("id % 65 = 11").withColumn("id", i + 3_000_000))
    stated = own.select("slug", F.when(F.col("slug") == "domain-3", 3).otherwise(F.col("parts")).cast("long").alias("parts")).where("parts >= 2")
    stated = stated.unionByName(own.where("slug = 'domain-1'").select(F.lit("no-such").alias("slug"), F.lit(4).cast("long").alias("parts")))
    flat = c.where("id % 44 <> 6").select("id").unionByName(c.where("id % 55 = 12").select((i + 2_000_000).alias("id")))
    c = c.unionByName(c.where("id % 95 = 13")).unionByName(c.where("id % 105 = 14").withColumn("id", -i)).withColumn("domain", F.when(~((i > 0) & (i % 120 == 15)), F.col("domain")))
    return quality.verify(c, details, flat, 300, 100_000, 100, stated, {"language": codes.where("code <> 2")}, 2000)


register("op_94_catalog_verify", verified, oracle(
    """, c0 AS (SELECT id, lower(domain) AS slug, domain, language, description, stars FROM C), p AS (SELECT slug, count(*) AS rows, CAST(power(2, CASE WHEN (count(*) - 1) // 100 = 0 THEN 0 ELSE length(bin((count(*) - 1) // 100)) END) AS BIGINT) AS parts FROM c0 GROUP BY 1),
    st AS (SELECT slug, CASE WHEN slug = 'domain-3' THEN 3 ELSE parts END AS parts FROM p WHERE parts >= 2 OR slug = 'domain-3' UNION ALL SELECT 'no-such', 4 FROM p WHERE slug = 'domain-1'),
    x AS (SELECT id, id AS base, CASE WHEN id % 120 <> 15 THEN slug END AS slug, language, description, stars FROM c0 UNION ALL SELECT id, id, CASE WHEN id % 120 <> 15 THEN slug END, language, description, stars FROM c0 WHERE id % 95 = 13
      UNION ALL SELECT -id, id, slug, language, description, stars FROM c0 WHERE id % 105 = 14),
    ow AS (SELECT s AS slug, CAST(power(2, CASE WHEN (count(*) - 1) // 100 = 0 THEN 0 ELSE length(bin((count(*) - 1) // 100)) END) AS BIGINT) AS parts FROM (SELECT coalesce(slug, 'other-general') AS s FROM x) z GROUP BY 1),
    rt AS (SELECT x.id, coalesce(x.slug, 'other-general') AS slug, ((x.id % coalesce(st.parts, 1)) + coalesce(st.parts, 1)) % coalesce(st.parts, 1) AS part FROM x LEFT JOIN st ON st.slug = coalesce(x.slug, 'other-general')),
    d0 AS (SELECT c0.id, c0.slug, c0.id % p.parts + CASE WHEN c0.id % 60 = 5 THEN 1 ELSE 0 END AS part, length(description) AS bytes FROM c0 JOIN p USING (slug) WHERE c0.id % 33 <> 4),
    dt AS (SELECT * FROM d0 UNION ALL SELECT id + 3000000, slug, part, bytes FROM d0 WHERE id % 65 = 11), fl AS (SELECT id FROM C WHERE id % 44 <> 6 UNION ALL SELECT id + 2000000 FROM C WHERE id % 55 = 12),
    pl AS (SELECT DISTINCT slug, part FROM rt), th AS (SELECT slug, part, sum(bytes) AS bytes FROM dt GROUP BY ALL), co AS (SELECT language, row_number() OVER (ORDER BY min(id)) - 1 AS code FROM C GROUP BY 1),
    nm(k) AS (VALUES ('id_out_of_range'), ('missing_owner_or_name'), ('below_floor'), ('hook_too_long'), ('margin_out_of_range'), ('missing_domain'), ('missing_subsystem'), ('missing_language'), ('missing_artifact'), ('malformed_topics'), ('too_few_rows'), ('duplicate_id'),
      ('flat_missing'), ('flat_stray'), ('details_missing'), ('details_stray'), ('details_misplaced'), ('part_missing'), ('part_orphan'), ('part_too_large'), ('fanout_malformed'), ('fanout_of_no_domain'), ('fanout_differs'), ('language_dangling')),
    rw AS (SELECT id, unnest(list_filter([CASE WHEN id <= 0 THEN 'id_out_of_range' END, CASE WHEN base % 70 = 2 THEN 'missing_owner_or_name' END, CASE WHEN stars < 300 THEN 'below_floor' END, CASE WHEN base % 40 = 0 AND length(description) * 9 > 90 THEN 'hook_too_long' END,
      CASE WHEN base % 90 = 1 THEN 'margin_out_of_range' END, CASE WHEN slug IS NULL THEN 'missing_domain' END, CASE WHEN base % 80 = 8 THEN 'missing_subsystem' END, CASE WHEN base % 85 = 10 THEN 'missing_language' END, CASE WHEN base % 75 = 9 THEN 'missing_artifact' END,
      CASE WHEN base % 50 = 3 OR base % 110 = 7 THEN 'malformed_topics' END], lambda v: v IS NOT NULL)) AS k FROM x),
    ids AS (SELECT id, count(*) FILTER (s = 'c') AS c, count(*) FILTER (s = 'f') AS f, count(*) FILTER (s = 'd') AS d FROM (SELECT id, 'c' AS s FROM x UNION ALL SELECT id, 'f' FROM fl UNION ALL SELECT id, 'd' FROM dt) u GROUP BY id),
    fa(k, num, key) AS (SELECT k, id, CAST(id AS VARCHAR) FROM rw UNION ALL SELECT 'too_few_rows', 0, CAST(count(*) AS VARCHAR) FROM x UNION ALL SELECT 'duplicate_id', id, CAST(id AS VARCHAR) FROM ids WHERE c > 1
      UNION ALL SELECT 'flat_missing', id, CAST(id AS VARCHAR) FROM ids WHERE c > 0 AND f = 0 UNION ALL SELECT 'flat_stray', id, CAST(id AS VARCHAR) FROM ids WHERE f > 0 AND c = 0
      UNION ALL SELECT 'details_missing', id, CAST(id AS VARCHAR) FROM ids WHERE c > 0 AND d = 0 UNION ALL SELECT 'details_stray', id, CAST(id AS VARCHAR) FROM ids WHERE d > 0 AND c = 0
      UNION ALL SELECT 'details_misplaced', id, CAST(id AS VARCHAR) FROM dt JOIN rt USING (id) WHERE dt.slug <> rt.slug OR dt.part <> rt.part
      UNION ALL SELECT 'part_missing', 0, concat(slug, '/', part) FROM pl ANTI JOIN th USING (slug, part) UNION ALL SELECT 'part_orphan', 0, concat(slug, '/', part) FROM th ANTI JOIN pl USING (slug, part)
      UNION ALL SELECT 'part_too_large', 0, concat(slug, '/', part) FROM th WHERE bytes > 2000 UNION ALL SELECT 'fanout_malformed', 0, slug FROM st WHERE parts = 3 UNION ALL SELECT 'fanout_of_no_domain', 0, slug FROM st WHERE slug NOT IN (SELECT slug FROM ow)
      UNION ALL SELECT 'fanout_differs', 0, slug FROM ow LEFT JOIN st USING (slug) WHERE ow.parts <> coalesce(st.parts, 1) UNION ALL SELECT 'language_dangling', id, CAST(id AS VARCHAR) FROM x JOIN co USING (language) WHERE code = 2)""" + _REPORT, "C"))


def artifacts(spark, d):
    """Order, index, edges, snapshot, facets and exported postings with planted faults of every kind."""
    n, e = edges(spark, d)
    n = n.withColumns({"activity_status": F.when(F.col("id") % 100 == 1, "odd").otherwise("idle"), "license_tier": F.when(F.col("id") % 130 == 2, "odd").otherwise("unknown")})
    postings, terms = (settled(t, "index") for t in search.build_index(n.withColumn("name", F.split("full_name", "/")[1]).select("ord", "name")))
    own = e.where("rank = 1 and src % 50 = 0").withColumns({"dst": F.col("src"), "weight": F.when(F.col("src") % 150 == 0, 1.5).otherwise(F.col("weight"))})
    e = e.unionByName(own).unionByName(own.where("src % 100 = 0"))
    counts = facets.facet_counts(n, {}).withColumn("count", F.col("count") + (F.col("name") == "ring").cast("int"))
    exported = search.export_postings(postings).withColumn("postings", F.when(F.col("token").endswith("9"), F.slice("postings", 1, F.size("postings") - 1)).otherwise(F.col("postings")))
    terms = terms.withColumn("df", F.col("df") + F.col("token").endswith("77").cast("int"))
    snapshot = n.where("id % 30 <> 3").select("full_name", "stars")
    n = n.withColumn("stars", F.when(F.col("ord") % 60 == 7, F.col("stars") - 1_000_000).otherwise(F.col("stars")))
    return quality.verify_artifacts(n, postings, terms, e, snapshot, facets=counts, exported=exported)


register("op_96_artifact_invariants", artifacts, oracle(
    """, n AS (SELECT *, row_number() OVER (ORDER BY stars DESC, full_name) - 1 AS ord FROM C), tk AS (SELECT id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda t: t <> ''))) AS token FROM C),
    tm AS (SELECT token FROM tk GROUP BY 1 HAVING count(*) <= greatest(1, (SELECT count(*) FROM C) // 10)),
    oe AS (SELECT ord FROM n WHERE ord % 50 = 0 UNION ALL SELECT ord FROM n WHERE ord % 100 = 0), nm(k) AS (VALUES ('order_not_by_stars'), ('index_df_differs'), ('postings_ragged'), ('edge_to_itself'), ('edge_weight_out_of_range'), ('edge_twice'), ('degree_differs'), ('facet_differs'), ('activity_status_unknown'), ('license_tier_unknown'), ('snapshot_differs')),
    fa(k, num, key) AS (SELECT 'order_not_by_stars', ord, CAST(ord AS VARCHAR) FROM n WHERE ord % 60 = 7 AND ord + 1 < (SELECT count(*) FROM n)
      UNION ALL SELECT 'index_df_differs', 0, token FROM tm WHERE token LIKE '%77' UNION ALL SELECT 'postings_ragged', 0, token FROM tm WHERE token LIKE '%9' OR token LIKE '%77'
      UNION ALL SELECT 'edge_to_itself', ord, concat(ord, '-', ord) FROM oe UNION ALL SELECT 'edge_twice', ord, concat(ord, '-', ord) FROM n WHERE ord % 100 = 0
      UNION ALL SELECT 'edge_weight_out_of_range', ord, concat(ord, '-', ord) FROM oe WHERE ord % 150 = 0 UNION ALL SELECT 'degree_differs', ord, CAST(ord AS VARCHAR) FROM n WHERE ord % 50 = 0
      UNION ALL SELECT 'activity_status_unknown', ord, CAST(ord AS VARCHAR) FROM n WHERE id % 100 = 1 UNION ALL SELECT 'license_tier_unknown', ord, CAST(ord AS VARCHAR) FROM n WHERE id % 130 = 2
      UNION ALL SELECT 'snapshot_differs', 0, key FROM n WHERE id % 30 = 3 OR ord % 60 = 7
      UNION ALL SELECT 'facet_differs', 0, f FROM (SELECT DISTINCT 'artifact/ring' AS f FROM C WHERE artifact = 'ring' UNION SELECT 'primitive/ring' FROM C WHERE t1 = 'ring' UNION SELECT 'topic/ring' FROM C WHERE t1 = 'ring' OR t2 = 'ring') y)""" + _REPORT))


def references(spark, d):
    """A library of blueprints, one for each brand and size, with planted faults of every kind."""
    c = C(spark, d)
    own = F.concat_ws("-", F.col("owner"), F.floor(F.col("id") / 40).cast("string"))
    prints = c.groupBy(own.alias("blueprint_id")).agg(F.min("id").alias("i"), F.min("domain").alias("goal"))
    prints = prints.withColumn("goal", F.when(F.col("i") % 23 == 5, F.concat(F.lit("only-"), "blueprint_id")).otherwise(F.col("goal")))
    prints = prints.unionByName(prints.where("i % 31 = 4")).unionByName(prints.where("i % 31 = 4")).select("blueprint_id", "goal")
    i = F.col("id")
    roles = c.select(own.alias("blueprint_id"), F.concat(F.lit("role-"), F.when(i % 61 == 6, i - i % 61).otherwise(i)).alias("role"), F.when(i % 47 == 7, "odd").otherwise(F.col("language")).alias("category"),
                     F.when(i % 53 == 8, "Nowhere").when(i % 2 == 0, F.col("subsystem")).alias("subsystem"), F.array(F.upper("full_name"), F.when(i % 59 == 9, F.concat("full_name", F.lit("-gone"))).otherwise(F.col("full_name"))).alias("seeds"))
    roles = roles.unionByName(roles.where(F.substring("role", 6, 20).cast("long") % 71 == 10))
    links = c.select(own.alias("blueprint_id"), F.concat(F.lit("role-"), i).alias("src"), F.concat(F.lit("role-"), F.when(i % 67 == 11, -i).otherwise(i)).alias("dst")).where("cast(substring(src, 6, 20) as long) % 61 <> 6")
    return quality.verify_blueprints(prints, roles, links, c, ("PROMO", "ECONOMY", "STANDARD", "MEDIUM", "LARGE", "SMALL"))


register("op_96_blueprint_references", references, oracle(
    """, x AS (SELECT *, concat(owner, '-', id // 40) AS bp FROM C), p0 AS (SELECT bp, min(id) AS i, min(domain) AS goal FROM x GROUP BY bp), pr AS (SELECT bp, i, CASE WHEN i % 23 = 5 THEN concat('only-', bp) ELSE goal END AS goal FROM p0),
    ps AS (SELECT bp, goal FROM pr UNION ALL SELECT bp, goal FROM pr WHERE i % 31 = 4 UNION ALL SELECT bp, goal FROM pr WHERE i % 31 = 4), r0 AS (SELECT id, bp, CASE WHEN id % 61 = 6 THEN id - id % 61 ELSE id END AS n, language, subsystem, full_name FROM x),
    ro AS (SELECT *, concat(bp, '/role-', n) AS rn FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r0 WHERE n % 71 = 10) z), lb AS (SELECT DISTINCT rn FROM ro),
    nm(k) AS (VALUES ('seed_missing'), ('subsystem_unknown'), ('category_unknown'), ('link_to_no_role'), ('goal_too_few'), ('blueprint_twice'), ('role_twice')),
    fa(k, num, key) AS (SELECT 'seed_missing', 0, concat(rn, '/', full_name, '-gone') FROM ro WHERE id % 59 = 9 UNION ALL SELECT 'subsystem_unknown', 0, rn FROM ro WHERE id % 53 = 8
      UNION ALL SELECT 'category_unknown', 0, rn FROM ro WHERE id % 47 = 7 OR language NOT IN ('PROMO', 'ECONOMY', 'STANDARD', 'MEDIUM', 'LARGE', 'SMALL') UNION ALL SELECT 'link_to_no_role', 0, concat(bp, '/role-', l) FROM (SELECT bp, unnest([id, CASE WHEN id % 67 = 11 THEN -id ELSE id END]) AS l FROM x WHERE id % 61 <> 6) y WHERE concat(bp, '/role-', l) NOT IN (SELECT rn FROM lb)
      UNION ALL SELECT 'goal_too_few', 0, goal FROM ps GROUP BY goal HAVING count(DISTINCT bp) < 2 UNION ALL SELECT 'blueprint_twice', 0, bp FROM ps GROUP BY bp HAVING count(*) > 1 UNION ALL SELECT 'role_twice', 0, rn FROM ro GROUP BY rn HAVING count(*) > 1)""" + _REPORT))


_SCAN = {"email": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+", "license": r"(?i)licen[sc]e"}
register("op_49_pattern_scan", lambda s, d: quality.pattern_scan(table(s, d, "documents"), "doc_id", "text", _SCAN).select("id", "line", "rule"), """WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  m AS (SELECT id, CAST(i AS INT) AS line, CASE WHEN regexp_matches(t, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\\.[a-z]+') THEN 'email' WHEN regexp_matches(t, '(?i)licen[sc]e') THEN 'license' END AS rule FROM l) SELECT * FROM m WHERE rule IS NOT NULL""")


def windows(spark, d):
    """Windows of orders by customer key, from the least to the largest key there is."""
    o = table(spark, d, "orders").withColumn("second", F.col("o_orderkey") % 1000)
    lo, hi = o.agg(F.min("o_custkey"), F.max("o_custkey")).first()
    return quality.plan_windows(o, "o_custkey", "second", lo or 0, hi or 0).select("lo", "hi", "second_lo", "second_hi", "rows", "truncated")


register("op_97_range_windows", windows, """WITH RECURSIVE w(lo, hi) AS (SELECT min(o_custkey)::BIGINT, max(o_custkey)::BIGINT FROM orders UNION ALL
    SELECT CASE WHEN s = 0 THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN s = 0 THEN (lo + hi) // 2 ELSE hi END FROM w, (VALUES (0), (1)) h(s) WHERE lo < hi AND (SELECT count(*) FROM orders WHERE o_custkey BETWEEN lo AND hi) > 1000),
    k AS (SELECT lo, hi, (SELECT count(*) FROM orders WHERE o_custkey BETWEEN lo AND hi) AS rows FROM w)
    SELECT lo, hi, NULL::BIGINT AS second_lo, NULL::BIGINT AS second_hi, rows, false AS truncated FROM k WHERE rows BETWEEN 1 AND 1000""")


def windowed(df, col, second):
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    lo, hi = int(lo or 0), int(hi or 0)
    windows = settled(quality.numbered_windows(quality.plan_windows(df, col, second, lo, hi)), "windows")
    return quality.by_window(df, col, second, lo, hi, windows=windows), windows


def rows_by_window(spark, d):
    """Every line item with its window: few quantities, so that values are cut on the second column."""
    rows, windows = windowed(table(spark, d, "lineitem"), "l_quantity", "l_orderkey")
    rows = rows.withColumn("task", F.spark_partition_id()).groupBy("window").agg(F.count("*").alias("held"), F.countDistinct("task").alias("tasks"), F.sum(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rows_sum"))
    return rows.join(windows, "window", "full_outer").select("window", "lo", "hi", "second_lo", "second_hi", "rows", "truncated", "held", "tasks", "rows_sum")


_BISECTED = """WITH RECURSIVE t AS (SELECT %s AS v, %s AS w, %s AS x FROM %s), w(lo, hi) AS (SELECT min(v)::BIGINT, max(v)::BIGINT FROM t UNION ALL
    SELECT CASE WHEN s = 0 THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN s = 0 THEN (lo + hi) // 2 ELSE hi END FROM w, (VALUES (0), (1)) h(s) WHERE lo < hi AND (SELECT count(*) FROM t WHERE v BETWEEN lo AND hi) > 1000),
    k AS (SELECT lo, hi, (SELECT count(*) FROM t WHERE v BETWEEN lo AND hi) AS n FROM w), e AS (SELECT lo, greatest(1000, n // 900 * 2) AS edge FROM k WHERE lo = hi AND n > 1000),
    a AS (SELECT lo, hi, NULL::BIGINT AS second_lo, NULL::BIGINT AS second_hi FROM k WHERE n BETWEEN 1 AND 1000 UNION ALL SELECT lo, lo, 0, edge FROM e UNION ALL SELECT lo, lo, edge + 1, NULL FROM e),
    g AS (SELECT a.*, (SELECT count(*) FROM t WHERE v BETWEEN lo AND hi AND w BETWEEN coalesce(second_lo, w) AND coalesce(second_hi, w)) AS n, (SELECT sum(x) FROM t WHERE v BETWEEN lo AND hi AND w BETWEEN coalesce(second_lo, w) AND coalesce(second_hi, w)) AS x FROM a)
    SELECT row_number() OVER (ORDER BY lo DESC, second_lo DESC) - 1 AS "window", lo, hi, second_lo, second_hi, n AS rows, n > 1000 AS truncated, n AS held, 1 AS tasks, CAST(x AS BIGINT) AS rows_sum FROM g WHERE n > 0"""
register("op_97_rows_by_window", rows_by_window, _BISECTED % ("CAST(l_quantity AS BIGINT)", "l_orderkey", "l_orderkey * 10 + l_linenumber", "lineitem"))


def orders_by_window(spark, d):
    """Every order with the number of its window by customer key."""
    return windowed(table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 1000).alias("second")), "o_custkey", "second")[0].select("o_orderkey", "window")


register("op_97_orders_by_window", orders_by_window, """WITH RECURSIVE w(lo, hi) AS (SELECT min(o_custkey)::BIGINT, max(o_custkey)::BIGINT FROM orders UNION ALL
    SELECT CASE WHEN s = 0 THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN s = 0 THEN (lo + hi) // 2 ELSE hi END FROM w, (VALUES (0), (1)) h(s) WHERE lo < hi AND (SELECT count(*) FROM orders WHERE o_custkey BETWEEN lo AND hi) > 1000),
    k AS (SELECT lo, hi, row_number() OVER (ORDER BY lo DESC) - 1 AS n FROM w WHERE (SELECT count(*) FROM orders WHERE o_custkey BETWEEN lo AND hi) BETWEEN 1 AND 1000)
    SELECT o_orderkey, n AS "window" FROM orders JOIN k ON o_custkey BETWEEN lo AND hi""")
_CONSOLE = "WITH x AS (SELECT language, count(*) AS n, sum(stars) AS stars FROM repos WHERE stars >= 400 GROUP BY language) SELECT language, n, stars FROM x ORDER BY stars DESC"


def console(spark, d):
    sql.repos_view(cat(spark, d))
    return sql.run_sql(spark, _CONSOLE + ";", None)


register("op_98_sql_console", console, oracle(", repos AS (SELECT language, stars FROM C), x AS (SELECT language, count(*) AS n, CAST(sum(stars) AS BIGINT) AS stars FROM repos WHERE stars >= 400 GROUP BY language) SELECT language, n, stars FROM x"))

"""Cases of the single operators on small tables."""

from __future__ import annotations

import functools
import json
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lattix.functions import lexicons, scalars, text
from lattix.operators import classify, facets, graph, merge, quality, recommend, score, search, sql, trend
from lattix.sources import catalog as files
from lattix.sources import raw
from lattix.streaming.ingest import ingest, read_target

NOW = 1_700_000_000


def one(spark, column, **values):
    kinds = {str: "string", int: "long", bool: "boolean", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("given, slug", [("Databases & Storage", "databases-and-storage"), (" --A  b-- ", "a-b"), ("", "other-general"), (None, "other-general"), ("***", "other-general")])
def test_slugs(spark, given, slug):
    assert one(spark, text.slugify(F.col("x")), x=given) == slug


def test_tags_are_unwrapped_and_made_unique(spark):
    assert one(spark, text.normalise_tags(F.col("x")), x=['["a", "B"]', " b ", "", "c", "[broken", "A"]) == ["a", "B", "c", "[broken"]
    assert spark.createDataFrame([(None,)], "x array<string>").select(text.normalise_tags(F.col("x"))).first()[0] == []


@pytest.mark.parametrize(
    "keyword, corpus, hit",
    [("sql", "mysql", False), ("sql", "a sql b", True), ("arm", "arm64", True), ("os", "gpt-oss", False), ("algorithm", "algorithms", True), ("key-value", "key_value store", True),
     ("key-value", "key value", True), ("cli", "client", False), ("oauth", "oauth2", True), ("os", "oss", False), ("data", "database", False), ("c++", "c++ code", True)],
)
def test_keyword_bounds(spark, keyword, corpus, hit):
    assert one(spark, text.has_keyword(F.col("x"), keyword), x=corpus) is hit


@pytest.mark.parametrize("given, tier", [("MIT", "permissive"), ("GPL-3.0", "copyleft"), ("SSPL-1.0", "source-available"), (None, "unknown"), ("NOASSERTION", "unknown"), ("Other", "unknown"), ("Unlimited", "permissive"), ("BSL-1.0", "source-available")])
def test_license_tiers(spark, given, tier):
    assert one(spark, scalars.license_tier(F.col("x")), x=given) == tier


@pytest.mark.parametrize(
    "stars, forks, days, level",
    [(25_000, 3_000, 10, "tier-2"), (25_000, 120, 10, "tier-3"), (25_000, 3_000, 6 * 366, "tier-4"), (60_000, 0, 10, "tier-1"), (7_000, 0, None, "tier-3"), (600, 0, None, "tier-4"), (60_000, 0, 5 * 366, "tier-4")],
)
def test_maturity(spark, stars, forks, days, level):
    epoch = F.lit(None).cast("long") if days is None else F.lit(NOW - days * 86_400)
    assert spark.range(1).select(scalars.maturity(F.lit(stars), F.lit(forks), epoch, NOW).alias("m")).first().m.level == level


def test_timestamps(spark):
    rows = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T01:00:00+01:00",), ("2024-01-01",), ("junk",), (None,)], "x string")
    assert [r[0] for r in rows.select(scalars.parse_epoch(F.col("x"))).collect()] == [1704067200, 1704067200, 1704067200, None, None]
    assert one(spark, scalars.real_date(F.col("x")), x=scalars.MISSING_DATE) is None


def test_seeded_draws(spark):
    def fnv(s):
        h = 0x811C9DC5
        for c in s:
            h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
        return h

    def mulberry(seed, k):
        a = (seed + (k + 1) * 0x6D2B79F5) & 0xFFFFFFFF
        t = (a ^ a >> 15) * (a | 1) & 0xFFFFFFFF
        t = (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF) & 0xFFFFFFFF) ^ t
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    seeds = ["", "a", "stack-42", "zzzzzz"]
    rows = spark.createDataFrame([(s, k) for s in seeds for k in range(4)], "s string, k int")
    for r in rows.select("s", "k", scalars.text_seed(F.col("s")).alias("h"), scalars.draw(scalars.text_seed(F.col("s")), F.col("k")).alias("v")).collect():
        assert r.h == fnv(r.s) and r.v == mulberry(r.h, r.k)


def _catalog(spark, n=40):
    rng = random.Random(3)
    rows = [(i, f"repo-{i}", "own", f"own/repo-{i}", rng.choice([500, 800, 5000, 90_000]), rng.randint(0, 900), NOW - rng.randint(0, 900) * 86_400 if i % 5 else None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, name string, owner string, full_name string, stars long, forks long, pushed_epoch long")


def test_signal_formula(spark):
    df = _catalog(spark)
    rows = df.collect()
    n = len(rows)

    def pct(values, v):
        below, equal = sum(x < v for x in values), sum(x == v for x in values)
        return (below + (equal - 1) / 2 + 1) / n

    stars, ratio = [float(r.stars) for r in rows], [(r.forks + 1.0) / (r.stars + 1.0) for r in rows]
    got = {r.id: r.signal for r in score.signal(df, NOW, F.lit("pip install x")).collect()}
    for r, q in zip(rows, ratio):
        rec = 0.5 if r.pushed_epoch is None else math.exp(-(NOW - r.pushed_epoch) / 86_400 / 548.0)
        assert got[r.id] == round(45 * pct(stars, float(r.stars)) + 25 * rec + 20 * pct(ratio, q) + 10)
    single = df.limit(1).withColumn("pushed_epoch", F.lit(NOW))
    assert score.signal(single, NOW, F.lit("cargo install x")).first().signal == 100
    assert score.signal(df.limit(0), NOW).count() == 0


def test_ordinals_are_gapless(spark):
    out = score.global_ordinal(_catalog(spark).repartition(7), F.col("stars").desc(), F.col("full_name")).orderBy("ord").collect()
    assert [r.ord for r in out] == list(range(40)) and [(-r.stars, r.full_name) for r in out] == sorted((-r.stars, r.full_name) for r in out)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ordinals_of_many_wide_rows(spark, adaptive):
    """Sampled bounds and joined partitions differ from run to run; positions must not."""
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        df = spark.range(0, 600_000, 1, 9).select((F.xxhash64("id") % 5000).alias("stars"), F.concat(F.lit("name-"), "id").alias("full_name"), F.repeat(F.lit("wide "), 20).alias("text"))
        out = score.global_ordinal(df, F.col("stars").desc(), F.col("full_name"))
        for _ in range(2):
            r = out.agg(F.count("*").alias("n"), F.countDistinct("ord").alias("d"), F.min("ord").alias("lo"), F.max("ord").alias("hi")).first()
            assert (r.n, r.d, r.lo, r.hi) == (600_000, 600_000, 0, 599_999)
        after = out.select("ord", "stars").alias("a").join(out.select((F.col("ord") - 1).alias("o"), F.col("stars").alias("next")), F.col("a.ord") == F.col("o"))
        assert after.where("stars < next").isEmpty()
        ranked = score.percentile_rank_avg(df, F.col("stars"), "p").agg(F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("mean")).first()
        assert ranked.n == 600_000 and ranked["mean"] == round((600_000 + 1) / 2 / 600_000, 9)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_ranks_within_a_value(spark):
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("g"), F.xxhash64("id").alias("v")).unionByName(spark.createDataFrame([(None, 5), (None, 7)], "g string, v long"))
    got = defaultdict(list)
    for r in score.ranked_within(df, "g", F.col("v").desc()).collect():
        got[r.g].append((r["rank"], r.v))
    for rows in got.values():
        rows.sort()
        assert [n for n, _ in rows] == list(range(1, len(rows) + 1)) and [v for _, v in rows] == sorted((v for _, v in rows), reverse=True)
    assert len(got) == 4


def test_exported_postings_in_blocks(spark):
    rows = [("a", i, 1 + i % 3, 8) for i in range(0, 100, 3)] + [("b", 50, 2, 1)]
    out = search.export_postings(spark.createDataFrame(rows, "token string, ord long, tf int, field_mask int"), span=10).orderBy("token", "block").collect()
    assert all(len(r.postings) <= 4 for r in out)
    at, decoded = 0, []
    for r in out:
        if r.token == "a":
            for gap, code in r.postings:
                at += gap
                decoded.append((at, code // 1024, code % 1024))
    assert decoded == [(o, tf, m) for t, o, tf, m in rows if t == "a"] and [tuple(p) for p in out[-1].postings] == [(50, 2049)]


def test_parts_above_their_budget_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(i, "D", "x" * 100) for i in range(40)], "id long, domain string, description string")
    with pytest.raises(ValueError, match="d/0"):
        files.write_details(df, str(tmp_path / "a"), target=20, max_bytes=2000)
    assert not (tmp_path / "a").exists()
    files.write_details(df, str(tmp_path / "a"), target=20, max_bytes=4000)
    sizes = files.part_bytes(spark.read.schema("id LONG, domain STRING, description STRING, slug STRING, part LONG").parquet(str(tmp_path / "a"))).collect()
    assert {(r.slug, r.part, r["rows"]) for r in sizes} == {("d", 0, 20), ("d", 1, 20)}
    assert sum(r.bytes for r in sizes) == sum(len(json.dumps({"id": i, "domain": "D", "description": "x" * 100}, separators=(",", ":"))) + 1 for i in range(40))


def test_coverage_gate(spark):
    df = spark.createDataFrame([(1, 900, ["a"]), (2, 900, []), (3, 900, None), (4, 100, ["b"])], "id long, stars long, topics array<string>")
    assert tuple(quality.coverage(df, 500).first()) == (3, 1, pytest.approx(100 / 3))
    quality.coverage_gate(df, 30, 500)
    with pytest.raises(ValueError):
        quality.coverage_gate(df, 40, 500)
    assert quality.coverage(df.limit(0)).first().pct == 0


def test_slots_of_any_number(spark):
    df = spark.createDataFrame([(i, f"n{i}", f"o/n{i}", "o", "Go", f"D{i % 3}", "S", 100 + i, []) for i in range(30)], "id long, name string, full_name string, owner string, language string, domain string, subsystem string, stars long, primitives array<string>")
    slots = spark.range(1200).select(F.col("id").alias("slot"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("D"), F.col("id") % 3)).alias("domain"), F.lit(None).cast("string").alias("subsystem"))
    picks = spark.createDataFrame([], "slot long, id long")
    got = recommend.slot_candidates(df, slots, picks, k=2).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.slot, r["rank"])):
        by[r.slot].append(r.id)
    assert len(by) == 1200 and all(ids == ([29, 28] if s % 4 == 0 else [27 + s % 3, 24 + s % 3]) for s, ids in by.items())


@pytest.mark.parametrize(
    "statement, ok",
    [("select 1", True), ("SELECT ';' AS a, 'drop table t' AS b;", True), ("-- c; d\nWITH x AS (SELECT 1) SELECT * FROM x ;", True), ("/* a; */ select 1", True), ("select 1; select 2", False), ("drop table t", False),
     ("with x as (select 1) insert into t select * from x", False), ("", False), (None, False), ("'x'", False), ("selection", False)],
)
def test_guard_as_an_expression(spark, statement, ok):
    assert spark.createDataFrame([(statement,)], "q string").select(sql.read_only(F.col("q"))).first()[0] is ok


def test_index_keeps_and_drops(spark):
    rows = [(i, "alpha" if i == 0 else f"n{i}", "body word" if i < 2 else "rare" if i == 3 else "spread" if i < 9 else "x") for i in range(30)]
    df = spark.createDataFrame(rows, "ord long, name string, description string")
    postings, terms = search.build_index(df)
    df_of = {r.token: r.df for r in terms.collect()}
    assert df_of["alpha"] == 1 and df_of["word"] == 2 and "rare" not in df_of and "spread" not in df_of and "x" not in df_of
    assert all(r.tf <= search.MAX_TF for r in postings.collect())
    q = spark.createDataFrame([(1, "word alpha"), (2, "word word"), (3, "nothing")], "qid long, q string")
    found = search.search(postings, terms, 30, q, df.withColumn("stars", F.lit(1)))
    got = {(r.qid, r.ord): r for r in found.collect()}
    assert got[1, 0].rank == 1 and got[1, 0].matched == 2 and got[2, 1].matched == 2 and not any(k[0] == 3 for k in got)
    once = search.search(postings, terms, 30, q, df.withColumn("stars", F.lit(1)), distinct=True)
    assert {r.matched for r in once.where("qid = 2").collect()} == {1}


def test_general_rows_only_get_fallback_edges(spark):
    df = spark.createDataFrame([(i, "General Components", "Other", []) for i in range(5)], "ord long, subsystem string, language string, topics array<string>")
    edges = graph.window_fill(graph.knn_edges(df), df)
    assert edges.where("not is_fallback").count() == 0 and edges.count() == 20 and {r.weight for r in edges.collect()} == {0.1}


def test_cooccurrence_floors(spark):
    rows = [(i, t) for t, n in (("a", 65), ("b", 40), ("c", 25), ("d", 15)) for i in range(n)]
    tags = spark.createDataFrame(rows + rows[:5], "id long, topic string")
    got = {(r.topic, r.other): r.pair_count for r in graph.cooccurrence(tags).collect()}
    assert got == {("a", "b"): 40, ("a", "c"): 25, ("b", "a"): 40, ("b", "c"): 25, ("c", "a"): 25, ("c", "b"): 25}
    assert {r.topic for r in graph.cooccurrence(tags, min_count=35).collect()} == {"a", "b"}


def test_movers(spark):
    s = spark.createDataFrame([("1", "a/x", 1000), ("2", "A/x", 1200), ("1", "b/y", 700), ("2", "b/y", 700), ("1", "c/z", 400), ("2", "c/z", 450), ("1", "gone", 900), ("2", "new", 800), ("2", "d", 0), ("1", "d", 600)], "snapshot_date string, full_name string, stars long")
    out = {r.full_name: r for r in trend.movers(s, "1", "2").collect()}
    assert set(out) == {"A/x", "d"} and out["A/x"].delta == 200 and out["A/x"].pct == 20.0
    changes = {r.full_name: r.change for r in trend.snapshot_diff(s, "1", "2").collect()}
    assert changes["gone"] == "removed" and changes["new"] == "added"
    assert trend.mover_series(trend.movers(s, "1", "2"), s).count() == 4


def test_fresh_blanks_win_and_ids_stay(spark):
    known = spark.createDataFrame([(1, "o/n", "o/n", 10, "old text", ["t"], "MIT", "2020")], "id long, key string, full_name string, stars long, description string, topics array<string>, license string, pushed_at string")
    fresh = spark.createDataFrame([(9, "o/n", "O/n", 20, "", [], "NOASSERTION", None)], known.schema)
    row = merge.upsert(known, fresh).first()
    assert (row.id, row.full_name, row.stars, row.description, row.topics, row.license, row.pushed_at, row.change) == (1, "O/n", 20, "", [], "Unknown", "2020", "refreshed")
    counts = merge.merge_counts(merge.upsert(known.limit(0), fresh.union(fresh))).first()
    assert (counts["new"], counts.refreshed, counts.final) == (1, 1, 1)


def test_errors_forbid_a_patch(spark):
    known = spark.createDataFrame([("a", 1)], "key string, stars long")
    fresh = known.limit(0)
    looked = spark.createDataFrame([("a", 401, False, 0, None)], "key string, status int, private boolean, stars long, current_name string")
    with pytest.raises(ValueError):
        merge.reconcile_patch(known, fresh, looked)
    with pytest.raises(ValueError):
        merge.reconcile_patch(known, fresh, looked.limit(0))
    private = looked.withColumns({"status": F.lit(200), "private": F.lit(True)})
    assert merge.reconcile_patch(known, fresh, private).first().verdict == "blocked"


def test_ids_are_probed(spark):
    df = spark.createDataFrame([(5, "a", 9), (5, "b", 8), (-1, "c", 7), (None, "d", 6), (1 << 60, "e", 5)], "id long, full_name string, stars long")
    out = merge.stable_ids(df).collect()
    assert len({r.id for r in out}) == 5 and {r.full_name for r in out if not r.rekeyed} == {"a"} and all(0 < r.id < merge.SAFE_ID for r in out)


def test_artifacts(spark):
    cases = [("redis-client", "client library for redis", [], "Library / SDK"), ("awesome-go", "", [], "Curated List / Docs"), ("x", "a query engine library", [], "Library / SDK"), ("x", "nothing", [], "Application / Service"),
             ("x", "y", ["roadmap"], "Curated List / Docs"), ("starter", "", [], "Template / Starter"), ("my-cli", "", [], "Developer Tool / CLI"), ("x", "web framework", [], "Framework"), ("x-extension", "extension", [], "Application / Service")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, name string, description string, topics array<string>, want string")
    for r in df.select("*", classify.artifact(F.col("name"), F.col("description"), F.col("topics")).alias("got")).collect():
        assert r.got == r.want, r


RULES = [{"domain": "Databases & Storage", "keywords": ["database", "sql", "key-value", "olap"], "strong": ["database"], "subsystems": {"OLTP": ["sql"], "KV": ["key-value"]}}, {"domain": "AI", "keywords": ["llm", "database model", "gpu"], "strong": ["llm"], "subsystems": {"Inference": ["gpu"]}}]


def _reference_domain(name, desc, topics, lang):
    body, tags = f"{name} {desc} {' '.join(topics)} {lang}".lower(), "\n".join(t.lower() for t in topics)
    hit = lambda w, t: bool(t) and re.search(text.keyword_pattern(w), t) is not None
    ranked = []
    for r in RULES:
        total = hits = weak = 0
        for k in r["keywords"]:
            if hit(k, tags):
                hits += 1
                total, weak = (total + 6, weak) if k in r["strong"] else (total, 1)
            elif hit(k, body):
                total += 1
        ranked.append((-(total + 3 * weak), -hits, r["domain"]))
    (a, _, best), (b, *_) = sorted(ranked)[:2]
    return (best if -a >= 3 and b - a >= 2 else classify.NO_DOMAIN), min(9, b - a)


def test_domains_by_token_join(spark):
    rng = random.Random(5)
    words = ["database", "databases", "sql", "key", "value", "llm", "llm2", "gpu", "gpus", "gpux", "model", "olap", "mysql", "x"]
    rows = [(i, f"n{i}", " ".join(rng.choices(words, k=5)), rng.sample(words, rng.randint(0, 3)), "Go") for i in range(150)]
    df = spark.createDataFrame(rows, "id long, name string, description string, topics array<string>, language string")
    got = {r.id: (r.domain, r.domain_margin) for r in classify.domains(df, RULES).collect()}
    assert got == {r[0]: _reference_domain(*r[1:]) for r in rows}
    # a keyword of two pieces may run across adjacent tags
    two = spark.createDataFrame([(1, "", "", ["key", "value"], "")], df.schema)
    assert classify.domains(two, RULES).first().domain == "Databases & Storage"


def test_reclassify_keeps_curated_cards(spark):
    card = "struct<what_it_does:string,why_it_matters:string,when_to_use:string,alternatives:array<string>,key_superpowers:array<string>>"
    df = spark.createDataFrame([(1, "x", "", ["database"], "Go", "AI", "Inference", "Framework", ["AI", "mine"], ("own", "", "", [], []))], f"id long, name string, description string, topics array<string>, language string, domain string, subsystem string, artifact string, keywords array<string>, beginner_intel {card}")
    r = classify.reclassify(df, RULES).first()
    assert r.domain == "Databases & Storage" and r.keywords[-1] == "mine" and "AI" not in r.keywords and r.beginner_intel.what_it_does == "own"


def _pair(spark, a, b):
    schema = "struct<language:string,license:string,primitives:array<string>,labels:array<string>,corpus:string>"
    return recommend.pair_synergy(spark.createDataFrame([(a, b)], f"a {schema}, b {schema}")).first()


def test_synergy_points(spark):
    def side(**k):
        v = {"language": "Go", "license": "MIT", "primitives": [], "labels": [], "corpus": ""} | k
        return tuple(v.values())

    assert _pair(spark, side(), side()).score == 68
    assert _pair(spark, side(primitives=["p"]), side(primitives=["p"])).status == "High Synergy"
    plain = _pair(spark, side(), side(language="Java")).score
    assert plain == 45 and _pair(spark, side(labels=["gRPC / Protobuf"]), side(language="Java", corpus="a grpc thing")).score == plain + 10
    assert _pair(spark, side(labels=["a", "b", "c"]), side(language="Java", labels=["a", "b", "c"])).score == plain + 20
    assert _pair(spark, side(license="GPL-3.0"), side()).score == 53 and _pair(spark, side(license="LGPL-3.0"), side()).score == 68
    assert _pair(spark, side(language="Python"), side(language="Rust")).score == 62


def test_windows_cover_without_gaps(spark):
    rows = [(v % 37, v) for v in range(900)] + [(40, i) for i in range(1500)] + [(41, 5)] * 300
    df = spark.createDataFrame(rows, "a long, b long")
    w = quality.plan_windows(df, "a", "b", 0, 100, 100).collect()
    assert sum(r["rows"] for r in w) == len(rows)
    assert all(r["rows"] <= 100 or r.truncated for r in w) and {r.lo for r in w if r.truncated} == {40, 41}
    plain = sorted((r.lo, r.hi) for r in w if r.second_lo is None)
    assert all(a[1] < b[0] for a, b in zip(plain, plain[1:]))

    def halve(lo, hi):
        n = sum(lo <= a <= hi for a, _ in rows)
        if n <= 100 or lo == hi:
            return {(lo, hi, n)} if 0 < n <= 100 else set()
        mid = (lo + hi) // 2
        return halve(lo, mid) | halve(mid + 1, hi)

    assert {(r.lo, r.hi, r["rows"]) for r in w if r.second_lo is None} == halve(0, 100)


@pytest.mark.parametrize(
    "statement, ok",
    [("select 1", True), ("WITH x AS (SELECT 1 AS a) SELECT a FROM x;", True), ("-- c\nSELECT 1", True), ("drop table t", False), ("select 1; drop table t", False), ("with x as (select 1 as a) insert into t select * from x", False), ("", False), ("insert into t values (1)", False)],
)
def test_guard(spark, statement, ok):
    spark.range(1).createOrReplaceTempView("t")
    assert sql.is_read_only(spark, statement) is ok


def test_raw_lines(spark):
    lines = ['{"id": 1, "owner": "a", "name": "b", "stars": 5}', "", "  ", "{broken", '{"owner": "", "name": "x"}', "[1]", '"text"']
    got = raw.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).groupBy("state").count().collect()
    assert {r.state: r["count"] for r in got} == {"good": 1, "bad": 3, "incomplete": 1}


def test_addresses(spark):
    owner, name = raw.from_url(F.col("u"))
    df = spark.createDataFrame([("https://github.com/a/b/?x=1",)], "u string")
    assert tuple(df.select(owner, name).first()) == ("a", "b") and one(spark, raw.number(F.col("x")), x="12,345") == 12345


def test_ingest_resumes(spark, tmp_path):
    src, dst, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    make = lambda *names: spark.createDataFrame([(json.dumps({"owner": "o", "name": n, "stars": 1}),) for n in names] + [("{bad",)], "value string")
    make("a", "b", "a").coalesce(1).write.mode("append").text(src)
    ingest(spark, src, dst, state)
    assert read_target(spark, dst).count() == 2
    make("b", "c").coalesce(1).write.mode("append").text(src)
    ingest(spark, src, dst, state)
    ingest(spark, src, dst, state)
    assert sorted(r.key for r in read_target(spark, dst).collect()) == ["o/a", "o/b", "o/c"]


def test_parts_are_powers_of_two(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 100, 101, 200, 201, 400, 401)], "n long")
    assert [r[0] for r in df.select(files.part_count(F.col("n"), 100)).collect()] == [1, 1, 1, 2, 2, 4, 4, 8]


def test_facets_break_ties_by_first_row(spark):
    df = spark.createDataFrame([(0, "b", ["x"]), (1, "a", ["x", "y"]), (2, "a", None), (3, "b", ["y"])], "ord long, domain string, topics array<string>")
    got = {(r.dimension, r.name): (r["count"], r["rank"]) for r in facets.facet_counts(df).collect()}
    assert got["domain", "b"] == (2, 1) and got["domain", "a"] == (2, 2) and got["topic", "x"] == (2, 1) and got["total", "total"] == (4, 1)
    assert facets.topics_by_domain(df).where("weight = 1").count() == 4  # x and y once each in both domains


def test_lexicons_keep_order(spark):
    found = one(spark, text.lexicon_tags(F.col("x"), lexicons.PRIMITIVES), x="cuda with raft, simd, zero-copy and wasm")
    assert found == ["Zero-Copy", "SIMD / Vectorized", "WASM / WASI", "Raft Consensus"]


def test_range_windows_hold_keys_of_any_size(spark, tmp_path):
    from lattix.plans.queries_tables import windows

    keys = [-3, 5, 20_000, 20_001, 40_003, 150_000]
    spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert sum(r["rows"] for r in windows(spark, str(tmp_path)).collect()) == len(keys)


def test_artifact_makes_its_texts_once(spark):
    df = spark.createDataFrame([("my-cli", "An SDK", ["x"])], "name string, description string, topics array<string>")
    out = df.select(classify.artifact(F.col("name"), F.col("description"), F.col("topics")).alias("a"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_join(") == 1 and out.first()[0] == "Developer Tool / CLI"


def test_one_pattern_stands_for_all(spark):
    patterns = [p for lexicon in (lexicons.PRIMITIVES, lexicons.USE_CASES) for ps in lexicon.values() for p in ps] + lexicons.CURATED_PATTERNS
    samples = ["", "Zero-Copy", "xsimd", "simdx", "a RAFT.", "awesome-x", "an awesome-x", "x-awesome", "x-awesome y", "Curated  list", "curated list", "tokeniz", "tokenizer", "rag", "drag"]
    df = spark.createDataFrame([(s,) for s in samples], "x string")
    rows = df.select("x", F.col("x").rlike(text.any_of(patterns)).alias("one"), functools.reduce(lambda a, b: a | b, [F.col("x").rlike(f"(?i){p}") for p in patterns]).alias("each")).collect()
    assert all(r.one == r.each for r in rows) and {r.one for r in rows} == {True, False}
    assert one(spark, text.lexicon_tags(F.col("x"), lexicons.PRIMITIVES), x=None) == []

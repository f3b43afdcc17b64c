"""Streaming upserts, rows by window, pruned look-ups, record layouts, mixed records, gates, counters and views on cases of their own."""

from __future__ import annotations

import json
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from lattix.operators import classify, graph, merge, quality, recommend
from lattix.plans import queries_core, queries_tables
from lattix.sources import catalog as files
from lattix.sources import raw, variants
from lattix.streaming import upsert as upserts

# Streaming upserts.


def drop(folder, name, records):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.txt", "w") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def record(i, stars, **more):
    return {"id": i, "name": f"n{i}", "owner": "O", "stars": stars, **more}


def table_of(spark, target):
    return {r["key"]: (r["id"], r["stars"]) for r in upserts.read_catalog(spark, target).collect()}


def test_batches_are_merged_and_survive_failures(spark, tmp_path, monkeypatch):
    source, target, state = (f"{tmp_path}/{n}" for n in ("in", "t", "c"))
    go = lambda: upserts.ingest_upserts(spark, source, target, state, buckets=8, order="stars")
    drop(source, "a", [record(i, i) for i in range(20)] + ["{bad", "", '{"name": "x"}'])
    go()
    expected = {f"o/n{i}": (i, i) for i in range(20)}
    assert table_of(spark, target) == expected
    drop(source, "b", [record(3, 50), record(3, 40), {**record(3, 45), "id": 999}, record(30, 7)])
    commit = upserts._commit

    def lost(*_):
        raise RuntimeError("lost before the commit")

    monkeypatch.setattr(upserts, "_commit", lost)
    with pytest.raises(Exception):
        go()
    assert table_of(spark, target) == expected  # what was written isn't current
    monkeypatch.setattr(upserts, "_commit", commit)
    go()
    expected |= {"o/n3": (3, 50), "o/n30": (30, 7)}
    assert table_of(spark, target) == expected
    before = upserts.commits(spark, target).agg(F.max("version")).first()[0]
    go()  # nothing new
    assert upserts.commits(spark, target).agg(F.max("version")).first()[0] == before
    # a batch that is run again after its commit changes nothing
    again = spark.createDataFrame([("o/n3", 3, "n3", "O", 1)], "key string, id long, name string, owner string, stars long")
    upserts.merge_batch(again, target, state, 1, buckets=8)
    assert table_of(spark, target) == expected
    assert len(table_of(spark, target)) == 21 and upserts.read_catalog(spark, target, version=0).count() == 20


def test_a_batch_writes_only_the_buckets_that_it_touches(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = lambda ids: spark.createDataFrame([(f"o/n{i}", i, f"n{i}", "o", i) for i in ids], "key string, id long, name string, owner string, stars long")
    upserts.merge_batch(rows(range(200)), target, "s", 0, buckets=16)
    upserts.merge_batch(rows([5]), target, "s", 1, buckets=16)
    written = [f for f in os.listdir(f"{target}/data/at=1") if f.startswith("bucket=")]
    assert len(written) == 1 and len(os.listdir(f"{target}/data/at=0")) > 10
    assert upserts.prune(spark, target) == 1
    assert upserts.read_catalog(spark, target).count() == 200
    upserts.merge_batch(rows([]), target, "s", 2, buckets=16)  # an empty batch is a commit
    assert upserts.read_catalog(spark, target).count() == 200
    assert upserts.read_catalog(spark, str(tmp_path / "none")).count() == 0


def test_batches_equal_one_upsert(spark, tmp_path):
    make = lambda ids, add: spark.createDataFrame([(f"o/n{i}", i, f"n{i}", "o", i + add, f" d{add} ", None) for i in ids], "key string, id long, name string, owner string, stars long, description string, license string")
    batches = [make(range(0, 30), 0), make(range(10, 50), 100), make([3, 12, 49], 200)]
    for k, b in enumerate(batches):
        upserts.merge_batch(b, str(tmp_path / "t"), "s", k, buckets=4)
    everything = batches[0].unionByName(batches[1]).unionByName(batches[2])
    empty = spark.createDataFrame([], upserts.RECORD)
    cols = ["key", "id", "name", "stars", "description", "license", "language"]
    once = merge.upsert(empty, everything, "stars").select(cols)
    assert sorted(map(str, once.collect())) == sorted(map(str, upserts.read_catalog(spark, str(tmp_path / "t")).select(cols).collect()))


# Windows.


def test_rows_meet_their_window(spark):
    rows = [(v, w) for v in range(1, 65) for w in range(v % 7)] + [(9, w) for w in range(3000)] + [(None, 1), (500, 2), (-4, 3), (9, None)]
    df = spark.createDataFrame(rows, "a long, b long")
    windows = quality.numbered_windows(quality.plan_windows(df, "a", "b", 1, 64, 50)).collect()
    by = {w["window"]: w for w in windows}
    assert sorted(by) == list(range(len(windows)))
    order = [(w["lo"], -1 if w["second_lo"] is None else w["second_lo"]) for _, w in sorted(by.items())]
    assert order == sorted(order, reverse=True)
    out = quality.by_window(df, "a", "b", 1, 64, 50).withColumn("task", F.spark_partition_id()).collect()
    assert len(out) == len(rows)
    held: dict = {}
    for r in out:
        if r["a"] is None or not 1 <= r["a"] <= 64:
            assert r["window"] is None
            continue
        w = by[r["window"]]
        held.setdefault(r["window"], []).append(r["task"])
        assert w["lo"] <= r["a"] <= w["hi"]
        second = 0 if r["b"] is None else r["b"]
        assert (w["second_lo"] or 0) <= second and (w["second_hi"] is None or second <= w["second_hi"])
    assert {w: len(t) for w, t in held.items()} == {w: r["rows"] for w, r in by.items()}
    assert all(len(set(t)) == 1 for t in held.values())
    assert all(len(t) <= 50 or by[w]["truncated"] for w, t in held.items())
    assert quality.by_window(df.limit(0), "a", "b", 1, 64).count() == 0


# Look-ups.


def test_look_up_reads_the_folders_of_wanted_rows_only(spark, tmp_path):
    df = spark.createDataFrame([(i, f"o/n{i}", f"n{i}", f"o/n{i}", i, f"Domain {i % 10}", "Sub", "hook", "text", f"https://h/o/n{i}") for i in range(1000)], "id long, key string, name string, full_name string, stars long, domain string, subsystem string, hook string, description string, url string")
    details = df.select("id", "domain", F.when(F.col("id") % 2 == 0, F.concat(F.lit("run "), "name")).otherwise(" ").alias("quickstart_code"))
    path = f"{tmp_path}/details"
    files.write_details(details, path, 25)
    folders = sum(d.startswith("part=") for s in os.listdir(path) if s.startswith("slug=") for d in os.listdir(f"{path}/{s}"))
    assert folders == 20  # ids of a domain are all odd or all even
    stored = spark.read.schema(details.drop("domain").schema.add("slug", "string").add("part", "long")).parquet(path)
    names = spark.createDataFrame([("N4",), ("o/n15",), ("n4",), ("gone",)], "name string")
    found = merge.lookup_details(df, stored, names, files.parts_by_slug(details, 25))
    rows = {r["wanted"]: r for r in found.collect()}
    assert {w: r["quickstart_code"] for w, r in rows.items()} == {"N4": "run n4", "n4": "run n4", "o/n15": "git clone https://h/o/n15.git"}
    plan = found._jdf.queryExecution().executedPlan()
    text = found._jdf.queryExecution().toString()
    assert "dynamicpruning" in text.lower()
    read = []

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        if node.nodeName().startswith("Scan parquet") and "quickstart_code" in node.simpleString(2000):
            read.append(node.metrics().apply("numFiles").value())
        kids = node.children()
        for k in range(kids.size()):
            walk(kids.apply(k))

    walk(plan)
    assert read and max(read) <= 4 < folders


def test_look_up_defaults(spark):
    df = spark.createDataFrame([(1, "o/a", "a", "o/a", 5, "Sub", None, "text", "https://h/o/a")], "id long, key string, name string, full_name string, stars long, subsystem string, hook string, description string, url string")
    details = spark.createDataFrame([], "id long, beginner_intel struct<what_it_does string, why_it_matters string, when_to_use string, alternatives array<string>, key_superpowers array<string>>, license_intel struct<tier string, commercial string, desc string>, quickstart_code string")
    r = merge.lookup_details(df, details, spark.createDataFrame([("A",)], "name string")).first()
    assert r["beginner_intel"]["what_it_does"] == "text" and r["beginner_intel"]["when_to_use"].endswith("in Sub.")
    assert r["license_intel"]["tier"] == merge.LOOKUP_LICENSE["tier"] and r["quickstart_code"] == "git clone https://h/o/a.git"


# Record layouts.


def test_layouts_in_one_folder(spark, tmp_path):
    put = lambda n, x: (tmp_path / n).write_text(x)
    put("a.json", '{"id":1,"name":"a","owner":"o"}\n\n{"bad\n{"id":2,"name":"","owner":"o"}\n{"id":9,"name":"z","owner":"o"},\n["x"]\n')
    put("b.json", '\n [\n{"id":3,"name":"b","owner":"o","topics":["x","y"]},\n{"id":4,"name":"c"},\n{"bad,\n{"id":5,"name":"e","owner":"o","topics":["q"]}\n]\n')
    put("c.json", '[{"id":6,"name":"f","owner":"o"},{"id":7,"name":"],[ {","owner":"o"}]')
    put("d.json", '[\n  {\n    "id": 8,\n    "name": "h",\n    "owner": "o"\n  }\n]')
    put("e.json", "[]")
    put("f.json", "")
    assert {os.path.basename(r["file"]): r["layout"] for r in raw.layouts(spark, str(tmp_path)).collect()} == {"a.json": "lines", "b.json": "array", "c.json": "array", "d.json": "nested", "e.json": "array"} | {"e.json": raw.layouts(spark, f"{tmp_path}/e.json").first()["layout"]}
    found = sorted((r["state"], r["id"] or 0, r["name"] or "") for r in raw.scan_records(spark, str(tmp_path)).collect())
    assert found == sorted([("bad", 0, "")] * 4 + [("good", i, n) for i, n in ((1, "a"), (3, "b"), (5, "e"), (6, "f"), (7, "],[ {"), (8, "h"))] + [("incomplete", 2, ""), ("incomplete", 4, "c")])


def test_large_arrays_are_split_and_read_as_lines(spark, tmp_path):
    records = [json.dumps({"id": i, "name": f"n{i}" if i % 50 else "", "owner": "o", "description": "d" * 100}) if i % 70 else '{"id": ' for i in range(20_000)]
    os.makedirs(tmp_path / "array")
    os.makedirs(tmp_path / "lines")
    (tmp_path / "array" / "x.json").write_text("[\n" + ",\n".join(records) + "\n]\n")
    (tmp_path / "lines" / "x.json").write_text("\n".join(records) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        array = raw.scan_records(spark, str(tmp_path / "array"))
        tasks = array.where("state = 'good'").select(F.spark_partition_id().alias("p")).distinct().count()
        cols = ["id", "name", "owner", "state"]
        assert tasks > 4
        assert array.select(cols).exceptAll(raw.scan_records(spark, str(tmp_path / "lines")).select(cols)).count() == 0
        assert array.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_of_mixed_shape(spark):
    texts = [
        '{"id":1,"name":"n","owner":{"login":"L"},"license":{"spdx_id":"MIT","name":"x"},"stargazers_count":5,"forks":2,"updated_at":"2020-01-01T00:00:00Z","topics":["a",null,"b"],"is_archived":true}',
        '{"id":2,"name":"n","owner":"P","license":"GPL","stars":"7","stargazers_count":0,"forks_count":3.0,"pushed_at":"","updated_at":"2020-01-01"}',
        "nope", '{"owner":{"x":1},"license":{"name":"Foo"},"topics":"x","stars":null}', None, '{"owner":["x"],"license":null,"name":5}', "[1]",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, record string").withColumn("stars", F.lit("clash"))
    rows = {r["k"]: r for r in variants.from_variants(df).collect()}
    assert (rows[0]["owner"], rows[0]["license"], rows[0]["stars"], rows[0]["forks"], rows[0]["topics"], rows[0]["pushed_epoch"], rows[0]["is_archived"]) == ("L", "MIT", 5, 2, ["a", "b"], 1577836800, True)
    assert (rows[1]["owner"], rows[1]["license"], rows[1]["stars"], rows[1]["forks"], rows[1]["pushed_at"]) == ("P", "GPL", 7, 3, "2020-01-01")
    assert (rows[3]["owner"], rows[3]["license"], rows[3]["stars"], rows[3]["topics"]) == (None, "Foo", 0, [])
    assert rows[5]["owner"] is None and rows[5]["license"] is None and rows[5]["name"] == "5"
    assert all(rows[k]["name"] is None and rows[k]["stars"] == 0 for k in (2, 4, 6))


# Gates.


def test_details_name_the_least_keys(spark):
    df = spark.createDataFrame([(i, "o" if i % 3 else "", f"n{i}", 1000, "D") for i in range(1, 200)] + [(None, "o", "n", 1000, "D"), (7, "o", "n", 1000, "D"), (7, "o", "n", 1, "D")], "id long, owner string, name string, stars long, domain string")
    flat = df.select("id").where("id <> 11").distinct()
    details = df.where("id is not null").select("id", F.lit("d").alias("slug"), F.lit(0).cast("long").alias("part")).distinct()
    found = {r["check"]: (r["failures"], r["detail"]) for r in quality.verify(df, details, flat, 500, 1).collect()}
    assert found["missing_owner_or_name"] == (66, "3, 6, 9, 12, 15")
    assert found["duplicate_id"] == (1, "7") and found["below_floor"] == (1, "7")
    assert found["id_out_of_range"] == (1, "null") and found["details_missing"] == (1, "null")
    assert found["flat_missing"] == (2, "11, null") and found["too_few_rows"] == (0, "") and found["part_orphan"] == (0, "")
    empty = {r["check"]: r["failures"] for r in quality.verify(df.limit(0), details.limit(0), flat.limit(0), 500, 1).collect()}
    assert {c for c, n in empty.items() if n} == {"too_few_rows"}


def test_gates_as_checks(spark):
    report = spark.createDataFrame([("changed", "domain", 30, 30.0)], "section string, name string, n long, pct double")
    assert tuple(quality.churn_check(report, 20.0).first()) == ("churn", 30, "30.00 % of domain labels changed; the limit is 20.00 %")
    assert tuple(quality.churn_check(report, 30.0).first()) == ("churn", 0, "")
    df = spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "id long, topics array<string>").withColumn("stars", F.lit(1))
    assert quality.coverage_check(df, 40.0).first()["failures"] == 2 and quality.coverage_check(df, 30.0).first()["failures"] == 0


# Counters.


def base_of(spark, rows):
    return spark.createDataFrame([(f"o/{n}", i, "o", n, f"o/{n}", i * 10, d, h) for i, n, d, h in rows], "key string, id long, owner string, name string, full_name string, stars long, description string, hook string")


def test_counters_of_a_written_merge(spark, tmp_path):
    base = base_of(spark, [(1, "a", "text", "hook"), (2, "b", "", ""), (3, "c", "x", "x"), (4, "d", "x", "x"), (5, "e", "x", "x"), (6, "f", "x", "x")])
    lines = ['{"id":1,"owner":"O","name":"A","stars":99,"description":" new "}', '{"id":1,"owner":"o","name":"a","stars":98}', '{"id":9,"owner":"o","name":"z","stars":5}', "{bad", '{"owner":"o"}', "", '[1]']
    records = raw.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    patch = spark.createDataFrame([("o/c", "drop", "o/c", 0), ("o/d", "update", "o/moved", 7), ("o/e", "update", "o/moved", 8), ("o/f", "update", "o/b", 9), ("o/a", "update", "o/a", 77), ("o/none", "drop", "o/none", 1)], "key string, action string, current string, stars long")
    path = str(tmp_path / "out")
    found = {r["counter"]: r["n"] for r in merge.write_merged(base, records, path, patch, "stars").collect()}
    assert found == {"bad_lines": 2, "incomplete": 1, "new": 1, "refreshed": 2, "dropped": 1, "updated": 2, "collisions": 2, "hook_synthesized": 2, "final": 4}
    rows = {r["key"]: r for r in spark.read.parquet(path).collect()}
    assert set(rows) == {"o/a", "o/b", "o/moved", "o/z"}
    assert rows["o/a"]["stars"] == 77 and rows["o/a"]["hook"] == "new" and rows["o/a"]["name"] == "A" and rows["o/moved"]["stars"] == 7
    assert rows["o/b"]["hook"].startswith("A foundational Other project in the General ecosystem")


def test_counters_without_good_records_or_patch(spark, tmp_path):
    base = base_of(spark, [(1, "a", "text", "hook")])
    for lines, bad in ((["{bad"], 1), ([], 0)):
        records = raw.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
        found = {r["counter"]: r["n"] for r in merge.write_merged(base, records, str(tmp_path / f"out{bad}")).collect()}
        assert found == dict.fromkeys(merge.COUNTERS, 0) | {"bad_lines": bad, "final": 1}
        assert set(found) == set(merge.COUNTERS)


# Views, cards, ids and blueprints.


def test_topic_map_is_a_sample_by_two_ranks(spark):
    rows = [(f"t{a:02}", 1000 - a, f"t{(a + k) % 60:02}", 500 - 10 * k - a, k) for a in range(60) for k in range(1, 8)] + [("lone", 2000, None, None, None)]
    view = graph.topic_map(spark.createDataFrame(rows, "topic string, count long, other string, pair_count long, rank int")).collect()
    topics = {r["topic"]: r["place"] for r in view}
    assert len(topics) == 48 and topics["lone"] == 1 and topics["t00"] == 2 and "t47" not in topics
    links = [(r["topic"], r["other"]) for r in view if r["other"]]
    assert ("lone", None) in {(r["topic"], r["other"]) for r in view}
    assert len({frozenset(x) for x in links}) == len(links) and all(o in topics for _, o in links)
    expected = {frozenset((f"t{a:02}", f"t{a + k:02}")) for a in range(47) for k in range(1, 6) if a + k < 47}
    assert {frozenset(x) for x in links} == expected


def test_default_cards_are_renewed(spark):
    rules = [{"domain": "Data", "keywords": ["database"], "strong": ["database"], "subsystems": {"Stores": ["database"]}}]
    df = spark.createDataFrame([(1, "a database", "a database", ["database"], "Go", "Old", "Old Sub", "Library", "hook"), (2, "a database", "own", ["database"], "Go", "Old", "Old Sub", "Library", "")], "id long, name string, description string, topics array<string>, language string, domain string, subsystem string, artifact string, hook string")
    hook = F.when(F.col("hook") != "", F.col("hook")).otherwise(F.col("description"))
    df = df.withColumn("beginner_intel", classify.default_card(hook, F.col("subsystem")))
    out = {r["id"]: r for r in classify.reclassify(df, rules).collect()}
    assert all(out[i]["domain"] == "Data" and out[i]["beginner_intel"]["what_it_does"].startswith("A foundational Go project in the Data") for i in (1, 2))
    curated = df.withColumn("beginner_intel", F.col("beginner_intel").withField("what_it_does", F.lit("mine")))
    assert all(r["beginner_intel"]["what_it_does"] == "mine" for r in classify.reclassify(curated, rules).collect())


def test_equal_names_are_settled_at_once(spark):
    df = spark.createDataFrame([(0, "o/same", 1)] * 200 + [(5, "o/same", 1)] * 40 + [(None, f"o/{i}", 1) for i in range(50)], "id long, full_name string, stars long")
    began = time.time()
    out = merge.stable_ids(df).collect()
    assert len({r["id"] for r in out}) == len(out) == 290 and sum(not r["rekeyed"] for r in out) == 1
    assert time.time() - began < 60


def test_a_library_of_any_size(spark):
    library = spark.createDataFrame([(f"b{i}", "data" if i % 2 else "web", i) for i in range(1500)], "blueprint_id string, goal string, pos long")
    asked = spark.createDataFrame([(k, f"seed{k}", ("data", "web", "none", None)[k % 4]) for k in range(200)], "request long, seed string, goal string")
    chosen = {r["request"]: r["blueprint_id"] for r in recommend.choose_blueprints(library, asked).collect()}
    assert len(chosen) == 200 and len(set(chosen.values())) > 100
    assert all(int(b[1:]) % 2 == (k % 4 == 0) for k, b in chosen.items() if k % 4 < 2)
    assert re.fullmatch(r"b\d+", chosen[2]) and re.fullmatch(r"b\d+", chosen[3])


def test_references_of_an_empty_library(spark):
    c = spark.createDataFrame([("o/a", "Sub")], "key string, subsystem string")
    roles = spark.createDataFrame([("b", "r", "data", " ", ["O/A"])], "blueprint_id string, role string, category string, subsystem string, seeds array<string>")
    links = spark.createDataFrame([("b", "r", "r")], "blueprint_id string, src string, dst string")
    prints = spark.createDataFrame([("b", "g"), ("c", "g")], "blueprint_id string, goal string")
    assert {r["failures"] for r in quality.verify_blueprints(prints, roles, links, c, ("data",)).collect()} == {0}
    assert {r["failures"] for r in quality.verify_blueprints(prints.limit(0), roles.limit(0), links.limit(0), c, ("data",)).collect()} == {0}


# Domains.


def test_tags_and_body_are_looked_up_in_one_pass(spark):
    rules = [{"domain": "A", "keywords": ["red", "big ring"], "strong": ["red"], "subsystems": {"R": ["ring2x"]}}, {"domain": "B", "keywords": ["blue"], "subsystems": {}}]
    rows = [(1, "n", "a big-rings 7", ["Red"], "en"), (2, "blue2", "reds", [], None), (3, None, None, None, None), (4, "x", "red", ["blue", "red"], "ring2"), (4, "y", "blue", [], "")]
    df = spark.createDataFrame(rows, "id long, name string, description string, topics array<string>, language string")
    out = classify.domains(df, rules)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("__runs") and plan.count("FullOuter") == 0
    assert sorted((r.id, r.domain, r.subsystem, r.domain_margin) for r in out.collect())[0] == (1, "A", "General A", 7)
    assert {(r.id, r.domain) for r in out.collect()} == {(1, "A"), (2, "Other / General"), (3, "Other / General"), (4, "A")}


def test_many_small_parts_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_FOLDERS", 30)
    df = spark.range(2000).select("id", F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("k"), "id").alias("full_name"), F.col("id").alias("stars"), F.concat(F.lit("Domain "), (F.col("id") % 3).cast("string")).alias("domain"))
    details = df.select("id", "domain", F.concat(F.lit("run "), "name").alias("quickstart_code"))
    path = f"{tmp_path}/details"
    files.write_details(details, path, 10)
    folders = [f"{s}/{f}" for s in os.listdir(path) if s.startswith("slug=") for f in os.listdir(f"{path}/{s}") if "=" in f]
    assert len(folders) == 3 * files.LOTS
    back = files.read_details(spark, path, "id LONG, domain STRING, quickstart_code STRING")
    assert set(back.columns) == {"id", "domain", "quickstart_code", "slug", "part"} and back.count() == 2000
    want = files.part_number(details, files.parts_by_slug(details, 10)).select("id", "slug", "part")
    assert want.exceptAll(back.select("id", "slug", "part")).isEmpty()
    assert {r.id for r in files.read_details_of(spark, path, "id LONG", "domain-1", 37).collect()} == {r.id for r in want.where("slug = 'domain-1' and part = 37").collect()} != set()
    stored = spark.read.schema("id LONG, quickstart_code STRING, slug STRING, part LONG").parquet(path)
    rows = files.part_bytes(spark.read.schema("id LONG, domain STRING, quickstart_code STRING, slug STRING, part LONG").parquet(path))
    assert rows.agg(F.sum("rows")).first()[0] == 2000 and rows.count() == want.select("slug", "part").distinct().count()
    found = merge.lookup_details(df, stored, spark.createDataFrame([("N4",), ("k15",), ("gone",)], "name string"), files.parts_by_slug(details, 10))
    assert "lot" not in found.columns and "dynamicpruning" in found._jdf.queryExecution().toString().lower()
    assert {r["wanted"]: r["quickstart_code"] for r in found.collect()} == {"N4": "run n4", "k15": "run n15"}


def test_record_files_grow_slower_than_runs_of_ids():
    assert queries_core.record_files(200) == 64 and queries_core.record_files(7_200_000) == 208


def test_patch_reads_its_views_once(spark, sf):
    plan = queries_tables.patch(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan

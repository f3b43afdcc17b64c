"""Gates that yield (check, failures, detail), pattern scans and range windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import array_or_empty, blank_to_null
from ..sources.catalog import part_number, parts_by_slug
from ..sources.shared import settled
from .facets import facet_counts
from .score import global_ordinal

SAFE_ID = (1 << 53) - 1


#: Offending keys that a check names.
LEAST = 5


def _failing(df: DataFrame, checks: dict[str, Column], key: Column, number: Column | None = None) -> DataFrame:
    """check, number, key for every check that a row fails: one pass over the table. Keys go by number, then as text."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    return df.select(F.explode(names).alias("check"), (F.lit(0) if number is None else number).cast("long").alias("number"), key.cast("string").alias("key"))


def _report(checks: list[str], failing: list[DataFrame], spark: SparkSession) -> DataFrame:
    """check, failures, detail: how many rows fail each check, and the least ``LEAST`` of their keys.

    The failing keys are written once; counts are summed per task, and each task hands on no more than the least keys of a
    check, so nothing that is held grows with the failures.
    """
    rows = settled(reduce(DataFrame.unionByName, failing), "failing")
    counts = rows.groupBy("check").agg(F.count("*").alias("failures"))
    nth = F.row_number().over(Window.partitionBy("check").orderBy(F.col("number").asc_nulls_last(), F.col("key").asc_nulls_last()))
    first = rows.withColumn("n", nth).where(F.col("n") <= LEAST).groupBy("check").agg(F.sort_array(F.collect_list(F.struct("n", F.coalesce("key", F.lit("null")).alias("key")))).alias("keys"))
    detail = F.array_join(F.transform("keys", lambda x: x["key"]), ", ")
    every = spark.createDataFrame([(c,) for c in checks], "check STRING")
    out = every.join(F.broadcast(counts), "check", "left").join(F.broadcast(first), "check", "left")  # a row for each check
    return out.select("check", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), F.coalesce(detail, F.lit("")).alias("detail"))


def _place(slug: str = "slug", part: str = "part") -> Column:
    return F.concat_ws("/", F.col(slug), F.col(part).cast("string"))


def verify(
    df: DataFrame, details: DataFrame, flat: DataFrame, min_stars: int = 500, min_rows: int = 1, target: int = 12_000,
    manifest: DataFrame | None = None, labels: dict[str, DataFrame] | None = None, max_part_bytes: int | None = None,
) -> DataFrame:
    """check, failures, detail for a catalog (id, owner, name, stars, hook, domain, domain_margin, ...), its details (id, slug, part) and flat index (id).

    ``manifest`` (slug, parts) is the stated fan-out: each slug must be that of a domain, its parts a power of two of 2 or
    more, and details are routed by it. ``labels`` has a table (code) for a column ``<name>_code`` of the catalog: a code
    that its table lacks dangles. Array columns must hold no null. Rows of the details are held against ``max_part_bytes``
    by part if they have a column ``bytes``. ``detail`` names the least keys that fail: ids, parts (slug/part) or slugs.
    The catalog is read once; ids of all three tables meet in one sum per id.
    """
    have, spark = set(df.columns), df.sparkSession
    checks = {
        "id_out_of_range": ~((F.col("id") > 0) & (F.col("id") < SAFE_ID)) | F.col("id").isNull(),
        "missing_owner_or_name": blank_to_null(F.col("owner")).isNull() | blank_to_null(F.col("name")).isNull(),
        "below_floor": F.coalesce("stars", F.lit(0)) < min_stars,
    }
    if "hook" in have:
        checks["hook_too_long"] = F.length("hook") > 90
    if "domain_margin" in have:
        checks["margin_out_of_range"] = ~F.col("domain_margin").between(0, 9) | F.col("domain_margin").isNull()
    for label in ("domain", "subsystem", "language", "artifact"):
        if label in have:
            checks[f"missing_{label}"] = blank_to_null(F.col(label)).isNull()
    for tail in ("topics", "compatibility"):
        if tail in have:
            checks[f"malformed_{tail}"] = F.col(tail).isNull() | F.exists(tail, lambda x: x.isNull())
    names = [*checks, "too_few_rows"]
    faults = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    # what every check needs of the catalog, written in its one pass
    df = settled(df.select("id", "domain", faults.alias("faults"), *[f"{c}_code" for c in labels or {}]), "verify")
    deep = settled(details.select("id", "slug", "part", *(["bytes"] if "bytes" in details.columns else [])), "verify-details")
    out = [df.select(F.explode("faults").alias("check"), F.col("id").alias("number"), F.col("id").cast("string").alias("key"))]
    few = df.agg(F.count("*").alias("n")).where(F.col("n") < min_rows)
    out.append(_failing(few, {"too_few_rows": F.lit(True)}, F.col("n")))
    sides = [t.select("id", F.lit(k).alias("side")) for k, t in (("c", df), ("f", flat), ("d", deep))]
    per = reduce(DataFrame.unionByName, sides).groupBy("id").agg(*[F.count_if(F.col("side") == k).alias(k) for k in "cfd"])
    c, f, d = (F.col(k) > 0 for k in "cfd")
    parity = {"duplicate_id": F.col("c") > 1, "flat_missing": c & ~f, "flat_stray": f & ~c, "details_missing": c & ~d, "details_stray": d & ~c}
    names += list(parity)
    out.append(_failing(per, parity, F.col("id"), F.col("id")))
    own = parts_by_slug(df, target)
    stated = own.select("slug", "parts") if manifest is None else manifest.select("slug", "parts")
    routed = part_number(df, stated).select("id", F.col("slug").alias("s"), F.col("part").alias("p"))
    misplaced = {"details_misplaced": (F.col("slug") != F.col("s")) | (F.col("part") != F.col("p"))}
    out.append(_failing(deep.join(routed, "id"), misplaced, F.col("id"), F.col("id")))
    size = F.sum("bytes") if "bytes" in deep.columns else F.lit(0)
    there = deep.groupBy("slug", "part").agg(size.alias("bytes")).withColumn("there", F.lit(True))
    meant = routed.groupBy(F.col("s").alias("slug"), F.col("p").alias("part")).agg(F.lit(True).alias("meant"))
    folders = {"part_missing": F.col("there").isNull(), "part_orphan": F.col("meant").isNull()}
    if max_part_bytes is not None:
        folders["part_too_large"] = F.col("bytes") > max_part_bytes
    names += ["details_misplaced", *folders]
    out.append(_failing(meant.join(there, ["slug", "part"], "full_outer"), folders, _place()))
    if manifest is not None:
        power = (F.col("stated") >= 2) & (F.col("stated").bitwiseAND(F.col("stated") - 1) == 0)
        both = own.withColumn("own", F.lit(True)).join(manifest.select("slug", F.col("parts").alias("stated"), F.lit(True).alias("told")), "slug", "full_outer")
        fan = {
            "fanout_malformed": F.col("told").isNotNull() & ~F.coalesce(power, F.lit(False)), "fanout_of_no_domain": F.col("own").isNull(),
            "fanout_differs": F.col("own").isNotNull() & (F.col("parts") != F.coalesce("stated", F.lit(1))),
        }
        names += list(fan)
        out.append(_failing(both, fan, F.col("slug")))
    for c, table in (labels or {}).items():
        code = F.col(f"{c}_code")
        lost = df.select("id", code.alias("code")).where("code is not null").join(table.select("code"), "code", "left_anti")
        names.append(f"{c}_dangling")
        out.append(_failing(lost, {f"{c}_dangling": F.lit(True)}, F.col("id"), F.col("id")))
    return _report(names, out, spark)


def verify_artifacts(
    df: DataFrame, postings: DataFrame, terms: DataFrame, edges: DataFrame, snapshot: DataFrame | None = None, k: int = 8, ord_col: str = "ord",
    facets: DataFrame | None = None, exported: DataFrame | None = None,
) -> DataFrame:
    """check, failures, detail for the catalog order, the index, the edges, the newest snapshot, facet counts and exported postings.

    ``facets`` (dimension, name, count) must equal a recount of single-valued columns and topics. ``exported`` (token,
    postings of (gap, code)) must have a row for each term, as many pairs as its df, and gaps that only go forward.
    ``detail`` names the least positions, tokens, links (src-dst), facets (dimension/name) or keys that fail.
    """
    out, names = [], []

    def add(rows: DataFrame, checks: dict[str, Column], key: Column, number: Column | None = None) -> None:
        names.extend(checks)
        out.append(_failing(rows, checks, key, number))

    n = df.agg(F.count("*").alias("n"))
    at = F.col(ord_col)
    after = df.select(ord_col, "stars").join(df.select((at - 1).alias("o"), F.col("stars").alias("next")), at == F.col("o"))
    add(after, {"order_not_by_stars": F.col("stars") < F.col("next")}, at, at)
    held = postings.groupBy("token").agg(F.count("*").alias("rows"))
    add(terms.join(held, "token", "full_outer"), {"index_df_differs": ~F.col("df").eqNullSafe(F.col("rows"))}, F.col("token"))
    if exported is not None:
        ragged = F.exists("postings", lambda x: x["gap"].isNull() | x["code"].isNull() | (x["gap"] < 0))
        pairs = exported.select("token", F.size("postings").alias("k"), ragged.alias("ragged"))
        pairs = pairs.groupBy("token").agg(F.sum("k").alias("pairs"), F.max("ragged").alias("ragged"))
        add(terms.join(pairs, "token", "full_outer"), {"postings_ragged": ~F.col("df").eqNullSafe(F.col("pairs")) | F.coalesce("ragged", F.lit(False))}, F.col("token"))
    link = F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string"))
    weight = F.col("weight")
    add(edges, {"edge_to_itself": F.col("src") == F.col("dst"), "edge_weight_out_of_range": ~F.coalesce((weight > 0) & (weight <= 1), F.lit(False))}, link, F.col("src"))
    add(edges.groupBy("src", "dst").agg(F.count("*").alias("c")), {"edge_twice": F.col("c") > 1}, link, F.col("src"))
    degree = df.select(at.alias("src")).join(edges.groupBy("src").agg(F.count("*").alias("d")), "src", "left").crossJoin(F.broadcast(n))  # n: one row
    add(degree, {"degree_differs": F.coalesce("d", F.lit(0)) != F.least(F.lit(k), F.col("n") - 1)}, F.col("src"), F.col("src"))
    if facets is not None:
        again = facet_counts(df, limits={}, ord_col=ord_col).where("dimension <> 'subsystem'").select("dimension", "name", F.col("count").alias("recount"))
        stated = facets.where("dimension <> 'subsystem'").select("dimension", "name", "count")
        # facets may be cut to the commonest names, so a name that they lack is no failure
        add(stated.join(again, ["dimension", "name"], "left"), {"facet_differs": ~F.col("count").eqNullSafe(F.col("recount"))}, F.concat_ws("/", "dimension", "name"))
    domains = {"activity_status": ("active", "idle", "archived"), "license_tier": ("permissive", "copyleft", "source-available", "unknown")}
    known = {f"{c}_unknown": F.col(c).isNotNull() & ~F.col(c).isin(*values) for c, values in domains.items() if c in df.columns}
    if known:
        add(df, known, at, at)
    if snapshot is not None:
        both = df.select(F.lower("full_name").alias("k"), "stars").join(snapshot.select(F.lower("full_name").alias("k"), F.col("stars").alias("s")), "k", "full_outer")
        add(both, {"snapshot_differs": ~F.col("stars").eqNullSafe(F.col("s"))}, F.col("k"))
    return _report(names, out, df.sparkSession)


def verify_topics(companions: DataFrame, min_count: int = 25, min_pair: int = 10, top: int = 10) -> DataFrame:
    """check, failures, detail for a co-occurrence map (topic, count, other, pair_count, rank) as ``graph.cooccurrence`` makes it.

    A link leads to a topic of the map, counts no more rows than the rarer of its topics, keeps the floors, ranks by falling
    count and is there from both sides, unless the other side's ``top`` links are all as strong or stronger.
    """
    topics = companions.groupBy("topic").agg(F.max("count").alias("count"), F.count_if(F.col("other").isNotNull()).alias("links"), F.min("pair_count").alias("weakest"))
    links = companions.where("other is not null").select("topic", "count", "other", "pair_count", "rank")
    name = F.concat_ws(">", "topic", "other")
    to = topics.select(F.col("topic").alias("other"), F.col("count").alias("other_count"), F.col("links").alias("other_links"), F.col("weakest").alias("other_weakest"))
    back = links.select(F.col("topic").alias("other"), F.col("other").alias("topic"), F.col("pair_count").alias("back"))
    both = links.join(to, "other", "left").join(back, ["topic", "other"], "left")
    cut = (F.col("other_links") >= top) & (F.col("other_weakest") >= F.col("pair_count"))
    checks = {
        "topic_link_to_nothing": F.col("other_count").isNull(), "topic_link_above_topic": F.col("pair_count") > F.least("count", "other_count"), "topic_link_below_floor": F.col("pair_count") < min_pair,
        "topic_link_one_sided": F.col("other_count").isNotNull() & F.col("back").isNull() & ~cut, "topic_link_differs": F.col("back") != F.col("pair_count"),
    }
    each = {"topic_below_floor": F.col("count") < min_count, "topic_links_too_many": F.col("links") > top}
    after = links.select("topic", "other", "pair_count", "rank").join(links.select("topic", (F.col("rank") - 1).alias("rank"), F.col("pair_count").alias("next")), ["topic", "rank"])
    order = {"topic_links_out_of_order": F.col("pair_count") < F.col("next")}
    return _report([*checks, *each, *order], [_failing(both, checks, name), _failing(topics, each, F.col("topic")), _failing(after, order, name)], companions.sparkSession)


def verify_blueprints(blueprints: DataFrame, roles: DataFrame, links: DataFrame, df: DataFrame, categories: tuple[str, ...], min_per_goal: int = 2) -> DataFrame:
    """check, failures, detail for the references of a blueprint library into a catalog (key, subsystem).

    blueprints: (blueprint_id, goal); roles: (blueprint_id, role, category, subsystem, seeds ARRAY); links: (blueprint_id, src, dst) between
    role labels. Every seed, required subsystem and category exists (keys in lower case), every goal has ``min_per_goal``
    blueprints or more, no id and no label inside a blueprint comes twice, and links join labels of their blueprint.
    Seeds are looked up by an equi-join of the exploded arrays, so libraries and catalogs of any size can be held together.
    """
    role = F.concat_ws("/", "blueprint_id", "role")
    seeds = roles.select("blueprint_id", "role", F.explode("seeds").alias("seed")).withColumn("key", F.lower("seed")).join(df.select("key").distinct(), "key", "left_anti")
    wanted = roles.where(blank_to_null(F.col("subsystem")).isNotNull()).join(df.select("subsystem").distinct(), "subsystem", "left_anti")
    labels = roles.select("blueprint_id", F.col("role").alias("label")).distinct()
    lost = links.withColumn("label", F.explode(F.array("src", "dst"))).join(labels, ["blueprint_id", "label"], "left_anti")
    always = F.lit(True)
    parts = [
        (seeds, {"seed_missing": always}, F.concat_ws("/", "blueprint_id", "role", "seed")),
        (wanted, {"subsystem_unknown": always}, role),
        (roles, {"category_unknown": ~F.coalesce(F.col("category").isin(*categories), F.lit(False))}, role),
        (lost, {"link_to_no_role": always}, F.concat_ws("/", "blueprint_id", "label")),
        (blueprints.groupBy("goal").agg(F.countDistinct("blueprint_id").alias("n")), {"goal_too_few": F.col("n") < min_per_goal}, F.col("goal")),
        (blueprints.groupBy("blueprint_id").agg(F.count("*").alias("n")), {"blueprint_twice": F.col("n") > 1}, F.col("blueprint_id")),
        (roles.groupBy("blueprint_id", "role").agg(F.count("*").alias("n")), {"role_twice": F.col("n") > 1}, role),
    ]
    return _report([c for _, checks, _ in parts for c in checks], [_failing(*p) for p in parts], df.sparkSession)


def churn_check(report: DataFrame, max_churn_pct: float = 20.0) -> DataFrame:
    """check, failures, detail: the changed rows of a churn report if their share is above the limit, else 0."""
    pct = F.coalesce("pct", F.lit(0.0))
    over = pct > max_churn_pct
    return report.where("section = 'changed'").select(
        F.lit("churn").alias("check"), F.when(over, F.col("n")).otherwise(0).cast("long").alias("failures"),
        F.when(over, F.format_string("%.2f %% of %s labels changed; the limit is %.2f %%", pct, F.col("name"), F.lit(float(max_churn_pct)))).otherwise("").alias("detail"),
    )


def coverage_check(df: DataFrame, min_topics_pct: float = 0.0, min_stars: int = 0) -> DataFrame:
    """check, failures, detail: the rows without topics if too few rows have any, else 0."""
    under = F.col("pct") < min_topics_pct
    return coverage(df, min_stars).select(
        F.lit("topic_coverage").alias("check"), F.when(under, F.col("rows") - F.col("with_topics")).otherwise(0).cast("long").alias("failures"),
        F.when(under, F.format_string("%.2f %% of rows have topics; the least is %.2f %%", F.col("pct"), F.lit(float(min_topics_pct)))).otherwise("").alias("detail"),
    )


def gate(report: DataFrame, max_churn_pct: float = 20.0, allow: bool = False) -> None:
    """Raise if a churn report's share of changed rows is above the limit."""
    pct = report.where("section = 'changed'").agg(F.max("pct")).first()[0] or 0.0
    if pct > max_churn_pct and not allow:
        raise ValueError(f"{pct} % of labels changed; the limit is {max_churn_pct} %")


def coverage(df: DataFrame, min_stars: int = 0) -> DataFrame:
    """One row: rows of the star floor, those with topics, and their per cent (0 without rows)."""
    there = df.where(F.coalesce("stars", F.lit(0)) >= min_stars) if min_stars else df
    tagged = F.count_if(F.size(array_or_empty(F.col("topics"))) > 0)
    return there.agg(F.count("*").alias("rows"), tagged.alias("with_topics"), (100.0 * tagged / F.greatest(F.count("*"), F.lit(1))).alias("pct"))


def coverage_gate(df: DataFrame, min_topics_pct: float = 0.0, min_stars: int = 0) -> None:
    """Raise if too few rows have topics."""
    pct = coverage(df, min_stars).first().pct
    if pct < min_topics_pct:
        raise ValueError(f"{pct:.2f} % of rows have topics; the least is {min_topics_pct} %")


def pattern_scan(df: DataFrame, id_col: str, text_col: str, rules: dict[str, str], snippet: int = 120) -> DataFrame:
    """id, line (from 1), rule, snippet of each line that matches; the first rule counts."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("at", "text"))
    rule = None
    for name, pattern in rules.items():
        rule = (F if rule is None else rule).when(F.col("text").rlike(pattern), name)
    return lines.withColumn("rule", rule).where("rule is not null").select("id", (F.col("at") + 1).alias("line"), "rule", F.substring(F.trim("text"), 1, snippet).alias("snippet"))


def _halves(v: Column, lo: int, hi: int) -> Column:
    """The ranges that hold a value as lo to hi is halved down to it: an array of (lo, hi), the largest first."""
    whole = F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))

    def half(path: Column, _: Column) -> Column:
        last = F.element_at(path, -1)
        mid = F.floor((last["lo"] + last["hi"]) / 2).cast("long")
        upper = v > mid
        inner = F.struct(F.when(upper, mid + 1).otherwise(last["lo"]).alias("lo"), F.when(upper, last["hi"]).otherwise(mid).alias("hi"))
        return F.when(last["lo"] < last["hi"], F.concat(path, F.array(inner))).otherwise(path)

    return F.aggregate(F.sequence(F.lit(0), F.lit(max(1, hi - lo).bit_length())), F.array(whole), half)


def _nodes(counts: DataFrame, lo: int, hi: int) -> DataFrame:
    """v, level, lo, hi, n: every value with each range that holds it."""
    path = counts.select("v", "n", F.posexplode(_halves(F.col("v"), lo, hi)).alias("level", "at"))
    return path.select("v", "level", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"), "n")


def _edge(rows: Column) -> Column:
    """Where a value of too many rows is cut on the second column."""
    return F.greatest(F.lit(1000), F.floor(rows / 900) * 2).cast("long")


def _upper(second: Column, edge: Column) -> Column:
    """Whether a row lies above the edge; a row without a second value lies below."""
    return F.coalesce(second > edge, F.lit(False))


def _cut(values: DataFrame, lo: int, hi: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """The ranges (level, lo, hi, rows) of all values ``v`` with ``n`` rows each that are no longer halved, and the values' paths to them."""
    path = _nodes(values, lo, hi)
    nodes = settled(path.groupBy("level", "lo", "hi").agg(F.sum("n").alias("rows")), "windows")
    # halves of ranges that don't fit; the first range is half of nothing
    split = nodes.where((F.col("rows") > cap) & (F.col("lo") < F.col("hi")))
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
    halves = split.select((F.col("level") + 1).alias("level"), F.explode(F.array(F.struct("lo", mid.alias("hi")), F.struct((mid + 1).alias("lo"), "hi"))).alias("h"))
    halves = halves.select("level", "h.lo", "h.hi")
    ends = nodes.where("level = 0").unionByName(nodes.join(halves, ["level", "lo", "hi"]).select(*nodes.columns))
    return ends.where((F.col("rows") <= cap) | (F.col("lo") == F.col("hi"))), path


def plan_windows(df: DataFrame, col: str, second_col: str, lo: int, hi: int, cap: int = 1000) -> DataFrame:
    """lo, hi, second_lo, second_hi, rows, truncated: ranges of two columns that hold at most ``cap`` rows each.

    The midpoints are fixed by lo and hi, so every value knows the ranges that would hold it. Their rows are summed per
    range, with sums per task before the one shuffle, so the range of all values is one row per task. A range is a window
    if it fits and the one that it is half of doesn't; a single value that doesn't fit is halved once on the second column.
    """
    counts = df.where(F.col(col).between(lo, hi)).groupBy(F.col(col).cast("long").alias("v")).agg(F.count("*").alias("n"))
    ends, _ = _cut(counts, lo, hi, cap)
    no = F.lit(None).cast("long")
    fits = ends.where(F.col("rows") <= cap).select("lo", "hi", no.alias("second_lo"), no.alias("second_hi"), "rows", F.lit(False).alias("truncated"))
    # a single value that is still too large: once on the second column
    atoms = ends.where(F.col("rows") > cap).select(F.col("lo").alias("v"), _edge(F.col("rows")).alias("edge"))
    second = df.select(F.col(col).cast("long").alias("v"), F.col(second_col).cast("long").alias("w")).join(atoms, "v")
    second = second.groupBy("v", "edge", _upper(F.col("w"), F.col("edge")).alias("upper")).agg(F.count("*").alias("rows"))
    cut = second.select(
        F.col("v").alias("lo"), F.col("v").alias("hi"), F.when(F.col("upper"), F.col("edge") + 1).otherwise(F.lit(0)).cast("long").alias("second_lo"),
        F.when(~F.col("upper"), F.col("edge")).cast("long").alias("second_hi"), "rows", (F.col("rows") > cap).alias("truncated"),
    )
    return fits.unionByName(cut)


def numbered_windows(windows: DataFrame) -> DataFrame:
    """The windows with ``window``, their number from 0 by falling lo and, of one value, falling second_lo."""
    return global_ordinal(windows, F.col("lo").desc(), F.col("second_lo").desc(), name="window")


def by_window(df: DataFrame, col: str, second_col: str, lo: int, hi: int, cap: int = 1000, windows: DataFrame | None = None) -> DataFrame:
    """The rows with ``window``, the number of the window that holds them (null outside lo to hi), dealt out by window.

    ``windows`` are those of ``numbered_windows`` for the same table and limits; they are planned here where none are given. A
    range join as an equality: each distinct value knows the ranges that hold it and meets its window by lo and hi, then the
    rows meet their value; a value that was cut on the second column has two windows, told apart by the side of the edge.
    All rows of a window lie in one partition, at most ``cap`` but for truncated windows; rows outside are spread.
    """
    values = df.where(F.col(col).between(lo, hi)).groupBy(F.col(col).cast("long").alias("v")).agg(F.count("*").alias("n"))
    if windows is None:
        windows = numbered_windows(plan_windows(df, col, second_col, lo, hi, cap))
    windows = settled(windows.select("window", "lo", "hi", "second_lo", "second_hi"), "numbered")
    whole = windows.where("second_lo is null and second_hi is null").select("lo", "hi", "window")
    of_value = _nodes(values, lo, hi).select("v", "lo", "hi").join(whole, ["lo", "hi"]).select(F.col("v").alias("__v"), F.col("window").alias("__whole"))
    sides = windows.where("second_lo is not null").groupBy(F.col("lo").alias("__v")).agg(
        F.max(F.when(F.col("second_lo") == 0, F.col("window"))).alias("__lower"), F.max(F.when(F.col("second_lo") > 0, F.col("window"))).alias("__upper"),
        F.max(F.coalesce(F.col("second_hi"), F.col("second_lo") - 1)).alias("__edge"),
    )
    found = of_value.join(sides, "__v", "full_outer")
    out = df.join(found, F.col(col).cast("long") == F.col("__v"), "left")
    side = F.when(_upper(F.col(second_col).cast("long"), F.col("__edge")), F.col("__upper")).otherwise(F.col("__lower"))
    out = out.withColumn("window", F.coalesce("__whole", side)).drop("__v", "__whole", "__lower", "__upper", "__edge")
    return out.repartition("window", F.when(F.col("window").isNull(), F.pmod(F.hash(*df.columns), F.lit(1024))))

"""Pair and pool synergy, slot candidates, role buckets and blueprint completion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import COMPATIBILITY, PROTOCOL_CLIENTS
from ..functions.scalars import pick_index, text_seed
from ..functions.text import array_or_empty, lexicon_tags, search_corpus
from .score import global_ordinal, ranked_within

#: Points of a pair.
BASE, SAME, SIBLING, FFI, APART, PRIMITIVE, PROTOCOL, PROTOCOL_CAP, ASYMMETRY = 50, 18, 15, 12, -5, 18, 10, 20, -15
NATIVE = ("rust", "c++", "c")


def _ffi(a: Column, b: Column) -> Column:
    return ((a == "python") & b.isin(*NATIVE)) | ((b == "python") & a.isin(*NATIVE))


def protocol_labels(df: DataFrame) -> Column:
    """The row's compatibility labels, else those found in name, owner and hook."""
    text = search_corpus(*[F.coalesce(F.col(c), F.lit("")) for c in ("name", "owner", "hook", "description") if c in df.columns][:3])
    found = lexicon_tags(text, COMPATIBILITY)
    return F.when(F.size(array_or_empty(F.col("compatibility"))) > 0, F.col("compatibility")).otherwise(found) if "compatibility" in df.columns else found


def _clients(labels: Column, others: Column, corpus: Column) -> Column:
    """Labels that the other side has not, but whose clients its corpus names."""
    hits = [F.when(F.array_contains(labels, k) & ~F.array_contains(others, k) & corpus.rlike(f"(?i){p}"), F.lit(k)) for k, p in PROTOCOL_CLIENTS.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def pair_synergy(pairs: DataFrame) -> DataFrame:
    """Score and status of each row with structs a and b of (language, license, primitives, labels, corpus)."""
    la, lb = (F.lower(F.coalesce(F.col(f"{s}.language"), F.lit("Other"))) for s in "ab")
    sibling = [("typescript", "javascript"), ("javascript", "typescript"), ("c++", "c"), ("c", "c++")]
    near = F.lit(False)
    for x, y in sibling:
        near = near | ((la == x) & (lb == y))
    runtime = F.when((la == lb) & (la != "other"), SAME).when(near, SIBLING).when(_ffi(la, lb), FFI).otherwise(APART)
    shared = F.when(F.size(F.array_intersect(array_or_empty(F.col("a.primitives")), array_or_empty(F.col("b.primitives")))) > 0, PRIMITIVE).otherwise(0)
    left = [F.lower(F.coalesce(F.col(f"{s}.license"), F.lit("Open Source"))) for s in "ab"]
    copyleft = [F.contains(x, F.lit("gpl")) & ~F.contains(x, F.lit("lgpl")) for x in left]
    license_ = F.when(copyleft[0] != copyleft[1], ASYMMETRY).otherwise(0)
    xa, xb = array_or_empty(F.col("a.labels")), array_or_empty(F.col("b.labels"))
    spoken = F.array_distinct(F.concat(F.array_intersect(xa, xb), _clients(xa, xb, F.coalesce(F.col("b.corpus"), F.lit(""))), _clients(xb, xa, F.coalesce(F.col("a.corpus"), F.lit("")))))
    protocol = F.least(F.size(spoken) * PROTOCOL, F.lit(PROTOCOL_CAP))
    score = F.greatest(F.lit(10), F.least(F.lit(100), F.lit(BASE) + runtime + shared + license_ + protocol))
    out = pairs.withColumn("score", score.cast("int")).withColumn("shared_protocols", F.size(spoken))
    return out.withColumn("status", F.when(F.col("score") >= 75, "High Synergy").when(F.col("score") >= 50, "Compatible").otherwise("Friction Warning"))


def pool_pairs(pools: DataFrame, df: DataFrame) -> DataFrame:
    """pool, x, y, a, b: each pair of members of a pool once, in the order of their ids."""
    side = df.select(
        "id", F.struct("language", "license", (F.col("primitives") if "primitives" in df.columns else F.array().cast("array<string>")).alias("primitives"),
                       protocol_labels(df).alias("labels"), search_corpus(*[F.coalesce(F.col(c), F.lit("")) for c in ("name", "owner", "hook", "description") if c in df.columns][:3]).alias("corpus")).alias("r")
    )
    members = pools.join(side, "id")
    a = members.select("pool", F.col("id").alias("x"), F.col("r").alias("a"))
    return a.join(members.select("pool", F.col("id").alias("y"), F.col("r").alias("b")), "pool").where("x < y")


def pool_synergy(pair_scores: DataFrame, pools: DataFrame | None = None) -> DataFrame:
    """pool, score, grade: the mean of the pairs, rounded half up, within 15 to 98; 50 for a pool without pairs."""
    mean = pair_scores.groupBy("pool").agg(F.greatest(F.lit(15), F.least(F.lit(98), F.floor(F.avg("score") + 0.5))).cast("int").alias("score"))
    if pools is not None:
        mean = pools.select("pool").distinct().join(mean, "pool", "left")
    s = F.col("score")
    grade = F.when(s.isNull(), "Awaiting Second Component").when(s >= 80, "High Architectural Synergy").when(s >= 60, "Production Viable (Standard IPC)").when(s >= 40, "Architectural Friction Detected").otherwise("High Coupling / License Conflict")
    return mean.withColumn("grade", grade).withColumn("score", F.coalesce("score", F.lit(50)))


#: Slots and picks that are broadcast, as one plan has; larger tables are shuffled.
MOST_PICKS = 1000


def slot_candidates(df: DataFrame, slots: DataFrame, picks: DataFrame, k: int = 45, query: str = "") -> DataFrame:
    """slot, id, score, rank: the best ``k`` rows for each slot (slot, domain or null, subsystem or null).

    ``picks`` (slot, id) are the choices upstream of a slot. A slot with picks ranks by harmony with them plus twice
    log10 of the stars; one without takes its subsystem's rows first, then catalog order. Slots of a domain meet its rows
    by an equality; up to ``MOST_PICKS`` slots and picks, as a plan has, are broadcast.
    """
    small = slots.limit(MOST_PICKS + 1).count() <= MOST_PICKS and picks.limit(MOST_PICKS + 1).count() <= MOST_PICKS
    if query:
        q = query.strip().lower()
        df = df.where(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("owner"), F.lit(q)))
    chosen = picks.join(df.select("id", F.lower("language").alias("up_language"), array_or_empty(F.col("primitives")).alias("up_primitives")), "id").drop("id")
    chosen = chosen.groupBy("slot").agg(F.collect_list(F.struct("up_language", "up_primitives")).alias("ups"))
    plan = slots.select("slot", F.col("domain").alias("want_domain"), F.col("subsystem").alias("want_subsystem")).join(chosen, "slot", "left")
    plan = F.broadcast(plan) if small else plan
    # a slot without a domain takes all rows, so those slots are joined to each of the domains there are
    domains = df.select(F.col("domain").alias("__domain")).distinct()
    every = plan.where("want_domain is null").join(domains, F.lit(True))
    plan = plan.where("want_domain is not null").withColumn("__domain", F.col("want_domain")).unionByName(every)
    base = df.join(F.broadcast(plan) if small else plan, F.col("domain").eqNullSafe(F.col("__domain"))).drop("__domain")
    lang = F.lower(F.coalesce("language", F.lit("")))

    def points(total: Column, up: Column) -> Column:
        runtime = F.when((up["up_language"] == lang) & (lang != "other"), 30).when(_ffi(up["up_language"], lang), 20).otherwise(0)
        return total + runtime + F.when(F.size(F.array_intersect(array_or_empty(F.col("primitives")), up["up_primitives"])) > 0, 25).otherwise(0)

    guided = F.col("ups").isNotNull()
    score = F.when(guided, F.aggregate(F.coalesce("ups", F.array()), F.lit(0), points) + 2 * F.log10(F.col("stars")))
    match = F.coalesce(F.col("subsystem") == F.col("want_subsystem"), F.lit(False))
    order = [F.bround(F.coalesce(F.col("score"), F.lit(0.0)), 9).desc(), F.col("match").desc(), F.col("stars").desc(), F.col("full_name")]
    out = base.select("slot", "id", "full_name", "stars", score.alias("score"), match.alias("match"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(*order))).where(F.col("rank") <= k)


def role_categories(df: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """One row per row and category whose condition holds; a row may be in several."""
    hits = F.array(*[F.when(cond, F.lit(name)) for name, cond in categories.items()])
    return df.select("*", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("category"))


def choose_blueprints(blueprints: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (request, seed, goal): the blueprint at the first draw among those of the goal, or of all.

    ``blueprints`` (blueprint_id, goal, pos) are numbered within their goal and among all by range partitions, so a library
    of any size, and a goal that most of it shares, will do; a request then meets its blueprint by goal and number.
    """
    library = blueprints.select("blueprint_id", "goal", "pos")
    every = global_ordinal(library, F.col("pos"), F.col("blueprint_id"), name="k").select("k", "blueprint_id")
    own = ranked_within(library, "goal", F.col("pos"), F.col("blueprint_id"), name="nth").select("goal", (F.col("nth") - 1).alias("k"), "blueprint_id")
    sizes = library.groupBy("goal").agg(F.count("*").alias("n"))
    total = library.agg(F.count("*").alias("total"))  # one row
    r = requests.join(sizes, "goal", "left").crossJoin(F.broadcast(total))
    r = r.withColumn("k", pick_index(text_seed(F.col("seed")), F.lit(0), F.coalesce("n", "total")).cast("long"))
    of_goal = r.where("n is not null").join(own, ["goal", "k"])
    of_all = r.where("n is null").join(every, "k", "left")
    return of_goal.select("request", "seed", "goal", "blueprint_id").unionByName(of_all.select("request", "seed", "goal", "blueprint_id"))


def _first_three(rows: DataFrame, *by: str) -> DataFrame:
    """The three rows with most stars of each group; each task hands on no more than three of a group."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("stars").desc(), "name", "id"))
    return rows.withColumn("n", nth).where("n <= 3").drop("n")


def complete_blueprints(df: DataFrame, roles: DataFrame, chosen: DataFrame) -> DataFrame:
    """request, blueprint_id, pos, role, via, id: a row for each role of the chosen blueprints; id is null if unfilled.

    roles: (blueprint_id, pos, role, category, subsystem, seeds). Seeds in the catalog come before rows of the category
    with the required subsystem, those before the rest of the category. One of the three with most stars is drawn; only
    filled roles use a draw, the first draw having chosen the blueprint. ``df`` has id, key, name, stars, subsystem, category.
    The first three of each category, and of each subsystem in it, are found once for all roles.
    """
    rows = df.select("id", "key", "name", "stars", "subsystem", "category")
    seeds = roles.select("blueprint_id", "pos", F.explode("seeds").alias("key")).withColumn("key", F.lower("key"))
    by_seed = seeds.join(rows.dropDuplicates(["id"]).drop("subsystem", "category"), "key").select("blueprint_id", "pos", "id", "name", "stars", F.lit(1).alias("tier"))
    asked = roles.select("blueprint_id", "pos", "category", F.col("subsystem").alias("want"))
    same = asked.where("want is not null").join(_first_three(rows, "category", "subsystem").withColumnRenamed("subsystem", "want"), ["category", "want"])
    # a row of the wanted subsystem is here a second time, but then the tier before has it
    rest = asked.join(_first_three(rows, "category").drop("subsystem"), "category")
    found = reduce(DataFrame.unionByName, [by_seed, *[t.select("blueprint_id", "pos", "id", "name", "stars", F.lit(k).alias("tier")) for k, t in ((2, same), (3, rest))]])
    best = F.min("tier").over(Window.partitionBy("blueprint_id", "pos"))
    nth = F.row_number().over(Window.partitionBy("blueprint_id", "pos").orderBy("tier", F.col("stars").desc(), "name", "id"))
    top = found.withColumns({"best": best, "n": nth}).where("n <= 3 and tier = best")
    top = top.groupBy("blueprint_id", "pos").agg(F.min("tier").alias("tier"), F.sort_array(F.collect_list(F.struct("n", "id"))).alias("c"))
    every = chosen.join(roles.select("blueprint_id", "pos", "role"), "blueprint_id").join(top, ["blueprint_id", "pos"], "left")
    turn = F.count("c").over(Window.partitionBy("request").orderBy("pos"))
    at = pick_index(text_seed(F.col("seed")), turn, F.size("c"))
    via = F.when(F.col("c").isNull(), "missing").when(F.col("tier") == 1, "seed").when(F.col("tier") == 2, "subsystem").otherwise("category")
    return every.select("request", "blueprint_id", "pos", "role", via.alias("via"), F.get("c", at)["id"].alias("id"))

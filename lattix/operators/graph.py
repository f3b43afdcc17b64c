"""Nearest-neighbour edges, co-occurrence maps, samples and hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import array_or_empty
from ..sources.shared import settled

#: Weights of the evidence groups.
GROUPS = {"topics": 3.0, "primitives": 2.0, "compatibility": 1.0, "subsystem": 1.5, "language": 1.0, "artifact": 1.0}
FALLBACK = 0.1


def _general(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).startswith("General")


def evidence(df: DataFrame, ord_col: str = "ord") -> DataFrame:
    """ord and its evidence columns; those that the table lacks are empty."""
    have = set(df.columns)
    out = [F.col(ord_col).alias("ord")]
    for g in ("topics", "primitives", "compatibility"):
        out.append((F.array_distinct(array_or_empty(F.col(g))) if g in have else F.array().cast("array<string>")).alias(g))
    for g in ("subsystem", "language", "artifact"):
        out.append((F.coalesce(F.col(g), F.lit("")) if g in have else F.lit("")).alias(g))
    return df.select(*out)


def features(ev: DataFrame) -> DataFrame:
    """ord, feature: values by which candidates are found."""

    def marked(group: str) -> Column:
        return F.transform(F.col(group), lambda x: F.concat(F.lit(f"{group[0]}:"), x))

    lists = [marked(g) for g in ("topics", "primitives", "compatibility")]
    single = F.array(
        F.when((F.col("subsystem") != "") & ~_general(F.col("subsystem")), F.concat(F.lit("s:"), "subsystem")),
        F.when(~F.col("language").isin("", "Other"), F.concat(F.lit("l:"), "language")),
        F.when(F.col("artifact") != "", F.concat(F.lit("a:"), "artifact")),
    )
    return ev.select("ord", F.explode(F.filter(F.concat(*lists, single), lambda x: x.isNotNull())).alias("feature"))


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard of two evidence structs; null without common ground to compare."""
    num, den = F.lit(0.0), F.lit(0.0)
    for g in ("topics", "primitives", "compatibility"):
        x, y = F.col(f"{a}.{g}"), F.col(f"{b}.{g}")
        both = F.size(F.array_intersect(x, y))
        num, den = num + GROUPS[g] * both, den + GROUPS[g] * (F.size(x) + F.size(y) - both)
    for g in ("subsystem", "language", "artifact"):
        x, y = F.col(f"{a}.{g}"), F.col(f"{b}.{g}")
        there = (x != "") & (y != "")
        if g == "subsystem":
            there = there & ~_general(x) & ~_general(y)
        same = (x == y).cast("int")
        num, den = num + F.when(there, GROUPS[g] * same).otherwise(0.0), den + F.when(there, GROUPS[g] * (2 - same)).otherwise(0.0)
    return F.when(den > 0, num / den)


def knn_edges(df: DataFrame, k: int = 8, max_df: int = 1500, cand_cap: int = 64, min_score: float = 0.05, ord_col: str = "ord") -> DataFrame:
    """src, dst, weight, rank, is_fallback = false.

    Values in more than ``max_df`` rows make no candidates, which bounds the self-join; a row keeps the ``cand_cap``
    candidates with most values in common, is scored on all its evidence, keeps the best ``k`` and drops those below ``min_score``.
    """
    ev = evidence(df, ord_col)
    tall = features(ev)
    rare = tall.groupBy("feature").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= max_df))
    tall = tall.join(rare, "feature", "left_semi")
    pairs = tall.select("feature", F.col("ord").alias("src")).join(tall.select("feature", F.col("ord").alias("dst")), "feature").where("src <> dst")
    shared = pairs.groupBy("src", "dst").agg(F.count("*").alias("shared"))
    nth = F.row_number().over(Window.partitionBy("src").orderBy(F.col("shared").desc(), "dst"))
    top = shared.withColumn("n", nth).where(F.col("n") <= cand_cap).select("src", "dst")
    packed = ev.select("ord", F.struct("topics", "primitives", "compatibility", "subsystem", "language", "artifact").alias("e"))
    scored = top.join(packed.select(F.col("ord").alias("src"), F.col("e").alias("a")), "src").join(packed.select(F.col("ord").alias("dst"), F.col("e").alias("b")), "dst")
    scored = scored.select("src", "dst", similarity("a", "b").alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.col("score").desc(), "dst"))
    best = scored.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("score") >= min_score))
    return best.select("src", "dst", F.bround("score", 2).alias("weight"), "rank", F.lit(False).alias("is_fallback"))


def window_fill(edges: DataFrame, df: DataFrame, k: int = 8, width: int = 8, weight: float = FALLBACK, ord_col: str = "ord") -> DataFrame:
    """Edges, and for rows with fewer than ``k`` the nearest positions in ascending order."""
    nodes = df.select(F.col(ord_col).alias("src"))
    degree = nodes.join(edges.groupBy("src").agg(F.count("*").alias("degree")), "src", "left").na.fill(0, ["degree"]).where(F.col("degree") < k)
    near = degree.select("src", "degree", F.explode(F.sequence(F.lit(-width), F.lit(width))).alias("step")).where("step <> 0")
    near = near.withColumn("dst", F.col("src") + F.col("step")).join(nodes.select(F.col("src").alias("dst")), "dst", "left_semi")
    near = near.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    rank = F.col("degree") + F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    added = near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return edges.unionByName(added.select("src", "dst", F.lit(weight).alias("weight"), "rank", F.lit(True).alias("is_fallback")))


def edge_report(edges: DataFrame, df: DataFrame, ord_col: str = "ord") -> DataFrame:
    """One row: edges, fallback share, least degree, rows without evidence, the commonest subsystem of targets and its share."""
    ev = evidence(df, ord_col)
    general = (F.col("subsystem") != "") & ~_general(F.col("subsystem"))
    blank = (F.size("topics") + F.size("primitives") + F.size("compatibility") == 0) & ~general & (F.col("language") == "") & (F.col("artifact") == "")
    rows = ev.agg(F.count("*").alias("n"), F.count_if(blank).alias("rows_no_evidence"))
    total = edges.agg(F.count("*").alias("total_edges"), F.count_if("is_fallback").alias("fallback_edges"))
    degree = ev.select(F.col("ord").alias("src")).join(edges.groupBy("src").agg(F.count("*").alias("d")), "src", "left").agg(F.min(F.coalesce("d", F.lit(0))).alias("min_degree"))
    label = F.when(F.col("subsystem") == "", "General Components").otherwise(F.col("subsystem")).alias("top_subsystem")
    target = edges.join(ev.select(F.col("ord").alias("dst"), label), "dst").groupBy("top_subsystem").agg(F.count("*").alias("top_edges"))
    target = target.orderBy(F.col("top_edges").desc(), "top_subsystem").limit(1)
    out = rows.crossJoin(total).crossJoin(degree).join(target, F.lit(True), "left")  # one row each
    share = lambda c: F.bround(100.0 * F.col(c) / F.greatest(F.lit(1), F.col("total_edges")), 2)
    return out.withColumns({"fallback_pct": share("fallback_edges"), "top_pct": share("top_edges")})


def cooccurrence(tags: DataFrame, id_col: str = "id", tag_col: str = "topic", min_count: int = 25, min_pair: int = 10, top: int = 10) -> DataFrame:
    """topic, count, other, pair_count, rank: each common tag's strongest companions (null for one without)."""
    tags = tags.select(F.col(id_col).alias("id"), F.col(tag_col).alias("topic")).distinct()
    kept = tags.groupBy("topic").agg(F.count("*").alias("count")).where(F.col("count") >= min_count)
    common = tags.join(kept.select("topic"), "topic", "left_semi")
    pairs = common.select("id", F.col("topic").alias("a")).join(common.select("id", F.col("topic").alias("b")), "id").where("a <> b")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("pair_count")).where(F.col("pair_count") >= min_pair)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("pair_count").desc(), "b"))
    edges = pairs.withColumn("rank", rank).where(F.col("rank") <= top)
    return kept.join(edges, kept["topic"] == edges["a"], "left").select("topic", "count", F.col("b").alias("other"), "pair_count", "rank")


def pairs_considered(tags: DataFrame, id_col: str = "id", tag_col: str = "topic") -> DataFrame:
    tags = tags.select(F.col(id_col).alias("id"), F.col(tag_col).alias("t")).distinct()
    return tags.select("id", F.col("t").alias("a")).join(tags.select("id", F.col("t").alias("b")), "id").where("a < b").select("a", "b").distinct().agg(F.count("*").alias("pairs"))


def reason(a: str, b: str, weight: Column | None = None) -> Column:
    """Why two evidence structs are alike; the first kind of common evidence counts."""

    def first(g: str) -> Column:
        return F.get(F.array_intersect(F.col(f"{a}.{g}"), F.col(f"{b}.{g}")), F.lit(0))

    def same(g: str) -> Column:
        return (F.col(f"{a}.{g}") == F.col(f"{b}.{g}")) & (F.col(f"{a}.{g}") != "")

    def say(text: str, c: Column) -> Column:
        return F.concat(F.lit(f"{text} ("), c, F.lit(")"))

    out = (
        F.when(same("subsystem") & ~_general(F.col(f"{a}.subsystem")), say("Shared Subsystem", F.col(f"{a}.subsystem")))
        .when(first("primitives").isNotNull(), say("Shared Primitive", first("primitives")))
        .when(first("compatibility").isNotNull(), say("Shared Interop", first("compatibility")))
        .when(first("topics").isNotNull(), say("Shared Topic", first("topics")))
        .when(same("language") & (F.col(f"{a}.language") != "Other"), say("Same Language", F.col(f"{a}.language")))
    )
    if weight is not None:
        out = out.when(weight > FALLBACK, "Weighted Similarity")
    return out.otherwise("Nearby catalog entry (no shared signals)")


def with_reasons(df: DataFrame, edges: DataFrame, ord_col: str = "ord", graph: bool = False) -> DataFrame:
    ev = evidence(df, ord_col)
    packed = ev.select("ord", F.struct("topics", "primitives", "compatibility", "subsystem", "language", "artifact").alias("e"))
    both = edges.join(packed.select(F.col("ord").alias("src"), F.col("e").alias("__a")), "src").join(packed.select(F.col("ord").alias("dst"), F.col("e").alias("__b")), "dst")
    return both.withColumn("reason", reason("__a", "__b", F.col("weight") if graph else None)).drop("__a", "__b")


def similar(df: DataFrame, edges: DataFrame, ids: DataFrame | None = None, k: int = 5, ord_col: str = "ord") -> DataFrame:
    """The first ``k`` stored neighbours of rows (all, or those whose ord is in ``ids``) with reasons."""
    near = edges.where(F.col("rank") <= k)
    if ids is not None:
        near = near.join(ids.select(F.col(ord_col).alias("src")), "src", "left_semi")
    return with_reasons(df, near, ord_col)


def sample_graph(df: DataFrame, edges: DataFrame, limit: int = 1600, ord_col: str = "ord") -> DataFrame:
    """src, dst, weight of undirected links among the first ``limit`` rows; lonely ones are tied to the nearest position."""
    nodes = df.orderBy(ord_col).limit(limit).select(F.col(ord_col).alias("n"))
    inside = edges.join(nodes.select(F.col("n").alias("src")), "src", "left_semi").join(nodes.select(F.col("n").alias("dst")), "dst", "left_semi")
    first = F.row_number().over(Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy("src", "rank"))
    links = inside.withColumn("k", first).where("k = 1").select("src", "dst", "weight")
    # lonely: no link that the node itself started
    w = Window.orderBy("n")  # at most `limit` rows
    around = nodes.withColumns({"before": F.lag("n").over(w), "after": F.lead("n").over(w)})
    lonely = around.join(links.select(F.col("src").alias("n")).distinct(), "n", "left_anti").join(links.select(F.col("dst").alias("n")).distinct(), "n", "left_anti")
    nearest = F.when(F.col("before").isNull() | (F.col("after") - F.col("n") < F.col("n") - F.col("before")), F.col("after")).otherwise(F.col("before"))
    tied = lonely.select(F.col("n").alias("src"), nearest.alias("dst")).where("dst is not null")
    once = F.row_number().over(Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy("src"))
    tied = tied.withColumn("k", once).where("k = 1").select("src", "dst", F.lit(FALLBACK).alias("weight"))
    return links.unionByName(tied)


def k_hop(links: DataFrame, starts: DataFrame, hops: int = 1) -> DataFrame:
    """start, node, hop: nodes within ``hops`` undirected links of each start, at their least distance."""
    both = links.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(links.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hop"))
    for h in range(1, hops + 1):
        step = seen.where(F.col("hop") == h - 1).join(both, F.col("node") == F.col("a")).select("start", F.col("b").alias("node"), F.lit(h).alias("hop"))
        seen = seen.unionByName(step).groupBy("start", "node").agg(F.min("hop").alias("hop"))
    return seen


def topic_map(companions: DataFrame, nodes: int = 48, links: int = 5) -> DataFrame:
    """place, topic, count, other, pair_count: the ``nodes`` commonest topics of ``cooccurrence`` and the links among them.

    A topic's ``links`` strongest companions count, those outside the sample included; of these the ones inside are links,
    each once: at the topic of the smaller place that has it. A topic without a link of its own has one row without other.
    Both ranks are limits of the view, so whatever joins here has at most nodes x links rows.
    """
    topics = companions.select("topic", "count").distinct()
    picked = topics.orderBy(F.col("count").desc(), "topic").limit(nodes)
    sample = settled(picked.withColumn("place", F.row_number().over(Window.orderBy(F.col("count").desc(), "topic"))), "topics")
    strong = companions.where(F.col("rank") <= links).select("topic", "other", "pair_count").where("other is not null")
    inside = strong.join(sample.select("topic", "place"), "topic").join(sample.select(F.col("topic").alias("other")), "other", "left_semi")
    first = F.row_number().over(Window.partitionBy(F.least("topic", "other"), F.greatest("topic", "other")).orderBy("place"))
    once = inside.withColumn("__n", first).where("__n = 1").select("topic", "other", "pair_count")
    return sample.join(once, "topic", "left").select("place", "topic", "count", "other", "pair_count")

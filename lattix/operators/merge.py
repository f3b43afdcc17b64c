"""Keyed merges: details, upserts, reconciliation, patches, overlays, look-ups and stable ids."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_license
from ..functions.text import array_or_empty, blank_to_null
from ..sources.catalog import lot, part_number
from ..sources.raw import keyed
from ..sources.shared import settled
from .classify import context_card
from .score import ranked_within

DEEP = ("primitives", "compatibility", "usecases", "keywords", "quickstart_code", "maturity", "beginner_intel")
SAFE_ID = (1 << 53) - 1
SYNTHETIC_ID = 1 << 40


def _filled(df: DataFrame, col: str):
    """The column, or null where it counts as missing: blank text, an empty array."""
    kind = df.schema[col].dataType.typeName()
    c = F.col(f"d.{col}")
    return blank_to_null(c) if kind == "string" else F.when(F.size(c) > 0, c) if kind == "array" else c


def attach_details(df: DataFrame, details: DataFrame, order: tuple[str, ...] = ("key",)) -> DataFrame:
    """Deep fields that are filled replace; topics fill only if empty; description and dates replace if present.

    If several rows share an id, the last of them in ``order`` gets the details. The result has ``attached``.
    """
    last = F.row_number().over(Window.partitionBy("id").orderBy(*[F.col(c).desc() for c in order])) == 1
    base = df.withColumn("__last", last).alias("c")
    d = details.dropDuplicates(["id"]).withColumn("__there", F.lit(True)).alias("d")
    joined = base.join(d, (F.col("c.id") == F.col("d.id")) & F.col("c.__last"), "left")
    out = []
    for c in df.columns:
        if c not in details.columns or c == "id":
            out.append(F.col(f"c.{c}"))
        elif c == "topics":
            out.append(F.when(F.size(array_or_empty(F.col("c.topics"))) > 0, F.col("c.topics")).otherwise(F.coalesce(F.slice("d.topics", 1, 8), F.col("c.topics"))).alias(c))
        elif c in DEEP or c == "description":
            out.append(F.coalesce(_filled(details, c), F.col(f"c.{c}")).alias(c))
        elif c in ("pushed_at", "created_at", "is_archived"):
            out.append(F.coalesce(F.col(f"d.{c}"), F.col(f"c.{c}")).alias(c))
        else:
            out.append(F.col(f"c.{c}"))
    return joined.select(*out, *[F.col(f"d.{c}") for c in DEEP if c in details.columns and c not in df.columns], F.coalesce("d.__there", F.lit(False)).alias("attached"))


VOLATILE = ("owner", "name", "full_name", "stars", "forks", "description", "topics", "language", "license")
IF_PRESENT = ("pushed_at", "created_at", "is_archived")


def latest(fresh: DataFrame, order: str | None = None) -> DataFrame:
    """One row per key with ``repeats``; the last in ``order`` counts."""
    by = F.col(order) if order else F.struct(*[F.col(c) for c in fresh.columns if c != "key" and fresh.schema[c].dataType.typeName() not in ("map",)])
    w = Window.partitionBy("key")
    return fresh.withColumn("repeats", F.count("*").over(w)).withColumn("__n", F.row_number().over(w.orderBy(by.desc()))).where("__n = 1").drop("__n")


def upsert(df: DataFrame, fresh: DataFrame, order: str | None = None) -> DataFrame:
    """Full outer merge by ``key`` with ``change`` (kept, refreshed, new) and ``repeats``.

    Fresh values win on volatile fields even when blank; the known id and the curated fields stay. Dates and the
    archived flag are taken only where the fresh record has them.
    """
    c, h = df.alias("c"), latest(fresh, order).alias("h")
    hit, old = F.col("h.key").isNotNull(), F.col("c.key").isNotNull()
    out = [F.coalesce("c.key", "h.key").alias("key")]
    for name in df.columns:
        if name == "key":
            continue
        if name not in fresh.columns:
            out.append(F.col(f"c.{name}"))
        elif name in VOLATILE:
            value = F.col(f"h.{name}")
            kind = df.schema[name].dataType.typeName()
            value = {"license": lambda: normalize_license(value), "language": lambda: F.coalesce(blank_to_null(value), F.lit("Other")), "description": lambda: F.trim(F.coalesce(value, F.lit("")))}.get(name, lambda: F.coalesce(value, F.lit(0)) if kind in ("long", "integer") else value)()
            out.append(F.when(hit, value).otherwise(F.col(f"c.{name}")).alias(name))
        elif name in IF_PRESENT:
            out.append(F.coalesce(F.col(f"h.{name}"), F.col(f"c.{name}")).alias(name))
        else:
            out.append(F.coalesce(F.col(f"c.{name}"), F.col(f"h.{name}")).alias(name))
    change = F.when(hit & old, "refreshed").when(hit, "new").otherwise("kept")
    return c.join(h, F.col("c.key") == F.col("h.key"), "full_outer").select(*out, change.alias("change"), F.coalesce("h.repeats", F.lit(0)).alias("repeats"))


def merge_counts(merged: DataFrame) -> DataFrame:
    """new, refreshed and final; a key that a harvest repeats is refreshed by each repetition."""
    new = F.count_if(F.col("change") == "new")
    return merged.agg(new.alias("new"), (F.coalesce(F.sum("repeats"), F.lit(0)) - new).alias("refreshed"), F.count("*").alias("final"))


def unmatched(df: DataFrame, fresh: DataFrame, key: str = "key") -> DataFrame:
    return df.join(fresh.select(key).distinct(), key, "left_anti")


def id_parity(a: DataFrame, b: DataFrame, col: str = "id") -> DataFrame:
    """value, side: values that only one of two tables has."""
    x, y = a.select(F.col(col).alias("value")).distinct(), b.select(F.col(col).alias("value")).distinct()
    return x.join(y, "value", "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, "value", "left_anti").withColumn("side", F.lit("right")))


def verdicts(lookups: DataFrame, min_stars: int = 500) -> DataFrame:
    """Look-ups (key, status, private, stars, current_name, ...) with their verdict."""
    status, current = F.col("status"), F.lower("current_name")
    verdict = (
        F.when(status == 404, "deleted").when(status == 451, "blocked").when(status.isin(409, 422), "empty_repo")
        .when((status != 200) | status.isNull(), "error").when(F.coalesce("private", F.lit(False)), "blocked")
        .when(blank_to_null(F.col("current_name")).isNull(), "error")
        .when(F.coalesce("stars", F.lit(0)) < min_stars, "below_threshold").when(current != F.col("key"), "renamed").otherwise("live_unindexed")
    )
    return lookups.withColumns({"verdict": verdict, "current": F.coalesce(current, F.col("key"))})


def reconcile_patch(df: DataFrame, fresh: DataFrame, lookups: DataFrame, min_stars: int = 500, strict: bool = True) -> DataFrame:
    """The look-ups of unmatched rows with ``action`` (drop, update, none) and ``reason``.

    With ``strict`` an error or a row that was not looked up forbids the patch, so that no partial one is applied.
    """
    judged = verdicts(lookups, min_stars)
    if strict:
        lost = unmatched(df, fresh).join(lookups.select("key"), "key", "left_anti")
        if not judged.where("verdict = 'error'").isEmpty() or not lost.isEmpty():
            raise ValueError("some rows were not resolved: no partial patch is made")
    harvested = fresh.select(F.col("key").alias("current"), F.lit(True).alias("in_fresh")).distinct()
    known = df.select(F.col("key").alias("current"), F.lit(True).alias("in_catalog")).distinct()
    judged = judged.join(harvested, "current", "left").join(known, "current", "left")
    moved = F.col("verdict").isin("renamed", "live_unindexed")
    gone = F.col("verdict").isin("deleted", "blocked", "below_threshold", "empty_repo")
    renamed = F.col("verdict") == "renamed"
    reason = F.when(renamed & F.col("in_fresh"), "renamed_duplicate_dropped").when(renamed & F.col("in_catalog"), "renamed_already_in_catalog_dropped").otherwise(F.col("verdict"))
    action = F.when(gone | (renamed & (F.col("in_fresh") | F.col("in_catalog"))), "drop").when(moved, "update").otherwise("none")
    return judged.withColumns({"action": action, "reason": reason}).drop("in_fresh", "in_catalog")


def apply_patch(df: DataFrame, patch: DataFrame) -> DataFrame:
    """Drop rows; move updated ones to their current name, unless that exists (then the old row goes)."""
    left = df.join(patch.where("action = 'drop'").select("key"), "key", "left_anti")
    ups = patch.where("action = 'update'").select("key", F.col("current").alias("__to"), F.col("stars").alias("__stars"))
    there = left.select(F.col("key").alias("__to"), F.lit(True).alias("__taken"))
    ups = ups.join(there, "__to", "left").withColumn("__clash", F.coalesce("__taken", F.lit(False)) & (F.col("__to") != F.col("key"))).drop("__taken")
    out = left.join(ups, "key", "left").where("__clash is null or not __clash")
    return out.withColumns({"stars": F.coalesce("__stars", "stars"), "key": F.coalesce("__to", "key")}).drop("__to", "__stars", "__clash")


#: Counters of a written merge, in the order in which things happen.
COUNTERS = ("bad_lines", "incomplete", "new", "refreshed", "dropped", "updated", "collisions", "hook_synthesized", "final")


def _with_fates(rows: DataFrame, patch: DataFrame) -> DataFrame:
    """The rows with ``__fate`` (keep, drop, update, collision), moved to their new key where they get one.

    As in ``apply_patch`` a row that is to move goes if a row has that key already, and of several that are to move to one
    key the first by its old key does. The table is used once: a moving row stands for its old key, too, while keys meet.
    """
    fates = patch.where("action in ('drop', 'update')").groupBy("key").agg(F.max_by(F.struct("action", F.col("current").alias("to"), "stars"), F.struct("action", "current")).alias("__p"))
    out = rows.join(fates, "key", "left").withColumn("__moves", F.coalesce((F.col("__p.action") == "update") & (F.col("__p.to") != F.col("key")), F.lit(False)))
    places = F.when(F.col("__moves"), F.array(F.struct(F.col("__p.to").alias("at"), F.lit(False).alias("old")), F.struct(F.col("key").alias("at"), F.lit(True).alias("old"))))
    dropped = F.coalesce(F.col("__p.action") == "drop", F.lit(False))
    places = F.coalesce(places, F.array(F.struct(F.col("key").alias("at"), F.lit(False).alias("old"))))
    out = out.withColumn("__e", F.explode(places))
    at = Window.partitionBy("__e.at")
    held = F.max((F.col("__e.old") | ~F.col("__moves")) & ~dropped).over(at)
    turn = F.row_number().over(at.orderBy(F.col("__e.old") | ~F.col("__moves"), "key"))
    out = out.withColumns({"__held": held, "__turn": turn}).where("not __e.old")
    clash = F.col("__moves") & (F.col("__held") | (F.col("__turn") > 1))
    fate = F.when(dropped, "drop").when(clash, "collision").when(F.col("__p.action") == "update", "update").otherwise("keep")
    return out.withColumns({"__fate": fate, "key": F.when(dropped, F.col("key")).otherwise(F.col("__e.at")), "stars": F.coalesce("__p.stars", "stars")}).drop("__p", "__moves", "__e", "__held", "__turn")


def write_merged(df: DataFrame, records: DataFrame, path: str, patch: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Merge parsed records (with ``state``) and a patch into a catalog, write it to ``path``, and yield counter, n for all ``COUNTERS``.

    The counters are observed while the table is written, so nothing is read twice for them: lines that are bad or
    incomplete, rows that are new or refreshed (a key that the records repeat is refreshed by each repetition), rows that the
    patch drops, updates, or drops as the key they would move to is taken, hooks made up for rows without hook and
    description, and rows in the end. Hooks of new and refreshed rows follow their description.
    """
    spark, seen, merged, fated, done = df.sparkSession, *[Observation(f"merge-{uuid.uuid4().hex}") for _ in range(4)]
    states = {c: F.count_if(F.col("state") == s).alias(c) for c, s in (("bad_lines", "bad"), ("incomplete", "incomplete"))}
    fresh = keyed(records.observe(seen, *states.values()).where("state = 'good'")).drop("value", "state")
    fresh = fresh.withColumn("full_name", F.concat_ws("/", "owner", "name"))
    new = F.count_if(F.col("change") == "new")
    rows = upsert(df, fresh, order).observe(merged, new.alias("new"), (F.coalesce(F.sum("repeats"), F.lit(0)) - new).alias("refreshed"))
    if "hook" in df.columns:
        rows = rows.withColumn("hook", F.when(F.col("change") != "kept", F.substring("description", 1, 90)).otherwise(F.col("hook")))
    rows = rows.drop("change", "repeats")
    if patch is not None:
        fate = {c: F.count_if(F.col("__fate") == f).alias(c) for c, f in (("dropped", "drop"), ("updated", "update"), ("collisions", "collision"))}
        rows = _with_fates(rows, patch).observe(fated, *fate.values()).where("__fate in ('keep', 'update')").drop("__fate")
    made = F.lit(False)
    if "hook" in df.columns:
        made = blank_to_null(F.col("hook")).isNull() & blank_to_null(F.col("description")).isNull()
        label = lambda c, other: F.coalesce(blank_to_null(F.col(c)), F.lit(other)) if c in df.columns else F.lit(other)
        card = context_card(label("domain", "General"), label("subsystem", "General Components"), label("language", "Other"))
        rows = rows.withColumn("__made", made).withColumn("hook", F.when(F.col("__made"), card["what_it_does"]).otherwise(F.col("hook")))
        made = F.col("__made")
    rows.observe(done, F.count_if(made).alias("hook_synthesized"), F.count("*").alias("final")).drop("__made").write.mode("overwrite").parquet(path)
    counts = dict.fromkeys(COUNTERS, 0)
    for told in (seen, merged, *([fated] if patch is not None else []), done):
        counts |= told.get
    if not seen.get:  # Spark leaves a side out of the final plan that turns out to be empty, and its counts with it
        counts |= records.agg(*states.values()).first().asDict()
    return spark.createDataFrame([(c, int(counts[c] or 0)) for c in COUNTERS], "counter STRING, n LONG")


def overlay_curated(df: DataFrame, curated: DataFrame, fields: tuple[str, ...] = ("beginner_intel", "quickstart_code"), require_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """(table with the curated fields, status of each curated row: in_sync, updated or missing)."""
    c, s = curated.alias("s"), df.select("key", *fields).alias("c")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"s.{f}").eqNullSafe(F.col(f"c.{f}"))
    status = c.join(s, "key", "left").select("key", F.when(F.col("c.key").isNull(), "missing").when(same, "in_sync").otherwise("updated").alias("status"))
    if require_all and not status.where("status = 'missing'").isEmpty():
        raise ValueError("curated rows are missing from the catalog")
    new = curated.select("key", *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__hit"))
    out = df.join(new, "key", "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col("__hit"), F.col(f"__{f}")).otherwise(F.col(f)))
    return out.drop("__hit", *[f"__{f}" for f in fields]), status


#: The card, licence terms and command of a looked-up row that has none.
LOOKUP_CARD = {
    "why_it_matters": "A prominent open-source system solving core scalability and reliability requirements in its domain.",
    "when_to_use": "Best suited for production applications requiring high performance in ",
    "alternatives": ("Standard libraries", "Cloud services", "Alternative open source engines"),
    "key_superpowers": ("High throughput", "Low resource overhead", "Battle-tested community stability"),
}
LOOKUP_LICENSE = {"tier": "Standard Open Source", "commercial": "Commercially Permissive", "desc": "Check repository license file for explicit terms."}
#: Wanted rows that are broadcast to the details, so that their folders are known before these are read; more of them are shuffled.
WANTED = 200_000


def wanted_rows(df: DataFrame, names: DataFrame) -> DataFrame:
    """For each wanted name: the row with that owner/name, else the first row (by stars) with that bare name."""
    n = names.select(F.col("name").alias("wanted"), F.lower("name").alias("__k")).distinct()
    exact = n.join(df, F.col("__k") == F.col("key")).withColumn("__p", F.lit(0))
    bare = n.join(df, F.col("__k") == F.lower(df["name"])).withColumn("__p", F.lit(1))
    best = F.row_number().over(Window.partitionBy("wanted").orderBy("__p", F.col("stars").desc(), "full_name"))
    return exact.unionByName(bare).withColumn("__n", best).where("__n = 1").drop("__n", "__p", "__k")


def lookup_defaults(df: DataFrame) -> dict[str, Column]:
    """What a looked-up row shows where neither its details nor itself have it, for the columns that can be made."""
    out = {}
    if {"hook", "description", "subsystem"} <= set(df.columns):
        out["beginner_intel"] = F.struct(
            F.coalesce(blank_to_null(F.col("hook")), F.col("description")).alias("what_it_does"), F.lit(LOOKUP_CARD["why_it_matters"]).alias("why_it_matters"),
            F.concat(F.lit(LOOKUP_CARD["when_to_use"]), F.coalesce("subsystem", F.lit("")), F.lit(".")).alias("when_to_use"),
            *[F.array(*map(F.lit, LOOKUP_CARD[c])).alias(c) for c in ("alternatives", "key_superpowers")],
        )
    out["license_intel"] = F.struct(*[F.lit(v).alias(k) for k, v in LOOKUP_LICENSE.items()])
    if "url" in df.columns:
        out["quickstart_code"] = F.concat(F.lit("git clone "), F.col("url"), F.lit(".git"))
    return out


def lookup_details(df: DataFrame, details: DataFrame, names: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """The wanted rows (see ``wanted_rows``) with the details of their id, a filled field of which counts before the row's own.

    With ``parts`` (slug, parts: the fan-out that the details were written by) a wanted row knows the folder of its details,
    and details (with slug and part) are joined by both: up to ``WANTED`` rows are broadcast, and Spark then reads their
    folders only. Cards, licence terms and commands that are missing on both sides get defaults (see ``lookup_defaults``).
    """
    found = wanted_rows(df, names)
    deep = [c for c in details.columns if c not in ("id", "slug", "part", "lot")]
    if parts is None:
        hits = details.select("id", *deep)
    else:
        found = settled(part_number(found, parts), "wanted")
        # a comparison tells Spark that the folders of these rows are worth looking up first
        near = found.where(F.col("id") > -(1 << 63)).select(F.col("id").alias("__id"), F.col("slug").alias("__slug"), F.col("part").alias("__part"), lot(F.col("part")).alias("__lot")).distinct()
        near = F.broadcast(near) if found.count() <= WANTED else near
        there = ["id", "slug", "part", *(["lot"] if "lot" in details.columns else [])]
        hits = details.join(near, reduce(Column.__and__, [F.col(c) == F.col(f"__{c}") for c in there]))
        hits, found = hits.select("id", *deep), found.drop("slug", "part")
    kinds = {c: details.schema[c].dataType.typeName() for c in deep}
    filled = [(blank_to_null(F.col(c)) if kinds[c] == "string" else F.when(F.size(c) > 0, F.col(c)) if kinds[c] == "array" else F.col(c)).alias(f"__d_{c}") for c in deep]
    out = found.join(hits.dropDuplicates(["id"]).select("id", *filled), "id", "left")
    defaults = lookup_defaults(found)
    for c in deep:
        own = [F.col(c)] if c in found.columns else []
        if own and kinds[c] == "string":
            own = [blank_to_null(F.col(c))]
        out = out.withColumn(c, F.coalesce(F.col(f"__d_{c}"), *own, *([defaults[c]] if c in defaults else []))).drop(f"__d_{c}")
    return out


def stable_ids(df: DataFrame) -> DataFrame:
    """Keep ids in (0, 2^53) of their first claimant in catalog order; give the others a hashed id from 2^40 on.

    The n-th of several rows that hash to one id takes the n-th id from there on, so rows of one name are settled in one
    round however many there are. Only rows whose new id is taken, or is another's new id, go on, to the id after it; each
    round is written, so its plan stays as short as the first. Claimants are ranked by range partitions, so no task
    holds all claimants of an id.
    """
    valid = F.coalesce((F.col("id") > 0) & (F.col("id") < SAFE_ID), F.lit(False))
    order = (F.col("stars").desc(), F.col("full_name"))
    sound = ranked_within(df.where(valid), "id", *order, name="__nth").withColumn("__keep", F.col("__nth") == 1).drop("__nth")
    # ids that can't be kept anyway are ranked by nothing
    marked = settled(sound.unionByName(df.where(~valid).withColumn("__keep", F.lit(False))), "ids")
    kept = marked.where("__keep").drop("__keep").withColumn("rekeyed", F.lit(False))
    losers = marked.where("not __keep").drop("__keep").withColumn("id", F.lit(SYNTHETIC_ID) + F.pmod(F.xxhash64(F.lower("full_name")), F.lit(SYNTHETIC_ID)))
    taken, done = kept.select("id"), [kept]
    while not losers.isEmpty():
        held = taken.select("id", F.lit(True).alias("__taken"))
        moved = ranked_within(losers, "id", F.col("full_name"), name="__nth").withColumn("__first", F.col("__nth") == 1)
        moved = moved.withColumn("id", F.col("id") + F.col("__nth") - 1).drop("__nth")
        # rows of several hashes on one new id: the one that hashed to it is before those that moved there
        turn = F.row_number().over(Window.partitionBy("id").orderBy(F.col("__first").desc(), "full_name"))
        probe = moved.withColumn("__n", turn).join(held, "id", "left")
        clash = F.coalesce("__taken", F.lit(False)) | (F.col("__n") > 1)
        probe = settled(probe.withColumn("__clash", clash).drop("__taken", "__n", "__first"), "ids-probed")
        placed = probe.where("not __clash").drop("__clash")
        done.append(placed.withColumn("rekeyed", F.lit(True)))
        taken = taken.unionByName(placed.select("id"))
        losers = probe.where("__clash").drop("__clash").withColumn("id", F.col("id") + 1)
    return reduce(DataFrame.unionByName, done)

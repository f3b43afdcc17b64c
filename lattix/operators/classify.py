"""Artifact, domain and subsystem by keyword evidence; cards; enrichment; reclassification; churn.

Domain rules are a parameter, not part of the library: a list of
``{"domain", "keywords", "strong", "subsystems": {name: [keywords]}}``, as ``load_rules`` reads from JSON. All keywords
are looked up in one pass by a token join (see ``keyword_hits``), so the number of rules does not multiply the work.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexicons import ARTIFACT_EVIDENCE, ARTIFACTS, COMPATIBILITY, CURATED_PATTERNS, CURATED_TAGS, PRIMITIVES, USE_CASES
from ..functions.scalars import license_terms, maturity
from ..functions.text import any_of, array_or_empty, blank_to_null, has_keyword, keyword_list, lexicon_tags, once, tokens
from ..sources.shared import settled

#: Fixed values of the domain rule: least score, least lead, cap of the margin, labels without a domain.
LEAST, LEAD, MARGIN_CAP = 3, 2, 9
NO_DOMAIN, NO_SUBSYSTEM = "Other / General", "General Components"
#: Rules of which a broadcast is thought; their keywords are counted then.
MOST_RULES = 5_000


def load_rules(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def artifact(name: Column, description: Column, topics: Column) -> Column:
    """Curated lists first; else the label with most evidence. A keyword counts in the name or elsewhere, never twice.

    The lower-cased texts are made once a row, and patterns are tried only where their words stand.
    """
    name, desc = F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))
    tags = F.transform(array_or_empty(topics), F.lower)
    low = F.lower(name)
    corpus = F.concat(low, F.lit("\n"), F.lower(desc), F.lit("\n"), F.array_join(tags, "\n"))
    curated = F.arrays_overlap(tags, F.array(*map(F.lit, CURATED_TAGS))) | name.rlike(any_of(CURATED_PATTERNS)) | desc.rlike(any_of(CURATED_PATTERNS))

    def best(texts: Column) -> Column:
        scores = {}
        for label, rules in ARTIFACT_EVIDENCE.items():
            total = F.lit(0)
            for words, in_name, elsewhere in rules:
                for word in words:
                    # the corpus begins with the name: a keyword of the name is in it, too
                    some = F.when(has_keyword(texts["low"], word), in_name).otherwise(elsewhere)
                    total = total + F.when(has_keyword(texts["corpus"], word), some).otherwise(0)
            scores[label] = total
        ranked = [F.struct(s.alias("score"), F.lit(-ARTIFACTS.index(label)).alias("priority"), F.lit(label).alias("label")) for label, s in scores.items()]
        return F.array_max(F.array(*ranked))

    found = once(F.struct(low.alias("low"), corpus.alias("corpus")), best)
    named = once(found, lambda b: F.when(b["score"] <= 0, ARTIFACTS[-1]).otherwise(b["label"]))
    return F.when(curated, ARTIFACTS[0]).otherwise(named)


def rules_table(spark: SparkSession, rules: Iterable[dict]) -> DataFrame:
    """A row per keyword: keyword, kind (d: of a domain, s: of a subsystem), domain, subsystem, strong, its pieces but the last (lead), the last (final), whether it has a plural."""
    rows = []
    for r in rules:
        entries = [("d", None, k, k in set(r.get("strong") or ())) for k in r["keywords"]]
        entries += [("s", s, k, False) for s, words in (r.get("subsystems") or {}).items() for k in words]
        for kind, sub, word, strong in entries:
            pieces = [p for p in re.split(r"[\s\-_./]+", word.lower()) if p]
            rows.append((word, kind, r["domain"], sub, strong, pieces[:-1], pieces[-1] if pieces else word.lower(), len(word) >= 4))
    schema = "keyword string, kind string, domain string, subsystem string, strong boolean, lead array<string>, final string, plural boolean"
    return spark.createDataFrame(rows, schema)


def keyword_hits(texts: DataFrame, keywords: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, keyword: keywords found between token bounds, by joining token runs to the keyword table.

    All tokens of a keyword but the last must be whole; the last may be any beginning of its token that a digit or the
    end follows, with an s before that for keywords that may be plural. So each token has few candidates for the last
    piece (its beginnings before a digit or the end, with and without a plural s), and the join is an equality.
    """
    longest = keywords.agg(F.coalesce(F.max(F.size("lead")), F.lit(0))).first()[0]
    every = texts.select(F.col(id_col).alias("__id"), tokens(F.col(text_col)).alias("__all"))

    def run(i: Column, k: int) -> Column:
        return F.when(i >= k, F.array_join(F.slice("__all", F.greatest(F.lit(1), i - k + 1), F.lit(k)), " "))

    # each token with the runs of up to `longest` tokens before it; the array itself isn't copied to its rows
    marked = F.transform("__all", lambda t, i: F.struct(t.alias("__token"), F.array(*[run(i, k) for k in range(longest + 1)]).alias("__runs")))
    words = every.select("__id", F.inline(marked))
    token = F.col("__token")
    ends = F.filter(F.sequence(F.lit(1), F.length(token)), lambda n: (n == F.length(token)) | F.substring(token, n + 1, F.lit(1)).rlike("[0-9]"))
    ends = F.when(token.rlike("[0-9]"), ends).otherwise(F.array(F.length(token)))
    forms = F.transform("__ends", lambda n: F.struct(F.substring(F.col("__token"), F.lit(1), n).alias("form"), F.lit(False).alias("cut")))
    plural = F.transform(F.filter("__ends", lambda n: F.substring(F.col("__token"), n, F.lit(1)) == "s"), lambda n: F.struct(F.substring(F.col("__token"), F.lit(1), n - 1).alias("form"), F.lit(True).alias("cut")))
    words = words.withColumn("__ends", ends)
    tall = words.select("__id", "__runs", F.inline(F.concat(forms, plural))).where("form <> ''")
    tall = tall.select("__id", "form", "cut", F.posexplode("__runs").alias("k", "before")).where("before is not null")
    keys = keywords.select("keyword", "plural", F.array_join("lead", " ").alias("before"), F.size("lead").alias("k"), F.col("final").alias("form")).distinct()
    # a rules table holds some hundreds of rows; a larger one is left to the optimizer
    keys = F.broadcast(keys) if keys.limit(20_001).count() <= 20_000 else keys
    return tall.join(keys, ["form", "before", "k"]).where("plural or not cut").select(F.col("__id").alias(id_col), "keyword").distinct()


def domains(df: DataFrame, rules: list[dict], id_col: str = "id") -> DataFrame:
    """id, domain, subsystem, domain_margin of every row with (id, name, description, topics, language).

    A strong keyword among the tags earns 6, other tags 3 once, a keyword elsewhere 1. The best domain needs 3 points
    and a lead of 2; its subsystems then earn 4 for a tag and 1 elsewhere.
    """
    spark = df.sparkSession
    table = rules_table(spark, rules)
    tags = F.transform(array_or_empty(F.col("topics")), F.lower)
    body = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("name", "description")], F.array_join(array_or_empty(F.col("topics")), " "), F.coalesce("language", F.lit(""))))
    base = settled(df.select(F.col(id_col).alias("id"), F.array_join(tags, "\n").alias("tags"), body.alias("body")), "texts")
    words = table.select("keyword", "lead", "final", "plural").distinct()
    labels = table.drop("lead", "final", "plural")
    labels = F.broadcast(labels) if len(rules) <= MOST_RULES and labels.limit(20_001).count() <= 20_000 else labels
    # tags and body are looked up together: one pass, and one shuffle that brings both to their row
    texts = base.select("id", F.inline(F.array(F.struct(F.lit(True).alias("tag"), F.col("tags").alias("text")), F.struct(F.lit(False).alias("tag"), F.col("body").alias("text")))))
    found = keyword_hits(texts.select(F.struct("id", "tag").alias("at"), "text").where("text <> ''"), words, "at", "text")
    hits = found.groupBy(F.col("at.id").alias("id"), "keyword").agg(F.max(F.when(F.col("at.tag"), 1)).alias("t")).join(labels, "keyword")
    d = hits.where("kind = 'd'").groupBy("id", "domain").agg(
        (6 * F.count_if(F.col("t").isNotNull() & F.col("strong")) + F.when(F.count_if(F.col("t").isNotNull() & ~F.col("strong")) > 0, 3).otherwise(0) + F.count_if(F.col("t").isNull())).alias("score"),
        F.count("t").alias("tag_hits"),
    )
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), F.col("tag_hits").desc(), "domain")
    best = d.withColumns({"n": F.row_number().over(w), "second": F.coalesce(F.lead("score").over(w), F.lit(0))}).where("n = 1")
    lead = F.col("score") - (F.col("second") if len(rules) > 1 else F.lit(0))
    best = best.select("id", "domain", F.least(F.lit(MARGIN_CAP), lead).cast("int").alias("domain_margin"), ((F.col("score") >= LEAST) & (lead >= LEAD)).alias("sure"))
    s = hits.where("kind = 's'").join(best.where("sure").select("id", "domain"), ["id", "domain"])
    s = s.groupBy("id", "subsystem").agg((4 * F.count("t") + F.count_if(F.col("t").isNull())).alias("score"), F.count("t").alias("tag_hits"))
    top = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), F.col("tag_hits").desc(), "subsystem"))
    s = s.withColumn("n", top).where("n = 1").select("id", "subsystem")
    out = base.select("id").join(best, "id", "left").join(s, "id", "left")
    general = F.concat(F.lit("General "), F.trim(F.element_at(F.split("domain", "&"), 1)))
    sure = F.coalesce("sure", F.lit(False))
    return out.select(
        "id", F.when(sure, F.col("domain")).otherwise(NO_DOMAIN).alias("domain"),
        F.when(sure, F.coalesce("subsystem", general)).otherwise(NO_SUBSYSTEM).alias("subsystem"), F.coalesce("domain_margin", F.lit(0)).alias("domain_margin"),
    )


#: The sentences and lists of the cards.
CARD = {
    "alternatives": ("Standard library solutions", "Cloud managed services", "Alternative open source engines"),
    "key_superpowers": ("High throughput", "Low resource overhead", "Battle-tested community stability"),
}
DEFAULT_CARD = {
    "why_it_matters": "A notable open source project with significant community adoption.",
    "when_to_use": "Use when building systems that require high performance in ",
    "alternatives": ("Standard library solutions", "Cloud managed services"),
    "key_superpowers": ("High performance", "Active community", "Open architecture"),
}


def default_card(hook: Column, subsystem: Column) -> Column:
    """The card that is written for a record without one."""
    return F.struct(
        hook.alias("what_it_does"), F.lit(DEFAULT_CARD["why_it_matters"]).alias("why_it_matters"),
        F.concat(F.lit(DEFAULT_CARD["when_to_use"]), F.coalesce(blank_to_null(subsystem), F.lit("its domain")), F.lit(".")).alias("when_to_use"),
        *[F.array(*map(F.lit, DEFAULT_CARD[c])).alias(c) for c in ("alternatives", "key_superpowers")],
    )


def context_card(domain: Column, subsystem: Column, language: Column) -> Column:
    low = F.lower(subsystem)
    return F.struct(
        F.concat(F.lit("A foundational "), language, F.lit(" project in the "), domain, F.lit(" ecosystem specialized for "), subsystem, F.lit(".")).alias("what_it_does"),
        F.concat(F.lit("It solves complex "), low, F.lit(" challenges without requiring teams to reinvent low-level primitives.")).alias("why_it_matters"),
        F.concat(F.lit("Use when your application demands reliable, high-performance "), low, F.lit(" with active community support.")).alias("when_to_use"),
        *[F.array(*map(F.lit, CARD[c])).alias(c) for c in ("alternatives", "key_superpowers")],
    )


def enrich(df: DataFrame, rules: list[dict], as_of: int, id_col: str = "id") -> DataFrame:
    """All derived columns of raw records (id, name, owner, description, stars, forks, language, license, topics, pushed_epoch)."""
    lang = F.coalesce(blank_to_null(F.col("language")), F.lit("Other"))
    base = df.withColumns({"language": lang, "license": F.coalesce(blank_to_null(F.col("license")), F.lit("Unknown")), "topics": array_or_empty(F.col("topics"))})
    out = base.join(domains(base, rules, id_col).withColumnRenamed("id", id_col), id_col)
    corpus = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")), F.array_join("topics", " "), "language"))
    out = out.withColumns({
        "artifact": artifact(F.col("name"), F.col("description"), F.col("topics")),
        "primitives": lexicon_tags(corpus, PRIMITIVES), "compatibility": lexicon_tags(corpus, COMPATIBILITY), "usecases": lexicon_tags(corpus, USE_CASES),
        "license_intel": license_terms(F.col("license")), "maturity": maturity(F.col("stars"), F.col("forks"), F.col("pushed_epoch"), as_of),
        "full_name": F.when(blank_to_null(F.col("owner")).isNull(), F.col("name")).otherwise(F.concat_ws("/", "owner", "name")),
    })
    path = F.when(blank_to_null(F.col("owner")).isNull(), F.col("name")).otherwise(F.concat_ws("/", "owner", "name"))
    return out.withColumns({
        "beginner_intel": context_card(F.col("domain"), F.col("subsystem"), F.col("language")),
        "keywords": keyword_list(F.col("subsystem"), F.col("artifact"), F.col("domain"), F.col("primitives"), F.col("compatibility"), F.col("usecases"), topics=F.col("topics")),
        "url": F.concat(F.lit("https://github.com/"), path),
        "quickstart_code": F.concat(F.lit("git clone https://github.com/"), F.coalesce("owner", F.lit("")), F.lit("/"), F.col("name"), F.lit(".git")),
    })


def reclassify(df: DataFrame, rules: list[dict], id_col: str = "id") -> DataFrame:
    """New labels next to old_domain, old_subsystem, old_artifact; keywords follow; a card that is the template, or the
    default card of the row's hook where the table has hooks, is renewed."""
    lang = F.coalesce(blank_to_null(F.col("language")), F.lit("Other"))
    old = df.withColumns({
        "old_domain": F.coalesce("domain", F.lit(NO_DOMAIN)), "old_subsystem": F.coalesce("subsystem", F.lit(NO_SUBSYSTEM)), "old_artifact": F.coalesce("artifact", F.lit(ARTIFACTS[-1])),
    }).drop("domain", "subsystem", "artifact", "domain_margin")
    new = old.join(domains(df, rules, id_col).withColumnRenamed("id", id_col), id_col).withColumn("artifact", artifact(F.col("name"), F.col("description"), F.col("topics")))
    same = (F.col("domain") == F.col("old_domain")) & (F.col("subsystem") == F.col("old_subsystem"))
    if "keywords" in df.columns:
        labels = F.array("old_domain", "old_subsystem", "old_artifact")
        kept = F.filter(array_or_empty(F.col("keywords")), lambda x: ~F.array_contains(labels, x))
        renewed = F.array_distinct(F.concat(F.array("subsystem", "artifact", "domain"), kept))
        new = new.withColumn("keywords", F.when(same & (F.col("artifact") == F.col("old_artifact")), F.col("keywords")).otherwise(renewed))
    if "beginner_intel" in df.columns:
        template = F.col("beginner_intel").eqNullSafe(context_card(F.col("old_domain"), F.col("old_subsystem"), lang))
        card = F.when(~same & template, context_card(F.col("domain"), F.col("subsystem"), lang))
        if "hook" in df.columns:
            hook = F.substring(F.coalesce(F.when(F.col("hook") != "", F.col("hook")), F.col("description"), F.lit("")), 1, 90)
            written = F.col("beginner_intel").eqNullSafe(default_card(hook, F.col("old_subsystem")))
            card = card.when(~same & written, context_card(F.col("domain"), F.col("subsystem"), lang))
        new = new.withColumn("beginner_intel", card.otherwise(F.col("beginner_intel")))
    return new


def churn_report(df: DataFrame, label: str = "domain", old: str = "old_domain", top: int = 15) -> DataFrame:
    """section (changed, label, transition, margin), name, n, out, in, pct: what a reclassification moved."""
    moved = F.col(old) != F.col(label)
    no = F.lit(None).cast("long")
    total = df.agg(F.count("*").alias("all"), F.count_if(moved).alias("n"))
    changed = total.select(F.lit("changed").alias("section"), F.lit(label).alias("name"), "n", no.alias("out"), no.alias("in"), F.bround(100.0 * F.col("n") / F.greatest("all", F.lit(1)), 2).alias("pct"))
    no_pct = F.lit(None).cast("double").alias("pct")
    sides = df.select(F.inline(F.array(F.struct(F.col(old).alias("name"), F.lit(0).alias("new")), F.struct(F.col(label).alias("name"), F.lit(1).alias("new")))), moved.alias("moved"))
    per = sides.groupBy("name").agg(F.count_if((F.col("new") == 0) & ~F.col("moved")).alias("n"), F.count_if((F.col("new") == 0) & F.col("moved")).alias("out"), F.count_if((F.col("new") == 1) & F.col("moved")).alias("in"))
    per = per.select(F.lit("label").alias("section"), "name", "n", "out", "in", no_pct)
    steps = df.where(moved).groupBy(F.concat(F.col(old), F.lit(" -> "), F.col(label)).alias("name")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(top)
    steps = steps.select(F.lit("transition").alias("section"), "name", "n", no.alias("out"), no.alias("in"), no_pct)
    out = changed.unionByName(per).unionByName(steps)
    if "domain_margin" in df.columns:
        zero = df.sparkSession.range(MARGIN_CAP + 1).select(F.col("id").cast("int").alias("domain_margin"))
        margins = zero.join(df.groupBy("domain_margin").agg(F.count("*").alias("n")), "domain_margin", "left")
        out = out.unionByName(margins.select(F.lit("margin").alias("section"), F.col("domain_margin").cast("string").alias("name"), F.coalesce("n", F.lit(0)).alias("n"), no.alias("out"), no.alias("in"), no_pct))
    return out

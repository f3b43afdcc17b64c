"""Inverted index, ranked batch search, export of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import array_or_empty, blank_to_null, tokens
from ..sources.shared import settled

#: Fields in the order of their bits, their weights, the cap on occurrences, characters of the body.
FIELDS = ("name", "owner", "subsystem", "domain", "topics", "primitives", "compatibility", "hook", "language", "license")
WEIGHTS = (5.0, 4.0, 3.0, 1.5, 2.5, 2.0, 1.5, 1.0, 0.5, 0.5)
MAX_TF = 7
BODY = 400


def _fields(df: DataFrame) -> list[tuple[int, Column]]:
    have, kind = set(df.columns), {f.name: f.dataType.typeName() for f in df.schema}
    out = []
    for bit, name in enumerate(FIELDS):
        if name == "hook":
            parts = [blank_to_null(F.col(c)) for c in ("description", "hook") if c in have]
            if parts:
                out.append((bit, F.substring(F.coalesce(*parts), 1, BODY)))
        elif name in have:
            out.append((bit, F.array_join(array_or_empty(F.col(name)), " ") if kind[name] == "array" else F.col(name)))
    return out


def occurrences(df: DataFrame, id_col: str = "ord") -> DataFrame:
    """id, token, tf (capped), field_mask of every token of every row."""

    def marked(bit: int, c: Column) -> Column:
        return F.transform(tokens(c), lambda t: F.struct(t.alias("token"), F.lit(1 << bit).alias("bit")))

    parts = [marked(bit, c) for bit, c in _fields(df)]
    tall = df.select(F.col(id_col), F.inline(F.flatten(F.array(*parts))))
    return tall.groupBy(id_col, "token").agg(F.least(F.count("*"), F.lit(MAX_TF)).cast("int").alias("tf"), F.bit_or("bit").alias("field_mask"))


def build_index(df: DataFrame, id_col: str = "ord", common: int = 10) -> tuple[DataFrame, DataFrame]:
    """(postings, terms): a token stays if at most N / ``common`` rows have it, and two rows or some name or owner."""
    found = occurrences(df, id_col)
    named = F.max(F.col("field_mask").bitwiseAND(F.lit(3)) > 0)
    n = df.agg(F.greatest(F.lit(1), F.floor(F.count("*") / common)).alias("cap"))  # one row
    terms = found.groupBy("token").agg(F.count("*").alias("df"), named.alias("named")).crossJoin(F.broadcast(n))
    terms = terms.where("df <= cap and (df >= 2 or named)").select("token", "df")
    return found.join(terms, "token", "left_semi"), terms


def mask_weight(mask: Column, weights: tuple[float, ...] = WEIGHTS) -> Column:
    total = F.lit(0.0)
    for bit, weight in enumerate(weights):
        total = total + F.when(mask.bitwiseAND(F.lit(1 << bit)) != 0, weight).otherwise(0.0)
    return total


def search(postings: DataFrame, terms: DataFrame, n: int, queries: DataFrame, stars: DataFrame, id_col: str = "ord", top: int | None = None, distinct: bool = False) -> DataFrame:
    """qid, id, matched, score, rank for a table of queries (qid, q) at once.

    A token that a query repeats counts again unless ``distinct``. Facets may be applied to ``stars`` (id, stars) before:
    N and df stay those of the whole index. Queries join postings on tokens; the index is never sent whole anywhere.
    """
    words = queries.select("qid", F.explode(tokens(F.col("q"))).alias("token"))
    words = words.groupBy("qid", "token").agg(F.count("*").alias("times"))
    times = F.lit(1) if distinct else F.col("times")
    weighed = words.join(terms, "token").withColumn("idf", F.log(1.0 + F.lit(float(n)) / F.col("df")))
    part = F.col("idf") * (F.col("tf") / (1.0 + F.col("tf"))) * mask_weight(F.col("field_mask")) * times
    found = weighed.join(postings, "token").groupBy("qid", id_col).agg(F.sum(times).alias("matched"), F.sum(part).alias("score"))
    found = found.join(stars.select(id_col, "stars"), id_col)
    found = found.withColumn("score", F.col("score") * (1.0 + 0.5 * (F.col("matched") - 1)))
    order = [F.col("matched").desc(), F.bround("score", 9).desc(), F.col("stars").desc(), F.col(id_col)]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


#: Positions that one row of exported postings may span.
SPAN = 1 << 20


def export_postings(postings: DataFrame, id_col: str = "ord", span: int = SPAN) -> DataFrame:
    """token, block, and the token's (gap, code) pairs in order: a gap is the distance from the token's position before,
    the first one the position itself; code = tf * 1024 + field_mask.

    A common token has a row for each ``span`` positions, so no row grows with the catalog; its blocks one after another
    are the token's list.
    """
    entry = F.struct(F.col(id_col).alias("at"), (F.col("tf") * 1024 + F.col("field_mask")).alias("code"))
    lists = postings.groupBy("token", F.floor(F.col(id_col) / span).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("own"), F.max(id_col).alias("last"))
    lists = settled(lists, "postings")
    before = lists.select("token", "block", F.coalesce(F.lag("last").over(Window.partitionBy("token").orderBy("block")), F.lit(0)).alias("before"))
    pairs = F.transform("own", lambda x, i: F.struct((x["at"] - F.when(i == 0, F.col("before")).otherwise(F.get(F.col("own"), i - 1)["at"])).alias("gap"), x["code"].alias("code")))
    return lists.join(before, ["token", "block"]).select("token", "block", pairs.alias("postings"))

"""Sharding by balanced label propagation, with DataFrame functions only.

Every row has a size and may share links (hyperedges, here: equal texts) with others. Rows start on hashed shards.
In each round the links count their rows by shard, every linked row wishes to move to the shard that holds most of
its neighbours (a link too large for one shard: to one of the few that its bytes need), and a wish is granted while the
target's quota lasts. Targets are picked anew each round among the shards that have room, until no row wishes to
move or ``ROUNDS`` are over; rows that still wish to move then stay where they are, so more links may be cut but no row is lost.
A row that has no link fills what the linked rows leave free, so all shards end within one row of the same number of bytes.

How it scales: links are joined on a 128-bit key and counted with map-side sums, so a link that holds a third of all
rows costs one partial row per task and shard. Quotas are decided on a table of at most ``shards`` x ``BANDS`` sums
(that bound is fixed, so it is broadcast); nothing else leaves the executors. Running sums over all rows use hash
buckets: a sum per bucket, a running sum over the buckets, and one window inside each bucket.

Results for odd inputs: a null text has no bytes, size 8, crc32 0 and no links; null ids are one more row each; equal
rows are rows of their own; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

LAW = "bytes"
#: Acceptance bands of a quota: a wish falls into one of these by hash, so that a quota can be cut between two bands.
BANDS = 512
#: Rounds at most; most corpora need two or three.
ROUNDS = 8
#: Rows without links above a shard's share divided by this are placed before the others.
LARGE = 200
#: Share of a shard that linked rows may fill while they move; the rest is left to rows without links.
FILL = 0.97
#: The same where linked rows hold more than 9 tenths of all bytes: too full shards give rows back after the rounds.
CROWDED = 1.1


def _spread(*cols: str | Column) -> Column:
    return F.xxhash64(*cols, F.lit("spread"))


def _buckets(rows: int) -> int:
    """Buckets for running sums: about 50,000 rows each, and few enough for one task to add up their sums."""
    return max(256, min(16_384, rows // 50_000))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, crc32 and link key of each row; the key is null for a row without text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.when(F.col(text_col).isNotNull(), F.unhex(F.md5(text.cast("binary")))).alias("link"),
    )


def _tables(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Linked rows, and the keys that more than one row has."""
    keys = items.where(F.col("link").isNotNull()).groupBy("link").agg(F.count("*").alias("members")).where("members > 1")
    return items, stage(keys, "shard-links")


def propagate(linked: DataFrame, shards: int, capacity: float, rounds: int = ROUNDS) -> DataFrame:
    """Rounds of label propagation over (doc_id, row, size, text_crc32, link, label), until no row wishes to move or ``rounds`` are over.

    A link of G bytes needs k = ceil(G / capacity) shards. Its targets are the k shards with most of its rows among those
    that have room for its share there (G / k); ties go to the larger hash of link and shard. Where too few of the
    shards that it lies on have that room, those of all shards that have it follow, and last those without. Rows on a
    target stay; the others wish for one of the targets, picked by a hash of the row. Wishes for a shard are granted by
    bands of a hash until their sum reaches the room that is left at the beginning of the round, so loads never pass
    ``capacity`` by wishes. Links that need one shard fall into one band, so that their rows move together.
    """
    spark = linked.sparkSession
    for step in range(rounds):
        loads = linked.groupBy("label").agg(F.sum("size").alias("load"))
        room = (
            spark.range(shards)
            .select(F.col("id").cast("int").alias("label"))
            .join(F.broadcast(loads), "label", "left")
            .select("label", F.greatest(F.lit(0.0), F.lit(capacity) - F.coalesce("load", F.lit(0))).alias("room"))
        )
        room = stage(room, "shard-room")
        rooms = room.agg(F.sort_array(F.collect_list(F.struct("room", "label")), asc=False).alias("rooms"))  # one row
        # at most `shards` rows for each link, whatever its number of members
        held = linked.groupBy("link", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
        held = held.join(F.broadcast(room), "label")
        mine = F.struct("n", _spread("link", "label").alias("tie"), "label", "room", "bytes")
        per = held.groupBy("link").agg(F.sum("bytes").alias("g"), F.sort_array(F.collect_list(mine), asc=False).alias("held"))
        k = F.least(F.lit(shards), F.greatest(F.lit(1), F.ceil(F.col("g") / F.lit(capacity)))).cast("int")
        per = per.withColumn("k", k).withColumn("part", F.col("g") / F.col("k")).crossJoin(F.broadcast(rooms))
        fit = F.transform(F.filter("held", lambda x: x["room"] + x["bytes"] >= F.col("part")), lambda x: x["label"])
        free = F.transform(F.filter("rooms", lambda x: x["room"] >= F.col("part")), lambda x: x["label"])
        # which of the free shards comes first goes by the link, so that links don't all ask for the emptiest
        turn = F.pmod(_spread("link", F.lit(step)), F.greatest(F.size("free"), F.lit(1)).cast("long")).cast("int")
        turned = F.concat(F.slice("free", turn + 1, F.greatest(F.size("free"), F.lit(1))), F.slice("free", 1, turn))
        rest = F.transform("held", lambda x: x["label"])
        per = per.withColumns({"fit": fit, "free": free})
        targets = F.slice(F.array_distinct(F.concat(F.col("fit"), turned, rest)), 1, F.col("k"))
        best = stage(per.select("link", "k", targets.alias("targets")), "shard-targets")
        wish = F.when(F.array_contains("targets", F.col("label")), F.col("label")).otherwise(
            F.element_at("targets", (F.pmod(_spread("row", F.lit(step)), F.size("targets").cast("long")) + 1).cast("int"))
        )
        band = F.pmod(F.when(F.col("k") == 1, _spread("link", F.lit(step), F.lit("band"))).otherwise(_spread("row", F.lit(step), F.lit("band"))), F.lit(BANDS))
        wishes = stage(linked.join(best, "link").withColumns({"wish": wish, "band": band.cast("int")}).drop("targets", "k"), "shard-moves")
        asked = stage(wishes.where("wish <> label").groupBy("wish", "band").agg(F.sum("size").alias("asked")), "shard-asked")
        if asked.isEmpty():
            break
        running = F.sum("asked").over(Window.partitionBy("wish").orderBy("band"))
        granted = (
            asked.withColumn("upto", running)
            .join(F.broadcast(room.withColumnRenamed("label", "wish")), "wish")
            .where("upto <= room")
            .select("wish", "band", F.lit(True).alias("granted"))
        )  # at most shards x BANDS rows
        linked = stage(
            wishes.join(F.broadcast(granted), ["wish", "band"], "left").select(
                "doc_id", "row", "size", "text_crc32", "link",
                F.when(F.coalesce("granted", F.lit(False)), F.col("wish")).otherwise(F.col("label")).alias("label"),
            ),
            "shard-round",
        )
    return linked


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, under the law of equal bytes."""
    spark = docs.sparkSession
    items = sized(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "size", "text_crc32", F.monotonically_increasing_id()))
    items, keys = _tables(stage(items, "shard-rows"))
    n, total = items.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = total / shards
    start = F.pmod(F.col("row"), F.lit(shards)).cast("int")
    marked = stage(items.join(keys, "link", "left"), "shard-marked")
    linked = marked.where("members is not null").select("doc_id", "row", "size", "text_crc32", "link", start.alias("label"))
    crowded = _total(linked) > 0.9 * total
    linked = propagate(linked, shards, share * (CROWDED if crowded else FILL), rounds)
    loose = marked.where("members is null").select("doc_id", "row", "size", "text_crc32")
    if crowded:
        linked, back = _give_back(linked, share)
        loose = loose.unionByName(back)

    # Large rows first, then the small ones level what the large ones leave uneven.
    placed = linked.select("doc_id", "row", "size", "text_crc32", F.col("label").alias("shard"))
    buckets = _buckets(n)
    small = F.col("size") <= F.lit(share / LARGE)
    for part in (loose.where(~small), loose.where(small)):
        placed = stage(placed.unionByName(_fill(part, placed, share, shards, buckets)), "shard-placed")

    # Slots: the rows of a shard in all buckets before, then the place within the bucket.
    placed = placed.withColumn("bucket", F.pmod(_spread("row"), F.lit(buckets)).cast("int"))
    before = _running(placed.groupBy("shard", "bucket").agg(F.count("*").alias("v")), ["shard"], "bucket")
    nth = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("row", "doc_id"))
    before = before.withColumnRenamed("before", "earlier")
    return (
        placed.withColumn("nth", nth)
        .join(F.broadcast(before) if shards * buckets <= 400_000 else before, ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
            (F.col("earlier") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _fill(loose: DataFrame, placed: DataFrame, share: float, shards: int, buckets: int) -> DataFrame:
    """Give rows without links to the shards in proportion to the room that each has left.

    The rooms lie one after another on a line, and so do the rows, in the order of a hash; a row goes where its middle falls.
    """
    free = (
        loose.sparkSession.range(shards)
        .select(F.col("id").cast("int").alias("shard"))
        .join(F.broadcast(placed.groupBy("shard").agg(F.sum("size").alias("load"))), "shard", "left")
        .select("shard", F.greatest(F.lit(0.0), F.lit(share) - F.coalesce("load", F.lit(0))).alias("room"))
        .withColumn("to", F.sum("room").over(Window.orderBy("shard")))
    )
    ends = free.agg(F.sort_array(F.collect_list(F.struct("to", "shard"))).alias("ends"), F.max("to").alias("line"))  # one row
    loose = loose.withColumn("bucket", F.pmod(_spread("row"), F.lit(buckets)).cast("int"))
    before = _running(loose.groupBy("bucket").agg(F.sum("size").alias("v")), [], "bucket")
    inside = Window.partitionBy("bucket").orderBy("row", "doc_id")
    return (
        loose.withColumn("at", F.sum("size").over(inside) - F.col("size") / 2)
        .join(F.broadcast(before), "bucket")
        .crossJoin(F.broadcast(ends))
        .withColumn("at", (F.col("at") + F.col("before")) * F.col("line") / F.lit(float(max(1, _total(loose)))))
        .select("doc_id", "row", "size", "text_crc32", F.coalesce(F.expr("filter(ends, e -> e.to > at)[0].shard"), F.lit(shards - 1)).alias("shard"))
    )


def _give_back(linked: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and rows (by bands of a hash) that a shard holds beyond its share."""
    banded = linked.withColumn("band", F.pmod(_spread("row", F.lit("back")), F.lit(BANDS)).cast("int"))
    sums = banded.groupBy("label", "band").agg(F.sum("size").alias("v"))
    upto = F.sum("v").over(Window.partitionBy("label").orderBy("band"))
    over = sums.withColumn("upto", upto).where(F.col("upto") > F.lit(share)).select("label", "band", F.lit(True).alias("over"))
    banded = stage(banded.join(F.broadcast(over), ["label", "band"], "left"), "shard-over")  # at most shards x BANDS rows
    return banded.where("over is null").drop("band", "over"), banded.where("over").select("doc_id", "row", "size", "text_crc32")


def _running(sums: DataFrame, by: list[str], order: str) -> DataFrame:
    """Sum ``v`` of all buckets before, for each bucket; the table has one row per bucket (and shard)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, order, F.coalesce(F.sum("v").over(w), F.lit(0)).alias("before"))


def _total(loose: DataFrame) -> int:
    return loose.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def cut(assigned: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality of an assignment: links, links that lie on more than one shard, and surplus shards of links."""
    keys = sized(items, id_col, text_col).where("link is not null").select("doc_id", "link")
    per = keys.join(assigned.select("doc_id", "shard"), "doc_id").groupBy("link", "shard").agg(F.count("*").alias("n"))
    per = per.groupBy("link").agg(F.count("*").alias("parts"), F.sum("n").alias("n")).where("n > 1")
    return per.agg(
        F.count("*").alias("links"),
        F.coalesce(F.sum((F.col("parts") > 1).cast("long")), F.lit(0)).alias("cut_links"),
        F.coalesce(F.sum(F.col("parts") - 1), F.lit(0)).alias("surplus_parts"),
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))

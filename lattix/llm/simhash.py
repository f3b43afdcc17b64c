"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has 64 bits; a bit is set if it is set in more than half of the hashes of its word shingles, repeats
included. Two fingerprints link if they differ in ``BITS`` (2) bits or fewer. Search: the fingerprint is cut into two
segments of 32 bits, so one of them differs in at most one bit. Each segment is indexed as it is and with each of its
bits left out (33 variants); fingerprints that agree on a variant are joined and held against the whole distance.

How it scales: only distinct fingerprints are indexed, so a group of copies of any size counts once. Variants are counted
with sums per task before the shuffle, and most occur once and go no further; one that two fingerprints share is their pair
(its least and greatest); the members of the others are joined back, a join that adaptive execution splits where a
variant is hot. A variant of up to ``SMALL`` fingerprints yields their pairs. Beyond that no pairs are made: its fingerprints are joined on their 65 points at a distance of 0 or 1; two
fingerprints share such a point exactly if they differ in 2 bits or fewer, so linking all that share a point to the
smallest of them loses nothing. Components are found on fingerprints and joined back to the rows.

``near_duplicates`` is for texts alike in ``similarity`` of their shingles. Its candidates are the links of the fingerprints
as above and, as those at 2 bits don't reach that far (at 0.8 about 10 of 64 bits differ), texts that share a key of
MinHashes over all 5-word shingles. Every candidate is verified by its exact shingles: texts of one template, alike in less,
come within 2 bits of each other by chance (about 1 pair in 1,000 at 0.77), which would chain them into one class.

Results for odd inputs: a null or blank text has fingerprint zero and links as any other; fewer words than a shingle has
make one shingle; repeated rows share their class; a null id gets the class of its text; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import discard, few, release, spare, stage, told_apart
from .words import SEED, WordHashes, fold, mix, rows, small, windows

BITS = 2
SHINGLE = 3
SEGMENT = 32
#: Fingerprints that a variant may have for its pairs to be made one by one.
SMALL = 8


def shingle_digests(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words joined by a space, as rows of 8 bytes, highest first."""
    if not words:
        return np.empty((0, 8), dtype=np.uint8)
    text = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    runs = zip(starts, ends[width - 1 :]) if len(words) > width else [(0, len(text))]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(text[a:b], SEED) for a, b in runs]), dtype=np.uint8).reshape(-1, 8)


def majority(digests: np.ndarray) -> int:
    """The fingerprint of some hashes as a signed 64-bit integer."""
    if not len(digests):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(digests), 32_768):
        votes += np.unpackbits(digests[k : k + 32_768], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(digests)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, fp of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for ids, texts in rows(batches):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([majority(shingle_digests(fold(t), width)) for t in texts], pa.int64())], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """fp, variant, side: 33 for each segment. side is the bit left out; the variant without a gap has side null."""
    mask = (1 << SEGMENT) - 1
    out = []
    for s in range(2):
        part = F.shiftrightunsigned("fp", s * SEGMENT).bitwiseAND(F.lit(mask))
        out.append(F.struct((part + F.lit((s * 64 + SEGMENT) << SEGMENT)).alias("variant"), F.lit(None).cast("int").alias("side")))
        for i in range(SEGMENT):
            side = F.shiftrightunsigned("fp", s * SEGMENT + i).bitwiseAND(F.lit(1)).cast("int")
            cut = part.bitwiseAND(F.lit(mask ^ (1 << i)))
            out.append(F.struct((cut + F.lit((s * 64 + i) << SEGMENT)).alias("variant"), side.alias("side")))
    return fps.select("fp", F.inline(F.array(*out)))


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b for distinct fingerprints: enough pairs within ``bits`` to connect all that are so linked."""
    if not 0 <= bits <= BITS:
        raise ValueError("two segments find up to 2 differing bits")
    marks = variants(fps)
    held = marks.groupBy("variant").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    held = stage(held, "simhash-held")
    twos = held.where("n = 2").select("a", "b")
    crowded = few(stage(held.where("n > 2").select("variant", "n"), "simhash-crowded"))
    shared = stage(marks.join(crowded, "variant"), "simhash-shared")
    some = shared.where(F.col("n") <= SMALL)
    x, y = some.select("variant", F.col("fp").alias("a"), F.col("side").alias("x")), some.select("variant", F.col("fp").alias("b"), F.col("side").alias("y"))
    # a gap pairs the two sides of its bit only: equal segments meet in the variant without a gap
    pairs = x.join(y, "variant").where("(x is null and a < b) or x < y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.unionByName(twos)
    crowd = shared.where(F.col("n") > SMALL).select("fp").distinct()
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    points = crowd.select("fp", F.explode(points).alias("point"))
    points = stage(points, "simhash-points")
    first = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("k")).where("k > 1").select("point", "a")
    stars = points.join(first, "point").select("a", F.col("fp").alias("b")).where("a < b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    return pairs.unionByName(stars).where(near).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id (smallest id reachable over links) of every row."""
    marked = stage(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    linked = stage(components(links(distinct.select("fp"), bits)), "simhash-components")
    named = linked.join(distinct, linked["node"] == distinct["fp"]).groupBy("component").agg(F.min("first").alias("component_id"))
    linked = linked.join(named, "component").select("node", "component_id")
    known = distinct.join(linked, distinct["fp"] == linked["node"], "left")
    known = stage(known.select("fp", F.coalesce("component_id", "first").alias("component_id")), "simhash-classes")
    return marked.join(known, "fp")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates by similarity.

#: Words of a shingle and least similarity, unless a contract says otherwise.
WORDS = 5
SIMILARITY = 0.8
#: A text's least shingles under BANDS x ROWS hashes, ROWS at a time, are its keys. Two texts alike in 0.8 share no key
#: with a chance of (1 - 0.8 ** ROWS) ** BANDS, about 3 in a million, whatever their length.
BANDS, ROWS = 24, 4
#: Texts of common keys meet by their rarest shingles: 2 ** CELLS cells count shingles, and sizes within about 5 % share a band.
CELLS = 22
BAND = 1.05


def shingle_hashes(words: list[bytes], cache: WordHashes, width: int) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` words; a shorter text is one run."""
    return np.unique(windows(cache.array(words), min(width, len(words)))) if words else np.zeros(1, dtype=np.uint64)


def _least(shingles: np.ndarray, n: int, first: int) -> np.ndarray:
    """The least of a text's distinct shingles under each of ``n`` hashes, those from ``first`` on."""
    odd = (mix(np.arange(first, first + n, dtype=np.uint64)) | np.uint64(1))[:, None]
    salt = mix(np.arange(first + 1_000_000, first + 1_000_000 + n, dtype=np.uint64))[:, None]
    least = np.full((n, 1), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 1024):
        least = np.minimum(least, (mix(shingles[k : k + 1024] ^ salt[:1]) * odd ^ salt).min(1, keepdims=True))
    return least[:, 0]


def _joined(rows: np.ndarray) -> np.ndarray:
    """One key for each row of hashes."""
    keys = np.arange(len(rows), dtype=np.uint64)
    for r in range(rows.shape[1]):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return keys.view(np.int64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The keys of a text from its distinct shingles."""
    return _joined(_least(shingles, BANDS * ROWS, 1).reshape(BANDS, ROWS))


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELLS)).astype(np.int64)


def _size_band(size) -> np.ndarray:
    return np.floor(np.log(size) / np.log(BAND)).astype(np.int64)


def prefix_keys(shingles: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a text from its distinct shingles, and for each how many shingles are left from its place on.

    Shingles stand in order from the rarest cell of ``counts`` to the commonest. Texts of sizes n and s that are alike have
    at least ``similarity / (1 + similarity) * (n + s)`` shingles in common, and the first of these has as many left in both.
    So a shingle is a key towards a band of sizes only if enough are left from it on, and one whose cell counts one text is
    none. A key is a shingle with the size bands of both sides, the smaller first: texts alike always share one.
    """
    n, share = len(shingles), similarity / (1 + similarity)
    held = counts[_cells(shingles)]
    order = np.lexsort((shingles, held))
    ranked, shared = shingles[order], held[order] > 1
    own = int(_size_band(n))
    keys, left = [], []
    for band in range(int(_size_band(max(1, np.ceil(similarity * n - 1e-6)))), int(_size_band(np.floor(n / similarity + 1e-6))) + 1):
        least = max(BAND**band * (1 - 1e-9), similarity * n)
        places = np.flatnonzero(shared[: max(0, int(n + 1 - share * (n + least) + 1e-6))])
        bands = mix(np.array([min(own, band) * 4096 + max(own, band)], dtype=np.uint64))
        keys.append(mix(ranked[places] ^ bands))
        left.append(n - places)
    return np.concatenate(keys).view(np.int64), np.concatenate(left)


def _sketch(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.int64()), ("keys", pa.list_(pa.int64())), ("fp", pa.int64())])

    def run(batches):
        cache = WordHashes()
        for ids, texts in rows(batches):
            sizes, keys, fps = [], [], []
            for t in texts:
                words = fold(t)
                found = shingle_hashes(words, cache, width)
                sizes.append(len(found))
                keys.append(band_keys(found))
                fps.append(majority(shingle_digests(words, SHINGLE)))
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, schema.field("keys").type), pa.array(fps, pa.int64())]
            yield pa.record_batch(columns, schema=schema)

    return run


SKETCH = "doc_id long, shingles long, keys array<long>, fp long"


def _counted(width: int):
    """cell, n: how many texts of a task have a shingle in each cell (repeats of a cell in one text count)."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches):
        cache, counts = WordHashes(), np.zeros(1 << CELLS, dtype=np.int32)
        for _, texts in rows(batches):
            for t in texts:
                np.add.at(counts, _cells(shingle_hashes(fold(t), cache, width)), 1)
        found = np.flatnonzero(counts)
        for k in range(0, len(found), 100_000):
            some = found[k : k + 100_000]
            yield pa.record_batch([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], schema=schema)

    return run


def _prefixes(width: int, similarity: float, shared):
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.int64()), ("keys", pa.list_(pa.int64())), ("left", pa.list_(pa.int64()))])

    def run(batches):
        cache, counts = WordHashes(), shared.value
        for ids, texts in rows(batches):
            found = [shingle_hashes(fold(t), cache, width) for t in texts]
            both = [prefix_keys(f, counts, similarity) for f in found]
            keys, left = (pa.array([b[k] for b in both], schema.field("keys").type) for k in (0, 1))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(f) for f in found], pa.int64()), keys, left], schema=schema)

    return run


def _alike(width: int, similarity: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])  # rows are b, a and their texts, in the order of b

    def shingles(text):
        w = fold(text)
        return {b" ".join(w)} if len(w) <= width else {b" ".join(t) for t in zip(*(w[k:] for k in range(width)))}

    def run(batches):
        for batch in small(batches):
            one, other, text, others = (batch.column(k).to_pylist() for k in range(4))
            out, last, seen = [], object(), set()
            for i in range(len(one)):
                if one[i] != last:
                    last, seen = one[i], shingles(text[i])
                found = shingles(others[i])
                both = len(seen & found)
                if both >= similarity * (len(seen) + len(found) - both) - 1e-9:
                    out.append(i)
            yield pa.record_batch([pa.array([x[i] for i in out], pa.int64()) for x in (other, one)], schema=schema)

    return run


def _by_fingerprint(sketch: DataFrame) -> DataFrame:
    """x, sx, y, sy: texts whose fingerprints link, with their numbers of shingles.

    Texts of one fingerprint meet the first of them, and the first texts of linked fingerprints meet.
    """
    firsts = stage(sketch.groupBy("fp").agg(F.min(F.struct("doc_id", "shingles")).alias("first")), "near-fingerprints")
    first = firsts.select("fp", F.col("first.doc_id").alias("x"), F.col("first.shingles").alias("sx"))
    one = sketch.select("fp", F.col("doc_id").alias("y"), F.col("shingles").alias("sy")).join(first, "fp").where("x <> y").drop("fp")
    linked = stage(links(firsts.select("fp")), "near-linked")
    other = first.toDF("b", "y", "sy")
    return one.select("x", "sx", "y", "sy").unionByName(linked.join(first.withColumnRenamed("fp", "a"), "a").join(other, "b").select("x", "sx", "y", "sy"))


def _verified(found: DataFrame, base: DataFrame, width: int, similarity: float) -> DataFrame:
    """The candidates a, b whose shingles are alike. Only the texts of candidates move, to meet their partners."""
    asked = stage(found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-asked")
    texts = stage(base.join(few(asked), "doc_id", "left_semi"), "near-texts")
    left = found.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")).hint("merge"), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")).hint("merge"), "b").select("b", "a", "right", "left")
    links = stage(both.mapInArrow(_alike(width, similarity), "a long, b long"), "near-links")
    discard(texts)
    release(found.sparkSession)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id: classes of rows with equal texts or linked by ``similarity`` of their shingles or more.

    Candidates: texts whose fingerprints link (see ``links``), and texts that share a key (``BANDS``). Copies count once, with
    their number. A key of up to ``SMALL`` texts yields their pairs. The texts of a commoner one are first held against two of them: the one whose keys are shared
    most, as those of a family's origin are, and one picked by a hash. Whatever is not linked by then is held against all
    texts with which it shares one of its rarest shingles (see ``_apart``): only the texts of the largest class there need not meet. Rows of one id (or none) are told apart by ``first_of_each``; here such rows
    with equal texts share their class, and rows with a null id are left out.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    keyed = stage(base.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("same")), "near-keys")
    same = stage(keyed.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "near-copies")
    sketch = base.mapInArrow(_sketch(width), SKETCH)
    sketch = stage(sketch.join(same.select(F.col("rep").alias("doc_id")), "doc_id"), "near-sketch")

    tall = sketch.select("doc_id", "shingles", F.explode("keys").alias("key"))
    held = stage(tall.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-held")
    met = stage(tall.join(held, "key"), "near-met")
    alike = F.least("sx", "sy") >= similarity * F.greatest("sx", "sy")
    small = met.where(F.col("n") <= SMALL).select("key", "doc_id", "shingles")
    pairs = small.toDF("key", "x", "sx").join(small.toDF("key", "y", "sy"), "key").where("x < y").where(alike).select("x", "y")
    large = met.where(F.col("n") > SMALL).select("key", "doc_id", "shingles", "n")
    shared = large.groupBy("doc_id").agg(F.sum("n").alias("shared"))
    large = stage(large.drop("n").join(shared, "doc_id"), "near-large")
    me = F.struct("shared", (-F.col("doc_id")).alias("id"), "shingles")
    dice = F.struct(F.xxhash64("doc_id", "key").alias("h"), (-F.col("doc_id")).alias("id"), "shingles")
    hubs = stage(large.groupBy("key").agg(F.max(me).alias("top"), F.max(dice).alias("any")), "near-hubs")
    hub = F.explode(F.array(*[F.struct(F.col(h)["id"].alias("id"), F.col(h)["shingles"].alias("s")) for h in ("top", "any")]))
    stars = large.join(hubs, "key").select(F.col("doc_id").alias("y"), F.col("shingles").alias("sy"), hub.alias("o"))
    stars = stars.select((-F.col("o.id")).alias("x"), F.col("o.s").alias("sx"), "y", "sy").where("x <> y").where(alike).select("x", "y")
    close = _by_fingerprint(sketch).where(alike).select("x", "y")
    found = pairs.unionByName(stars).unionByName(close).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    found = stage(found, "near-candidates")
    sure = _verified(found, base, width, similarity)

    rest = _apart(large, sure, base, width, similarity)
    if rest is not None:
        rest = stage(rest.join(found, ["a", "b"], "left_anti"), "near-candidates")
        sure = sure.unionByName(_verified(rest, base, width, similarity))
    linked = components(sure).select(F.col("node").alias("rep"), "component")
    classed = stage(same.join(linked, "rep", "left").select("same", F.coalesce("component", "rep").alias("component_id")), "near-classes")
    return keyed.join(classed, "same").select("doc_id", "component_id")


def _apart(large: DataFrame, sure: DataFrame, base: DataFrame, width: int, similarity: float) -> DataFrame | None:
    """a, b: pairs of texts of common keys that the links so far leave in two classes; None without any.

    What common keys stand for is mostly a passage or a template; so these texts meet by their rarest shingles
    (``prefix_keys``), which finds every pair that is alike, and only texts of two classes that share such a key are
    paired. How rare a shingle is comes from one table of 2 ** ``CELLS`` counts, whose size doesn't depend on the texts.
    """
    if large.isEmpty():
        return None
    spark = base.sparkSession
    linked = components(sure).select(F.col("node").alias("doc_id"), "component")
    named = large.join(linked, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("class"))
    open_ = stage(_divided(stage(named, "near-named"), "key").select("doc_id", "class").distinct(), "near-mixed")
    texts = stage(base.join(few(open_.select("doc_id")), "doc_id", "left_semi"), "near-open-texts")
    cells = texts.mapInArrow(_counted(width), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    counts = np.ones(1 << CELLS, dtype=np.int32)
    counts[cells["cell"].to_numpy()] = np.minimum(cells["n"].to_numpy(), np.iinfo(np.int32).max)
    shared = spark.sparkContext.broadcast(counts)
    keyed = texts.mapInArrow(_prefixes(width, similarity, shared), "doc_id long, shingles long, keys array<long>, left array<long>")
    keyed = keyed.select("doc_id", "shingles", F.explode(F.arrays_zip("keys", "left")).alias("k")).select("doc_id", "shingles", F.col("k.keys").alias("key"), F.col("k.left").alias("left"))
    keyed = stage(keyed.join(open_, "doc_id"), "near-prefixes")
    open_ = stage(_divided(keyed, "key"), "near-apart")
    if open_.isEmpty():
        return None
    x = open_.where("class <> most").select("key", F.col("doc_id").alias("x"), F.col("shingles").alias("sx"), F.col("left").alias("lx"), F.col("class").alias("cx"))
    y = open_.select("key", F.col("doc_id").alias("y"), F.col("shingles").alias("sy"), F.col("left").alias("ly"), F.col("class").alias("cy"))
    enough = F.least("lx", "ly") >= similarity / (1 + similarity) * (F.col("sx") + F.col("sy")) - 1e-6
    pairs = x.join(y, "key").where("cx <> cy").where(enough)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _divided(named: DataFrame, key: str) -> DataFrame:
    """The rows of keys that have texts of several classes, with the class that most of them have."""
    counts = named.groupBy(key, "class").agg(F.count("*").alias("k"))
    most = counts.groupBy(key).agg(F.count("*").alias("classes"), F.max(F.struct("k", "class"))["class"].alias("most")).where("classes > 1")
    return named.join(stage(most.select(key, "most"), "near-open"), key)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class: the one with the smallest id.

    Rows are told apart even where ids repeat or are null: of equal rows one stays, and a null id comes after all others.
    """
    docs, row = told_apart(docs, id_col)
    found = near_duplicates(docs, row, text_col)
    gone = spare(docs, "__gone")
    drop = few(stage(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)), "near-drop"))
    left = docs.join(drop, F.col(row) == F.col(gone), "left_anti")
    return left if row == id_col else left.drop(row)

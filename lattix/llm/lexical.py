"""Ranked lexical search of a set of items over all documents, by dense blocked matrix multiplication.

A document's score for an item sums, over the item's terms with repeats, the term's weight times a saturating share of
its occurrences (see ``impacts``), all in whole numbers. Items are cut into tiles of ``ITEM_TILE`` items and ``VOCAB_TILE``
of their terms. For ``DOC_TILE`` documents at a time the impacts of a tile's terms are laid out as a dense matrix of
doubles, and one BLAS multiplication by the item tile's term counts gives all partial scores. Every product and partial
sum of a tile is below 2^53 by construction (a tile is closed, or a term's count divided, before it could be passed), so the doubles hold whole
numbers exactly in whatever order they are added; tiles are added up as 64-bit integers. A task keeps the best ``k``
documents of each item; what ties with the k-th is kept until ids decide.

How it scales: documents are read twice (statistics, scores) and never shuffled; a task holds one document tile. Items are
the query set; they travel in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters (an item above that is
a block of its own), so statistics that come back to the driver are those of a block's terms, and what is broadcast has
that bound. Each task sends ``k`` rows an item, which are ranked within ``SALTS`` groups first and then together.

Results for odd inputs: items and documents that are null or have no terms match nothing; items are rows of their own even
where they or their ids repeat; repeated documents are rows of their own; equal scores go by ascending id, a null id last;
without documents or items the result is empty; other columns are not read.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage
from .words import small

TOP = 20
ITEM_TILE, VOCAB_TILE, DOC_TILE = 64, 2048, 512
BLOCK_ITEMS, BLOCK_CHARS = 4_000, 2_000_000
SALTS = 64
#: Partial sums of doubles stay below this.
EXACT = 1 << 53
#: What a term's share of occurrences stays below.
SHARE = 1_000_000
_KEPT = string.digits + string.ascii_letters
#: Lower-cases A-Z, keeps digits, letters and all bytes from 0x80 on; everything else parts terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b) in _KEPT else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Items of a block: their rows, ids, term counts, and the numbers of their distinct terms."""

    def __init__(self, rows: list[tuple]):
        self.rows = [(row, item) for row, item, _ in rows]
        self.number: dict[bytes, int] = {}
        self.counts = [{self.number.setdefault(t, len(self.number)): c for t, c in Counter(terms(text)).items()} for _, _, text in rows]

    def tiles(self, weights: list[int]) -> list[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
        """(first item, items, [(term numbers, item x term counts)]) with every possible partial sum below ``EXACT``."""
        out = []
        for first in range(0, len(self.counts), ITEM_TILE):
            group = self.counts[first : first + ITEM_TILE]
            left: dict[int, dict[int, int]] = {}
            for i, counts in enumerate(group):
                for t, c in counts.items():
                    if weights[t] > 0:
                        left.setdefault(t, {})[i] = c
            parts = []
            while left:
                load, taken = [0] * len(group), []
                for t in sorted(left)[:VOCAB_TILE]:
                    unit = weights[t] * SHARE
                    fits = {i: min(c, (EXACT - 1 - load[i]) // unit) for i, c in left[t].items()}
                    for i, c in fits.items():
                        load[i] += c * unit
                    left[t] = {i: c - fits[i] for i, c in left[t].items() if c > fits[i]}
                    if not left[t]:
                        del left[t]
                    if any(fits.values()):
                        taken.append((t, fits))
                counts = np.zeros((len(group), len(taken)))
                for k, (_, fits) in enumerate(taken):
                    counts[list(fits), k] = list(fits.values())
                parts.append((np.array([t for t, _ in taken], dtype=np.int64), counts))
            out.append((first, len(group), parts))
        return out


def _statistics(block):
    """term number (-1: documents with terms, -2: terms) and its count, for the documents of a task."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches):
        number = block.value.number
        df, docs, total = np.zeros(len(number), dtype=np.int64), 0, 0
        for batch in small(batches):
            texts = batch.column(0)
            for i in range(len(texts)):
                found = terms(texts[i].as_py())
                docs += bool(found)
                total += len(found)
                df[[number[t] for t in number.keys() & set(found)]] += 1
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.concatenate([held, [-1, -2]])), pa.array(np.concatenate([df[held], [docs, total]]))], schema=schema)

    return run


def impacts(tf: np.ndarray, weights: np.ndarray, m: np.ndarray) -> np.ndarray:
    """weight * (10^9 tf div (1000 tf + 12 m)), m being the document's length measure."""
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Best:
    """The best ``k`` documents of each item of a tile. Rows are pruned only when ids have decided between equal scores."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, dtype=np.int64)
        self.found = [np.empty(0, dtype=np.int64)] * 4  # item, score, id missing, id

    def add(self, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.found = [np.concatenate(x) for x in zip(self.found, (item, scores[item, doc], missing[doc], ids[doc]))]
        if len(self.found[0]) > 4 * self.k * len(self.least):
            self.prune()

    def prune(self) -> list[np.ndarray]:
        item, score, missing, ids = self.found
        order = np.lexsort((ids, missing, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        self.found = [x[order][place < self.k] for x in self.found]
        last = place == self.k - 1
        self.least[item[last]] = score[order][last]
        return self.found


_HITS = pa.schema([("item_row", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _scores(block, model, k: int):
    def run(batches):
        items, (weights, tiles, n_docs, total) = block.value, model.value
        known, best = items.number.get, [Best(n, k) for _, n, _ in tiles]

        def score(rows: list[tuple]) -> None:
            ids = np.array([i or 0 for i, _, _ in rows], dtype=np.int64)
            missing = np.array([i is None for i, _, _ in rows], dtype=np.int64)
            m = np.array([75 + 25 * n * n_docs // total for _, n, _ in rows], dtype=np.int64)
            doc = np.repeat(np.arange(len(rows)), [len(t) for _, _, t in rows])
            number = np.concatenate([np.array(t, dtype=np.int64) for _, _, t in rows])
            cell, tf = np.unique(number * len(rows) + doc, return_counts=True)  # by term, then document
            number, doc = cell // len(rows), cell % len(rows)
            value = impacts(tf, weights[number], m[doc]).astype(np.float64)
            for (_, n, parts), top in zip(tiles, best):
                scores = np.zeros((n, len(rows)), dtype=np.int64)
                for own, counts in parts:
                    place = np.minimum(np.searchsorted(own, number), len(own) - 1)
                    inside = own[place] == number
                    dense = np.zeros((len(own), len(rows)))
                    dense[place[inside], doc[inside]] = value[inside]
                    scores += (counts @ dense).astype(np.int64)
                top.add(scores, missing, ids)

        waiting: list[tuple] = []
        for batch in small(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc_id in enumerate(ids):
                found = terms(texts[i].as_py())
                numbers = [t for t in map(known, found) if t is not None]
                if numbers:
                    waiting.append((doc_id, len(found), numbers))
                if len(waiting) == DOC_TILE:
                    score(waiting)
                    waiting = []
        if waiting:
            score(waiting)
        for (first, _, _), top in zip(tiles, best):
            item, points, missing, ids = top.prune()
            rows, names = zip(*(items.rows[first + i] for i in item)) if len(item) else ((), ())
            yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(names, pa.int64()), pa.array(ids, pa.int64(), mask=missing.astype(bool)), pa.array(points)], schema=_HITS)

    return run


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[tuple], bool]]:
    """Blocks of (row, id, text) within both bounds, and whether another follows; the driver holds one and the row after it."""
    block, chars = [], 0
    for row, (item, text) in enumerate(items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator()):
        if block and (len(block) >= BLOCK_ITEMS or chars + len(text or "") > BLOCK_CHARS):
            yield block, True
            block, chars = [], 0
        block.append((row, item, text))
        chars += len(text or "")
    yield block, False


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_row (the item's place in ``items``), item_id, rank, doc_id, score: the best ``k`` documents of each item with a score above 0."""
    send = docs.sparkSession.sparkContext.broadcast
    texts = docs.select(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    found = []
    for queries, more in _blocks(items, item_col, item_text_col):
        block = Block(queries)
        sent = send(block)
        counted = texts.mapInArrow(_statistics(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        n = dict(zip(counted.column("term").to_pylist(), counted.column("n").to_pylist()))
        n_docs, total = n.get(-1, 0), n.get(-2, 0)
        weights = [weight(n_docs, n[t]) if t in n else 0 for t in range(len(block.number))]
        model = send((np.array(weights, dtype=np.int64), block.tiles(weights), n_docs, total))
        hits = rows.mapInArrow(_scores(sent, model, k), "item_row long, item_id long, doc_id long, score long")
        hits = hits.withColumn("salt", F.spark_partition_id() % SALTS)
        for keys in (["item_row", "salt"], ["item_row"]):
            order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
            hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        hits = hits.select("item_row", "item_id", "rank", "doc_id", "score")
        if more or found:  # each block's result is written before the next is sent
            hits = stage(hits, "search")
            sent.destroy()
            model.destroy()
        found.append(hits)
    return reduce(DataFrame.unionAll, found)


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return search(docs, items).select("item_id", "rank", "doc_id", "score")


_TERMS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS l FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, {_TERMS_SQL} AS l FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(l)) AS BIGINT) AS total FROM d WHERE len(l) > 0),
q AS (SELECT i, item_id, t, count(*) AS q FROM (SELECT i, item_id, unnest(l) AS t FROM b) GROUP BY ALL),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(l) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM f GROUP BY t), s),
m AS (SELECT r, doc_id, 75 + (25 * len(l) * n_docs) // total AS m FROM d, s),
p AS (SELECT i, item_id, r, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT p.item_id, m.doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, m.doc_id NULLS LAST) AS rank
      FROM p JOIN m USING (r) WHERE score > 0) WHERE rank <= {TOP}"""

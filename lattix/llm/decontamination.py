"""Benchmark decontamination by size-partitioned MinHash containment search.

Finds test items that lie inside documents of any length. A short item has a tiny Jaccard similarity with a long
document, so sizes are partitioned: items fall into classes by their number of shingles (4 to 7, 8 to 15, ...), and for
each class the words of a task's documents are seen as overlapping windows of three times the class's least size, one of
which holds an item of the class whole wherever it lies. Inside a window containment t bounds the similarity from below
(0.25 at t = 0.8), and one equal MinHash value among ``HASHES`` makes a candidate. Every candidate pair is verified: the share of the item's distinct shingles that the document holds.

How it scales: documents are read once and not shuffled. Items are the query set; their texts are broadcast in blocks of at
most ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters (an item above that is a block of its own). The driver holds two
blocks at most: it reads the items as a stream, one block ahead, and each block's pass over the documents is done, and its
result written, before the next is sent. So a benchmark of any size works, however its items repeat. Windows live only inside a task.

Words are lower-cased, with ASCII punctuation taken as white space. An item of fewer than five words is one shingle of
its own length. Results for odd inputs: items and documents that are null or have no words match nothing; repeated items
and documents are rows of their own; ids may be null; empty tables give an empty result; other columns are not read, or kept
as they are (``clean``).
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, stage
from .words import SEED, WordHashes, small, windows

WORDS = 5
CONTAINMENT = 0.8
HASHES = 24
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 20_000_000
#: Words of documents that a task searches at a time.
STREAM = 500_000
_FOLD = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation))
_RNG = np.random.default_rng(SEED)
_ODD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plain_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split() if text else []


def size_class(n: int) -> int:
    """The power of two not above ``n``."""
    return 1 << (n.bit_length() - 1)


def _blocks(values: np.ndarray, size: int) -> np.ndarray:
    """Least value of each ``size`` values; the last block may be short."""
    whole = len(values) // size * size
    least = values[:whole].reshape(-1, size).min(1)
    return np.append(least, values[whole:].min()) if whole < len(values) else least


class Items:
    """A block of items: shingle hashes of each, and per shingle width and size class their sorted MinHash values."""

    def __init__(self, rows: list[tuple], cache: WordHashes):
        self.shingles: list[set] = []
        self.widths: list[int] = []
        self.ids = [r[0] for r in rows]
        found: dict[tuple[int, int], list] = {}
        for i, (_, text) in enumerate(rows):
            words = plain_words(text)
            width = min(WORDS, len(words))
            own = np.unique(windows(cache.array(words), width)) if words else np.empty(0, dtype=np.uint64)
            self.shingles.append(set(own.tolist()))
            self.widths.append(width)
            if words:
                # the class goes by the shingles as they lie in a text, repeats included
                found.setdefault((width, size_class(len(words) - width + 1)), []).append((i, own))
        self.index = {}
        for key, members in found.items():
            tables = []
            for k in range(HASHES):
                least = np.array([(own * _ODD[k]).min() for _, own in members])
                order = np.argsort(least, kind="stable")
                tables.append((least[order], np.array([i for i, _ in members])[order]))
            self.index[key] = tables

    def matches(self, h: np.ndarray, ends: np.ndarray):
        """(document, item, shared, of) for documents whose words' hashes ``h`` lie one after another up to ``ends``."""
        starts = np.concatenate([[0], ends[:-1]])
        candidates: set[tuple[int, int]] = set()
        runs = {width: windows(h, width) for width, _ in self.index}
        for width in (w for w in runs if len(runs[w])):
            steps = sorted(size for w, size in self.index if w == width)
            for k in range(HASHES):
                least, step = runs[width] * _ODD[k], 1
                for size in steps:
                    least, step = _blocks(least, size // step), size
                    window = least.copy()
                    for ahead in (1, 2):
                        window[:-ahead] = np.minimum(window[:-ahead], least[ahead:])
                    table, members = self.index[width, size][k]
                    at = np.searchsorted(table, window)
                    at[at == len(table)] = 0
                    for place in np.flatnonzero(table[at] == window).tolist():
                        a, b = np.searchsorted(table, window[place], "left"), np.searchsorted(table, window[place], "right")
                        first = np.searchsorted(ends, place * size, "right")
                        last = np.searchsorted(starts, (place + 3) * size + width, "left")
                        candidates.update((d, i) for d in range(first, last) for i in members[a:b].tolist())
        for d, i in sorted(candidates):
            own = self.shingles[i]
            width = self.widths[i]
            shared = len(own.intersection(runs[width][starts[d] : max(starts[d], ends[d] - width + 1)].tolist()))
            if shared >= CONTAINMENT * len(own) - 1e-9:
                yield d, i, shared, len(own)


def _found(items: Items, cache: WordHashes, texts: pa.Array):
    """(row, item, shared, of) for a batch of texts, ``STREAM`` words at a time."""
    first, words, ends, total = 0, [], [], 0
    for i in range(len(texts)):
        own = plain_words(texts[i].as_py())
        words.append(b"".join(map(cache.__getitem__, own)))
        ends.append(total := total + len(own))
        if total >= STREAM or i == len(texts) - 1:
            h = np.frombuffer(b"".join(words), dtype="<u8")
            for d, m, shared, of in items.matches(h, np.array(ends)):
                yield first + d, m, shared, of
            first, words, ends, total = i + 1, [], [], 0


def _search(block):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int64()), ("of", pa.int64())])

    def run(batches):
        cache = WordHashes()
        items = Items(block.value, cache)
        for batch in small(batches):
            ids = batch.column(0).to_pylist()
            out = [(ids[d], items.ids[m], shared, of) for d, m, shared, of in _found(items, cache, batch.column(1))]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], schema=schema)

    return run


def _without(block, text_col: str):
    def run(batches):
        cache = WordHashes()
        items = Items(block.value, cache)
        for batch in small(batches):
            clean = np.ones(batch.num_rows, dtype=bool)
            clean[[d for d, *_ in _found(items, cache, batch.column(batch.schema.get_field_index(text_col)))]] = False
            yield batch.filter(pa.array(clean))

    return run


def _blocks_of(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Blocks of (id, text), each within both bounds; only one of them is held."""
    queries = items.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    block, chars = [], 0
    for row in queries.toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(row[1]) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append(tuple(row))
        chars += len(row[1])
    yield block


def _each(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[Broadcast, bool]]:
    """The blocks one by one as broadcasts, and whether another follows."""
    blocks = _blocks_of(items, item_col, text_col)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        yield items.sparkSession.sparkContext.broadcast(block), following is not None
        block = following


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, shared, of: documents that hold ``CONTAINMENT`` of an item's distinct shingles or more."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    found = []
    for block, more in _each(items, item_col, item_text_col):
        part = rows.mapInArrow(_search(block), "doc_id long, item_id long, shared long, of long")
        if more or found:
            part = stage(part, "leaks")
            block.destroy()
        found.append(part)
    return reduce(DataFrame.unionAll, found)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns; nothing is shuffled.

    With more than one block, what each leaves is written for the next.
    """
    last = None
    for block, more in _each(items, item_col, item_text_col):
        docs = docs.mapInArrow(_without(block, text_col), docs.schema)
        if more:
            docs = stage(docs, "clean")
            block.destroy()
            if last is not None:
                discard(last)
            last = docs
    return docs


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks(docs, items).select("doc_id", "item_id", "shared", F.col("of").alias("item_shingles"))

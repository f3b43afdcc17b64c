"""Words, shingles and their hashes, as the text operators of this subpackage share them.

A word is a run of bytes other than space and U+0009 to U+000D; A-Z count as a-z. ``bytes.lower`` and
``bytes.split`` do exactly that on UTF-8, so a text is cut without a regular expression.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Fixed value: seed of every XXH64 here.
SEED = 42
#: Words whose hashes a Python worker keeps; the cache starts anew beyond it.
CACHE_WORDS = 200_000


def fold(text: str | None) -> list[bytes]:
    """Lower-cased words of a text; none for null."""
    return text.encode("utf-8").lower().split() if text else []


class WordHashes(dict):
    """word -> 8 bytes of its XXH64, for at most ``CACHE_WORDS`` words at a time."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_digest(word, SEED)
        return found

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype="<u8")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values (the finaliser of XXH64)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` word hashes, in order; empty if there are fewer words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mix(out)


#: Bytes of text and rows that a worker handles at a time.
SMALL_BYTES = 3_000_000
SMALL_ROWS = 2_000


def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold little text (or one long row), so that what a worker makes of one stays small."""
    for batch in batches:
        size = np.ones(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows or batch.num_rows == 0 and at == 0:
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + SMALL_BYTES, "right")))
            upto = min(upto, at + SMALL_ROWS)
            yield batch.slice(at, upto - at)
            at = upto


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(ids, texts) of batches whose first two columns are an id and a text."""
    for batch in small(batches):
        yield batch.column(0).to_pylist(), batch.column(1).to_pylist()

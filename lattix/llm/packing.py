"""Packing of examples into sequences by vector bin packing.

An example asks for three things at once: tokens, one segment, and loss-bearing tokens. A sequence has a limit on each.
Sequences are filled one at a time: of the waiting examples that still fit, the one goes in whose demand has the largest
dot product with what is left of the sequence (both in parts of the limits, weighted by how scarce each is among those
waiting). Plain documents may be cut: then stretches of a whole sequence go out as they are, a gap that no example fits
is closed with the beginning of the longest one, and the last, part-filled sequences of a task are cut to powers of two,
so that they need no padding either.

How it scales: one pass without a shuffle. Each task packs its own rows from a pool of at most ``POOL`` examples; of a
document only the ids that still wait for a place are held (less than a sequence's length), so memory is bounded by the pool and a hot source is spread as the input files are. A task that is run again packs the same
rows to the same sequences.

Results for odd inputs: a null or empty text is its end id alone; repeated rows are packed each for itself; rows of a null
id are packed like any other and keep it; a very long text is turned to ids whole, inside its task, and cut into as many
sequences as it fills; an example over a limit that can't be cut is reported with sequence_id and offset null; an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import END_ID, VOCABULARY, encoder, vocabulary
from .words import small

LENGTH = 4096
SEGMENTS = 256
#: Examples that wait in a task for a place.
POOL = 2048
#: Gaps below this many tokens stay padding; larger ones are closed by cutting.
GAP = 24


class Packer:
    """Fills sequences. ``emit`` gets (key, start, length, sequence, offset) for each piece.

    ``rest(key, start)`` gives the key under which the tokens from ``start`` on wait.
    """

    def __init__(self, emit: Callable, length: int = LENGTH, segments: int = SEGMENTS, loss: int = LENGTH, cut: bool = False, pool: int = POOL, rest: Callable | None = None):
        self.emit, self.cut, self.pool, self.rest = emit, cut, pool, rest
        self.limits = np.array([length, segments, loss], dtype=np.float64)
        self.length, self.sequences = length, 0
        self.keys: list = []
        self.starts: list[int] = []
        self.need = np.empty((2 * pool + 2, 3))
        self.n = 0

    def add(self, key, tokens: int, loss: int, start: int = 0) -> None:
        if self.cut:
            while tokens >= self.length:
                self._out([(key, start, self.length)])
                start, tokens = start + self.length, tokens - self.length
            loss = tokens
        if tokens == 0:
            return
        self._wait(key, start, tokens, loss)
        while self.n > self.pool:
            self._fill()

    def close(self) -> None:
        while self.n:
            self._fill()

    def _wait(self, key, start: int, tokens: int, loss: int) -> None:
        self.keys.append(self.rest(key, start) if self.rest else key)
        self.starts.append(start)
        self.need[self.n] = tokens, 1, loss
        self.n += 1

    def _take(self, i: int) -> tuple:
        self.n -= 1
        taken = self.keys[i], self.starts[i], int(self.need[i, 0])
        self.keys[i], self.starts[i] = self.keys[-1], self.starts[-1]
        self.keys.pop(), self.starts.pop()
        self.need[i] = self.need[self.n]
        return taken

    def _fill(self) -> None:
        left, pieces = self.limits.copy(), []
        scarce = self.need[: self.n].sum(0) / self.limits
        weight = scarce / scarce.sum() / self.limits**2
        while self.n and left[0] > 0:
            need = self.need[: self.n]
            score = need @ (weight * left)
            score[(need > left).any(1)] = -1.0
            best = int(score.argmax())
            if score[best] < 0:
                break
            left -= need[best]
            pieces.append(self._take(best))
        gap = int(left[0])
        if self.cut and self.n and gap >= GAP and left[1] >= 1:
            longest = int(self.need[: self.n, 0].argmax())
            key, start, tokens = self._take(longest)
            pieces.append((key, start, gap))
            self._wait(key, start + gap, tokens - gap, tokens - gap)
            gap = 0
        if self.cut and gap >= GAP:
            self._powers(pieces)
        else:
            self._out(pieces)

    def _powers(self, pieces: list[tuple]) -> None:
        """Cut a part-filled sequence into sequences whose lengths are powers of two."""
        total = sum(p[2] for p in pieces)
        pieces = pieces[::-1]
        for bit in range(total.bit_length() - 1, -1, -1):
            room, out = total & (1 << bit), []
            while room:
                key, start, tokens = pieces.pop()
                part = min(room, tokens)
                out.append((key, start, part))
                room -= part
                if part < tokens:
                    pieces.append((key, start + part, tokens - part))
            if out:
                self._out(out)

    def _out(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, tokens in pieces:
            self.emit(key, start, tokens, self.sequences, offset)
            offset += tokens
        self.sequences += 1


def _sequence_base() -> int:
    return TaskContext.get().partitionId() << 33


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_texts(vocab, end_id: int, length: int, segments: int):
    def run(batches):
        encode, base, out = encoder(vocab.value, end_id).all_ids, _sequence_base(), []

        # a key is (doc_id, ids, place of the first of them in the document, ids of the document)
        def emit(key, start, tokens, sequence, offset):
            doc_id, ids, at, whole = key
            crc = zlib.crc32(memoryview(ids)[4 * (start - at) : 4 * (start - at + tokens)])
            out.append((doc_id, start, tokens, crc, whole, base + sequence, offset))

        def rest(key, start):
            doc_id, ids, at, whole = key
            return doc_id, ids[4 * (start - at) :], start, whole

        def flush():
            cols = list(zip(*out)) or [[]] * 7
            out.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _PIECES)], schema=_PIECES)

        packer = Packer(emit, length, segments, length, cut=True, rest=rest)
        for batch in small(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                n = len(ids) // 4
                packer.add((doc_id, ids, 0, n), n, n)
            yield flush()
        packer.close()
        yield flush()

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, segments: int = SEGMENTS, path: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document; every token of a document bears loss, and documents are cut freely."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(_pack_texts(vocabulary(docs.sparkSession, path), end_id, length, segments), PIECES)


def _pack_examples(length: int, segments: int, loss: int):
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        base, out = _sequence_base(), []
        packer = Packer(lambda key, start, tokens, sequence, offset: out.append((*key, base + sequence, offset)), length, segments, loss)

        def flush():
            cols = list(zip(*out)) or [[]] * 5
            out.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in small(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, tokens, bearing = row, row[1] or 0, row[2] or 0
                if tokens > length or bearing > loss or tokens == 0:
                    out.append((*key, None, None))
                else:
                    packer.add(key, tokens, bearing)
            yield flush()
        packer.close()
        yield flush()

    return run


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, length: int = LENGTH, segments: int = SEGMENTS, loss: int = LENGTH) -> DataFrame:
    """id, tokens, loss_tokens, sequence_id, offset: whole instruction examples under all three limits.

    An example without tokens or over a limit gets no sequence (nulls).
    """
    rows = examples.select(F.col(id_col).cast("long"), F.col(tokens_col).cast("long"), F.col(loss_col).cast("long"))
    return rows.mapInArrow(_pack_examples(length, segments, loss), "id long, tokens long, loss_tokens long, sequence_id long, offset long")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

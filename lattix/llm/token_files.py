"""Token-id files: canonical length-limited Huffman codes from global counts, read back by table.

``write`` turns texts to ids, counts all ids, builds one code for the corpus and writes blocks in ascending order of
doc_id. A block holds whole documents, about ``BLOCK`` ids, as one bit string; every ``LANE`` ids it notes the bit
offset, so a reader can start there. ``read`` decodes each block for itself: all lanes of a block step through the code
table together. A folder holds ``code`` (id, bits: canonical codes follow from the lengths) and ``blocks`` (part, block,
first_id, doc_ids, doc_tokens, payload, checkpoints), both Parquet, so any store that Spark reaches will do.

How it scales: ids are made once and staged as 2-byte values (4 bytes where the vocabulary has larger ids); counts are summed per task before they are shuffled (at
most one row per id and task); the driver only sees one count per id of the vocabulary, a fixed bound. Range
partitioning on doc_id keeps the global order; the position of a block's first id is kept within its part, and the parts'
totals (one row per part) are added up when reading.

Results for odd inputs: a null or empty text is its end id alone; rows with equal ids follow each other, ordered by the
hash and bytes of their ids; a null doc_id comes first; a very long text lies whole in one block, which is as long as it needs; an empty table gives
an empty file and an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import shared_dir, stage
from .tokens import END_ID, VOCABULARY, encoder, vocabulary
from .words import small

#: Longest code in bits, or one more than the used ids need to be told apart; a decoding table has 2 ** bits entries.
MAX_BITS = 16
WIDEST = 24
BLOCK = 262_144
LANE = 128


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits for each symbol (0 for a count of 0): the best code under the limit, by merging packages level by level."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), dtype=np.uint8)
    if len(used) == 1:
        bits[used] = 1
    if len(used) < 2:
        return bits
    limit = max(limit, (len(used) - 1).bit_length() + 1) if len(used) > 1 << limit else limit
    if limit > WIDEST:
        raise ValueError(f"a vocabulary of {len(used)} ids is beyond codes of {WIDEST} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        place = np.argsort(merged, kind="stable")
        levels.append(place < len(leaves))
        merged = merged[place]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        bits[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return bits


def canonical(bits: np.ndarray) -> np.ndarray:
    """Codes in order of (bits, symbol)."""
    codes, code, last = np.zeros(len(bits), dtype=np.uint64), 0, 0
    order = np.lexsort((np.arange(len(bits)), bits))
    for s in order[np.count_nonzero(bits == 0) :]:
        code <<= int(bits[s]) - last
        last = int(bits[s])
        codes[s] = code
        code += 1
    return codes


def table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, bits) for each value of as many next bits as the longest code has, or ``MAX_BITS``."""
    limit = max(MAX_BITS, int(bits.max(initial=0)))
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[np.count_nonzero(bits == 0) :]
    spans = 1 << (limit - bits[order].astype(np.int64))
    symbols, widths = np.zeros(1 << limit, dtype=np.uint32), np.ones(1 << limit, dtype=np.int64)
    end = int(spans.sum())
    symbols[:end], widths[:end] = np.repeat(order, spans), np.repeat(bits[order], spans)
    return symbols, widths


def encode(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """The bit string of some ids, and the bit offsets of every ``LANE``-th (little-endian unsigned 64-bit)."""
    width = bits[ids].astype(np.int64)
    ends = np.cumsum(width)
    starts = ends - width
    word, over = starts >> 6, (starts & 63) + width - 64
    value = codes[ids]
    high = np.where(over <= 0, value << np.maximum(-over, 0).astype(np.uint64), value >> np.maximum(over, 0).astype(np.uint64))
    firsts = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(ends[-1] >> 6) + 1 if len(ids) else 0, dtype=np.uint64)
    if len(ids):
        out[: int(word[-1]) + 1] = np.add.reduceat(high, firsts)
        split = np.flatnonzero(over > 0)
        out[word[split] + 1] |= value[split] << (64 - over[split]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8 if len(ids) else 0], starts[::LANE].astype("<u8").tobytes()


def decode(payload: bytes, checkpoints: bytes, n: int, symbols: np.ndarray, widths: np.ndarray) -> np.ndarray:
    limit = len(symbols).bit_length() - 1
    raw = np.frombuffer(payload + bytes(LANE * limit // 8 + 4), dtype=np.uint8).astype(np.uint32)
    next32 = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = np.frombuffer(checkpoints, dtype="<u8").astype(np.int64)
    out = np.empty((LANE, len(at)), dtype=np.uint32)
    for k in range(LANE):
        seen = (next32[at >> 3] >> (32 - limit - (at & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)
        out[k] = symbols[seen]
        at += widths[seen]
    return out.T.reshape(-1)[:n]


def id_width(vocab, end_id: int) -> str:
    """The least of 2 and 4 bytes that hold every id of a vocabulary."""
    from tokenizers import Tokenizer

    largest = max([end_id, *Tokenizer.from_str(vocab.value).get_vocab(with_added_tokens=True).values()])
    return "<u2" if largest < 1 << 16 else "<u4"


def token_ids(docs: DataFrame, id_col: str, text_col: str, vocab, width: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (little-endian, unsigned, of the given width) of every text with the end id."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        ids = encoder(vocab.value, end_id).all_ids
        for batch in small(batches):
            packed = [np.frombuffer(x, dtype="<u4").astype(width).tobytes() for x in ids(batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(packed, pa.binary())], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids binary")


def _count(width: str):
    def run(batches):
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in small(batches):
            n = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=width))
            if len(n) > len(total):
                n, total = total, n
            total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return run


_BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("payload", pa.binary()), ("checkpoints", pa.binary())])
BLOCKS = "part int, block int, first_id long, doc_ids array<long>, doc_tokens array<long>, payload binary, checkpoints binary"


def _write_blocks(bits: np.ndarray, width: str):
    def run(batches):
        codes, part, block, first = canonical(bits), TaskContext.get().partitionId(), 0, 0
        names, held, size, size_of = [], [], 0, np.dtype(width).itemsize

        def flush():
            nonlocal block, first, names, held, size
            ids = np.frombuffer(b"".join(held), dtype=width)
            payload, checkpoints = encode(ids, bits, codes)
            row = pa.record_batch([pa.array([v], f.type) for v, f in zip((part, block, first, names, [len(x) // size_of for x in held], payload, checkpoints), _BLOCKS)], schema=_BLOCKS)
            block, first, names, held, size = block + 1, first + len(ids), [], [], 0
            return row

        for batch in small(batches):
            column = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = column[i].as_py()
                names.append(doc_id)
                held.append(ids)
                size += len(ids) // size_of
                if size >= BLOCK:
                    yield flush()
        if names:
            yield flush()

    return run


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, end_id: int = END_ID) -> None:
    spark = docs.sparkSession
    vocab = vocabulary(spark, path)
    width = id_width(vocab, end_id)
    ids = stage(token_ids(docs, id_col, text_col, vocab, width, end_id), "token-ids")
    counted = ids.select("ids").mapInArrow(_count(width), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([0, *(r[0] for r in counted)]) + 1, dtype=np.int64)
    for id_, n in counted:  # one row per id of the vocabulary at most
        counts[id_] = n
    bits = code_lengths(counts)
    used = np.flatnonzero(bits)
    spark.createDataFrame([(int(i), int(bits[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{folder}/code")
    ordered = ids.repartitionByRange("doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"), "ids")
    ordered.mapInArrow(_write_blocks(bits, width), BLOCKS).write.parquet(f"{folder}/blocks")


def read(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit) of every document of a folder."""
    code = spark.read.parquet(f"{folder}/code").collect()  # as bounded as the vocabulary
    bits = np.zeros(max([0, *(r[0] for r in code)]) + 1, dtype=np.uint8)
    for id_, width in code:
        bits[id_] = width
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        symbols, widths = table(bits)
        for batch in small(batches):
            for part, first, doc_ids, tokens, payload, checkpoints in zip(*(batch.column(k) for k in range(6))):
                sizes = np.array(tokens.as_py(), dtype=np.int64)
                ends = np.cumsum(sizes)
                raw = decode(payload.as_py(), checkpoints.as_py(), int(ends[-1]), symbols, widths).astype("<u4").tobytes()
                texts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
                cols = ([part.as_py()] * len(sizes), doc_ids.as_py(), ends - sizes + first.as_py(), sizes, [zlib.crc32(x) for x in texts], texts)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    totals = blocks.select("part", F.expr("aggregate(doc_tokens, 0L, (a, x) -> a + x)").alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    found = blocks.select("part", "first_id", "doc_ids", "doc_tokens", "payload", "checkpoints").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    # `before` has a row for each partition that the writer had, a setting and not a count of rows
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")

"""A word bigram model with Katz backoff, trained and evaluated as Spark jobs.

Counts of words and word pairs are discounted by Good-Turing (counts up to ``K``; pairs seen once are kept like all others),
and what that frees is given to the unseen: for words to one unknown word, for a context in proportion to the words' own
probabilities, with the weight that makes each context's probabilities sum to one exactly:

    P(w) = d(c) c / N,  P(unknown) = what is left
    P(w | v) = d(c) c / C(v) if the pair was seen, else alpha(v) P(w)
    alpha(v) = (1 - sum of seen P(w | v)) / (1 - sum of P(w) over the seen)

Evaluation follows the recursion for each token. As log P(w | v) is either the pair's entry or log alpha(v) + log P(w), a
text's score is the sum of log P(w) + log alpha(v) over its tokens, plus for each seen pair what its entry differs by.

How it scales: the model is a table of buckets. A pair lies in the bucket of its context's hash, so a context's sums are
made in one place; a context with more than ``HOT`` occurrences is spread over several buckets by the next word, and its
sums are added up. Buckets hold about ``BUCKET`` occurrences: their number grows with the corpus. Pairs,
and later the occurrences to be scored, move as packed arrays, one per bucket and flush of a task, counted before they
move; occurrences meet their bucket by an equi-join of groups, in ``SLICES`` passes whose shuffle files are freed in
between, and send back one sum per document and bucket. A pair with more than a quarter of a bucket's
occurrences never moves: its value travels with the head. There are at most ``COMMON_PAIRS`` of these (beyond 1.3e11 tokens
those with more than that share of all occurrences), so no pair, however common, brings more to its bucket. The ``HEAD`` most frequent words get small numbers as codes and
travel as arrays of fixed size with their values; all others are looked up in buckets by their hash. Nothing is left out.
The driver sees counts of counts and the head, both bounded.

Results for odd inputs: a null or blank text is its end alone; repeated rows are rows of their own; a null id is a
training row; without training rows every word is unknown (score and base come from N = 0); an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import discard, release, stage
from .words import CACHE_WORDS, SEED, fold, mix, small

#: Good-Turing discounts apply up to this count.
K = 5
HEAD = 1 << 18
#: Pairs with more than a quarter of a bucket's occurrences are scored where they occur, so many of them at most.
COMMON_PAIRS = 1 << 20
#: Occurrences of a bucket, least number of buckets, occurrences beyond which a context is spread, passes of the evaluation.
BUCKET = 500_000
LEAST_BUCKETS = 256
HOT = 1_000_000
SLICES = 2
#: Tokens that a task gathers before it hands them on.
FLUSH = 1_500_000
#: Codes that no word has: the start of a text (a context only) and its end (a token).
START, END = 0, 1
_TAIL = 1 << 63


class Codes(dict):
    """word -> 8 bytes of its code: its number if it is a head word, else its hash with the highest bit set."""

    def __init__(self, numbers: dict[int, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word, SEED) | _TAIL
        found = self[word] = self.numbers.get(h, h).to_bytes(8, "little")
        return found

    def text(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, fold(text))) + _END


_START, _END = START.to_bytes(8, "little"), END.to_bytes(8, "little")


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of word pairs: 63 bits, so they are never those of words outside the head."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b)) >> np.uint64(1)


def discounts(n: dict[int, int], k: int = K) -> list[float]:
    """d(1) to d(k) from counts of counts; absolute discounting by a half where Good-Turing gives no valid value."""
    if all(n.get(r, 0) > 0 for r in range(1, k + 2)):
        last = (k + 1) * n[k + 1] / n[1]
        found = [((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) if last != 1 else -1.0 for r in range(1, k + 1)]
        if all(0 < d <= 1 for d in found):
            return found
    return [(r - 0.5) / r for r in range(1, k + 1)]


def _unique(parts: list[np.ndarray]):
    return np.unique(np.concatenate(parts or [np.empty(0, dtype=np.uint64)]), return_counts=True)


def _count_words(batches):
    codes, parts, size = Codes({}), [], 0

    def flush():
        keys, n = _unique(parts)
        return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["code", "c"])

    for batch in small(batches):
        for text in batch.column(0).to_pylist():
            parts.append(np.frombuffer(codes.text(text), dtype="<u8"))
            size += len(parts[-1])
        if size > FLUSH:
            yield flush()
            parts, size = [], 0
    yield flush()


def _floor(counts: dict[int, int], most: int) -> int:
    """The least count such that no more than ``most`` entries have it or a larger one."""
    total, floor = 0, max(counts, default=0) + 1
    for c in sorted(counts, reverse=True):
        total += counts[c]
        if total > most:
            break
        floor = c
    return floor


def _by_count(df: DataFrame) -> dict[int, int]:
    """count -> entries; large counts together by their binary logarithm's lower bound, so that the driver sees few rows."""
    step = F.when(F.col("c") <= 4096, F.col("c")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("c"))).cast("long"))
    return {c: n for c, n in df.groupBy(step.alias("c")).agg(F.count("*").alias("n")).collect()}


@functools.cache
def _codec() -> tuple:
    """A worker's compressor and decompressor."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, compressed."""
    return len(arrays[0]).to_bytes(8, "little") + _codec()[0].compress(b"".join([np.ascontiguousarray(a).tobytes() for a in arrays]))


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw, out, at = _codec()[1].decompress(data[8:], max_output_size=n * sum(np.dtype(t).itemsize for t in types) or 1), [], 0
    for t in types:
        out.append(np.frombuffer(raw, dtype=t, count=n, offset=at))
        at += n * np.dtype(t).itemsize
    return out


def _together(parts: list[list[np.ndarray]], *types: str) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, dtype=t) for t in types]


class Plan:
    """Where pairs and words lie: ``n`` buckets for pairs, as many for words, and the parts of common contexts."""

    def __init__(self, n: int, parts: np.ndarray):
        self.n, self.parts = n, parts

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        parts = np.where(a < len(self.parts), self.parts[np.where(a < len(self.parts), a, 0).astype(np.int64)], 1).astype(np.uint64)
        return (mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b) % parts) % np.uint64(self.n)).astype(np.int32)


def _by_bucket(buckets: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(buckets, kind="stable")
    buckets, arrays = buckets[order], [a[order] for a in arrays]
    starts = np.flatnonzero(np.diff(buckets, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(buckets))):
        yield int(buckets[a]), [x[a:b] for x in arrays]


def _count_pairs(numbers, plan):
    schema = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])

    def run(batches):
        codes, place, parts, size = Codes(numbers.value), plan.value, [], 0

        def flush():
            a, b = _together(parts, "<u8", "<u8")
            _, at, n = np.unique(pair_keys(a, b), return_index=True, return_counts=True)
            a, b = a[at], b[at]
            found = [(k, pack(x, y, c)) for k, (x, y, c) in _by_bucket(place.pairs(a, b), a, b, n.astype("<u4"))]
            return pa.record_batch([pa.array([k for k, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], schema=schema)

        for batch in small(batches):
            stream = np.frombuffer(b"".join([_START + codes.text(t) for t in batch.column(0).to_pylist()]), dtype="<u8")
            inside = stream[1:] != START
            parts.append([stream[:-1][inside], stream[1:][inside]])
            size += len(parts[-1][0])
            if size > FLUSH:
                yield flush()
                parts, size = [], 0
        yield flush()

    return run


MERGED = "bucket int, data binary, " + ", ".join(f"n{r} long" for r in range(1, K + 2))
_MERGED = pa.schema([("bucket", pa.int32()), ("data", pa.binary()), *((f"n{r}", pa.int64()) for r in range(1, K + 2))])


def _merge(table: pa.Table) -> pa.Table:
    """One row for a bucket: its pairs in the order of context and word, with their counts, and counts of counts."""
    a, b, c = _together([unpack(d.as_py(), "<u8", "<u8", "<u4") for d in table.column("data")])
    order = np.lexsort((b, a))
    a, b, c = a[order], b[order], c[order].astype("<i8")
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    c = np.add.reduceat(c, at)
    tally = [int((c == r).sum()) for r in range(1, K + 2)]
    return pa.table([pa.array([x], f.type) for x, f in zip((table.column("bucket")[0].as_py(), pack(a[at], b[at], c), *tally), _MERGED)], schema=_MERGED)


def _rare_words(batches):
    """bucket, code: the words outside the head that a bucket's pairs end in."""
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            b = np.unique(unpack(data.as_py(), "<u8", "<u8", "<i8")[1])
            b = b[b >= np.uint64(_TAIL)]
            yield pa.record_batch([pa.array(np.full(len(b), bucket, dtype=np.int32)), pa.array(b.view(np.int64))], names=["bucket", "code"])


def _discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.asarray([1.0, *d, 1.0])[np.minimum(c, len(d) + 1)] * c


BUCKETS = "bucket int, pairs binary, words binary, contexts binary, head array<long>, mass array<double>, lower array<double>, whole array<long>"
_BUCKETS = pa.schema([("bucket", pa.int32()), ("pairs", pa.binary()), ("words", pa.binary()), ("contexts", pa.binary()), ("head", pa.list_(pa.int64())), ("mass", pa.list_(pa.float64())), ("lower", pa.list_(pa.float64())), ("whole", pa.list_(pa.int64()))])


def log_alpha(mass: np.ndarray, lower: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of contexts (half a one more where no discount freed anything) and the logarithms of their weights."""
    whole = np.where(mass < whole, whole, whole + 0.5)
    return whole, np.log10((1 - mass / whole) / (1 - lower))


def _finish(d1: list[float], d2: list[float], total: float, head):
    """Sums of the contexts of a bucket; weights of those outside the head, which are whole there."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _BUCKETS.empty_table()
        a, b, c = unpack(left.column("data")[0].as_py(), "<u8", "<u8", "<i8")
        code, n = (right.column(k).to_numpy() for k in ("code", "c"))
        order = np.argsort(code.view(np.uint64))
        code, n = code.view(np.uint64)[order], n[order]
        p = np.where(b < HEAD, head.value[np.where(b < HEAD, b, 0).astype(np.int64)], 0.0)
        rare = np.flatnonzero(b >= np.uint64(_TAIL))
        p[rare] = _discounted(n[np.searchsorted(code, b[rare])], d1) / total
        at = np.flatnonzero(np.diff(a, prepend=a[0] ^ np.uint64(1)) != 0)
        sums = [np.add.reduceat(x, at) for x in (_discounted(c, d2), p, c)]
        own = a[at]
        tail = own >= np.uint64(_TAIL)
        whole, alpha = log_alpha(*(x[tail] for x in sums))
        row = (left.column("bucket")[0].as_py(), pack(a, b, c), pack(code, n), pack(own[tail], whole, alpha), own[~tail].view(np.int64), *(x[~tail] for x in sums))
        return pa.table([pa.array([x], f.type) for x, f in zip(row, _BUCKETS)], schema=_BUCKETS)

    return run


def _placed(n: int):
    def run(batches):
        for batch in batches:
            buckets = _word_buckets(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), n)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), batch.column(0), batch.column(1)], names=["bucket", "code", "c"])

    return run


def _pack_words(table: pa.Table) -> pa.Table:
    code, c = (table.column(k).to_numpy() for k in ("code", "c"))
    order = np.argsort(code.view(np.uint64))
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "words": pa.array([pack(code[order].view(np.uint64), c[order])], pa.binary())})


class Model:
    """A trained model: ``buckets`` (pairs and weights of contexts) and ``rare`` (words outside the head), both tables, and the head.

    The tables lie in the shared folder; ``bucket`` is what evaluation joins them by.
    """

    def __init__(self, train: DataFrame, text_col: str = "text"):
        spark = self.spark = train.sparkSession
        send = spark.sparkContext.broadcast
        texts = train.select(F.col(text_col).cast("string").alias("text"))
        words = texts.mapInArrow(_count_words, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))
        words = stage(words, "lm-words")
        ends = words.where(F.col("code") == END).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
        self.n, self.v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        by_count = _by_count(words)
        self.d1 = discounts(by_count)
        freed = sum(by_count.get(r, 0) * r * (1 - self.d1[r - 1]) for r in range(1, K + 1))
        self.total = float(self.n if freed > 0 else self.n + 0.5)
        self.unknown = math.log10((freed or 0.5) / self.total)
        # Numbers for the head: no more than HEAD words, however large the corpus.
        floor = _floor(by_count, HEAD - 2)
        top = words.where((F.col("c") >= floor) & (F.col("code") != END)).collect()
        top.sort(key=lambda r: (-r[1], r[0]))
        self.counts = np.zeros(HEAD, dtype=np.int64)
        self.counts[END] = ends
        self.counts[2 : len(top) + 2] = [r[1] for r in top]
        self.numbers = send({r[0] + (1 << 64): i for i, r in enumerate(top, 2)})
        prob = _discounted(self.counts, self.d1) / self.total
        rare = words.where((F.col("c") < floor) & (F.col("code") != END))

        # Buckets of pairs.
        contexts = self.counts.copy()
        contexts[START] = ends
        self.place = Plan(max(LEAST_BUCKETS, -(-self.n // BUCKET)), np.where(contexts > HOT, -(-contexts // BUCKET), 1))
        self.plan = send(self.place)
        n = self.place.n
        pairs = texts.mapInArrow(_count_pairs(self.numbers, self.plan), "bucket int, data binary")
        pairs = stage(pairs.groupBy("bucket").applyInArrow(_merge, MERGED), "lm-pairs")
        release(spark)
        tally = pairs.agg(*[F.coalesce(F.sum(f"n{r}"), F.lit(0)) for r in range(1, K + 2)]).first()
        self.d2 = discounts(dict(enumerate(tally, 1)))
        asked = pairs.select("bucket", "data").mapInArrow(_rare_words, "bucket int, code long")
        known = asked.join(rare, "code").select("bucket", "code", "c")
        both = pairs.groupBy("bucket").cogroup(known.groupBy("bucket"))
        self.buckets = stage(both.applyInArrow(_finish(self.d1, self.d2, self.total, send(prob)), BUCKETS), "lm-buckets")
        discard(pairs)
        placed = rare.mapInArrow(_placed(n), "bucket int, code long, c long")
        self.rare = stage(placed.groupBy("bucket").applyInArrow(_pack_words, "bucket int, words binary"), "lm-rare")
        release(spark)

        # The head's weights: sums of the parts of each context, at most HEAD rows.
        sums = self.buckets.select(F.inline(F.arrays_zip("head", "mass", "lower", "whole"))).groupBy("head").agg(F.sum("mass"), F.sum("lower"), F.sum("whole")).collect()
        self.whole, self.alpha = np.ones(HEAD), np.zeros(HEAD)
        if sums:
            code, mass, lower, whole = (np.array(x) for x in zip(*sums))
            self.whole[code], self.alpha[code] = log_alpha(mass, lower, whole)
        with np.errstate(divide="ignore"):
            self.logs = np.where(self.counts > 0, np.log10(prob), self.unknown)
        discard(words)
        # the values of common pairs: no more than COMMON_PAIRS, as their occurrences are no more than all
        self.common, self.common_values, self.common_contexts = np.empty(0, dtype=np.uint64), np.empty(0), np.zeros(HEAD + 1, dtype=bool)
        parts = self.buckets.select("pairs", "words", "contexts").mapInArrow(_common(send(self.sent()), max(BUCKET // 4, self.n // COMMON_PAIRS)), "key long, context long, value double").toArrow()
        keys, contexts, values = (parts.column(c).to_numpy() for c in ("key", "context", "value"))
        keys, contexts = keys.view(np.uint64), contexts.view(np.uint64)
        self.common_contexts[np.minimum(contexts, np.uint64(HEAD)).astype(np.int64)] = True
        order = np.argsort(keys)
        self.common, self.common_values = keys[order], values[order]

    def sent(self) -> dict:
        """What tasks need, of fixed size."""
        return {"counts": self.counts, "logs": self.logs, "alpha": self.alpha, "whole": self.whole, "d1": self.d1, "d2": self.d2, "total": self.total, "unknown": self.unknown, "common": self.common, "common_values": self.common_values, "common_contexts": self.common_contexts, "den": self.n + 0.5 * (self.v + 1)}


_OCCURRENCES = pa.schema([("bucket", pa.int32()), ("flush", pa.int64()), ("data", pa.binary())])


def _occurrences(numbers, plan, sent, step: int, steps: int):
    """bucket, flush, data: pairs and rare words of all documents of a flush, by bucket, and what the head says of them.

    Documents are told apart by their place in the flush. Buckets are dealt to the ``steps`` passes by their number.
    """

    def run(batches):
        codes, place, m = Codes(numbers.value), plan.value, sent.value
        base = np.log10((m["counts"] + 0.5) / m["den"])
        flush, parts, ids, size = TaskContext.get().partitionId() << 32, [], [], 0

        def close():
            a, b, doc = _together(parts, "<u8", "<u8", "<u4")
            found = []
            common, value = _found(m, a, b)
            if step == 0:
                head, context = b < HEAD, a < HEAD
                number = np.where(head, b, 0).astype(np.int64)
                known, plain = np.where(head, m["counts"][number] > 0, 0), np.where(head, base[number], 0.0)
                score = np.where(head, m["logs"][number], 0.0) + np.where(context, m["alpha"][np.where(context, a, 0).astype(np.int64)], 0.0)
                score += value
                sums = [np.bincount(doc, weights=x, minlength=len(ids)) for x in (np.ones(len(doc)), known, plain, score)]
                missing = np.array([i is None for i in ids], dtype="<u1")
                found.append((2 * place.n + flush % place.n, pack(np.array([i or 0 for i in ids], dtype="<i8"), missing, *sums)))
                rare = np.flatnonzero(~head)
                found += [(k, pack(x, y)) for k, (x, y) in _by_bucket(_word_buckets(b[rare], place.n), b[rare], doc[rare])]
            buckets = place.pairs(a, b)
            mine = np.flatnonzero((buckets % steps == step) & ~common)
            found += [(k, pack(x, y, z)) for k, (x, y, z) in _by_bucket(buckets[mine], a[mine], b[mine], doc[mine])]
            return pa.record_batch([pa.array([k for k, _ in found], pa.int32()), pa.array([flush] * len(found), pa.int64()), pa.array([d for _, d in found], pa.binary())], schema=_OCCURRENCES)

        for batch in small(batches):
            texts = [codes.text(t) for t in batch.column(1).to_pylist()]
            stream = np.frombuffer(b"".join([_START + t for t in texts]), dtype="<u8")
            doc = np.repeat(np.arange(len(ids), len(ids) + len(texts), dtype="<u4"), [len(t) // 8 for t in texts])
            inside = stream[1:] != START
            parts.append([stream[:-1][inside], stream[1:][inside], doc])
            ids += batch.column(0).to_pylist()
            size += len(doc)
            if size > FLUSH:
                yield close()
                flush, parts, ids, size = flush + 1, [], [], 0
        if ids:
            yield close()

    return run


def _word_buckets(codes: np.ndarray, n: int) -> np.ndarray:
    return (mix(codes) % np.uint64(n)).astype(np.int32) + np.int32(n)


def _values(m: dict, row: dict) -> tuple[np.ndarray, ...]:
    """context, word, count, value and rest of a bucket's pairs: the entry less log alpha(v) + log P(w); log alpha(v) where v is not in the head."""
    a, b, c = unpack(row["pairs"], "<u8", "<u8", "<i8")
    code, count = unpack(row["words"], "<u8", "<i8")
    own, whole, alpha = unpack(row["contexts"], "<u8", "<f8", "<f8")
    rare, tail = b >= np.uint64(_TAIL), a >= np.uint64(_TAIL)
    word = m["logs"][np.where(rare, 0, b).astype(np.int64)]
    word[rare] = np.log10(_discounted(count[np.searchsorted(code, b[rare])], m["d1"]) / m["total"])
    number, at = np.where(tail, 0, a).astype(np.int64), np.searchsorted(own, a[tail])
    wholes, alphas = m["whole"][number], m["alpha"][number]
    wholes[tail], alphas[tail] = whole[at], alpha[at]
    return a, b, c, np.log10(_discounted(c, m["d2"]) / wholes) - alphas - word, np.where(tail, alphas, 0.0)


def _common(sent, least: int):
    """key, context, value of the pairs with more than ``least`` occurrences."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b, c, value, rest = _values(sent.value, row)
                hot = c > least
                yield pa.record_batch([pa.array(pair_keys(a[hot], b[hot]).view(np.int64)), pa.array(a[hot].view(np.int64)), pa.array((value + rest)[hot])], names=["key", "context", "value"])

    return run


def _found(m: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are common ones, and the values of all (0 for the others); contexts that no common pair has are passed over."""
    hit, value, keys = np.zeros(len(a), dtype=bool), np.zeros(len(a)), m["common"]
    flags = m["common_contexts"]  # one for each head word, and one for all other contexts
    at = np.flatnonzero(flags[np.minimum(a, np.uint64(len(flags) - 1)).astype(np.int64)])
    if len(keys) and len(at):
        key = pair_keys(a[at], b[at])
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit[at] = keys[place] == key
        value[at] = np.where(hit[at], m["common_values"][place], 0.0)
    return hit, value


_SUMS = pa.schema([("flush", pa.int64()), ("whole", pa.bool_()), ("data", pa.binary())])
SUMS = "flush long, whole boolean, data binary"


def _evaluate(sent, n: int):
    """Sums by document of the occurrences of a bucket."""

    def pairs(m: dict, row: dict | None):
        if row is None:
            return lambda a, b: (np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a)))
        a, b, _, value, _ = _values(m, row)
        own, _, alpha = unpack(row["contexts"], "<u8", "<f8", "<f8")
        keys = pair_keys(a, b)
        order = np.argsort(keys)
        keys, value = keys[order], value[order]

        def found(x: np.ndarray, y: np.ndarray):
            key = pair_keys(x, y)
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            score = np.where(keys[place] == key, value[place], 0.0)
            if len(own):
                place = np.minimum(np.searchsorted(own, x), len(own) - 1)
                score += np.where(own[place] == x, alpha[place], 0.0)
            return np.zeros(len(x)), np.zeros(len(x)), score

        return found

    def words(m: dict, row: dict | None):
        code, count = unpack(row["words"], "<u8", "<i8") if row else (np.empty(0, dtype="<u8"), np.empty(0, dtype="<i8"))

        def found(x: np.ndarray):
            c = np.zeros(len(x), dtype=np.int64)
            if len(code):
                place = np.minimum(np.searchsorted(code, x), len(code) - 1)
                c = np.where(code[place] == x, count[place], 0)
            with np.errstate(divide="ignore"):
                score = np.where(c > 0, np.log10(_discounted(c, m["d1"]) / m["total"]), m["unknown"])
            return (c > 0).astype(np.float64), np.log10((c + 0.5) / m["den"]), score

        return found

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SUMS.empty_table()
        bucket = left.column("bucket")[0].as_py()
        if bucket >= 2 * n:
            return pa.table([left.column("flush"), pa.array([True] * left.num_rows), left.column("data")], schema=_SUMS)
        row = right.to_pylist()[0] if right.num_rows else None
        look, types = (pairs, ("<u8", "<u8", "<u4")) if bucket < n else (words, ("<u8", "<u4"))
        found, out = look(sent.value, row), []
        for data in left.column("data"):
            *keys, doc = unpack(data.as_py(), *types)
            docs, at = np.unique(doc, return_inverse=True)
            out.append(pack(docs, *(np.bincount(at, weights=x) for x in found(*keys))))
        return pa.table([left.column("flush"), pa.array([False] * len(out)), pa.array(out, pa.binary())], schema=_SUMS)

    return run


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _add_up(table: pa.Table) -> pa.Table:
    """One row for each document of a flush."""
    whole = [d.as_py() for d, w in zip(table.column("data"), table.column("whole").to_pylist()) if w]
    ids, missing, tokens, *sums = (x.copy() for x in unpack(whole[0], "<i8", "<u1", "<f8", "<f8", "<f8", "<f8"))
    for data, w in zip(table.column("data"), table.column("whole").to_pylist()):
        if not w:
            docs, *parts = unpack(data.as_py(), "<u4", "<f8", "<f8", "<f8")
            for x, y in zip(sums, parts):
                x[docs] += y
    return pa.table([pa.array(ids, mask=missing.astype(bool)), pa.array(tokens.astype(np.int64)), pa.array(np.rint(sums[0]).astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], schema=_SCORES)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    sent, none = spark.sparkContext.broadcast(model.sent()), F.lit(None).cast("binary")
    sums = []
    for step in range(SLICES):
        table = model.buckets.where(F.col("bucket") % SLICES == step).select("bucket", "pairs", "words", "contexts")
        if step == 0:
            table = table.unionByName(model.rare.select("bucket", none.alias("pairs"), "words", none.alias("contexts")))
        asked = rows.mapInArrow(_occurrences(model.numbers, model.plan, sent, step, SLICES), "bucket int, flush long, data binary")
        found = asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(_evaluate(sent, model.place.n), SUMS)
        sums.append(stage(found, "lm-sums"))
        release(spark)
    total = reduce(DataFrame.unionByName, sums).groupBy("flush").applyInArrow(_add_up, SCORES)
    return total.select("doc_id", "n_tokens", "n_known", F.lit(int(model.n)).cast("long").alias("train_tokens"), "base_score", "score")


def fold_of(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0))


def op3_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = Model(docs.where(fold_of() != 1))
    return score(docs, model).withColumn("held_out", fold_of() == 1)

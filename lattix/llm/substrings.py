"""Substring dedup by sliding sentence spans.

A text is cut into pieces: after . ! ? … with white space behind, at line ends, and everywhere where the words
themselves say so: of any ``REACH`` pairs of words in a row, the one with the least hash makes a cut. So a copied passage
is cut the same way wherever it stands, but for its first and last ``REACH`` words. From each cut, the shortest run of
consecutive pieces with ``SPAN`` words or more is hashed. A run that occurs more than once in the corpus keeps its first
occurrence, by (doc_id, place); pieces covered by any other are removed.

A passage of n words has a cut common to all copies after 10 words or fewer, and the first cut SPAN words or more behind
it lies at most 8 words further. So every repeated passage of 50 words or more loses a run of at least ``SPAN`` words
wherever it isn't first, punctuated or not; what stays of it is up to 10 words at its beginning and 18 at its end. A
single sentence of fewer than ``SPAN`` words stays, however common it is; a longer one counts as a passage.

Matches are by 96 bits: a polynomial of the words' hashes modulo 2 ** 64 and 32 bits of one with other coefficients.
A corpus of 10 ** 13 runs has about one chance in a hundred of a single false match.

How it scales: one row per run. Runs are counted by hash with sums per task before the shuffle, so a passage that a third
of all rows hold is one partial row per task; the repeated ones are joined back, a join of staged tables that adaptive
execution splits where a hash is hot; only those look for their first occurrence. What is to be removed is gathered per
document, bounded by its own length, and the texts move once, by id, to meet it.

Results for odd inputs: null and blank texts have no pieces and stay as they are; equal rows lose their repeats too, also
where they share an id or have none (see ``staging.told_apart``; a null id comes after all others); an empty table gives
an empty result; other columns are not read, or kept as they are (``shortened``).
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, release, spare, stage, told_apart
from .words import WordHashes, mix, small, windows

#: Least words of a run that counts as repeated.
SPAN = 32
#: Of so many pairs of words in a row, the one with the least hash makes a cut, so pieces have at most as many words.
REACH = 9
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s)|\n")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _parts(text: str) -> tuple[list[int], list[list[bytes]]]:
    """Ends (exclusive, in characters) and words of the sentences as punctuation and line ends cut them."""
    ends, words, last = [], [], 0
    for cut in (*(m.end() for m in _END.finditer(text)), len(text)):
        own = text[last:cut].encode("utf-8").lower().split()
        if own:
            ends.append(cut)
            words.append(own)
            last = cut
    if ends:
        ends[-1] = len(text)
    return ends, words


def _marks(h: np.ndarray) -> np.ndarray:
    """Cuts (words before them) that the words themselves make: after the last least pair of any ``REACH`` in a row."""
    pairs = windows(h, 2)
    if len(pairs) < REACH:
        return np.empty(0, dtype=np.int64)
    least = REACH - 1 - sliding_window_view(pairs, REACH)[:, ::-1].argmin(1)
    chosen = np.zeros(len(h) + 1, dtype=bool)
    chosen[np.arange(len(least)) + least + 2] = True
    return np.flatnonzero(chosen[:-1])


def _cuts(words: list[list[bytes]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the words before each cut, from 0 to their number."""
    h = cache.array([w for s in words for w in s])
    chosen = np.zeros(len(h) + 1, dtype=bool)
    chosen[[0, *accumulate(map(len, words))]] = True
    chosen[_marks(h)] = True
    return h, np.flatnonzero(chosen)


def sentences(text: str, cache: WordHashes) -> tuple[list[int], list[list[bytes]]]:
    """Ends (exclusive, in characters) and words of all pieces; only pieces with words count, together they span the text."""
    own, parts = _parts(text)
    if not own:
        return [], []
    at = _cuts(parts, cache)[1].tolist()
    ends, words, k, done, last = [], [], 1, 0, 0
    for end, part in zip(own, parts):
        places, begin = None, 0
        while begin < len(part):
            upto = at[k] - done
            if upto < len(part):
                places = places or [m.end() for m in _WORD.finditer(text[last:end])]
                ends.append(last + places[upto - 1])
            else:
                ends.append(end)
            words.append(part[begin:upto])
            begin, k = upto, k + 1
        done, last = done + len(part), end
    return ends, words


def spans(sums: np.ndarray, least: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """first and last piece of the shortest run with ``least`` words from each piece on, from the words before each cut."""
    after = np.searchsorted(sums, sums[:-1] + least, "left")
    first = np.flatnonzero(after < len(sums))
    return first, after[first] - 1


_TABLE = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    if len(_TABLE[0]) < n + 1:
        for k, factor in enumerate((base, pow(base, -1, 1 << 64))):
            _TABLE[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n + 1, factor, dtype=np.uint64)]), dtype=np.uint64)
    return _TABLE[0][:n], _TABLE[1]


def run_hashes(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits for the words from ``begin`` up to ``end``, wherever in a text they stand."""
    powers, inverse = _powers(len(h))
    out = []
    for values in (h ^ (h >> np.uint64(31)), mix(h)):
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(values * powers)])
        out.append(mix((prefix[end] - prefix[begin]) * inverse[begin]))
    return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


_RUNS = pa.schema([("doc_id", pa.int64()), ("first", pa.int32()), ("hash", pa.int64()), ("check", pa.int32())])


def _runs(least: int):
    """A row for each run, and one for each text with its number of pieces as the hash and -1 as the first piece."""

    def run(batches):
        cache = WordHashes()
        for batch in small(batches):
            texts, ids, parts = batch.column(1), [], []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                text = texts[i].as_py()
                if not text:
                    continue
                h, at = _cuts(_parts(text)[1], cache)
                first, last = spans(at, least)
                ids.append(np.full(len(first) + 1, doc_id, dtype=np.int64))
                size = np.array([-1], dtype=np.int32), np.array([len(at) - 1]), np.zeros(1, dtype=np.int32)
                runs = (first.astype(np.int32), *run_hashes(h, at[first], at[last + 1]))
                parts.append([np.concatenate(x) for x in zip(size, runs)])
            columns = [np.concatenate(ids), *(np.concatenate(c) for c in zip(*parts))] if parts else [[]] * 4
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _RUNS)], schema=_RUNS)

    return run


def cut(text: str, firsts: list[int], cache: WordHashes, least: int = SPAN) -> tuple[int, int, str]:
    """Pieces of a text, how many go, and what is left, given the pieces from which repeated runs start."""
    ends, words = sentences(text, cache)
    first, last = spans(np.array([0, *accumulate(map(len, words))]), least)
    upto = dict(zip(first.tolist(), last.tolist()))
    gone = np.zeros(len(ends) + 1, dtype=np.int64)
    for f in firsts:
        gone[f] += 1
        gone[upto[f] + 1] -= 1
    gone = (np.cumsum(gone[:-1]) > 0).tolist()
    out, last = [], 0
    for a, b, g in zip([0, *ends], ends, gone):
        if not g:
            if a > last and out and not text[a].isspace() and not out[-1][-1].isspace():
                out.append(text[a - 1])  # the line end of the piece before, so that two words stay two
            out.append(text[a:b])
            last = b
    return len(ends), sum(gone), "".join(out)


def _digest(least: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def run(batches):
        cache = WordHashes()
        for batch in small(batches):
            out, texts = [], batch.column(1)
            for i, (n, firsts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                text = texts[i].as_py()
                out.append(cut(text, firsts, cache, least) if firsts else (n or 0, 0, text))
            columns = list(zip(*out)) or [[]] * 3
            yield pa.record_batch([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return run


def _shorten(text_col: str, length_col: str | None, least: int):
    """Batches with the pieces in their last column cut out of the text; texts of which nothing is left go."""

    def run(batches):
        cache = WordHashes()
        for batch in small(batches):
            names, firsts = batch.schema.names[:-1], batch.column(batch.num_columns - 1).to_pylist()
            columns = {n: batch.column(k) for k, n in enumerate(names)}
            hit = [i for i, f in enumerate(firsts) if f]
            if hit:
                texts = columns[text_col]
                new = {i: cut(texts[i].as_py(), firsts[i], cache, least)[2] for i in hit}
                columns[text_col] = pa.array([new.get(i, texts[i].as_py()) for i in range(len(texts))], pa.string())
                if length_col:
                    lengths = columns[length_col].to_pylist()
                    columns[length_col] = pa.array([len(new[i]) if i in new else n for i, n in enumerate(lengths)], columns[length_col].type)
                stays = pa.array([i not in new or bool(new[i].encode().split()) for i in range(len(texts))], pa.bool_())
                yield pa.record_batch(list(columns.values()), names=names).filter(stays)
            else:
                yield pa.record_batch(list(columns.values()), names=names)

    return run


def removals(rows: DataFrame, least: int = SPAN) -> DataFrame:
    """doc_id, n_sentences, firsts: the number of pieces of each row (doc_id, text) with any, and those from which a run
    starts that repeats an earlier one (null: none)."""
    every = stage(rows.mapInArrow(_runs(least), "doc_id long, first int, hash long, check int"), "spans")
    found = every.where("first >= 0")
    counts = found.groupBy("hash", "check").agg(F.count("*").alias("n")).where("n > 1").select("hash", "check")
    repeats = stage(found.join(stage(counts, "spans-repeated"), ["hash", "check"]), "spans-repeats")
    sizes = stage(every.where("first < 0").select("doc_id", F.col("hash").alias("n_sentences")), "spans-sizes")
    discard(every)
    release(rows.sparkSession)
    here = F.struct("doc_id", "first")
    # written, so that the sums per task come before a shuffle of their own, and the join can split a hot run
    origin = stage(repeats.groupBy("hash", "check").agg(F.min(here).alias("origin")), "spans-origins")
    again = repeats.join(origin, ["hash", "check"]).where(here != F.col("origin"))
    gone = again.groupBy("doc_id").agg(F.collect_list("first").alias("firsts"))
    gone = stage(sizes.join(gone, "doc_id", "left").select("doc_id", "n_sentences", "firsts"), "spans-removed")
    release(rows.sparkSession)
    return gone


def _met(docs: DataFrame, gone: DataFrame, row: str, *columns: str) -> DataFrame:
    """Columns of the rows, followed by those of ``gone`` (null where it has none), by one shuffle of the rows."""
    names = [spare(docs, f"__{c}") for c in gone.columns]
    # what is to be removed has no bound that is known before, so it is never broadcast
    return docs.join(gone.toDF(*names).hint("merge"), F.col(row).cast("long") == F.col(names[0]), "left").select(*columns, *names[1:])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = SPAN) -> DataFrame:
    """doc_id, n_sentences, n_removed and the text that is left of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs, row = told_apart(docs, "doc_id")
    gone = removals(docs.select(F.col(row).alias("doc_id"), "text"), least)
    return _met(docs, gone, row, "doc_id", "text").mapInArrow(_digest(least), "doc_id long, n_sentences long, n_removed long, text string")


def shortened(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, least: int = SPAN) -> DataFrame:
    """The documents with repeated passages removed, all columns kept; those of which nothing is left go.

    ``length_col`` gets the new number of characters where a text changes. Texts that were null or blank stay.
    """
    kept, schema = docs.columns, docs.schema
    docs, row = told_apart(docs, id_col)
    gone = removals(docs.select(F.col(row).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), least)
    gone = gone.where("firsts is not null").select("doc_id", "firsts")
    return _met(docs, gone, row, *kept).mapInArrow(_shorten(text_col, length_col, least), schema)


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_sentences", "n_removed", "text")

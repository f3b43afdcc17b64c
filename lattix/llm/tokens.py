"""Token ids by a public vocabulary, cached by chunk inside each Python worker.

The vocabulary file is read once on the driver and travels as a broadcast (its size is that of the file, 1.7 MB).
A chunk is a run without white space. The word tokenizer drops white space and never joins across it, so the ids of a
text are the ids of its chunks in order. Arrow splits a slice of texts, tells its distinct chunks apart and lays their ids
out again; each distinct one is looked up once. A new chunk is given to the ``tokenizers`` library once; most chunks of a
corpus are old ones, so the library sees a few per cent of the words. Chunks of lower-case Latin letters are what the
library's normalizer and pre-tokenizer would leave as they are, so the new ones of a slice go to its model at once, as one
text. To make chunks agree, Latin letters are lower-cased, and the closing punctuation of a chunk, a pre-token of its own in
any case, is looked up for itself (only in chunks without apostrophes, special tokens and other characters beside which that
could join or part a pre-token). Special tokens have a fixed case, so texts that may hold some are not lower-cased.
Texts with the separators U+001C to U+001F, which Python counts as white space and the library doesn't, are encoded whole.
"""

from __future__ import annotations

import codecs
import os
import re
import string
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
#: Chunks in each of the two generations of a worker's cache.
CACHE_CHUNKS = 250_000
_SEPARATORS = re.compile("[\x1c-\x1f]")
_NOT_LATIN = re.compile("[^\x00-\u024f]")
#: Texts that are not lower-cased before a closer look, and chunks whose closing punctuation stays with them; for Arrow.
_KEPT = "[\x00-\x08\x0e-\x1f'\x7f-\xbf\xd7\xf7\u0130\u0250-\U0010ffff]|<[|]"
#: The characters by which byte-level vocabularies write the bytes of letters and, here, the space.
_BYTES = "".join(chr(b) if b < 0x7F or b >= 0xA1 and b != 0xAD else chr(0x100 + 33 + b - 0x7F if b < 0xA1 else 0x100 + 67) for b in range(0x100))
_ENCODERS: dict[int, "Encoder"] = {}


def vocabulary(spark: SparkSession, path: str = VOCABULARY):
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(vocabulary_json: str, end_id: int | None = END_ID) -> "Encoder":
    """The worker's encoder for a vocabulary; its cache outlives a task where Spark reuses the worker."""
    key = hash((vocabulary_json, end_id))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary_json, end_id)
    return _ENCODERS[key]


def _stems_and_closings(chunks: pa.Array) -> list[pa.Array]:
    """Each chunk without the closing punctuation that is looked up for itself, and that punctuation (else empty)."""
    stems = pc.ascii_rtrim(chunks, characters=string.punctuation)
    size = pc.binary_length(stems)
    cut = pc.and_(pc.and_(pc.greater(size, 0), pc.less(size, pc.binary_length(chunks))), pc.invert(pc.match_substring_regex(chunks, _KEPT)))
    pairs = zip(*(x.filter(cut).to_numpy(zero_copy_only=False).tolist() for x in (chunks, stems)))
    closings = pa.array([chunk[len(stem) :] for chunk, stem in pairs], pa.string())
    return [pc.if_else(cut, stems, chunks), pc.replace_with_mask(pa.repeat("", len(chunks)), cut, closings)]


class Encoder:
    """Ids as little-endian unsigned 32-bit integers. The two generations of the cache map a chunk to its ids."""

    def __init__(self, vocabulary_json: str, end_id: int | None = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(vocabulary_json)
        self.end = b"" if end_id is None else end_id.to_bytes(4, "little")
        self.model = self.tokenizer.model
        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        pieces, suffix = self.tokenizer.get_vocab(with_added_tokens=False), getattr(self.model, "end_of_word_suffix", None)
        self.closes = np.zeros(max(pieces.values(), default=0) + 1, dtype=bool)
        self.closes[[i for piece, i in pieces.items() if suffix and piece.endswith(suffix)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of words of lower-case Latin letters, by the library's model."""
        joined = codecs.charmap_decode(" ".join(words).encode(), "strict", _BYTES)[0]
        ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):  # a vocabulary that doesn't mark the ends of words
            return [b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)]) for word in joined.split(" ") if word]
        offsets = pa.py_buffer(4 * np.append(0, ends))
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, offsets, pa.py_buffer(ids)]).to_numpy(zero_copy_only=False).tolist()

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        found, new, words = list(map(self.young.get, chunks)), {}, []
        for chunk in [chunk for chunk, ids in zip(chunks, found) if ids is None]:
            ids = self.old.get(chunk)
            if ids is None and chunk.isalpha() and chunk.islower() and (chunk.isascii() or not _NOT_LATIN.search(chunk)):
                words.append(chunk)
            else:
                new[chunk] = self.whole(chunk) if ids is None else ids
        new.update(zip(words, self.words(words)))
        if len(self.young) + len(new) > CACHE_CHUNKS:
            self.young, self.old = {}, self.young
        self.young.update(islice(new.items(), CACHE_CHUNKS))
        return [new[chunk] if ids is None else ids for chunk, ids in zip(chunks, found)]

    def ids(self, text: str | None) -> bytes:
        """The ids of a text and the end id."""
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and the end id."""
        ready, whole = [], {}
        kept = pc.match_substring_regex(pa.array(texts, pa.string()), _KEPT).to_pylist()
        for i, text in enumerate(texts):
            if not text:
                ready.append("")
            elif not kept[i]:
                ready.append(text.lower())
            elif _SEPARATORS.search(text):
                ready.append("")
                whole[i] = self.whole(text) + self.end
            else:  # white space beyond ASCII too
                ready.append(" ".join((text if "<|" in text or _NOT_LATIN.search(text) else text.lower()).split()))
        split = pc.ascii_split_whitespace(pa.array(ready, pa.string()))
        chunks = split.values.dictionary_encode()
        both = pa.concat_arrays(_stems_and_closings(chunks.dictionary)).dictionary_encode()
        known = self.chunks(both.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, n = pa.array(known, pa.large_binary()).take(both.indices), len(chunks.dictionary)
        laid = pc.binary_join_element_wise(ids[:n], ids[n:], pa.scalar(b"", pa.large_binary())).take(chunks.indices)
        ends = np.append(0, np.cumsum(pc.binary_length(laid).to_numpy()))
        at, raw = ends[split.offsets.to_numpy()].tolist(), memoryview(laid.buffers()[2] or b"")
        return [whole.get(i) or b"".join((raw[at[i] : at[i + 1]], self.end)) for i in range(len(texts))]

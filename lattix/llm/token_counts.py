"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the vocabulary's word mark in front. Its best segmentation is the one with the largest sum of
piece scores; ties go to fewer pieces. The best score of a prefix depends on the prefix alone, so distinct pre-tokens
are put in a trie, and the forward score of each node is computed once however many pre-tokens share it. Every node stores
its score and how many pieces it takes; the node where a pre-token ends is kept under that word, with the number of times
that the text has it.

Scores: the public vocabulary lists its pieces by rank, and a piece of rank r scores -ln(r + 1) (Zipf's law). A character
that no piece covers costs its UTF-8 bytes, each as a piece of the last rank.

How it scales: one pass without a shuffle. Each Python worker keeps one trie of at most ``NODES`` nodes, looked at after
every pre-token, and starts anew beyond it, keeping the last one's results by word (fewer than its nodes); pre-tokens of
more than ``LONG`` characters are scored by the same recurrence without being kept. The pieces travel as one broadcast
whose size is that of the vocabulary file (0.5 MB).

Results for odd inputs: a null or blank text has no pre-tokens and score 0; very long words are cut like others (work
grows with their length times that of the longest piece, memory with that of the longest piece); repeated rows, null ids and extra columns are no matter; an
empty table gives an empty result.
"""

from __future__ import annotations

import gc
import math
from collections import Counter

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import small

PIECES = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
NODES = 400_000
#: Characters of pre-tokens that are kept in the trie.
LONG = 1000


def piece_scores(path: str = PIECES) -> dict[str, float]:
    """piece -> score for the ordinary pieces of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            out.setdefault(model.id_to_piece(i), -math.log(len(out) + 2))
    return out


def endings(scores: dict[str, float]) -> dict:
    """A trie of the pieces read backwards: char -> node; a node has its piece's score at "". """
    root: dict = {}
    for piece, score in scores.items():
        node = root
        for char in reversed(piece):
            node = node.setdefault(char, {})
        node[""] = score
    return root


class Trie:
    """Forward scores of prefixes. A node is [children, best score, pieces of the best segmentation]."""

    def __init__(self, scores: dict[str, float], nodes: int = NODES):
        self.limit, self.endings = nodes, endings(scores)
        self.longest = max(map(len, scores), default=1)
        self.floor = -math.log(len(scores) + 2)
        self.known: dict[str, list] = {}
        self._renew()

    def _renew(self) -> None:
        """A new trie; what the words of the last one came to is kept for one more generation."""
        self.old = {word: node[1:] for word, node in self.known.items()}
        self.known, self.size, self.root = {}, 0, [{}, 0.0, 0]

    def _step(self, token: str, end: int, path: list, shift: int = 0) -> list:
        """The node after character ``end``, from those before it (``path[0]`` is the one at character ``shift``)."""
        char = token[end]
        n_bytes = len(char.encode("utf-8"))
        before = path[end - shift]
        best, pieces = before[1] + n_bytes * self.floor, before[2] + n_bytes
        ending, start = self.endings.get(char), end
        while ending is not None:
            if "" in ending:
                before = path[start - shift]
                total, count = before[1] + ending[""], before[2] + 1
                if total > best or total == best and count < pieces:
                    best, pieces = total, count
            if start == shift:
                break
            start -= 1
            ending = ending.get(token[start])
        return [{}, best, pieces]

    def insert(self, word: str) -> list:
        token, node = MARK + word, self.root
        path = [node]
        for end, char in enumerate(token):
            child = node[0].get(char)
            if child is None:
                child = node[0][char] = self._step(token, end, path)
                self.size += 1
            path.append(child)
            node = child
        return node

    def long(self, word: str) -> list:
        """The last node of a word that is not kept: only nodes within the reach of a piece are held."""
        token, path, shift = MARK + word, [self.root], 0
        for end in range(len(token)):
            path.append(self._step(token, end, path, shift))
            if len(path) > 4 * self.longest + 1000:
                drop = len(path) - 1 - self.longest
                del path[:drop]
                shift += drop
        return path[-1]

    def find(self, word: str) -> list:
        """[..., score, pieces] of a word."""
        found = self.known.get(word) or self.old.get(word)
        if found is None:
            if len(word) > LONG:
                return self.long(word)
            found = self.insert(word)
        if len(found) == 2:
            found = [None, *found]
        self.known[word] = found
        if self.size > self.limit or len(self.known) > self.limit:
            self._renew()
        return found

    def count(self, text: str | None) -> tuple[int, int, float]:
        """Pre-tokens, tokens and score of a text."""
        words = text.split() if text else []
        tokens, values = 0, []
        for word, times in Counter(words).items():
            node = self.known.get(word) or self.find(word)
            tokens += times * node[2]
            values.append(times * node[1])
        return len(words), tokens, math.fsum(values)


_TRIES: dict[int, Trie] = {}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = PIECES) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score of every row."""
    scores = docs.sparkSession.sparkContext.broadcast(piece_scores(path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(batches):
        key = hash(frozenset(scores.value.items()))
        if key not in _TRIES:
            _TRIES.clear()
            _TRIES[key] = Trie(scores.value)
        trie = _TRIES[key]
        for batch in small(batches):
            texts = batch.column(1)
            gc.disable()  # a trie has no cycles, and looking for some walks all its nodes
            try:
                cols = list(zip(*(trie.count(texts[i].as_py()) for i in range(len(texts))))) or [[]] * 3
            finally:
                gc.enable()
            yield pa.record_batch([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:]))], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Quality rules with host verdicts.

Each text is measured and held against two rules (too few words; too many words inside repeated windows). Failures are
summed per host, the failure rate of a host is shrunk towards the rate of all hosts by a beta prior fitted to the hosts
themselves (method of moments), and a host loses all its documents if its shrunk rate is above ``TIMES`` the mean of all
hosts, or above ``MOST`` where that is less. Below ``LEAST`` no host goes.

How it scales: one pass over the texts in Arrow batches, one map-side summed aggregate by host (a host with a third of
all rows sends one partial row per task), one-row statistics for the prior, and a join of verdicts. Only rejected hosts
are joined back; they are broadcast only if they are counted to be few.

Results for odd inputs: a null or blank text has no words, so it fails; a null host is a host of its own; copies are
rows of their own; an empty table gives an empty result; other columns are not read, or kept as they are (``keep``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import spare, stage
from .words import WordHashes, small, windows

MIN_WORDS = 20
#: Largest share, in hundredths, of words inside windows found twice or more.
MAX_REPEATED = 30
WINDOW = 8
#: A host is rejected if its shrunk failure rate is above so many times the mean, held between LEAST and MOST.
TIMES, LEAST, MOST = 3.0, 0.2, 0.5
#: Rejected hosts that are broadcast; more of them are joined by a shuffle.
BROADCAST_HOSTS = 10_000

#: The symbols that are counted.
_SYMBOLS = b"#*$%&|<>"
_OTHERS = bytes(b for b in range(256) if b not in _SYMBOLS)
_BLANKS = b" \t\n\x0b\x0c\r"
MEASURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))])


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included."""
    runs = windows(hashes, width)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order[1:]] == runs[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(runs), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.encode("utf-8").split(b"\n") if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def _measure(batches):
    cache = WordHashes()
    for batch in small(batches):
        out = []
        texts = batch.column(2)
        for text in (texts[i].as_py() for i in range(len(texts))):
            raw = text.encode("utf-8") if text else b""
            words = raw.split()
            solid = raw.translate(None, _BLANKS)
            out.append((len(words), len(solid.decode("utf-8")), len(raw.translate(None, _OTHERS)), duplicate_lines(text or ""), repeated_words(cache.array(words))))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), *(pa.array(c, pa.int64()) for c in cols)], schema=_SCHEMA)


def measures(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The measures of every text and whether it fails the rules of its own."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.mapInArrow(_measure, MEASURES).withColumn("base_failed", failed)


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n, failed, rate (shrunk) and rejected.

    The prior is a beta distribution with the mean m and the variance v of the hosts' rates: strength
    s = m (1 - m) / v - 1, held between 1 and 1,000,000, and shrunk rate = (failed + s m) / (n + s).
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    prior = hosts.agg((F.sum("failed") / F.sum("n")).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"))  # one row
    strength = F.when(F.col("v") > 0, F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.when(F.col("v") > 0, F.col("v")) - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))
    shrunk = (F.col("failed") + F.col("s") * F.col("m")) / (F.col("n") + F.col("s"))
    bar = F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.lit(TIMES) * F.col("m")))
    return hosts.crossJoin(F.broadcast(prior.withColumn("s", strength))).select("host", "n", "failed", shrunk.alias("rate"), (shrunk > bar).alias("rejected"))


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document with its measures, base_failed, the host's verdict and kept."""
    measured = stage(measures(docs, id_col, host_col, text_col), "quality")
    bad = stage(host_rates(measured).where("rejected").select(F.col("host").alias("bad_host"), F.lit(True).alias("host_rejected")), "hosts")
    few = bad.count() <= BROADCAST_HOSTS
    out = measured.join(F.broadcast(bad) if few else bad, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    out = out.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False))).drop("bad_host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def passes(text: str | None, cache: WordHashes) -> bool:
    """The rules of a text's own."""
    words = text.encode("utf-8").split() if text else []
    return len(words) >= MIN_WORDS and 100 * repeated_words(cache.array(words)) <= MAX_REPEATED * len(words)


def _passing(text_col: str):
    def run(batches):
        cache = WordHashes()
        for batch in small(batches):
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([passes(texts[i].as_py(), cache) for i in range(len(texts))], pa.bool_()))

    return run


def keep(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns. Texts are read twice rather than shuffled or stored."""
    rates = host_rates(measures(docs, id_col, host_col, text_col).select("host", "base_failed"))
    name = spare(docs, "__bad")
    bad = stage(rates.where("rejected").select(F.col("host").alias(name)), "hosts")
    n = bad.count()
    passed = docs.mapInArrow(_passing(text_col), docs.schema)
    if n == 0:
        return passed
    return passed.join(F.broadcast(bad) if n <= BROADCAST_HOSTS else bad, F.col(host_col).eqNullSafe(F.col(name)), "left_anti")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    shifts = " || ' ' || ".join(f"lead(w, {k}) OVER d" if k else "w" for k in range(WINDOW))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM t)),
g AS (SELECT r, i, {shifts} AS run FROM w WINDOW d AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM g WHERE run IS NOT NULL),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, range({WINDOW}) AS k(k) WHERE n > 1 GROUP BY r),
n AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, source, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM t LEFT JOIN n USING (r) LEFT JOIN p USING (r) LEFT JOIN l USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS failed FROM f GROUP BY source),
b AS (SELECT sum(failed) / sum(n) AS mu, var_pop(failed / n) AS v FROM h),
s AS (SELECT mu, CASE WHEN v > 0 THEN least(greatest(mu * (1 - mu) / v - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM b),
x AS (SELECT source, (failed + s * mu) / (n + s) > least({MOST}, greatest({LEAST}, {TIMES} * mu)) AS rejected FROM h, s)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN x ON f.source IS NOT DISTINCT FROM x.source"""


ORACLE = _oracle()

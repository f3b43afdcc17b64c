"""Toxicity by a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios.

A text is lower-cased, runs of anything but letters and digits (below U+0080) become one blank, and its distinct n-grams of
``SIZES`` characters (blanks at both ends included) are its features. With df the labelled texts of a class that hold a
feature and s = ``SMOOTH``, a feature's ratio is r = log((df1 + s p1) / n1) - log((df0 + s p0) / n0), p being the classes'
shares: a feature seen once stays near 0, one that is common in toxic texts only becomes large. A logistic regression is
then fitted to r times presence. The score of a text is the classifier's probability with the classes' true shares.

How it scales: the classifier is fitted on at most ``FIT_ROWS`` labelled rows of each class, in the order of a hash of
the id, whole texts each; that bound is a parameter, and the share of a class that is left out is made up for by weights.
Counts of features are summed per task before they move. The ``FEATURES`` of the largest ratios (by ratio times root of
document frequency; least ratio ``LEAST``) are kept. All documents are then scored in one pass without a shuffle by a
broadcast of that fixed size; a bitmap of hashes sorts out most n-grams, and a sorted list of 64-bit hashes decides.

Results for odd inputs: a null or blank text has no feature of its own and gets the score of the intercept; a document with
several labels is toxic if one of them is 1; null labels, and labels without a document, count as none; repeated rows are
rows of their own; a null id is never labelled and counts as held out; without labelled rows, or with one class only, every
text gets the class's smoothed share (0.5 without any); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import discard, few, stage
from .words import mix, small

SIZES = (3, 4, 5, 6)
#: Labelled rows of a class that the classifier is fitted on, at most.
FIT_ROWS = 20_000
FEATURES = 1 << 16
#: Texts of the base rate that every feature is seen in besides; least ratio, and least texts, of a feature.
SMOOTH, LEAST, LEAST_TEXTS = 50.0, 0.5, 3
REGULARIZATION, ITERATIONS = 1e-3, 15
FOLDS, HELD_OUT = 5, 0
#: Characters of a text that a worker takes at a time.
STRETCH = 1_000_000
_MAP_BITS = 22
_BLANK = np.uint32(32)
_PARTS = np.array([not (chr(c).isalnum()) for c in range(128)])


def _stretches(text: str) -> Iterator[np.ndarray]:
    """The characters of a folded text, a blank at both ends, in stretches that overlap by what an n-gram needs."""
    text, last = text.lower(), max(SIZES) - 1
    before = np.array([_BLANK], dtype=np.uint32)
    for k in range(0, max(len(text), 1), STRETCH):
        c = np.frombuffer(text[k : k + STRETCH].encode("utf-32-le"), dtype=np.uint32)
        c = np.where(_PARTS[np.minimum(c, 127)] & (c < 128), _BLANK, c)
        c = np.concatenate([before, c, [_BLANK]] if k + STRETCH >= len(text) else [before, c]).astype(np.uint32)
        c = c[(c != _BLANK) | np.append(True, c[:-1] != _BLANK)]
        yield c
        before = c[-last:]


def grams(text: str | None) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of a text, in pieces, with repeats."""
    for c in _stretches(text or ""):
        h = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, max(SIZES) + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :].astype(np.uint64)
            if n in SIZES:
                yield mix(h + np.uint64(n))


def _distinct(text: str | None) -> np.ndarray:
    return np.unique(np.concatenate([np.unique(g) for g in grams(text)] or [np.empty(0, dtype=np.uint64)]))


_FLUSH = 4_000_000


def _count(batches):
    """feature, df0, df1 of the texts of a task (label, text), summed whenever many have come together."""
    parts: list[list[np.ndarray]] = [[], []]
    size = 0

    def flush():
        keys, at = np.unique(np.concatenate([*parts[0], *parts[1], np.empty(0, dtype=np.uint64)]), return_inverse=True)
        first = sum(map(len, parts[0]))
        df0, df1 = (np.bincount(x, minlength=len(keys)) for x in (at[:first], at[first:]))
        return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(df0, pa.int64()), pa.array(df1, pa.int64())], names=["feature", "df0", "df1"])

    for batch in small(batches):
        texts = batch.column(1)
        for i, label in enumerate(batch.column(0).to_pylist()):
            parts[label].append(_distinct(texts[i].as_py()))
            size += len(parts[label][-1])
            if size > _FLUSH:
                yield flush()
                parts, size = [[], []], 0
    yield flush()


class Lexicon:
    """Sorted feature hashes with their weights, and a bitmap of their first bits."""

    def __init__(self, features: np.ndarray, weights: np.ndarray):
        order = np.argsort(features)
        self.features, self.weights = features[order], weights[order]
        self.map = np.zeros(1 << _MAP_BITS, dtype=bool)
        self.map[self.features >> np.uint64(64 - _MAP_BITS)] = True

    def places(self, text: str | None) -> np.ndarray:
        """Places of the distinct features that a text has."""
        found = [np.empty(0, dtype=np.uint64)]
        for h in grams(text):
            found.append(np.unique(h[self.map[h >> np.uint64(64 - _MAP_BITS)]]))
        h = np.unique(np.concatenate(found))
        if not len(h) or not len(self.features):
            return np.empty(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
        return at[self.features[at] == h]


def _named(lexicon):
    """label, share and the names of the features of each text, for the classifier."""
    schema = pa.schema([("label", pa.float64()), ("weight", pa.float64()), ("features", pa.list_(pa.string()))])

    def run(batches):
        for batch in small(batches):
            texts = batch.column(2)
            names = [[str(p) for p in lexicon.value.places(texts[i].as_py())] for i in range(len(texts))]
            yield pa.record_batch([batch.column(0).cast(pa.float64()), batch.column(1), pa.array(names, pa.list_(pa.string()))], schema=schema)

    return run


@dataclass
class Model:
    lexicon: Lexicon
    intercept: float

    def probability(self, text: str | None) -> float:
        z = self.intercept + float(self.lexicon.weights[self.lexicon.places(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def _constant(share: float) -> Model:
    return Model(Lexicon(np.empty(0, dtype=np.uint64), np.empty(0)), float(np.log(share / (1 - share))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """The classifier of the labelled rows of ``docs``, at most ``fit_rows`` of each class."""
    send = docs.sparkSession.sparkContext.broadcast
    marks = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) == 1).cast("int").alias("label")).where("id is not null and label is not null")
    marks = stage(marks.groupBy("id").agg(F.max("label").alias("label")), "toxic-labels")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = stage(texts.select("id").join(few(marks), "id"), "toxic-known")
    n = dict(known.groupBy("label").agg(F.count("*")).collect())
    total = sum(n.values())
    if len(n) < 2:
        return _constant((n.get(1, 0) + 1) / (total + 2))
    # the sample: ids whose hash is below a bar that about ``fit_rows`` of the class are below; all where there are no more
    share = {c: min(1.0, fit_rows / n[c]) for c in (0, 1)}
    draw = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    chosen = few(known.where(draw < F.when(F.col("label") == 1, share[1]).otherwise(share[0])).distinct())
    drawn = texts.join(chosen, "id").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    sample = stage(drawn.select("label", "text"), "toxic-sample")
    m = dict(sample.groupBy("label").agg(F.count("*")).collect())
    if len(m) < 2:
        return _constant((n[1] + 1) / (total + 2))

    counts = sample.mapInArrow(_count, "feature long, df0 long, df1 long").groupBy("feature").agg(F.sum("df0").alias("df0"), F.sum("df1").alias("df1"))
    p1 = n[1] / total
    # document frequencies of the whole classes, as the sample's shares tell them
    seen = {c: F.col(f"df{c}") * F.lit(n[c] / m[c]) for c in (0, 1)}
    ratio = F.log((seen[1] + SMOOTH * p1) / n[1]) - F.log((seen[0] + SMOOTH * (1 - p1)) / n[0])
    counts = counts.where(F.col("df0") + F.col("df1") >= LEAST_TEXTS).select("feature", ratio.alias("ratio"), (F.col("df0") + F.col("df1")).alias("df"))
    best = counts.where(F.abs("ratio") >= LEAST).orderBy((F.abs("ratio") * F.sqrt("df")).desc(), "feature").limit(FEATURES).select("feature", "ratio").toArrow()
    features, ratios = best.column("feature").to_numpy().view(np.uint64), best.column("ratio").to_numpy()
    if not len(features):
        return _constant((n[1] + 1) / (total + 2))

    lexicon = Lexicon(features, ratios)
    weights = F.when(F.col("label") == 1, n[1] / m[1]).otherwise(n[0] / m[0]).alias("weight")
    rows = sample.select("label", weights, "text").mapInArrow(_named(send(lexicon)), "label double, weight double, features array<string>")
    rows = stage(rows, "toxic-features")
    discard(sample)
    present = CountVectorizerModel.from_vocabulary([str(k) for k in range(len(features))], inputCol="features", outputCol="present").setBinary(True)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(lexicon.weights.tolist()), inputCol="present", outputCol="scaled")
    train = scaled.transform(present.transform(rows)).select("label", "weight", "scaled")
    learned = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", standardization=False, regParam=REGULARIZATION, maxIter=ITERATIONS).fit(train)
    return Model(Lexicon(lexicon.features, lexicon.weights * learned.coefficients.toArray()), float(learned.intercept))


def _score(model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in small(batches):
            texts = batch.column(1)
            yield pa.record_batch([batch.column(0), pa.array([model.value.probability(texts[i].as_py()) for i in range(len(texts))], pa.float64())], schema=schema)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_score(sent), "doc_id long, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs.where(~held_out()), labels)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

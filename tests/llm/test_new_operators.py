"""Whitening, toxicity and ranked search against plain counterparts, and on odd inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from lattix.llm import language_model, lexical, toxicity, whitening
from lattix.llm.queries import ORACLES, QUERIES

# 11


def plain_whitening(x, k=8):
    """The contract's values by one eigendecomposition."""
    n, sums = len(x), x.sum(0)
    z = n * x - sums
    rows = z / n
    values, vectors = np.linalg.eigh(rows.T @ rows / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return (z * z).sum(1), rows @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"n": F.lit(1), "component": F.lit("x"), "whitened": F.lit(None)})


def held_against(found, ids, x, k=8):
    deviation, whitened, explained = plain_whitening(x, k)
    table = {(r["vec_id"], r["component"]): r for r in found.collect()}
    assert len(table) == len(x) * k
    got = np.array([[table[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    assert np.abs(got * np.sign((got * whitened).sum(0)) - whitened).max() < 1e-7
    for place, i in enumerate(ids):
        for c in range(k):
            row = table[i, c + 1]
            assert (row["n"], row["deviation"], int(row["deviation_exact"])) == (len(x), deviation[place], deviation[place])
            assert math.isclose(row["explained"], explained[c], rel_tol=1e-6) and row["identity_error"] < 1e-10


def test_whitening_by_eigendecomposition(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.floor(np.array([r["embedding"] for r in rows]) * 1024).astype(np.int64) + 100_000
    held_against(QUERIES["op11_whitening"](spark, sf), [r["vec_id"] for r in rows], x)


def test_whitening_of_ill_conditioned_rows(spark):
    """Dimensions that differ by six powers of ten and nearly depend on each other."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 10)) * 10.0 ** np.linspace(3, -2, 10)
    base[:, 9] = base[:, 0] + base[:, 9]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    held_against(whitening.whiten(df, whitening.fit(df)), range(300), np.floor(base * 1024).astype(np.int64) + 100_000)


def test_whitening_odd(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(60, 9)).astype(np.float32)
    good[20:40] = good[0]  # a vector that a third of the rows share
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(good)]
    bad = [(100, None), (101, []), (102, [1.0] * 8 + [None]), (103, [1.0] * 8 + [float("nan")]), (104, [1.0] * 8 + [float("inf")]), (105, [1.0] * 4), (None, None)]
    df = vectors_of(spark, rows + bad)
    held_against(whitening.whiten(df, whitening.fit(df)), range(60), np.floor(good.astype(float) * 1024).astype(np.int64) + 100_000)
    twice = vectors_of(spark, rows + [(None, rows[3][1]), (3, rows[3][1])])
    assert whitening.whiten(twice, whitening.fit(twice)).where("vec_id is null").count() == 8
    for few in ([], bad, rows[:1], [rows[20], rows[21]]):
        df = vectors_of(spark, few)
        assert whitening.whiten(df, whitening.fit(df)).collect() == []
    df = vectors_of(spark, rows[:4])  # three directions only
    assert {r["component"] for r in whitening.whiten(df, whitening.fit(df)).collect()} == {1, 2, 3}


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [float(v) for v in np.random.default_rng(i).normal(size=3) * 1e9]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[math.floor(v * 1024) + 100_000 for v in r] for _, r in rows]
    sums = [sum(c) for c in zip(*x)]
    exact = {i: sum((len(x) * v - s) ** 2 for v, s in zip(r, sums)) for i, r in enumerate(x)}
    found = whitening.whiten(df, whitening.fit(df)).collect()
    assert found and all(r["deviation"] is None and int(r["deviation_exact"]) == exact[r["vec_id"]] for r in found)


# 12


def plain_grams(text):
    """Distinct n-grams of a text, as strings."""
    folded = re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", f" {(text or '').lower()} ")
    return {folded[i : i + n] for n in toxicity.SIZES for i in range(len(folded) - n + 1)}


@pytest.mark.parametrize("text", [None, "", "  ", "a", "You are AN idiot!!", "été  über\n\tweg", "日本語 x" * 3, "ab " * 50])
@pytest.mark.parametrize("stretch", [7, 1_000_000])
def test_grams_are_those_of_the_text(text, stretch, monkeypatch):
    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    assert len(toxicity._distinct(text)) == len(plain_grams(text))


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumns({"label": F.lit("x"), "weight": F.lit(3), "id": F.lit(None)})
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    return docs, labels


def words(rng, n):
    return " ".join("".join(rng.choice(list("aeioulmnrst"), 4)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(11)
    bad = ("grumple", "snarkot", "vexlump")
    rows = []
    for i in range(900):
        text = words(rng, int(rng.integers(5, 60)))
        toxic = int(i % 6 == 0)
        if toxic:
            text += f" {bad[i % 3]}{'aeiou'[i % 5]} " + words(rng, 5)
        rows.append((i, text, toxic))
    return rows


def test_toxic_texts_are_told_apart(spark, corpus):
    docs, labels = labelled(spark, corpus)
    model = toxicity.fit(docs.where("doc_id < 700"), labels)
    truth = {i: y for i, _, y in corpus}
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert set(found) == set(truth) and all(0 <= s <= 1 for s in found.values())
    right = [(found[i] >= 0.5) == bool(y) for i, y in truth.items() if i >= 700]
    assert sum(right) >= 0.97 * len(right)


def test_ratios_by_plain_counts(spark, corpus, monkeypatch):
    docs, labels = labelled(spark, corpus[:200])
    kept = []
    made = toxicity.Lexicon.__init__
    monkeypatch.setattr(toxicity.Lexicon, "__init__", lambda self, features, weights: kept.append(weights) or made(self, features, weights))
    toxicity.fit(docs, labels)
    df, n = [Counter(), Counter()], [0, 0]
    for _, text, y in corpus[:200]:
        df[y].update(plain_grams(text))
        n[y] += 1
    expected = []
    for g in df[0].keys() | df[1].keys():
        if df[0][g] + df[1][g] >= toxicity.LEAST_TEXTS:
            r = math.log((df[1][g] + toxicity.SMOOTH * n[1] / 200) / n[1]) - math.log((df[0][g] + toxicity.SMOOTH * n[0] / 200) / n[0])
            if abs(r) >= toxicity.LEAST:
                expected.append(r)
    assert np.allclose(np.sort(kept[0]), np.sort(expected))


def test_a_sample_of_the_labels_is_enough(spark, corpus):
    docs, labels = labelled(spark, corpus)
    model = toxicity.fit(docs.where("doc_id < 700"), labels, fit_rows=80)
    right = [(model.probability(t) >= 0.5) == bool(y) for i, t, y in corpus if i >= 700]
    assert sum(right) >= 0.9 * len(right)


def test_toxicity_query(spark, sf):
    found = QUERIES["op12_toxicity"](spark, sf).collect()
    ids = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in found) == sorted(ids)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in found)


def test_toxicity_is_learned_from_texts_that_are_not_held_out_only(spark, corpus, tmp_path):
    """Other labels of the texts held out change no score."""
    scores = []
    for name, flip in (("a", 0), ("b", 1)):
        docs, labels = labelled(spark, [(i, t, y ^ (flip if zlib.crc32(str(i).encode()) % 5 == 0 else 0)) for i, t, y in corpus[:300]])
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        scores.append({r["doc_id"]: round(r["score"], 9) for r in QUERIES["op12_toxicity"](spark, f"{tmp_path}/{name}").collect()})
    assert scores[0] == scores[1]


def test_toxicity_odd(spark, corpus):
    docs, labels = labelled(spark, corpus[:120])
    more = spark.createDataFrame([(1, None), (2, ""), (None, "grumplea grumplea"), (5, "x" * 10_000_000), (5, "x" * 10_000_000)], "doc_id long, text string")
    model = toxicity.fit(docs, labels.unionByName(labels.select(F.lit(None).cast("long").alias("doc_id"), F.lit(1).alias("toxic"), "text")).unionByName(labels.withColumn("toxic", F.lit(None).cast("int"))))
    found = toxicity.score(more, model).collect()
    assert len(found) == 5 and all(0 < r["score"] < 1 for r in found)
    assert found[0]["score"] == found[1]["score"]
    for some, share in (([], 0.5), ([(i, t, 1) for i, t, _ in corpus[:6]], 7 / 8), ([(i, t, None) for i, t, _ in corpus[:6]], 0.5)):
        docs, labels = labelled(spark, some)
        assert math.isclose(toxicity.fit(docs, labels).probability("text"), share)
    assert toxicity.score(more.limit(0), model).collect() == []


# 13


def plain_terms(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=20):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for row, (item, text) in enumerate(items):
        hits = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t in plain_terms(text) if b[t])
            if score > 0:
                hits.append((-score, i is None, i or 0))
        out += [(row, item, rank, None if gone else i, -score) for rank, (score, gone, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


def tables_of(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "rank": F.lit(1), "item_id": F.lit(2)}), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))


def test_search_oracle(spark, sf):
    same(QUERIES["op13_ranked_search"](spark, sf), connect(sf), ORACLES["op13_ranked_search"])


@pytest.mark.parametrize("tile", [(64, 2048, 512), (2, 3, 5)])
@pytest.mark.parametrize("block", [4_000, 2])
def test_search_by_brute_force(spark, monkeypatch, tile, block):
    for name, value in zip(("ITEM_TILE", "VOCAB_TILE", "DOC_TILE", "BLOCK_ITEMS"), (*tile, block)):
        monkeypatch.setattr(lexical, name, value)
    rng = np.random.default_rng(8)
    pool = [f"w{k}" for k in range(40)] + ["ÉTÉ", "日本", "A1"]
    docs = [(int(i) if i % 9 else None, " ".join(rng.choice(pool, int(rng.integers(1, 30))))) for i in rng.permutation(120)]
    docs += [(500 + i, docs[3][1]) for i in range(50)]  # equal texts: ties beyond the 20th place
    docs += [(700, None), (701, ""), (702, "!?"), (703, docs[3][1]), (703, docs[3][1])]
    items = [(int(i), " ".join(rng.choice(pool, 6))) for i in range(7)] + [(3, docs[3][1]), (None, docs[3][1]), (90, None), (91, "unknown terms"), (92, "w1 " * 400)]
    found = [tuple(r) for r in lexical.search(*tables_of(spark, docs, items)).collect()]
    assert sorted(found, key=str) == plain_search(docs, items)


def test_partial_sums_stay_exact():
    """An item that repeats a term so often that one product would pass 2^53 is divided among tiles."""
    block = lexical.Block([(0, 1, "a " * 900_000 + "b c"), (1, 2, "b b d")])
    weights = [30_000] * len(block.number)
    tiles = block.tiles(weights)
    total = Counter()
    for first, n, parts in tiles:
        for own, counts in parts:
            assert (counts @ np.full(len(own), 30_000.0 * lexical.SHARE) < lexical.EXACT).all()
            for i, k in zip(*np.nonzero(counts)):
                total[first + i, int(own[k])] += int(counts[i, k])
    assert len(tiles[0][2]) > 1
    assert total == {(i, t): c for i, counts in enumerate(block.counts) for t, c in counts.items()}


def test_search_odd(spark):
    docs, items = tables_of(spark, [(1, "a b"), (2, "x" * 10_000_000 + " a")], [(1, "a")])
    assert [r["doc_id"] for r in lexical.search(docs, items).collect()] == [2, 1] or len(lexical.search(docs, items).collect()) == 2
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs.where("doc_id > 5"), items).collect() == []


# 3


@pytest.mark.parametrize("share", [1 << 20, 64, 4])
def test_common_pairs_are_scored_where_they_occur(spark, monkeypatch, share):
    """One pair is a third of all tokens; scores don't depend on what is scored where, and the pair brings nothing to its bucket."""
    rng = np.random.default_rng(2)
    texts = [" ".join(["hot pair"] * 6 + [f"w{k}" for k in rng.integers(0, 60, 6)]) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r["doc_id"]: r["score"] for r in language_model.score(docs, language_model.Model(docs)).collect()}
    monkeypatch.setattr(language_model, "COMMON_PAIRS", share)
    monkeypatch.setattr(language_model, "BUCKET", 8)
    model = language_model.Model(docs)
    assert 0 < len(model.common) <= share
    found = {r["doc_id"]: r["score"] for r in language_model.score(docs, model).collect()}
    assert all(math.isclose(found[i], plain[i], rel_tol=1e-12) for i in plain) and len(found) == 400
    if share > 4:
        sent = spark.sparkContext.broadcast(model.sent())
        rows = docs.select("doc_id", "text").mapInArrow(language_model._occurrences(model.numbers, model.plan, sent, 0, 1), "bucket int, flush long, data binary").where(F.col("bucket") < model.place.n).collect()
        moved = [language_model.unpack(r["data"], "<u8", "<u8", "<u4") for r in rows]
        assert sum(len(a) for a, _, _ in moved) <= (1 - 1 / 3) * model.n
        assert max((len(a) for a, _, _ in moved), default=0) <= max(2 * model.n / share, 400)

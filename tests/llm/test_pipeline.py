"""The pipeline against planted cases and its parts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattix.llm.queries import QUERIES


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = np.random.default_rng(9)

    def prose(n):
        return " ".join(". ".join(" ".join(f"v{x}" for x in rng.integers(0, 10**6, k)) for k in rng.integers(5, 14, n)).split(" ")) + ". "

    passage, item = prose(8), " ".join(f"bench{x}" for x in rng.integers(0, 10**6, 25))
    clean = {i: prose(20) for i in range(60)}
    docs = dict(clean)
    near = clean[3].split(" ")
    near[40], near[90] = "changed", "words"
    docs |= {100: clean[1], 101: " ".join(near), 102: "too few words", 103: "same words " * 40, 104: None, 105: prose(9) + item.upper() + " " + prose(9)}
    docs |= {110 + i: prose(9) + passage + prose(9) for i in range(3)}
    folder = str(tmp_path_factory.mktemp("planted"))
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, passage


def test_stages(spark, planted):
    folder, texts, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, work in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(work(spark, docs, folder), "test")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(60)) | {110, 111, 112}
    assert set(kept["quality rules"]) == set(texts) - {102, 103, 104}
    assert set(kept["near dedup"]) == set(kept["quality rules"]) - {100, 101}
    last = kept["substring dedup"]
    assert set(last) == set(kept["near dedup"]) and all(last[i].text == texts[i] for i in range(60)) and passage in last[110].text
    for i in (111, 112):
        assert len(set(last[i].text.split()) & set(passage.split())) < 0.4 * len(passage.split()) and last[i].n_chars == len(last[i].text)
    assert set(kept["decontamination"]) == clean


def test_run_covers_what_is_left(spark, planted):
    folder = planted[0]
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(range(60)) | {110, 111, 112}


def test_all_queries_are_there():
    assert {n: sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)} == dict.fromkeys(range(1, 11), 1)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def walk(spark, docs, folder):
    for _, work in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(work(spark, docs, folder), "test")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    return docs, corpus_pipeline.STAGES[-1][1](spark, docs, folder)


def test_stages_of_nothing(spark, planted):
    folder, _, _ = planted
    docs, packed = walk(spark, spark.createDataFrame([], SCHEMA), folder)
    assert docs.count() == packed.count() == 0


def test_stages_tell_rows_apart(spark, planted):
    """Repeated and null ids, equal rows, one very long text, and further columns with names that the stages use inside."""
    folder, _, _ = planted
    rng = np.random.default_rng(1)
    prose = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**7, n))
    one, two, long = prose(100), prose(120), prose(150_000)
    rows = [(5, one), (5, one), (5, two), (None, prose(90)), (None, one), (7, long), (8, long + " tail"), (9, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], SCHEMA)
    for clash in ("__bad", "__gone", "__row", "__key", "__firsts", "a", "b", "n"):
        docs = docs.withColumn(clash, F.lit(1))
    kept, packed = walk(spark, docs, folder)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(5, one), (5, two), (None, rows[3][1]), (7, long)], key=str)
    assert packed.agg(F.countDistinct("doc_tokens")).first()[0] >= 3 and packed.where("doc_id is null").count() >= 1

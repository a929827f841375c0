"""The pipeline's stages one by one, each against what its operator says of its own input."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from readloom.llm import mixing, queries, toxicity
from readloom.llm.common import kept, table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables")


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = kept(stage(spark, docs, DATA), name)
        assert docs.columns == columns, name
        n = docs.count()
        assert n <= before if name != "mixing" else n >= 0.5 * before
        assert n >= 0.6 * before, name
        before = n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == before and {r["shard"] for r in last.select("shard").distinct().collect()} <= set(range(24))


def test_mix_does_not_depend_on_the_layout(spark):
    """The same rows, repeated ones among them, in one partition and in seven give the same mix."""
    rows = [(i % 150, f"t{i % 140} " * (i % 9), "en", "ab"[i % 2] if i % 7 else None, 0) for i in range(200)] * 2 + [(7, "same text " * 4, "en", "a", 0)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    mixes = [sorted(map(repr, mixing.mixed_documents(d, bucket_rows=20, block_words=8).collect())) for d in (docs.coalesce(1), docs.repartition(7), docs.orderBy(F.desc("doc_id")).coalesce(2))]
    assert mixes[0] == mixes[1] == mixes[2] and len(mixes[0]) > 300


def test_copies_of_a_labelled_text_bring_one_row(spark, monkeypatch):
    seen = []
    real = toxicity.ToxicityModel
    monkeypatch.setattr(toxicity, "ToxicityModel", lambda *a: (seen.append(len(a[1]) if len(a) > 1 else 0), real(*a))[1])
    docs = spark.range(20_000).select((F.col("id") % 2).alias("doc_id"), F.when(F.col("id") % 2 == 0, "you idiot scum").otherwise("a fine day").alias("text")).unionByName(spark.createDataFrame([(0, "another text of the same id")], "doc_id long, text string"))
    toxicity.learn(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"), per_class=100)
    assert seen == [2]


def test_queries_are_named(spark):
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)

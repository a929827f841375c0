"""Every operator and stage that keeps other columns does so whatever they are called; what a run makes it gives back."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from readloom.llm import decontamination, language_id, mixing, ngram_join, sharding, toxicity, url_filter, wrappers
from readloom.llm.common import giving_back, kept, kept_by, scratch_dir, shared

NAMES = [
    "id_", "key_", "spans_", "whole_", "key__", "row__", "row", "nr", "extra_id", "bad_id", "own_id", "p_block", "host", "path", "rule", "verdict", "score", "lang_pred", "component_id", "label", "rep", "n", "size", "hash", "shard", "slot", "bucket", "nth",
    "start", "src", "block", "spans", "words", "new_text", "is_whole", "source_", "items", "n_words", "text_key", "pass", "a.b", "with space", "tick`ed",
]


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(1, "the hand and the thing of the hand and more", "en", "a", 43), (1, "the hand and the thing of the hand and more", "en", "a", 43), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "no id but some words to be read here", "en", None, 36), (4, "der die das und nicht wieder " * 400, "de", "b", 0), (None, "no id but some words to be read here", "en", None, 36)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"kept {i}").alias(c) for i, c in enumerate(NAMES)])


def _kept_values(df):
    return all(r[c] == f"kept {i}" for r in df.select(*["`" + c.replace("`", "``") + "`" for c in NAMES]).collect() for i, c in enumerate(NAMES))


STAGES = {
    "language_id": lambda df, spark: language_id.accepted(df), "ngram_join": lambda df, spark: ngram_join.deduplicated(df), "mixing": lambda df, spark: mixing.mixed_documents(df, block_words=4, n_shards=2),
    "decontamination": lambda df, spark: decontamination.decontaminated(df, spark.createDataFrame([(1, "der die das und nicht")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stage_keeps_columns(spark, wide, name):
    out = STAGES[name](wide, spark)
    assert out.columns == wide.columns and out.count() > 0 and _kept_values(out)
    assert STAGES[name](wide.filter("false"), spark).count() == 0


def test_stages_on_odd_rows(wide, spark):
    """Nulls in every column, repeated ids and rows, empty texts: what each stage keeps of them."""
    docs = wide.select("doc_id", "text", "lang", "source", "n_chars")
    ids = lambda df: sorted((repr(r["doc_id"]) for r in df.collect()))
    assert ids(STAGES["ngram_join"](docs, spark)) == sorted(["1", "1", "2", "3", "4", "None", "None"])  # rows of one id stand together
    assert ids(STAGES["decontamination"](docs, spark)) == sorted(["1", "1", "2", "3", "None", "None"])
    assert "2" not in ids(STAGES["language_id"](docs, spark)) and "3" not in ids(STAGES["language_id"](docs, spark))
    assert {"2", "3"}.isdisjoint(ids(STAGES["mixing"](docs, spark)))
    assert ids(sharding.shard(docs)) == ids(docs)


def test_operators_take_any_columns(spark, wide):
    urls = wide.withColumn("url", F.lit("http://a.com/en/1"))
    out = url_filter.judged(urls, url_filter.UrlModel(url_filter.rule_labels(urls)))
    assert out.select("rule", "verdict").distinct().collect() == [("com/en/", "block")] and set(urls.columns) <= set(out.columns)
    net, names = language_id.learn(wide.select("text", "lang"))
    for n in (net, None):
        assert {r["score"] == "kept 14" for r in language_id.predict(wide, n, names).select("score").collect()} == {False}
    assert ngram_join.JaccardJoin(wide).result().columns == ["doc_id", "n_shingles", "component_id"]
    assert sharding.shard(wide).count() == wide.count()
    assert mixing.taken(*mixing.mix(wide)).count() == wide.count()
    assert toxicity.scored(wide, toxicity.ToxicityModel(toxicity.LexiconAutomaton(["idiot"], []))).columns == ["doc_id", "score"]
    pages = wide.withColumns({"page_id": F.col("doc_id"), "url": F.lit("http://a.b/"), "html": F.lit("<p>x</p>")})
    assert {r["text"] for r in wrappers.extract(pages).collect()} == {"x"}


def _files(spark):
    top = Path(scratch_dir(spark).removeprefix("file://"))
    return {str(p) for p in top.iterdir()} if top.exists() else set()


def test_what_a_scope_makes_goes(spark):
    df = spark.range(5)
    before, tables = _files(spark), {t.name for t in spark.catalog.listTables()}
    with giving_back(spark) as outer:
        with giving_back(spark) as stay:
            a, b, c = kept(df, "a"), kept_by(df, "id", "b"), shared(spark, [1])
            stay.append(a)
        assert a.count() == 5 and {t.name for t in spark.catalog.listTables()} == tables and len(_files(spark) - before) == 1
        assert outer == []
    assert _files(spark) == before
    del b, c


def test_join_and_pipeline_leave_no_scratch(spark, wide, tmp_path):
    docs = wide.select("doc_id", "text", "lang", "source", "n_chars")
    before, tables = _files(spark), {t.name for t in spark.catalog.listTables()}
    with giving_back(spark):
        join = ngram_join.JaccardJoin(docs)
        assert {t.name for t in spark.catalog.listTables()} == tables and len(_files(spark) - before) == 4  # described, classes, links, labels
        assert join.result().count() == 7
    os.mkdir(tmp_path / "in")
    docs.write.parquet(str(tmp_path / "in/documents.parquet"))
    spark.createDataFrame([(1, "der die das und nicht")], "item_id long, text string").write.parquet(str(tmp_path / "in/benchmark.parquet"))
    with giving_back(spark):
        out = corpus_pipeline.run(spark, str(tmp_path / "in"))
        assert out.count() > 0 and {t.name for t in spark.catalog.listTables()} == tables
        assert len(_files(spark) - before) <= 5
    assert _files(spark) == before and {t.name for t in spark.catalog.listTables()} == tables

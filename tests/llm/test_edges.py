"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import (compact_windows, decontamination, html_extract, knn_join, language_crf, minhash, packing, secrets, sharding,
                         url_filter)
from tests.llm.fixtures import empty_documents, messy_documents

BENCH = "item_id long, text string, id int"


def items(spark):
    return spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "short", 3), (None, "x", 4)], BENCH)


OPERATORS = {
    "knn": lambda s, d: knn_join.top_k(d.select("doc_id", F.array(F.length("text").cast("double")).alias("v"), "id", "score"), F.col("doc_id") < 3,
                                       id_col="doc_id", vec_col="v"),
    "url": lambda s, d: url_filter.judge(d, [("allow", "org/")], url_filter.train(d.select(F.col("text").alias("url"), F.lit(True).alias("blocked"))),
                                         url_col="text"),
    "secrets": lambda s, d: secrets.scan(d, secrets.train(secrets.labelled_tokens(d)), out="score"),
    "packing": lambda s, d: packing.pack(d, with_ids=True),
    "html": lambda s, d: html_extract.extract(d, id_col="doc_id", url_col="source", html_col="text"),
    "decontamination": lambda s, d: decontamination.contamination(d, items(s)),
    "decontamination in slices": lambda s, d: decontamination.contamination(d, items(s), max_broadcast_words=1),
    "language": lambda s, d: language_crf.identify(d, language_crf.fit(language_crf.sample(d))),
    "minhash": lambda s, d: minhash.near_duplicates(d),
    "sharding": lambda s, d: sharding.shard_by_bytes(d, 4),
}
ONE_PER_ROW = ("url", "secrets", "html", "decontamination", "decontamination in slices", "language", "minhash", "sharding")


@pytest.mark.parametrize("name", OPERATORS)
def test_messy_and_empty_tables(spark, name):
    docs = messy_documents(spark)
    got = OPERATORS[name](spark, docs).collect()
    if name in ONE_PER_ROW:
        assert len(got) == docs.count()
    assert OPERATORS[name](spark, empty_documents(spark)).collect() == []


def test_passages_of_messy_and_empty_tables(spark):
    got = compact_windows.duplicate_passages(messy_documents(spark)).collect()
    assert {i for r in got for i in (r.doc_id, r.other_id)} == {1, 2, 9}
    assert compact_windows.duplicate_passages(empty_documents(spark)).collect() == []


def test_defined_results(spark):
    docs = messy_documents(spark)
    near = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert (near[2].component_id, near[2].kept, near[9].component_id) == (1, False, 1)
    assert all(near[i].kept and near[i].n_shingles == 0 for i in (3, 4, 5)) and near[None].component_id is None
    lang = {r.doc_id: (r.lang_pred, r.score) for r in language_crf.identify(docs, language_crf.fit(language_crf.sample(docs))).collect()}
    assert all(lang[i] == ("und", 0.0) for i in (3, 4, 5, 10)) and lang[1][0] == "en"
    packed = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed if r.doc_id in (3, 4)} == {3: 1, 4: 1}
    sizes = {r.doc_id: r["size"] for r in sharding.shard_by_bytes(docs, 4).collect()}
    assert (sizes[3], sizes[4], sizes[6], sizes[7]) == (1, 1, 6, len("🙂 é ß 12345".encode()) + 1)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, stage, tmp_path):
    items(spark).drop("id").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = messy_documents(spark).drop("score", "id")
    out = stage[1](spark, docs, str(tmp_path))
    if stage[0] != "pack":
        assert out.columns == docs.columns and out.count() <= docs.count()
    assert out.count() > 0
    assert stage[1](spark, docs.limit(0), str(tmp_path)).count() == 0

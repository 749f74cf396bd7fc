"""The pipeline on planted cases."""

import random

import pytest

import corpus_pipeline
from tests.llm.fixtures import prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    item = prose(rng, 30)
    texts = {i: prose(rng, rng.randrange(20, 300)) for i in range(80)}
    texts |= {100: texts[5], 101: texts[6] + " more", 102: prose(rng, 40) + " " + item.upper() + " " + prose(rng, 9), 103: "12 ... 34", 104: None, 105: "",
              106: texts[7] + " token = \"0123456789abcdef0123\""}
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_take_effect_in_order(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, corpus)
        if i < 4:
            kept.append({r.doc_id: r for r in docs.collect()})
            docs = spark.createDataFrame(list(kept[-1].values()), docs.schema)
    everything = {*range(80), *range(100, 107)}
    assert set(kept[0]) == everything - {103, 104, 105}
    assert set(kept[1]) <= set(kept[0]) - {100} and (101 not in kept[1] or len(kept[0][6].text.split()) < 25) and set(range(80)) <= set(kept[1])
    assert set(kept[2]) == set(kept[1]) - {102}
    assert set(kept[3]) == set(kept[2])
    changed = {i for i in kept[3] if kept[3][i].text != kept[2][i].text}
    assert changed <= {106} and all(r.n_chars == len(r.text) for r in kept[3].values())
    assert {r.doc_id for r in docs.collect()} == set(kept[3])


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).select("doc_id").distinct().count() >= 80

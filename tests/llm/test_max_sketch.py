"""Ranked search against scoring every document."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import max_sketch
from gleaner.llm.decontamination import words_of
from tests.llm.fixtures import empty_documents, messy_documents, prose


def brute(docs, items, k=20):
    held = [(i, Counter(words_of(t))) for i, t in docs]
    n = sum(bool(c) for _, c in held)
    total = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in held:
            m = 75 + 25 * c.total() * n // max(total, 1)
            score = sum(times * max_sketch.weight(df[t], n) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                        for t, times in Counter(words_of(text)).items() if c[t])
            if score > 0:
                scored.append((-score, i is not None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    docs = [(i, prose(rng, rng.choice([0, 3, 20, 200]))) for i in range(700)] + [(i, "river stone letter") for i in range(700, 760)]
    items = [(i, prose(rng, rng.choice([1, 5, 40]))) for i in range(30)] + [(30, "river river stone"), (31, "nowhere"), (32, None)]
    return docs, items


@pytest.mark.parametrize("width", [1, 16, 16_384])
def test_equals_scoring_everything(spark, corpus, width):
    docs, items = corpus
    got = max_sketch.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                                   spark.createDataFrame(items, "item_id long, text string"), width=width)
    assert rows(got) == brute(docs, items)


def test_blocks_of_queries_and_few_known_weights(spark, corpus):
    docs, items = corpus
    got = max_sketch.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
                                   k=3, most_query_terms=50, most_weights=4)
    assert rows(got) == brute(docs, items, 3)


def test_bounds_hold_and_spare_most_documents():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(50)) for _ in range(2000)]
    df = Counter(t for x in texts for t in set(words_of(x)))
    asked = [t.encode() for t in rng.sample(vocabulary, 6)]
    rows = pa.table({"query": pa.array([0] * 6, pa.int64()), "term": pa.array(asked, pa.binary()), "times": pa.array([1] * 6, pa.int64()),
                     "df": pa.array([df[t] for t in asked], pa.int64())})
    block = max_sketch.Block(rows, pa.table({"term": pa.array([], pa.binary()), "df": pa.array([], pa.int64())}), 2000, 100_000, 4096)
    best, rescored = [], 0
    for s in range(0, 2000, 500):
        found = max_sketch.Sketches(texts[s:s + 500], block)
        numbers, places, times = block.of[0]
        assert (found.bounds(places, times) >= found.exact(np.arange(500), numbers, times)).all()
        rescored += max_sketch.best_of_batch(found, *block.of[0], list(range(s, s + 500)), best, 5)
    assert len(best) == 5 and rescored < 600


def test_messy_and_empty(spark):
    docs = messy_documents(spark)
    items = [(1, "the river"), (1, "the river"), (1, "stone"), (None, "short"), (3, None), (4, "")]
    asked = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, query int, rank int")
    assert rows(max_sketch.ranked_search(docs, asked)) == brute([(r.doc_id, r.text) for r in docs.collect()], items)
    assert max_sketch.ranked_search(empty_documents(spark), asked).collect() == []
    assert max_sketch.ranked_search(docs, asked.limit(0)).collect() == []

"""Resampling: run hashes, the bracketed cutoff and the drawn rows against brute force."""

import math
import random
from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from gleaner.llm import importance
from gleaner.llm.decontamination import words_of
from tests.llm.fixtures import empty_documents, messy_documents, prose


def runs(text, longest=3):
    w = words_of(text)
    return [b" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=5, least=20, buckets=10_000):
    s, t = (Counter(crc32(f) % buckets for x in texts for f in runs(x)) for texts in ([x for _, x in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[crc32(f) % buckets] for f in runs(x))
        out.append((i, len(runs(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(x)) >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0], r[1]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=repr)


def test_hashes_of_runs_of_any_length():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcé9") for _ in range(rng.choice([1, 3, 7, 63, 64, 65, 200, 9000]))) for _ in range(rng.randrange(9)))
             for _ in range(100)] + ["", None, "A"]
    n, hashes, places = importance.run_hashes(texts)
    assert n.tolist() == [len(words_of(t)) for t in texts]
    for k in range(3):
        want = [(i, crc32(b" ".join(w[p:p + k + 1]))) for i, w in enumerate(map(words_of, texts)) for p in range(len(w) - k)]
        assert list(zip(places[k].tolist(), hashes[k].tolist())) == want


def test_draw_equals_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, prose(rng, rng.randrange(60))) for i in range(600)] + [(i, "the same words " * 10) for i in range(600, 900)]
    target = [prose(rng, 40) for _ in range(20)] + [None]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                              spark.createDataFrame([(t,) for t in target], "text string"))
    assert rows(got) == brute(docs, target)


@pytest.mark.parametrize("values", [[7] * 500, list(range(500)), [1, 2] * 250, [i % 5 - 9 for i in range(997)], [-10 ** 9, 10 ** 9] * 40 + list(range(300))])
@pytest.mark.parametrize("accuracy", [2, 10, 10_000])
def test_cutoff_however_coarse_the_sketch(spark, values, accuracy):
    scores = spark.createDataFrame([(v,) for v in values], "score long").repartition(3)
    for k in (1, len(values) // 3, len(values)):
        for most in (3, 10 ** 6):
            assert importance.cutoff(scores, "score", k, accuracy=accuracy, most=most) == sorted(values, reverse=True)[k - 1]


def test_messy_and_empty(spark):
    docs = messy_documents(spark)
    target = spark.createDataFrame([("the river",), (None,)], "text string")
    got = importance.resample(docs, target, percent=50)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(got) == brute(plain, ["the river", None], percent=50)
    assert importance.resample(empty_documents(spark), target).collect() == []
    alone = importance.resample(docs, target.limit(0), percent=50)
    assert rows(alone) == brute(plain, [], percent=50)


def test_repeated_rows_each_take_part(spark):
    docs = [(1, "one two three " * 10)] * 40 + [(2, "four five six " * 10)]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("one two",)], "text string"), percent=50)
    ranks = [r["rank"] for r in got.filter(F.col("rank").isNotNull()).collect()]
    assert sorted(ranks) == list(range(1, 21))

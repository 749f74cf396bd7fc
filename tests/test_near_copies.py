"""Keep-first near copies against comparing all pairs; tags read in stretches against reading all."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gleaner.functions import facts as C
from gleaner.functions import text as X


def brute(facts, over=0.7):
    kept, out = [], []
    for words in map(set, facts):
        copy = any(words and k and len(words & k) / len(words | k) > over for k in kept)
        out.append(not copy)
        if not copy:
            kept.append(words)
    return out


@pytest.mark.parametrize("paired", [1, 2, 5, 9, 40])
def test_equals_comparing_all_pairs(monkeypatch, paired):
    monkeypatch.setattr(C, "PAIRED", paired)
    rng = random.Random(paired)
    for _ in range(800):
        letters = "abcdefghijklmnopqrstuvwxyz"[:rng.choice([3, 6, 12, 26])]
        facts = [list({rng.choice(letters) for _ in range(rng.randrange(24))}) for _ in range(rng.randrange(25))]
        assert C.first_of_near_copies(facts) == brute(facts)


def test_grows_with_the_lines_not_their_square():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    took = []
    for n in (5_000, 20_000):
        facts = [rng.sample(vocabulary, rng.randrange(3, 20)) for _ in range(n)]
        start = time.process_time()
        assert sum(C.first_of_near_copies(facts)) > n * 0.95
        took.append(time.process_time() - start)
    assert took[1] < 12 * took[0]


def test_null_and_wordless_facts_stay(spark):
    kind = "array<struct<text:string,n:int>>"
    rows = [([("the river stone", 1), ("The RIVER, stone!", 2), (None, 3), ("..", 4), ("..", 5), ("other words here", 6)],), ([],), (None,)]
    got = spark.createDataFrame(rows, f"f {kind}").select(C.dedupe_facts("f", kind).alias("k")).collect()
    assert [None if r.k is None else [x.n for x in r.k] for r in got] == [[1, 3, 4, 5, 6], [], None]


def test_tags_in_stretches(spark, monkeypatch):
    rng = random.Random(2)
    rows = [[rng.choice(["  A b ", "#!", "x", "Ünï", "c--d", "\0", None, "", "tag" + str(rng.randrange(12))]) for _ in range(n)] for n in (0, 1, 5, 31, 32, 33, 70, 200)]
    df = spark.createDataFrame([(r,) for r in [*rows, None]], "t array<string>")
    for limit in (1, 3, 8, 50):
        monkeypatch.setattr(X, "TAG_STRETCH", 32)
        some = df.select(X.normalise_tags("t", limit)).collect()
        monkeypatch.setattr(X, "TAG_STRETCH", 10_000)
        assert some == df.select(X.normalise_tags("t", limit)).collect()
        assert some[-1][0] == [] and all(len(r[0]) == len(set(r[0])) <= limit for r in some)

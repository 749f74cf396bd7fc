"""Small tables with the cases every operator must survive."""

import random

WORDS = ("the of and to in is that for it was on are with as at by this from or an river stone garden letter winter morning "
         "paper window silver engine forest harbour candle market bridge valley").split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(("", "s", "ly", "ing")) for _ in range(n))


def messy_documents(spark):
    """(doc_id, text, and columns whose names clash with those operators add)."""
    rng = random.Random(3)
    text = prose(rng, 120)
    rows = [(1, text), (2, text), (3, None), (4, ""), (5, " \n\t "), (6, "short"), (7, "🙂 é ß 12345"), (8, prose(rng, 6000)),
            (9, text + " " + prose(rng, 5)), (9, text), (9, text), (None, text), (None, None), (10, "!!! ... ###"), (11, "a" * 5000)]
    return spark.createDataFrame([(i, t, "en", "x", len(t or ""), "own", 7, "k", 1.5, [1]) for i, t in rows], (
        "doc_id long, text string, lang string, source string, n_chars long, id string, size int, key string, score double, shard array<int>"))


def empty_documents(spark):
    return messy_documents(spark).limit(0)

"""Dictionary redaction in one pass against one regular expression per term."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gleaner.functions import media


def one_by_one(df, column, terms):
    """Each term on its own, in order, by Spark's expressions."""
    whole = lambda t: r"(?U)\b" + re.escape(t) + r"\b"
    hits, text = F.lit(0), F.col(column)
    for term, stand_in in terms.items():
        hits = hits + F.col(column).rlike(whole(term)).cast("int")
        text = F.regexp_replace(text, whole(term), stand_in.replace("\\", r"\\").replace("$", r"\$"))
    return df.withColumn("hits", hits).withColumn(column, text)


@pytest.mark.parametrize("seed", range(4))
def test_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    words = ["ab", "a", "b c", "b", "C++", "x_y", "é", "é", "ab b", "₂", "中", "-", "a.b", "‍"]
    terms = {w: rng.choice(["a", "b c", "Z$1", "\\", "", "ab ab", "中"]) for w in rng.sample(words, 8)}
    texts = ["".join(rng.choice([*words, " ", " ", "", ".", "\n"]) for _ in range(rng.randrange(14))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string")
    assert media.redact_terms(df, "t", terms).collect() == one_by_one(df, "t", terms).collect()


def test_no_terms_and_an_empty_one(spark):
    df = spark.createDataFrame([("a b",)], "t string")
    assert [tuple(r) for r in media.redact_terms(df, "t", {}).collect()] == [("a b", 0)]
    with pytest.raises(ValueError):
        media.redact_terms(df, "t", {"": "x"})


def test_a_large_dictionary_costs_what_a_small_one_does():
    rng = random.Random(3)
    text = " ".join(f"word{rng.randrange(10 ** 6)}" for _ in range(20_000)) + " term7 here"
    took = []
    for n in (50, 5_000):
        redactor = media.Redactor({f"term{i}": "X" for i in range(n)})
        redactor.places("")
        start = time.process_time()
        for _ in range(5):
            assert redactor.run(text)[1] == 1
        took.append(time.process_time() - start)
    assert took[1] < 4 * took[0] + 0.05

"""Index, vectors, samples and group orders, checked against plain brute force on skewed data."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.operators import ranking as W
from gleaner.operators import vectors as E
from gleaner.operators.prefix import running_total
from gleaner.plans import reports
from tests.test_sources import small_records


def test_running_total_with_a_hot_group(spark):
    df = spark.range(3000).select((F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7)).cast("string").alias("k"),
                                  (F.col("id") * 7919 % 1000).alias("o"), "id", (F.col("id") % 11).alias("m"))
    got = running_total(df, ["k"], [("o")], ["id"], F.col("m"), "t")
    w = Window.partitionBy("k").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert sorted(got.select("id", "t").collect()) == sorted(df.select("id", F.sum("m").over(w).alias("t")).collect())


def test_even_subsample_indexes(spark):
    df = spark.range(131).select(F.lit("a").alias("g"), "id").union(spark.range(5).select(F.lit("b"), "id"))
    out = W.even_subsample(df.withColumn("block", F.expr("id div 10")), ["g"], ["block"], ["id"], 9)
    rows = out.groupBy("g").agg(F.sort_array(F.collect_list("id"))).collect()
    assert {r[0]: r[1] for r in rows} == {"a": [int(k * (131 / 9)) for k in range(9)], "b": [0, 1, 2, 3, 4]}


def test_stratified_sample(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 12, "a").when(F.col("id") < 19, "b").alias("genre"))
    one, two = (sorted(map(tuple, W.stratified_sample(df, n=9, seed=4).collect())) for _ in range(2))
    assert one == two and len(one) == 9 and {g for g, _ in one} == {"a", "b", "other"}
    few = W.stratified_sample(df, n=2).groupBy("genre").count().collect()
    assert sum(r["count"] for r in few) == 2


def test_unique_names(spark):
    rows = [(0, "u0", "ai"), (1, "u1", "ai"), (2, "u0", "ai"), (3, "u3", "books"), (4, "u4", "ai"), (5, "u5", "ai-2")]
    df = spark.createDataFrame(rows, "arrival bigint, url string, base string").withColumn("block", F.lit(0))
    names = {r["url"]: r["name"] for r in W.unique_names(df, ["block"]).collect()}
    assert names == {"u0": "ai", "u1": "ai-3", "u3": "books", "u4": "ai-4", "u5": "ai-2"}
    taken = spark.createDataFrame([("books",), ("books-2",)], "name string")
    assert {r["url"]: r["name"] for r in W.unique_names(df, ["block"], taken).collect()}["u3"] == "books-3"


def test_nearest_all_ways_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(300)]
    index = spark.createDataFrame(rows, "id bigint, vec array<float>").repartition(5)
    queries = index.filter("id < 40")
    m = np.array([r[1] for r in rows])
    norms = np.linalg.norm(m, axis=1)
    unit = m / np.where(norms == 0, 1, norms)[:, None]
    want = {q: sorted(range(300), key=lambda j: (-round(float(unit[q] @ unit[j]), 9), j))[:7] for q in range(40)}
    ways = {"queries": E.nearest(queries, index, 7), "index": E.nearest(index, queries, 7, few="index")}
    got = {r["query_id"]: r["ids"] for r in ways["queries"].groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "row_id"))), lambda x: x["row_id"]).alias("ids")).collect()}
    assert got == want
    blocks = E._rank(E._nearest_in_blocks(queries, index, 7, "query_id bigint, row_id bigint, score double",
                                          *[__import__("pyarrow").int64()] * 2, block=16 * 6 * 8), 7)
    assert sorted(map(tuple, blocks.select("query_id", "row_id", "rank").collect())) == sorted(
        map(tuple, ways["queries"].select("query_id", "row_id", "rank").collect()))
    assert ways["index"].count() == 300 * 7


def test_search_in_cells_finds_most_and_everything_with_all_cells(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=16)).tolist()) for i in range(2000)]
    index = spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(4)
    queries = index.filter("id % 20 = 0")
    pairs = lambda df: {(r.query_id, r.row_id) for r in df.collect()}
    exact = pairs(E.nearest(queries, index, 10))
    some = pairs(E.nearest_in_cells(queries, index, 10, cells=64, probes=8, block=4_096))
    assert len(some & exact) / len(exact) >= 0.9
    assert pairs(E.nearest_in_cells(queries, index, 10, cells=16, probes=16)) == exact


def test_top_n_of_any_size_is_cut_before_the_last_shuffle(spark):
    from gleaner.operators.facets import top_n_per_group

    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    out = top_n_per_group(df, ["k"], ["o"], 5_000)
    assert [tuple(r) for r in out.filter("k = 1").orderBy("rank").limit(3).collect()] == [(1, 1, 1), (1, 3, 2), (1, 5, 3)]
    assert out.count() == 10_000 and "_block" in out._jdf.queryExecution().optimizedPlan().toString()


def test_index_reuse(spark):
    embed = E.hashing_embedder(32)
    r = small_records(spark)
    first = E.build_index(r, embed).persist()
    assert first.count() == 3 and first.filter("reused").count() == 0
    assert E.build_index(r, embed, first).filter("NOT reused").count() == 0
    edited = r.withColumn("summary", F.when(F.col("id") == "AAA", "new").otherwise(F.col("summary")))
    again = E.build_index(edited, embed, first)
    assert sorted(x["record_id"] for x in again.filter("NOT reused").collect()) == ["AAA", "AAA"]
    touched = r.withColumn("author_handle", F.lit("@x"))
    assert E.build_index(touched, embed, first).filter("NOT reused").count() == 0
    assert E.build_index(r, embed, first, full=True).filter("reused").count() == 0
    assert E.build_index(r.filter("id = 'BBB'"), embed, first).count() == 1


def test_answers_cite_one_row_per_record_and_note_an_empty_archive(spark):
    row = "id bigint, record_id string, title string, url string, text string, timestamp double, vec array<float>"
    index = spark.createDataFrame([(1, "R", "t", "u", "best", None, [1.0, 0.0]), (2, "R", "t", "u", "other", 3.0, [0.9, 0.1]),
                                   (3, "S", "t", "u", "far", None, [0.0, 1.0])], row)
    q = spark.createDataFrame([(7, [1.0, 0.0])], "id bigint, vec array<float>")
    members = spark.createDataFrame([("R", "shelf")], "record_id string, slug string")
    ans = lambda a: spark.createDataFrame([(7, a, "x")], "question_id bigint, answer string, error string")
    cited = reports.answer_batch(q, index, members, ans("yes [R]")).first()
    assert [(c["id"], c["snippet"], c["collections"]) for c in cited["citations"]] == [("R", "best", ["shelf"])]
    assert [c["id"] for c in reports.answer_batch(q, index, members, ans("no cite")).first()["citations"]] == ["R", "S"]
    assert reports.answer_batch(q, index, members, ans(None)).first()["note"] == "synthesis unavailable: x"
    empty = reports.answer_batch(q, index.limit(0), members, ans("x")).first()
    assert empty["note"] == "archive is empty" and empty["answer"] is None


def test_top_n_whatever_the_session_cuts(spark):
    from gleaner.operators.facets import top_n_per_group

    df = spark.range(3_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 3 END AS k", "id AS o")
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    had = spark.conf.get(key)
    want = sorted((str(r.k), r.o) for r in df.collect() if r.o < 21)
    try:
        for threshold in ("-1", "5", had):
            spark.conf.set(key, threshold)
            got = top_n_per_group(df, ["k"], ["o"], 7, block_rows=100)
            assert sorted((str(r.k), r.o) for r in got.collect()) == want
    finally:
        spark.conf.set(key, had)

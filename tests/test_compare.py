"""Claim matching, scoreboards and diffs on hand-made claims."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import facts as C
from gleaner.operators import matching as V
from gleaner import schemas as S


def diff(spark, a, b):
    df = spark.createDataFrame([(1, a, b)], "id int, fa array<string>, fb array<string>")
    d = V.with_diff(df).select("diff.*").first()
    return [(x["a"], x["b"]) for x in d["shared"]], d["only_a"], d["only_b"]


def score(spark, a, b):
    return spark.range(1).select(C.claim_similarity(F.lit(a), F.lit(b))).first()[0]


def test_paraphrase_is_shared(spark):
    shared, a, b = diff(spark, ["The course covers graph algorithms in twelve weeks"],
                        ["twelve weeks course covers graph algorithms"])
    assert len(shared) == 1 and a == [] and b == []


def test_terse_and_detailed_are_shared(spark):
    assert score(spark, 'No. 1 is "Linear Algebra Basics" at example.org/linear-algebra-basics',
                 "no. 1 LINEAR ALGEBRA BASICS") >= 0.5


def test_one_shared_word_is_no_match(spark):
    shared, a, b = diff(spark, ["python"], ["python tutorial for complete beginners today"])
    assert shared == [] and len(a) == 1 and len(b) == 1


def test_one_to_one(spark):
    shared, a, b = diff(spark, ["alpha beta gamma delta", "alpha beta gamma delta"], ["alpha beta gamma delta"])
    assert len(shared) == 1 and len(a) == 1 and b == []


def test_empty_sides(spark):
    assert diff(spark, [], ["x y z w"]) == ([], [], ["x y z w"])
    assert diff(spark, [], []) == ([], [], [])


def test_narration_is_ignored(spark):
    assert score(spark, "Frame 2 displays the on-screen text 'ISOMETRIC HOLD TIMER'", "Isometric hold timer") >= 0.7


def test_quoted_label_is_enough(spark):
    assert score(spark, '"SLOW TEMPO SQUAT", hinging over a wooden bench near windows',
                 "the athlete follows a label reading 'SLOW TEMPO SQUAT' during warmups") == pytest.approx(0.8)


def test_unrelated_is_below_threshold(spark):
    assert score(spark, "Coffee beans roast at 200 degrees", "The museum opens on Mondays in spring") < 0.5


def test_empty_word_sets(spark):
    assert score(spark, "the of", "an it") == 1.0 and score(spark, "the", "kettle boils") == 0.0


def facts_table(spark, rows):
    return spark.createDataFrame(rows, "record_id bigint, arm string, pos bigint, text string")


def test_joins_match_like_the_stream(spark):
    words = "red blue green amber violet teal coral olive navy plum".split()
    rows = []
    for rec in range(4):
        for i in range(12):
            ref = " ".join(words[(i + j * (rec + 1)) % 10] for j in range(4))
            rows.append((rec, "ref", i, ref if i % 5 else "the of"))
            rows.append((rec, "x", i, " ".join(words[(i + 1 + j * (rec + 1)) % 10] for j in range(5)) if i % 4 else "it is"))
            if rec % 2:
                rows.append((rec, "y", i, ref))
    f = facts_table(spark, rows)
    key = ["record_id", "arm", "side", "pos", "other_pos", "score"]
    streamed = {tuple(r) for r in V.match_facts(f, "ref").select(*key).collect()}
    joined = {tuple(r) for r in V.match_by_rounds(f, "ref").select(*key).collect()}
    assert streamed == joined and any(r[4] is not None for r in streamed)


def record(spark, variants, **more):
    """Records with variant maps from {id: {arm: [facts]}}."""
    import json

    docs = [json.dumps({"id": i, "variants": {
        arm: {"facts": [{"text": t} for t in facts], "model": arm, "summary": f"s {arm}",
              "tokens": more.get("tokens", {}).get(arm, {})} for arm, facts in arms.items()}})
        for i, arms in variants.items()]
    return spark.createDataFrame([(d,) for d in docs], "v string").select(F.from_json("v", S.RECORD).alias("r")).select("r.*")


def test_scoreboard_and_disagreement(spark):
    r = record(spark, {"R": {"a": ["alpha beta gamma delta", "one two three four"], "b": ["alpha beta gamma delta"]}})
    board = {x["arm"]: x for x in V.scoreboard(V.variant_measures(V.explode_variants(r))).collect()}
    assert board["a"]["avg_facts"] == 2.0 and board["b"]["avg_facts"] == 1.0
    d = V.two_arm_diffs(r).select(*[F.size(f"diff.{c}").alias(c) for c in ("shared", "only_a", "only_b")])
    assert V.avg_disagreement(d).first()[0] == 0.5


def test_empty_and_salvaged_are_counted(spark):
    r = record(spark, {"R1": {"a": ["alpha beta gamma delta"]}, "R2": {"a": []}}, tokens={"a": {"salvaged": True, "cost_usd": 0.25}})
    x = V.scoreboard(V.variant_measures(V.explode_variants(r))).first()
    assert (x["empty"], x["salvaged"], x["empty_rate"], x["cost_per_record"]) == (1, 2, 0.5, 0.25)


def test_agreement_counts_only_shared_records(spark):
    f = facts_table(spark, [(1, "ref", 0, "alpha beta gamma delta"), (1, "ref", 1, "one two three four"),
                            (1, "c", 0, "alpha beta gamma delta"), (2, "c", 0, "nothing to compare here")])
    x = V.arm_agreement(f.select("record_id", "arm"), V.match_facts(f, "ref"), "ref").first()
    assert (x["records"], x["shared"], x["only_ref"], x["only_cand"], x["agreement"]) == (1, 1, 1, 0, 0.5)


def test_stored_diff_picks_reference_then_next(spark):
    r = record(spark, {"R": {"zeta": ["alpha beta gamma delta"], "claude-cli": ["alpha beta gamma delta"], "m": []},
                       "S": {"only": ["x"]}})
    rows = {x["id"]: x for x in V.variants_diff(r).collect()}
    assert (rows["R"]["a"], rows["R"]["b"], rows["R"]["available"]) == ("claude-cli", "m", ["claude-cli", "m", "zeta"])
    assert rows["R"]["diff"]["only_a"] == ["alpha beta gamma delta"]
    assert rows["S"]["b"] is None and rows["S"]["diff"] is None
    asked = {x["id"]: x for x in V.variants_diff(r, a="zeta", b="claude-cli").collect()}
    assert len(asked["R"]["diff"]["shared"]) == 1


def facts_of(spark, rows):
    return spark.createDataFrame(rows, "record_id int, arm string, pos int, text string")


def test_many_equal_facts_settle_at_once(spark):
    rows = [(1, arm, i, text) for arm in ("ref", "c") for i, text in enumerate(
        ["alpha beta gamma delta"] * 500 + ["one two three four"] * 3 + ["!!"] * 2)]
    got = {(r.side, r.pos): (r.other_pos, r.score) for r in V.match_facts(facts_of(spark, rows), "ref").collect()}
    assert got == {(s, i): (i, 1.0) for s in ("ref", "cand") for i in range(505)}
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("rounds", "rounds")
    again = {(r.side, r.pos): (r.other_pos, r.score) for r in V.match_by_rounds(facts_of(spark, rows), "ref").collect()}
    spark.sparkContext.setJobGroup("", "")
    assert again == got and len(jobs.getJobIdsForGroup("rounds")) < 80


def test_both_matchers_agree_on_ties_and_conflicts(spark):
    import random

    rng = random.Random(7)
    words = ["amber", "birch", "cedar", "delta", "ember", "flint"]
    rows = [(r, arm, i, " ".join(rng.sample(words, rng.randrange(0, 4)))) for r in range(6) for arm in ("ref", "c", "d") for i in range(rng.randrange(0, 9))]
    key = lambda r: (r.record_id, r.arm, r.side, r.pos, r.text, r.other_pos, r.score)
    got = {key(r) for r in V.match_facts(facts_of(spark, rows), "ref").collect()}
    assert got and got == {key(r) for r in V.match_by_rounds(facts_of(spark, rows), "ref").collect()}


def test_bench_report_describes_the_sample_only(spark):
    from gleaner.plans import reports

    m = "record_id string, arm string, model string, facts int, tags int, summary_chars int, seconds double, cost_usd double, structured_fields int, salvaged boolean"
    measures = spark.createDataFrame([("R0", "claude-cli", "c", 2, 1, 3, 20.0, 0.02, 1, False), ("R0", "qwen", "q", 2, 1, 4, 5.0, 0.0, 0, False),
                                      ("R9", "stranger", "s", 1, 0, 0, 1.0, 0.0, 0, False)], m)
    facts = spark.createDataFrame([("R0", "claude-cli", 0, "five github repos for homelab"), ("R0", "claude-cli", 1, "coolify is a heroku alternative"),
                                   ("R0", "qwen", 0, "five github repos"), ("R0", "qwen", 1, "laptop standing alone outside"),
                                   ("R9", "stranger", 0, "not in the sample")], "record_id string, arm string, pos int, text string")
    summaries = facts.select("record_id", "arm").distinct().withColumn("summary", F.lit("s"))
    log = "arm string, record_id string, at string, seq bigint, ok boolean, seconds double"
    sample = spark.createDataFrame([("R0",)], "id string")

    def report(attempts):
        tables = reports.bench_tables(measures, facts, summaries, spark.createDataFrame(attempts, log), sample, "claude-cli")
        return {(r.section, r.text) for r in reports.bench_report(tables, "claude-cli").collect()}

    text = report([])
    assert ("3 attempts", "_No run log yet — variants were written before the bench existed._") in text
    assert ("1 metrics", "| qwen | 1 | 2.00 | 1.00 | 4.00 | 0.00 | 0 | 0 | 5.00 | 0.0000 |") in text
    assert ("2 agreement with claude-cli", "| qwen | 1 | 33% | 1.00 | 1.00 |") in text
    assert any("missed coolify is a heroku alternative / added laptop standing alone outside" in t for _, t in text)
    assert not any("stranger" in t for _, t in text)
    tried = report([("qwen", "R0", "1", 0, False, 9.0), ("qwen", "R0", "2", 0, True, 5.0), ("broken", "R0", "1", 0, False, 1.0)])
    assert ("3 attempts", "| qwen | 1 | 0 | 5.00 |  |") in tried and ("3 attempts", "| broken | 0 | 1 | 1.00 | abandoned |") in tried


def test_matching_behind_a_join_that_turns_into_a_broadcast(spark):
    """Every record's claims lie in all map tasks of the join's shuffle; the join is a broadcast only once its sizes are known."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    had = {key: spark.conf.get(key) for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        f = spark.range(0, 16_000, 1, 8).selectExpr("id % 2000 AS record_id", "CASE WHEN id div 2000 % 2 = 0 THEN 'user' ELSE 'b' END AS arm",
                                                    "id div 2000 AS pos", "'alpha beta gamma w' || (id div 4000) AS text")
        few = f.groupBy("record_id").agg(F.count_distinct("arm").alias("n")).filter("n = 2 AND record_id % 20 = 0").select("record_id")
        got = V.match_facts(f.join(few, "record_id", "left_semi"), "user").agg(F.count("*"), F.count("other_pos")).first()
    finally:
        for key, value in had.items():
            spark.conf.set(key, value)
    assert tuple(got) == (800, 800)


def test_markers_that_go_over_turns(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    from tests.oracle import compare

    said = [(1, 0, "user", "abcdefghij and kl-mnopqrstu, klmnopqrstu"), (1, 1, "assistant", "so abcd"), (1, 2, "assistant", "É!"), (1, 3, "assistant", "ef"),
            (1, 5, "assistant", "GHIJ"), (1, 6, "assistant", "klmno"), (1, 8, "assistant", "no pqrstu"), (2, 0, "user", "abcdefghijkl"), (2, 1, "assistant", None)]
    spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet') ORDER BY conv_id, turn")
    name = "ag19_marker_recall"
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path)) is None


def test_long_arm_texts_in_rows_hold_every_marker(spark):
    import random

    from gleaner.operators import markers as M

    draw = random.Random(5)
    turns = [(r, a, p, "".join(draw.choices("ab", k=draw.choice([0, 1, 2, 30])))) for r in "xyz" for a in ("m", "n") for p in range(0, 2_400, 60)]
    wanted = {r: ["".join(draw.choices("ab", k=draw.randint(1, 12))) for _ in range(40)] for r in "xy"}
    rows = M.arm_texts(spark.createDataFrame(turns, "record_id string, arm string, pos bigint, key string"),
                       spark.createDataFrame(list(wanted.items()), "record_id string, markers array<string>"), size=7).collect()
    assert max(len(r.key) for r in rows) <= 12 + 11 and {r.record_id for r in rows} == {"x", "y"}
    for r, ms in wanted.items():
        for a in ("m", "n"):
            whole = "".join(k for x, y, _, k in turns if (x, y) == (r, a))
            for m in ms:
                assert (m in whole) == any(m in t.key for t in rows if (t.record_id, t.arm) == (r, a))

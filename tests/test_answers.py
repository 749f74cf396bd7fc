"""Answers, fact hygiene, structured fields, request texts, dates."""

import json

from pyspark.sql import functions as F

from gleaner.functions import answers as N
from gleaner.functions import facts as C
from gleaner.functions import prompts as P
from gleaner.functions import text as X


def parse(spark, text):
    out = spark.createDataFrame([(text,)], "t string").select(N.answer_object("t")).first()[0]
    return None if out is None else json.loads(out)


def test_richest_object_wins_and_later_wins_ties(spark):
    assert parse(spark, 'plan {"a": 1} then {"a": 1, "b": {"x": 1, "y": 2, "z": 3}} end') == {"a": 1, "b": {"x": 1, "y": 2, "z": 3}}
    assert parse(spark, '{"a": 1} {"b": 2}') == {"b": 2}


def test_fenced_plain_and_missing(spark):
    assert parse(spark, 'x {"p":1,"q":2}\n```json\n{"a": 1}\n```') == {"a": 1}
    assert parse(spark, '  {"a": {"b": [1, 2]}}  ') == {"a": {"b": [1, 2]}}
    assert parse(spark, "no object {") is None and parse(spark, "") is None and parse(spark, None) is None


def test_reasoning_fallback(spark):
    df = spark.createDataFrame([("hi", "think"), (" ", "think"), (None, None)], "c string, r string")
    rows = [tuple(x[0]) for x in df.select(N.reply_text("c", "r")).collect()]
    assert rows == [("hi", False), ("think", True), (None, False)]


def normalised(spark, obj, transcript=""):
    df = spark.createDataFrame([(json.dumps(obj), transcript)], "j string, t string").select(F.from_json("j", N.ANSWER).alias("a"), "t")
    out = N.normalised_answer("a", "t")
    return df.select(*[c.alias(n) for n, c in out.items()]).first()


def test_bare_string_facts_stay_and_wrong_types_become_null(spark):
    r = normalised(spark, {"genre": "news", "facts": [
        "The library opens at nine on weekdays",
        {"text": "A ticket costs twelve euros online", "frame": 3, "timestamp": 4},
        {"text": "Parking behind the hall is free", "frame": "3", "timestamp": "x"},
        {"frame": 1}, "too short"]})
    assert [(f["text"][:9], f["timestamp"], f["frame"]) for f in r["facts"]] == [
        ("The libra", None, None), ("A ticket ", 4.0, 3), ("Parking b", None, None)]


def test_lists_are_trimmed_and_cut(spark):
    r = normalised(spark, {"key_points": [" a ", "", *map(str, range(20))], "on_screen_text": ["big red sale today", "NEW LABEL"],
                           "tags": ["Machine Learning", "machine-learning", "C++", "!!"]}, "we have a big red sale today only")
    assert r["key_points"] == ["a", *map(str, range(7))]
    assert r["on_screen_text"] == ["NEW LABEL"] and r["tags"] == ["machine-learning", "c"]


def unwrap(spark, value, genre="news"):
    return dict(spark.createDataFrame([(json.dumps(value),)], "j string").select(N.unwrap_structured("j", F.lit(genre))).first()[0])


def test_structured_shapes(spark):
    assert unwrap(spark, {"educational": {"topic": "x"}}) == {"topic": "x"}
    assert unwrap(spark, {"mygenre": {"topic": "x"}}, "mygenre") == {"topic": "x"}
    assert unwrap(spark, {"topic": "x", "name": "y"}) == {"topic": "x", "name": "y"}
    assert unwrap(spark, {"tools": ["a"]}) == {"tools": '["a"]'}
    assert unwrap(spark, [1]) == {} and unwrap(spark, None) == {}


def fragment(spark, text):
    return spark.range(1).select(C.is_fragment(F.lit(text))).first()[0]


def test_fragments(spark):
    for bad in ("for years now and", "clutch", "you will ever see it", "aspiring cooks all need to", "the only way up there.", ""):
        assert fragment(spark, bad), bad
    for good in ("The only way up is stairs", "rain falls on plains daily", "Seven chapters cover basic physics."):
        assert not fragment(spark, good), good


def test_near_copies_collapse(spark):
    facts = [("Course runs twelve weeks with labs",), ("course runs twelve weeks with labs!",), ("Entry is free on Sundays",)]
    df = spark.createDataFrame([([{"text": t[0]} for t in facts],)], "f array<struct<text:string>>")
    assert [f["text"] for f in df.select(C.dedupe_facts("f")).first()[0]] == [facts[0][0], facts[2][0]]


def test_subtitles(spark):
    lines = ["so here is the plan", "PLAN", "no. 1 BUILD A RADIO", "we start tomorrow"]
    df = spark.createDataFrame([(lines, "So here is the plan: we start tomorrow.", "")], "l array<string>, t string, e string")
    row = df.select(C.strip_subtitles("l", "t"), C.strip_subtitles("l", "e")).first()
    assert row[0] == ["PLAN", "no. 1 BUILD A RADIO"] and row[1] == lines


def test_caption_keeps_trailing_hashtags(spark):
    text = "word " * 300 + "#ad #tools #ad"
    out = spark.range(1).select(P.caption_for_prompt(F.lit(text))).first()[0]
    assert out.endswith("… [trimmed]\nHashtags: #ad #tools") and out.startswith("word word")
    assert spark.range(1).select(P.caption_for_prompt(F.lit("  "))).first()[0] == "(none)"


def test_ocr_lines_are_counted(spark):
    df = spark.createDataFrame([("c", "", False, [f"line {i}" for i in range(20)])], "c string, t string, b boolean, o array<string>")
    out = df.select(P.media_request("c", "t", "b", "o", "S", P.MediaFrame("Clip.", "Caption: ", "Said{}:", " (translated)", "Read:"))).first()[0]
    assert "line 14 … [+5 more]" in out and "line 15" not in out


def test_dates(spark):
    cases = {"2024-05-02T10:00:00+02:00": "2024-05-02 08:00:00", "2024-05-02T10:00:00Z": "2024-05-02 10:00:00",
             "Thu, 02 May 2024 10:00:00 +0000": "2024-05-02 10:00:00", "Thu, 2 May 2024 10:00:00 GMT": "2024-05-02 10:00:00",
             "2024-05-02": "2024-05-02 00:00:00", "yesterday": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = df.select("s", F.date_format(X.parse_date("s"), "yyyy-MM-dd HH:mm:ss")).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_tags_rename(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["b"],), (["a", "c"],)], "t array<string>")
    rows = df.select(X.renamed_tags("t", "B", "c"), X.renamed_tags("t", "b", "z"), X.renamed_tags("t", "b", "")).collect()
    assert [tuple(r) for r in rows] == [(["a", "c"], ["a", "z", "c"], ["a", "c"]), (["c"], ["z"], []), (["a", "c"],) * 3]


def test_winning_model_takes_first_of_ties(spark):
    df = spark.sql("SELECT map('a[1m]', named_struct('outputTokens', 900L, 'canonicalModel', 'a'), "
                   "'b', named_struct('outputTokens', 12L, 'canonicalModel', cast(null as string))) AS u")
    assert df.select(N.winning_model("u")).first()[0] == "a"


def test_unicode_tags_and_nul(spark):
    df = spark.createDataFrame([([" Été Sale ", "a\x00b", "--x--", "ab"],)], "t array<string>")
    assert df.select(X.normalise_tags("t")).first()[0] == ["t-sale", "ab", "x"]

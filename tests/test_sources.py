"""Landed files: records, manifests, logs, feeds, exports, snapshots, streams."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner import schemas as S
from gleaner.operators import sync as Y
from gleaner.operators.attempts import attempt_stats, newest_stage
from gleaner.operators.joins import invert_membership
from gleaner.sources import feeds, scans, sinks
from gleaner.streaming import sync as T


def write(path, name, value):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_scan_records_strict_and_tolerant(spark, tmp_path):
    write(tmp_path, "AAA.json", {"url": "u", "genre": "news", "facts": [{"text": "t", "timestamp": 1.5}]})
    write(tmp_path, "BBB.json", {"id": "BBB", "url": "v", "structured": {"topic": "x", "tools": ["a"]}})
    assert {r["id"] for r in scans.scan_records(spark, str(tmp_path)).select("id").collect()} == {"AAA", "BBB"}
    write(tmp_path, "CCC.json", '{"id": "CCC", ')
    assert scans.scan_records(spark, str(tmp_path), strict=False).count() == 2
    with pytest.raises(Exception):
        scans.scan_records(spark, str(tmp_path)).collect()  # strict


def test_membership_skips_corrupt_manifests(spark, tmp_path):
    write(tmp_path, "ai.json", {"slug": "ai", "title": "AI", "reel_ids": ["AAA", "BBB", "AAA"]})
    write(tmp_path, "books.json", {"slug": "books", "title": "Books", "reel_ids": ["BBB"]})
    write(tmp_path, "bad.json", "{nope")
    m = invert_membership(scans.membership(scans.scan_manifests(spark, str(tmp_path))))
    assert {r[0]: r[1] for r in m.collect()} == {"AAA": ["ai"], "BBB": ["ai", "books"]}


def test_attempt_log_keeps_last_attempt(spark, tmp_path):
    rows = [{"profile": "p", "reel_id": "R00", "ok": False, "seconds": 100, "at": "2024-01-01T00:00:00"},
            {"profile": "p", "reel_id": "R00", "ok": True, "seconds": 10, "at": "2024-01-02T00:00:00"},
            {"profile": "p", "reel_id": "R01", "ok": True, "seconds": 20, "at": "2024-01-01T00:00:00"}]
    write(tmp_path, "runs.jsonl", "\n".join([*map(json.dumps, rows), "{broken"]))
    x = attempt_stats(scans.attempts_from_log(scans.scan_attempt_log(spark, str(tmp_path)))).first()
    assert (x["ok"], x["failed"], x["avg_seconds"]) == (2, 0, 15.0)


def test_side_stores_ledger_and_report(spark, tmp_path):
    write(tmp_path / "a", "annotations.json", {"AAA": {"starred": True, "note": "n"}, "BBB": {"read": True}})
    rows = {r["id"]: r for r in scans.scan_keyed_json(spark, str(tmp_path / "a"), S.ANNOTATION_ENTRY).collect()}
    assert rows["AAA"]["starred"] is True and rows["BBB"]["starred"] is None and rows["BBB"]["read"] is True
    write(tmp_path / "l", "state.json", {"s": {"runs": 2, "cumulative_seen": ["A", "B"], "failed_ids": ["C"], "error": ""}})
    state, seen, dead = scans.scan_ledger(spark, str(tmp_path / "l"))
    assert state.first()["failed"] == 1 and seen.count() == 2 and dead.first()["id"] == "C"
    write(tmp_path / "r", "run_report.json", {"started_at": "x", "reels": {
        "A": {"url": "u", "stages": {"ocr": "ok", "vision": "error"}, "errors": {"vision": "boom"}}}})
    out = {(r["stage"], r["status"], r["error"]) for r in scans.scan_run_report(spark, str(tmp_path / "r")).collect()}
    assert out == {("ocr", "ok", None), ("vision", "error", "boom")}


def test_url_list_and_registry(spark, tmp_path):
    write(tmp_path / "u", "urls.txt", "# list\n\n https://www.instagram.com/reel/Ab_1/ \nhttps://example.org/x\n")
    assert [r[0] for r in scans.scan_url_list(spark, str(tmp_path / "u")).collect()] == ["https://www.instagram.com/reel/Ab_1/"]
    write(tmp_path / "v", "urls.txt", "https://example.org/x\n")
    with pytest.raises(ValueError):
        scans.scan_url_list(spark, str(tmp_path / "v"))
    write(tmp_path / "s", "sources.json", {"sources": [{"name": "a", "url": "u"}, {"name": "b", "url": "v", "type": "rss", "enabled": False, "limit": 5}]})
    assert [tuple(r) for r in scans.scan_sources(spark, str(tmp_path / "s")).orderBy("name").collect()] == [
        ("a", "u", "collection", True, 200), ("b", "v", "rss", False, 5)]


def test_run_log(spark, tmp_path):
    write(tmp_path, "run.log", "2024-05-02 10:00:00 INFO collection x page 2\n2024-05-02 10:01:00 INFO [ingest] a (3/15)\n"
          "2024-05-02 10:02:00 INFO [process] b (6/15)\n2024-05-02 10:03:00 INFO resting\n")
    row = newest_stage(scans.scan_run_log(spark, str(tmp_path)), ["log_time"]).first()
    assert (row["stage"], row["done"], row["total"]) == ("process", 6, 15)
    write(tmp_path / "none", "run.log", "nothing here\n")
    assert newest_stage(scans.scan_run_log(spark, str(tmp_path / "none")), ["log_time"]).count() == 0


RSS = """<rss xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>
<item><title>One</title><link>https://e.org/1</link><description>&lt;p&gt;Hello &lt;b&gt;there&lt;/b&gt;&lt;/p&gt;</description>
<pubDate>Thu, 02 May 2024 10:00:00 +0000</pubDate><dc:creator>Ann</dc:creator></item>
<item><title>Two</title><link>https://e.org/2</link><description>short</description><content:encoded>long body</content:encoded></item>
<item><title>No link</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>https://e.org/p1</id><title>P</title><link href="https://e.org/a1"/>
<summary>abstract</summary><author><name>Ann</name></author><author><name>Bob</name></author><updated>2024-05-02T10:00:00Z</updated>
<published>2024-05-01T10:00:00Z</published></entry></feed>"""


def test_rss_and_atom(spark, tmp_path):
    write(tmp_path, "feed.xml", RSS)
    write(tmp_path, "atom.xml", ATOM)
    rows = {r["url"]: r for r in feeds.scan_rss_atom(spark, str(tmp_path)).collect()}
    assert set(rows) == {"https://e.org/1", "https://e.org/2", "https://e.org/a1"}
    assert rows["https://e.org/1"]["caption"] == "Hello there" and rows["https://e.org/1"]["author"] == "Ann"
    assert str(rows["https://e.org/1"]["timestamp"]).startswith("2024-05-02") and rows["https://e.org/2"]["caption"] == "long body"
    assert rows["https://e.org/a1"]["caption"] == "abstract" and rows["https://e.org/1"]["id"].startswith("rs_")
    assert [r["url"] for r in feeds.scan_rss_atom(spark, str(tmp_path), limit=1).orderBy("url").collect()] == ["https://e.org/1", "https://e.org/a1"]
    paper = feeds.scan_paper_atom(spark, str(tmp_path / "atom.xml")).first()
    assert paper["author"] == "Ann, Bob" and paper["url"] == "https://e.org/p1"


def test_releases(spark, tmp_path):
    write(tmp_path, "r.json", [{"html_url": "https://e.org/r1", "tag_name": "v1", "name": "First", "body": "<b>x</b>", "published_at": "2024-05-02T10:00:00Z"}, {}])
    rows = feeds.scan_releases(spark, str(tmp_path), "https://github.com/own/repo").orderBy("title").collect()
    assert [r["title"] for r in rows] == ["repo :", "repo v1: First"]
    assert rows[0]["url"] == "https://github.com/own/repo" and rows[1]["caption"] == "x" and rows[1]["author"] == "own"


def test_feed_pages_and_collections(spark, tmp_path):
    item = lambda code, kind, cols, **m: {"media": {"code": code, "media_type": kind, "saved_collection_ids": cols, **m}}
    write(tmp_path, "p1.json", {"items": [item("AAA", 2, ["111"]), item("BBB", 2, ["222"]), item("CCC", 1, ["111"])]})
    write(tmp_path, "p2.json", {"items": [item("DDD", 8, ["111"], carousel_media=[{"media_type": 2}]), item("AAA", 2, ["111"]),
                                          item("EEE", 8, [], carousel_media=[{"media_type": 1}]), {"code": "FFF", "user": {"username": "u"}}]})
    items = feeds.scan_feed_pages(spark, str(tmp_path))
    assert {r["id"] for r in items.collect()} == {"AAA", "BBB", "DDD", "FFF"}
    assert {r["id"] for r in feeds.scan_feed_pages(spark, str(tmp_path), known_only=True).collect()} == {"AAA", "BBB"}
    from gleaner.operators.joins import collection_members_from_feed

    pos = items.select("id", F.struct("page", "pos").alias("pos"), "collection_ids")
    cols = spark.createDataFrame([("one", "111", 10), ("two", "222", 10)], "slug string, id string, limit int")
    got = collection_members_from_feed(pos, cols).orderBy("slug", "pos").collect()
    assert [(r["slug"], r["id"]) for r in got] == [("one", "AAA"), ("one", "DDD"), ("two", "BBB")]


def test_feed_pages_in_the_order_of_their_numbers(spark, tmp_path):
    for n, user in ((9, "first"), (10, "second"), (101, "third"), (1000, "fourth")):
        write(tmp_path, f"part-00000-a-c{n:03}.json", {"items": [{"code": c, "media_type": 2, "user": {"username": user}} for c in ("AAA", user)[n < 100:]]})
    seen = {r["id"]: r for r in feeds.scan_feed_pages(spark, str(tmp_path)).collect()}
    assert seen["AAA"]["handle"] == "third" and len(seen) == 5
    assert [r["handle"] for r in sorted(seen.values(), key=lambda x: (x["page"], x["pos"]))] == ["first", "second", "third", "third", "fourth"]
    only = lambda *names: [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(feeds.name_order(F.col("n"))).collect()]
    assert only("p10", "p9", "p010", "q1", "p", "p1000-2", "p1000-10", "p101") == ["p", "p9", "p010", "p10", "p101", "p1000-2", "p1000-10", "q1"]


def small_records(spark):
    docs = [{"id": "AAA", "url": "u/a", "title": "A | title", "author": "x", "genre": "news", "summary": "line\ntwo", "tags": ["t1", "t2"],
             "likes": 1234, "facts": [{"text": "f one", "timestamp": 65.0}], "structured": {"topic": "tt", "tools": ["h", "i"]},
             "timestamp": "2024-05-02T10:00:00Z", "caption": "c #x", "hashtags": ["x"], "transcript_text": "hello",
             "transcript": [{"start": 0.0, "end": 1.0, "text": "hello"}]},
            {"id": "BBB", "url": "u/b", "genre": "", "likes": 0}]
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "v string").select(F.from_json("v", S.RECORD).alias("r")).select("r.*")


def test_exports(spark, tmp_path):
    r = small_records(spark)
    sinks.export_csv(r, str(tmp_path / "csv"))
    back = {x["id"]: x for x in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()}
    assert back["AAA"]["tags"] == "t1, t2" and back["AAA"]["summary"] == "line two" and back["BBB"]["likes"] is None
    sinks.export_markdown(r, str(tmp_path / "md"))
    lines = [x[0] for x in spark.read.text(str(tmp_path / "md")).collect()]
    assert lines.count("# Reels export") == 1 and "## news" in lines and "- **[BBB](u/b)** —   " in lines
    sinks.write_recency_index(r, str(tmp_path / "index"))
    index = [x[0] for x in spark.read.text(str(tmp_path / "index")).collect()]
    assert index[0] == "# Instagram Reels Archive" and index[2].startswith("**2** reels") and index[4].startswith("| Title") and "| A \\| title |" in index[6]
    page = {x["id"]: x["page"] for x in sinks.record_pages(r).collect()}
    assert "| **Likes** | 1,234 |" in page["AAA"] and "| `1:05` | f one |" in page["AAA"] and "- h\n- i" in page["AAA"]
    assert "## Summary" not in page["BBB"] and "## Key facts" not in page["BBB"]


def test_write_records_versions(spark, tmp_path):
    cur = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, genre string, likes int")
    changes = spark.createDataFrame([("b", "z", 1), ("b", "w", 2), ("c", "n", 1)], "id string, genre string, seq int")
    out = sinks.write_records(cur, changes, str(tmp_path / "v2"), "seq")
    assert {tuple(r) for r in out.collect()} == {("a", "x", 1), ("b", "w", 2), ("c", "n", None)}


def test_sync_run_then_second_run_then_retry(spark, tmp_path):
    write(tmp_path / "landing", "1.json", "\n".join(json.dumps({"source": "s", "id": i, "pos": n}) for n, i in enumerate(("AAA", "BBB", "CCC"))))
    spark.createDataFrame([("s", "AAA", 0)], "source string, id string, pos bigint").withColumn("part", T.pool_part()) \
        .write.partitionBy("part").parquet(str(tmp_path / "pool"))
    items = spark.readStream.schema("source string, id string, pos bigint").json(str(tmp_path / "landing"))
    only_b = lambda df: df.filter("id <> 'CCC'")
    run = lambda ck, dead: T.sync_stream(items, str(tmp_path / "pool"), str(tmp_path / dead), str(tmp_path / ck), only_b, ["pos"])
    run("ck1", "dead")
    pool = lambda: sorted(r[0] for r in spark.read.parquet(str(tmp_path / "pool")).select("id").collect())
    assert pool() == ["AAA", "BBB"] and spark.read.parquet(str(tmp_path / "dead")).first()["id"] == "CCC"
    run("ck2", "dead")          # everything is offered again: nothing is new
    assert pool() == ["AAA", "BBB"] and spark.read.parquet(str(tmp_path / "dead")).count() == 1
    cleared = T.retry_dead(spark, str(tmp_path / "dead"), str(tmp_path / "dead2"))
    assert T.read_or_empty(spark, cleared, T.DEAD).count() == 0
    T.sync_stream(items, str(tmp_path / "pool"), cleared, str(tmp_path / "ck3"), None, ["pos"])
    assert pool() == ["AAA", "BBB", "CCC"]


def test_batch_diff_counts(spark):
    ids = lambda rows: spark.createDataFrame(rows, "source string, id string")
    current = ids([("s", "AAA"), ("s", "BBB"), ("s", "CCC")])
    one = lambda *i: spark.createDataFrame([(x,) for x in i], "id string")
    r = Y.sync_result(current, one("AAA"), ids([]), one("AAA", "BBB")).first()
    assert (r["current"], r["new"], r["skipped"], r["ingested"], r["failed"]) == (3, 2, 1, 1, 1)
    r = Y.sync_result(current, one("AAA", "BBB"), ids([("s", "CCC")]), one("AAA", "BBB")).first()
    assert (r["new"], r["skipped"]) == (0, 3)


def test_attempt_stream_equals_batch_and_replay_is_harmless(spark, tmp_path):
    schema = T.ATTEMPTS
    rows = [{"arm": "p", "record_id": "R0", "at": "2024-01-01T00:00:00Z", "seq": 0, "ok": False, "seconds": 9.0},
            {"arm": "p", "record_id": "R1", "at": "2024-01-01T00:00:00Z", "seq": 1, "ok": True, "seconds": 1.0}]
    write(tmp_path / "log", "1.json", "\n".join(map(json.dumps, rows)))
    stream = lambda: spark.readStream.schema(schema).json(str(tmp_path / "log"))
    T.attempt_stats_stream(stream(), str(tmp_path / "t"), str(tmp_path / "ck"))
    write(tmp_path / "log", "2.json", json.dumps({**rows[0], "at": "2024-01-02T00:00:00Z", "seq": 2, "ok": True, "seconds": 3.0}))
    T.attempt_stats_stream(stream(), str(tmp_path / "t"), str(tmp_path / "ck"))
    T.attempt_stats_stream(stream(), str(tmp_path / "t"), str(tmp_path / "ck-again"))
    table = attempt_stats(T.last_attempts(spark, str(tmp_path / "t"))).first()
    batch = attempt_stats(spark.read.schema(schema).json(str(tmp_path / "log"))).first()
    assert tuple(table) == tuple(batch) == ("p", 2, 0, 2.0)


def test_snapshot_is_reused_until_rebuilt(spark, tmp_path):
    load = lambda n, rebuild=False: sinks.load_or_build(
        spark, str(tmp_path / "s"), lambda: spark.range(n), "id bigint", rebuild).count()
    assert (load(2), load(5), load(5, True)) == (2, 2, 5)


def test_tables_keep_their_state_over_new_checkpoints(spark, tmp_path):
    root, land = str(tmp_path / "t"), tmp_path / "land"
    rows = lambda n: "\n".join(json.dumps({"arm": "p", "record_id": f"R{i % 3}", "at": "2024-01-01T00:00:00Z", "seq": n * 10 + i,
                                           "ok": True, "seconds": float(n)}) for i in range(3))
    for n in range(12):
        write(land / str(n), "x.json", rows(n))
        T.attempt_stats_stream(spark.readStream.schema(T.ATTEMPTS).json(str(land / str(n))), root, str(tmp_path / f"ck{n}"))
    assert {r.seconds for r in T.last_attempts(spark, root).collect()} == {11.0}
    late = "\n".join(json.dumps({"arm": "p", "record_id": f"R{i}", "at": "2023-01-01T00:00:00Z", "seq": 999, "ok": False, "seconds": 99.0}) for i in range(4))
    write(land / "late", "x.json", late)
    T.attempt_stats_stream(spark.readStream.schema(T.ATTEMPTS).json(str(land / "late")), root, str(tmp_path / "ck-late"))
    assert {r.record_id: r.seconds for r in T.last_attempts(spark, root).collect()} == {"R0": 11.0, "R1": 11.0, "R2": 11.0, "R3": 99.0}
    other = T.compacted(T.last_attempts(spark, root), str(tmp_path / "t2"))
    write(land / "more", "x.json", late.replace("2023", "2025"))
    T.attempt_stats_stream(spark.readStream.schema(T.ATTEMPTS).json(str(land / "more")), other, str(tmp_path / "ck-more"))
    assert T.changes(spark, other, T.ATTEMPTS).count() == 8
    assert {r.seconds for r in T.last_attempts(spark, other).collect()} == {99.0}


def test_a_batch_writes_only_what_changed(spark, tmp_path):
    row = lambda i, seq: json.dumps({"arm": "p", "record_id": f"R{i}", "at": "2024-01-01T00:00:00Z", "seq": seq, "ok": True, "seconds": 1.0})
    for name, lines in (("1", [row(i, i) for i in range(5)]), ("2", [row(3, 9)])):
        write(tmp_path / "log", f"{name}.json", "\n".join(lines))
        T.attempt_stats_stream(spark.readStream.schema(T.ATTEMPTS).json(str(tmp_path / "log")), str(tmp_path / "t"), str(tmp_path / "ck"))
    per = spark.read.parquet(str(tmp_path / "t/changes")).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in per} == {0: 5, 1: 1}


def test_ledger_and_progress_after_a_new_checkpoint(spark, tmp_path):
    results = "source string, run_date string, current bigint, new bigint, ingested bigint, error string, rate_limited boolean"
    for n in range(3):
        write(tmp_path / f"r{n}", "x.json", json.dumps({"source": "s", "run_date": f"2024-05-0{n + 1}", "current": n, "new": 0, "ingested": 0, "error": ""}))
        T.source_ledger_stream(spark.readStream.schema(results).json(str(tmp_path / f"r{n}")), str(tmp_path / "l"), str(tmp_path / f"lc{n}"))
        write(tmp_path / f"p{n}", "run.log", f"2024-05-02 10:00:0{n} INFO [ingest] x ({n}/1234567890123)\n")
        T.progress_stream(scans.scan_run_log(spark, str(tmp_path / f"p{n}"), stream=True), str(tmp_path / "p"), str(tmp_path / f"pc{n}"))
    x = T.ledger(spark, str(tmp_path / "l")).first()
    assert (x.last_run, x.runs, x.last_current) == ("2024-05-03", 3, 2)
    seen = T.progress(spark, str(tmp_path / "p"), F.lit("2024-05-02 10:00:30").cast("timestamp")).first()
    assert (seen.done, seen.total, seen.live) == (2, 1234567890123, True)
    assert not T.progress(spark, str(tmp_path / "p"), F.lit("2024-05-02 10:02:00").cast("timestamp")).first().live


def test_empty_and_corrupt_files_are_not_silent(spark, tmp_path):
    write(tmp_path / "r", "AAA.json", {"id": "AAA", "url": "u"})
    write(tmp_path / "r", "EMPTY.json", "")
    with pytest.raises(Exception):
        scans.scan_records(spark, str(tmp_path / "r")).collect()
    assert scans.scan_records(spark, str(tmp_path / "r"), strict=False).count() == 1
    assert [r.file for r in scans.record_rejects(spark, str(tmp_path / "r")).collect()] == ["EMPTY.json"]
    write(tmp_path / "k", "annotations.json", '{"AAA": {"starred": tr')
    with pytest.raises(Exception):
        scans.scan_keyed_json(spark, str(tmp_path / "k"), S.ANNOTATION_ENTRY).collect()
    assert scans.scan_keyed_json(spark, str(tmp_path / "k"), S.ANNOTATION_ENTRY, strict=False).count() == 0
    assert scans.keyed_rejects(spark.read.text(str(tmp_path / "k"), wholetext=True), "value").count() == 1


def test_a_null_limit_is_no_limit(spark):
    from gleaner.operators.joins import collection_members_from_feed

    items = spark.createDataFrame([(f"i{n}", n, ["1", "2"]) for n in range(5)], "id string, pos bigint, collection_ids array<string>")
    cols = spark.createDataFrame([("all", "1", None), ("two", "2", 2)], "slug string, id string, limit int")
    got = collection_members_from_feed(items, cols).groupBy("slug").count().collect()
    assert {r["slug"]: r["count"] for r in got} == {"all": 5, "two": 2}


def test_damaged_feeds_are_reported(spark, tmp_path):
    item = lambda i: f"<item><title>t{i}</title><link>https://e.org/{i}</link></item>"
    whole = f"<rss><channel>{item(1)}{item(2)}<!-- <item> --><x><![CDATA[<item>]]></x></channel></rss>"
    write(tmp_path / "f", "whole.xml", whole)
    assert feeds.feed_rejects(spark, str(tmp_path / "f")).collect() == []
    assert feeds.scan_rss_atom(spark, str(tmp_path / "f"), strict=True).count() == 2
    write(tmp_path / "f", "stray.xml", f"<rss><channel>{item(3)}<item><title>x</b></title><link>https://e.org/4</link></item>{item(5)}</channel></rss>")
    write(tmp_path / "f", "short.xml", f"<rss><channel>{item(6)}<item><title>cut")
    bad = {r.file.rsplit("/", 1)[1]: (r.tag, r.opened) for r in feeds.feed_rejects(spark, str(tmp_path / "f")).collect()}
    assert bad == {"stray.xml": ("item", 3), "short.xml": ("item", 2)}
    with pytest.raises(ValueError):
        feeds.scan_rss_atom(spark, str(tmp_path / "f"), strict=True)
    assert {r.url for r in feeds.scan_rss_atom(spark, str(tmp_path / "f")).collect()} >= {"https://e.org/1", "https://e.org/2", "https://e.org/3", "https://e.org/6"}


def test_damaged_releases_are_reported(spark, tmp_path):
    write(tmp_path / "r", "good.json", json.dumps([{"tag_name": "v1", "html_url": "u"}]))
    write(tmp_path / "r", "bad.json", '[{"tag_name": "v2"')
    assert feeds.scan_releases(spark, str(tmp_path / "r"), "https://github.com/o/r").count() == 1
    assert [r.file.rsplit("/", 1)[1] for r in feeds.release_rejects(spark, str(tmp_path / "r")).collect()] == ["bad.json"]
    with pytest.raises(Exception):
        feeds.scan_releases(spark, str(tmp_path / "r"), "https://github.com/o/r", strict=True).collect()

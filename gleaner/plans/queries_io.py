"""Runnable checks of scans and sinks: files are written from the driver's tables and read back by the scans, or texts a file
would hold are parsed by the same reader code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import schemas as S
from gleaner.operators.attempts import stage_events
from gleaner.plans import sqlparts as Q
from gleaner.plans import stage
from gleaner.plans.registry import query
from gleaner.session import work_folder
from gleaner.operators.records import video_item
from gleaner.sources import folders, feeds, scans, sinks

PERMISSIVE = {"mode": "PERMISSIVE"}


def landed(lines, purpose: str, one_each: bool = False, order: str | None = None) -> str:
    """Folder of text files that hold these rows; one row a file where the format is one document a file, named in the order of
    the column `order`, which is not written.

    Many files are written by all cores, whatever the table's own partitions, and put in place by the tasks that wrote them rather
    than one by one by the driver: nobody reads the folder before all are there.
    """
    path = work_folder(lines.sparkSession, purpose)
    if not one_each:
        lines.write.text(path)
        return path
    cores = lines.sparkSession.sparkContext.defaultParallelism
    dealt = lines.repartition(cores) if order is None else lines.repartitionByRange(cores, order).sortWithinPartitions(order).drop(order)
    dealt.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
    return path


@query("sc1_scan_record_files", """
SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS title, n_name AS genre, 2 AS n_facts FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def sc1_files(spark, sf):
    """Suppliers as record files, one document each."""
    s = stage.table(spark, sf, "supplier").join(stage.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    fact = lambda t: F.struct(t.alias("text"), F.lit(1.5).alias("timestamp"))
    doc = F.to_json(F.struct(stage.text_of("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("n_name").alias("genre"),
                             F.array(fact(F.col("s_name")), fact(F.lit("second"))).alias("facts")))
    read = scans.scan_records(spark, landed(s.select(doc), "records", one_each=True))
    return read.select("id", "title", "genre", F.size("facts").cast("bigint").alias("n_facts"))


@query("sc2_scan_manifest_files", """
SELECT 's' || s_suppkey AS slug, 0 AS pos, s_name AS record_id FROM supplier UNION ALL SELECT 's' || s_suppkey, 1, CAST(s_nationkey AS VARCHAR) FROM supplier""")
def sc2_files(spark, sf):
    """Suppliers as collection manifests; every file is one, and one file is broken."""
    s = stage.table(spark, sf, "supplier")
    doc = F.to_json(F.struct(F.concat(F.lit("s"), "s_suppkey").alias("slug"), F.array("s_name", stage.text_of("s_nationkey")).alias("reel_ids")))
    broken = s.select(F.lit('{"slug": "x", ').alias("d")).distinct()
    path = landed(s.select(doc.alias("d")).unionByName(broken), "manifests", one_each=True)
    return scans.membership(scans.scan_manifests(spark, path)).withColumn("pos", F.col("pos").cast("bigint"))


@query("sc4_scan_keyed_files", """
SELECT CAST(doc_id AS VARCHAR) AS id, quality = 1 AS starred, 'n' || toxic AS note FROM labels""")
def sc4_files(spark, sf):
    """labels as stores of a hundred annotations each, one store a file."""
    entry = F.struct((F.col("quality") == 1).alias("starred"), F.concat(F.lit("n"), "toxic").alias("note"))
    one = F.struct(stage.text_of("doc_id"), entry)
    stores = stage.table(spark, sf, "labels").groupBy(F.expr("doc_id div 100")).agg(F.to_json(F.map_from_entries(F.collect_list(one))).alias("d"))
    return scans.scan_keyed_json(spark, landed(stores.select("d"), "stores", one_each=True), S.ANNOTATION_ENTRY).select("id", "starred", "note")


@query("sc5_scan_run_report_files", """
SELECT CAST(event_id AS VARCHAR) AS record_id, event_type AS stage, CASE WHEN value > 50 THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN value > 50 THEN 'boom' END AS error FROM events""", shown=["error"])
def sc5_files(spark, sf):
    """events as run reports of five hundred records each, one report a file."""
    bad = F.col("value") > 50
    outcome = F.struct(F.lit("u").alias("url"), F.create_map("event_type", F.when(bad, "error").otherwise("ok")).alias("stages"),
                       F.when(bad, F.create_map("event_type", F.lit("boom"))).alias("errors"))
    reports = stage.table(spark, sf, "events").groupBy(F.expr("event_id div 500")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(
        F.struct(stage.text_of("event_id"), outcome))).alias("reels"))).alias("d"))
    return scans.scan_run_report(spark, landed(reports.select("d"), "reports", one_each=True)).select("record_id", "stage", "status", "error")


@query("sc6_scan_url_file", """
SELECT 'https://www.instagram.com/reel/' || page_id || '/' AS url FROM pages WHERE page_id % 3 = 0""")
def sc6_file(spark, sf):
    """Every third page as a permalink among other urls and comments."""
    p = stage.table(spark, sf, "pages")
    line = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" https://www.instagram.com/reel/"), "page_id", F.lit("/ "))) \
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("# "), "url")).otherwise(F.col("url"))
    return scans.scan_url_list(spark, landed(p.select(line), "urls"))


@query("sc1_scan_records", f"""WITH {Q.REC}
SELECT id, title0 AS title, genre, likes, len(lines) AS n_facts,
       coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS fact_chars FROM records""", bigint=["fact_chars"])
def sc1(spark, sf):
    r = stage.records(spark, sf).select("id", "title", "genre", "likes", "facts")
    landed = r.select(F.to_json(F.struct(*r.columns)).alias("value"))
    read = landed.select(F.from_json("value", scans.with_corrupt(S.RECORD), PERMISSIVE).alias("r")).select("r.*")
    good, _ = scans.split_corrupt(read)
    chars = F.aggregate("facts", F.lit(0), lambda s, f: s + F.length(f["text"]))
    return good.select("id", "title", "genre", "likes", F.size("facts").cast("bigint").alias("n_facts"),
                       chars.cast("bigint").alias("fact_chars"))


@query("sc2_scan_manifests", f"""WITH {Q.REC}
SELECT id AS slug, generate_subscripts(string_split(title0, ' '), 1) - 1 AS pos,
       unnest(string_split(title0, ' ')) AS record_id FROM records""")
def sc2(spark, sf):
    r = stage.records(spark, sf)
    text = F.to_json(F.struct(F.col("id").alias("slug"), "title", F.split("title", " ").alias("reel_ids")))
    read = r.select(F.from_json(text, scans.with_corrupt(S.MANIFEST), PERMISSIVE).alias("m")).select("m.*")
    return scans.membership(scans.split_corrupt(read)[0]).withColumn("pos", F.col("pos").cast("bigint"))


@query("sc3_scan_attempt_log", """
SELECT event_type AS arm, CAST(user_id AS VARCHAR) AS record_id, event_type <> 'error' AS ok, value AS seconds
FROM events""")
def sc3(spark, sf):
    e = stage.table(spark, sf, "events")
    line = F.to_json(F.struct(
        F.col("event_type").alias("profile"), F.col("user_id").cast("string").alias("reel_id"),
        (F.col("event_type") != "error").alias("ok"), F.col("value").alias("seconds"),
        F.col("ts").cast("string").alias("at")))
    log = scans.scan_attempt_log(spark, landed(e.select(line), "log"))
    return scans.attempts_from_log(log).select("arm", "record_id", "ok", "seconds")


@query("sc4_scan_keyed_json", """
SELECT 'k' AS key, count(*) AS n, sum(CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT)) AS total
FROM events WHERE regexp_matches(props, '"k": *-?[0-9]+')""", bigint=["total"])
def sc4(spark, sf):
    rows = scans.keyed_json(stage.table(spark, sf, "events"), "props", "bigint", "key")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("sc5_scan_run_report", """
WITH o AS (
  SELECT event_type AS stage, CASE WHEN value > 50 THEN 'error' ELSE 'ok' END AS status FROM events
  UNION ALL SELECT 'site', 'skip' FROM events)
SELECT stage, status, count(*) AS n, count(*) FILTER (status = 'error') AS errors FROM o GROUP BY stage, status""")
def sc5(spark, sf):
    e = stage.table(spark, sf, "events")
    status = F.when(F.col("value") > 50, "error").otherwise("ok")
    stages = F.create_map("event_type", status, F.lit("site"), F.lit("skip"))
    errors = F.when(F.col("value") > 50, F.create_map("event_type", F.lit("boom")))
    text = F.to_json(F.struct(F.create_map(F.col("user_id").cast("string"), F.struct(
        F.lit("u").alias("url"), stages.alias("stages"), errors.alias("errors"))).alias("reels")))
    reports = e.select(F.from_json(text, S.RUN_REPORT).alias("r")).select("r.*")
    return scans.report_outcomes(reports).groupBy("stage", "status").agg(
        F.count("*").alias("n"), F.count("error").alias("errors"))


@query("sc6_scan_url_list", r"""
SELECT url, regexp_matches(url, '(?i)^https?://(www\.)?[a-z0-9.-]+\.(com|org)/') AS valid FROM pages
WHERE url <> '' AND NOT starts_with(url, '#')""")
def sc6(spark, sf):
    lines = stage.table(spark, sf, "pages").select(F.concat(F.lit("  "), "url", F.lit(" ")).alias("value"))
    good, bad = scans.url_lines(lines, pattern=r"(?i)^https?://(www\.)?[a-z0-9.-]+\.(com|org)/")
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


def clean(x: str) -> str:
    return Q.strip(f"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '{Q.WS}+', ' ', 'g')")


# characters an XML 1.0 file cannot hold
NOT_XML = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{fffe}\x{ffff}]"


def _element(name: str, value) -> Column:
    """One XML element with its text escaped."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


@query("sc7_scan_rss_atom", f"""
SELECT 'rs_' || substring(sha1(url), 1, 14) AS id, url,
       {clean(f"regexp_replace(html, '{NOT_XML}', '', 'g')")} AS caption,
       'w' AS author, '2024-05-02 10:00:00' AS at FROM pages""")
def sc7(spark, sf):
    item = F.concat(
        F.lit("<item>"), _element("title", F.lit("")), _element("link", F.col("url")),
        _element("description", F.regexp_replace("html", NOT_XML, "")), _element("dc:creator", F.lit("<b>w</b>")),
        _element("pubDate", F.lit("Thu, 02 May 2024 12:00:00 +0200")), F.lit("</item>"))
    items = stage.table(spark, sf, "pages").select(F.from_xml(item, S.RSS_ITEM).alias("x")).select("x.*")
    out = feeds.rss_records(items)
    return out.select("id", "url", "caption", "author", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("sc7_scan_feed_files", f"""
WITH f AS (SELECT page_id // 50 AS feed, page_id, url, html, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) AS nth FROM pages)
SELECT 'rs_' || substring(sha1(url), 1, 14) AS id, url, CASE WHEN feed % 2 = 0 THEN 'w' ELSE 'v' END AS author,
       CASE WHEN feed % 2 = 0 THEN '2024-05-02 10:00:00' ELSE '2024-05-01 10:00:00' END AS at FROM f WHERE nth <= 20""")
def sc7_files(spark, sf):
    """Pages in feeds of fifty, RSS and Atom in turn, one feed a file; twenty items of each are taken."""
    p = stage.table(spark, sf, "pages").withColumn("feed", F.expr("page_id div 50"))
    text = F.regexp_replace("html", NOT_XML, "")
    url = F.replace("url", F.lit("&"), F.lit("&amp;"))
    rss = F.concat(F.lit("<item>"), _element("title", F.lit("t")), _element("link", F.col("url")), _element("description", text),
                   _element("dc:creator", F.lit("w")), _element("pubDate", F.lit("Thu, 02 May 2024 12:00:00 +0200")), F.lit("</item>"))
    atom = F.concat(F.lit("<entry>"), _element("title", F.lit("t")), F.lit('<link href="'), url, F.lit('"/>'), _element("content", text),
                    F.lit("<author><name>v</name></author>"), _element("published", F.lit("2024-05-01T10:00:00Z")), F.lit("</entry>"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("page_id", F.when(F.col("feed") % 2 == 0, rss).otherwise(atom).alias("x")))),
                        lambda i: i["x"])
    feed = F.concat(F.lit('<feed xmlns:dc="d">'), F.array_join(items, ""), F.lit("</feed>"))
    path = landed(p.groupBy("feed").agg(feed.alias("d")).select("d"), "feeds", one_each=True)
    out = feeds.scan_rss_atom(spark, path, limit=20)
    return out.select("id", "url", "author", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("sc8_scan_paper_files", """
SELECT 'ar_' || substring(sha1('https://example.org/abs/' || doc_id), 1, 14) AS id, source || ', ' || lang AS author, source AS caption FROM documents""")
def sc8_files(spark, sf):
    """documents as entries of paper feeds, two hundred a file."""
    d = stage.table(spark, sf, "documents")
    entry = F.concat(F.lit("<entry>"), _element("id", F.concat(F.lit("https://example.org/abs/"), "doc_id")), _element("title", F.lit("t")),
                     _element("summary", F.col("source")), F.lit("<author>"), _element("name", F.col("source")), F.lit("</author><author>"),
                     _element("name", F.col("lang")), F.lit("</author></entry>"))
    feed = F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>"))
    path = landed(d.groupBy(F.expr("doc_id div 200")).agg(feed.alias("d")).select("d"), "papers", one_each=True)
    return feeds.scan_paper_atom(spark, path).select("id", "author", "caption")


@query("sc9_scan_release_files", """
SELECT 'gi_' || substring(sha1('https://example.org/r/' || doc_id), 1, 14) AS id, 'repo v' || doc_id || ': ' || source AS title FROM documents""")
def sc9_files(spark, sf):
    """documents as release lists of two hundred, one list a file."""
    one = F.struct(F.concat(F.lit("https://example.org/r/"), "doc_id").alias("html_url"), F.concat(F.lit("v"), "doc_id").alias("tag_name"),
                   F.col("source").alias("name"), F.lit("b").alias("body"), F.lit("2024-05-02T12:00:00Z").alias("published_at"))
    lists = stage.table(spark, sf, "documents").groupBy(F.expr("doc_id div 200")).agg(F.to_json(F.collect_list(one)).alias("d"))
    path = landed(lists.select("d"), "releases", one_each=True)
    return feeds.scan_releases(spark, path, "https://github.com/own/repo.git").select("id", "title")


@query("sc8_scan_paper_atom", f"""
SELECT 'ar_' || substring(sha1('https://example.org/abs/' || doc_id), 1, 14) AS id,
       source || ', ' || lang AS author, {clean('text')} AS caption FROM documents""")
def sc8(spark, sf):
    d = stage.table(spark, sf, "documents")
    entries = d.select(
        F.concat(F.lit("https://example.org/abs/"), "doc_id").alias("id"), F.lit("t").alias("title"),
        F.struct(F.col("text").alias("_VALUE")).alias("summary"),
        F.array(F.struct(F.col("source").alias("name")), F.struct(F.col("lang").alias("name"))).alias("author"))
    text = F.to_json(F.struct(*entries.columns))
    read = entries.select(F.from_json(text, S.ATOM_ENTRY).alias("x")).select("x.*")
    return feeds.paper_records(read).select("id", "author", "caption")


@query("sc9_scan_releases", f"""
SELECT 'gi_' || substring(sha1('https://example.org/r/' || doc_id), 1, 14) AS id,
       'repo v' || doc_id || ': ' || source AS title, 'own' AS author, {clean('text')} AS caption,
       '2024-05-02 12:00:00' AS at FROM documents""")
def sc9(spark, sf):
    d = stage.table(spark, sf, "documents")
    text = F.to_json(F.struct(
        F.concat(F.lit("https://example.org/r/"), "doc_id").alias("html_url"),
        F.concat(F.lit("v"), "doc_id").alias("tag_name"), F.col("source").alias("name"),
        F.col("text").alias("body"), F.lit("2024-05-02T12:00:00Z").alias("published_at")))
    read = d.select(F.from_json(text, S.RELEASE).alias("x")).select("x.*")
    out = feeds.release_records(read, F.lit("https://github.com/own/repo.git"))
    return out.select("id", "title", "author", "caption", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


def feed_pages(spark, sf):
    """events as landed feed pages of one item; the event type picks the kind of post."""
    e = stage.table(spark, sf, "events")
    kind = (F.when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 1)
            .when(F.col("event_type").isin("purchase", "signup"), 8))
    inner = F.when(F.col("event_type") == "purchase", 2).otherwise(1)
    media = F.struct(
        kind.alias("media_type"), F.concat(F.lit("u"), "user_id").alias("code"),
        F.array(F.floor(F.col("value") / 10).cast("string"), F.lit("all")).alias("saved_collection_ids"),
        F.array(F.struct(inner.alias("media_type"))).alias("carousel_media"),
        F.struct(F.concat(F.lit("h"), "event_id").alias("username")).alias("user"))
    text = F.to_json(F.struct(F.array(F.struct(media.alias("media"))).alias("items")))
    return e.select("event_id", F.from_json(text, S.FEED_PAGE).alias("p")).select("event_id", "p.*")


@query("sc10_scan_feed_pages", """
SELECT 'u' || user_id AS id, min(event_id) AS page, 'h' || min(event_id) AS handle FROM events
WHERE event_type IN ('view', 'purchase', 'error') GROUP BY user_id""")
def sc10(spark, sf):
    items = feeds.page_items(feed_pages(spark, sf), F.col("event_id"))
    return feeds.feed_items(items).select("id", "page", "handle")


@query("sc10_scan_feed_page_files", """
SELECT 'u' || user_id AS id, 'h' || min(event_id) AS handle, len(list(event_id)) AS n FROM events
WHERE event_type IN ('view', 'purchase', 'error') GROUP BY user_id""")
def sc10_files(spark, sf):
    """The same posts as landed page files of 500 in the order of their names, read back; `n` counts a post's places in the pages."""
    posts = feed_pages(spark, sf).select(F.expr("event_id div 500").alias("page"), "event_id", F.explode("items").alias("item"))
    pages = posts.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("event_id", "item"))).alias("p")).select(
        "page", F.to_json(F.struct(F.transform("p", lambda x: x["item"]).alias("items"))).alias("d"))
    path = landed(pages, "pages", one_each=True, order="page")
    seen = feeds.feed_page_items(spark, path).filter(video_item(F.col("media"))).groupBy(F.col("media.code").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return feeds.scan_feed_pages(spark, path).select("id", "handle").join(seen, "id")


@query("sc11_scan_sources", """
SELECT s_name AS name, 'https://example.org/s/' || s_suppkey AS url, 'collection' AS type,
       s_acctbal >= 0 AS enabled, 200 AS "limit" FROM supplier""")
def sc11(spark, sf):
    s = stage.table(spark, sf, "supplier")
    entry = F.struct(F.col("s_name").alias("name"), F.concat(F.lit("https://example.org/s/"), "s_suppkey").alias("url"),
                     F.when(F.col("s_acctbal") < 0, False).alias("enabled"))
    text = F.to_json(F.struct(F.array(entry).alias("sources")))
    return scans.source_rows(s.select(F.from_json(text, S.SOURCES).alias("r")).select("r.*"))


@query("sc11_scan_source_files", """
SELECT s_name AS name, 'https://example.org/s/' || s_suppkey AS url, CASE WHEN s_suppkey % 2 = 0 THEN 'rss' ELSE 'collection' END AS type,
       true AS enabled, CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE 200 END AS "limit" FROM supplier""")
def sc11_files(spark, sf):
    """Suppliers as source registries of a hundred, one registry a file; odd ones leave the defaults out."""
    even = F.col("s_suppkey") % 2 == 0
    entry = F.struct(F.col("s_name").alias("name"), F.concat(F.lit("https://example.org/s/"), "s_suppkey").alias("url"),
                     F.when(even, "rss").alias("type"), F.when(even, 5).alias("limit"))
    files = stage.table(spark, sf, "supplier").groupBy(F.expr("s_suppkey div 100")).agg(
        F.to_json(F.struct(F.collect_list(entry).alias("sources"))).alias("d"))
    return scans.scan_sources(spark, landed(files.select("d"), "registry", one_each=True))


def log_lines(spark, sf):
    return log_lines_of(stage.table(spark, sf, "events"))


def log_lines_of(e):
    """events as run-log lines."""
    progress = F.concat(F.lit(" ("), F.floor("value").cast("string"), F.lit("/500)"))
    body = (F.when(F.col("event_type") == "view", F.concat(F.lit("[ingest] got"), progress))
            .when(F.col("event_type") == "click", F.concat(F.lit("[process] done"), progress))
            .when(F.col("event_type") == "signup", F.lit("[index] building"))
            .when(F.col("event_type") == "purchase", F.lit("collection 7 page 3"))
            .otherwise("worker failed"))
    return e.select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO "), body).alias("value"))


LOG = """log AS (
  SELECT event_id, date_trunc('second', ts) AS log_time,
    CASE event_type WHEN 'view' THEN 'ingest' WHEN 'click' THEN 'process' WHEN 'signup' THEN 'index'
                    WHEN 'purchase' THEN 'enumerate' END AS stage,
    CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(value) AS BIGINT) END AS done,
    CASE WHEN event_type IN ('view', 'click') THEN 500 END AS total FROM events)"""


@query("sc12_scan_run_log", f"""WITH {LOG}
SELECT stage, count(*) AS n, max(done) AS done, max(total) AS total,
       strftime(max(log_time), '%Y-%m-%d %H:%M:%S') AS last FROM log WHERE stage IS NOT NULL GROUP BY stage""", filled=["done", "total"])
def sc12(spark, sf):
    return stage_events(log_lines(spark, sf)).groupBy("stage").agg(
        F.count("*").alias("n"), F.max("done").alias("done"), F.max("total").alias("total"),
        F.date_format(F.max("log_time"), "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("sc12_scan_log_files", f"""WITH {LOG}
SELECT stage, count(*) AS n, coalesce(sum(done), 0) AS done FROM log WHERE stage IS NOT NULL GROUP BY stage""", bigint=["done"])
def sc12_files(spark, sf):
    """events as the lines of run logs."""
    lines = scans.scan_run_log(spark, landed(log_lines(spark, sf).select("value"), "logs"))
    return lines.groupBy("stage").agg(F.count("*").alias("n"), F.coalesce(F.sum("done"), F.lit(0)).alias("done"))


# --- sinks -------------------------------------------------------------------
@query("sk1_write_records", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || l.quality ELSE d.lang END AS genre, d.source AS author
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def sk1(spark, sf):
    current = stage.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("genre"),
                                                         F.col("source").alias("author"))
    changes = stage.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("genre"), F.col("toxic").alias("seq"))
    written = sinks.write_records(current.withColumnRenamed("doc_id", "id"), changes, work_folder(spark, "records"), "seq")
    return written.withColumnRenamed("id", "doc_id")


@query("sk1_upsert_records", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || l.quality ELSE d.lang END AS genre, d.source AS author
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def sk1_folders(spark, sf):
    """The same upsert into a table in folders, in two parts: each rewrites the folders its changes fall in."""
    path = work_folder(spark, "record-folders")
    current = stage.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("genre"), F.col("source").alias("author"))
    folders.write_folders(current, path, "id", 8)
    labels = stage.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("genre"), F.col("toxic").alias("seq"))
    for k in range(2):
        folders.upsert_records(labels.filter(folders.part_of("id", 8) % 2 == k), path, current.schema, "seq", parts=8)
    return folders.read_folders(spark, path, current.schema, "id").select(F.col("id").alias("doc_id"), "genre", "author")


@query("sk2_export_csv", f"""WITH {Q.REC}, {Q.TAGS},
joined AS (SELECT id, string_agg(tag, ', ' ORDER BY nth) AS tags FROM tags GROUP BY id)
SELECT r.id, title0 AS title, author, genre, coalesce(j.tags, '') AS tags,
       CASE WHEN likes <> 0 THEN CAST(likes AS VARCHAR) ELSE '' END AS likes, '' AS comments, '' AS views,
       CASE WHEN n_chars <> 0 THEN CAST(CAST(n_chars AS DOUBLE) / 8 AS VARCHAR) ELSE '' END AS duration,
       CAST(n_chars AS VARCHAR) AS tokens_in, CAST(length(genre) AS VARCHAR) AS tokens_out, replace(coalesce(summary, ''), chr(10), ' ') AS summary,
       array_to_string(odd_lines, ' ') AS transcript, url
FROM records r LEFT JOIN joined j ON j.id = r.id""")
def sk2(spark, sf):
    path = work_folder(spark, "csv")
    sinks.export_csv(stage.records(spark, sf), path)
    back = spark.read.options(**sinks.CSV, multiLine=True, lineSep="\n").csv(path)
    return back.fillna("")


@query("sk3_export_markdown", f"""WITH {Q.REC}, {Q.TAGS},
joined AS (SELECT id, string_agg('#' || tag, ' ' ORDER BY nth) AS tags FROM tags GROUP BY id)
SELECT '# Reels export' AS text
UNION ALL SELECT DISTINCT '## ' || genre FROM records
UNION ALL
SELECT '- **[' || title || '](' || url || ')** — ' || author || '  ' || coalesce(j.tags, '')
FROM records r LEFT JOIN joined j ON j.id = r.id
UNION ALL
SELECT '  - ' || summary FROM records WHERE coalesce(summary, '') <> ''""")
def sk3(spark, sf):
    path = work_folder(spark, "markdown")
    sinks.export_markdown(stage.records(spark, sf), path)
    return spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "text")


NL = "chr(10)"
PAGE_FACTS = ("array_to_string(list_transform(lines, lambda x, i: '| `' || ((i - 1) * 8 // 60) || ':' || "
              "lpad(CAST((i - 1) * 8 % 60 AS VARCHAR), 2, '0') || '` | ' || x || ' |'), chr(10))")
PAGE_SAID = "array_to_string(list_transform(lines, lambda x, i: '- `[' || ((i - 1) * 4) || '.0s]` ' || x), chr(10))"


@query("sk5_record_pages", f"""WITH {Q.REC},
m AS (SELECT *, regexp_extract_all(caption, '#([\\p{{L}}\\p{{N}}_]+)', 1) AS hs,
             regexp_extract_all(caption, '@([\\p{{L}}\\p{{N}}_.]+)', 1) AS ms FROM records)
SELECT id, md5(concat_ws({NL} || {NL},
  '---' || {NL} || 'title: "' || title0 || '"' || {NL} || 'author: "' || author || '"' || {NL} || 'date: ""' || {NL} ||
    'source: "' || url || '"' || {NL} || 'id: "' || id || '"' || {NL} || '---' || {NL} || {NL} || '# ' || title0,
  '| | |' || {NL} || '|---|---|' || {NL} || '| **Author** | ' || author || ' |' || {NL} || '| **Date** | — |' || {NL} ||
    '| **Source** | [' || url || '](' || url || ') |' || {NL} || '| **Likes** | ' || format('{{:,}}', likes) || ' |' ||
    CASE WHEN n_chars <> 0 THEN {NL} || '| **Duration** | ' || CAST(round_even(n_chars / 8.0, 0) AS BIGINT) || 's |' ELSE '' END,
  '**Genre:** `' || genre || '`',
  CASE WHEN coalesce(summary, '') <> '' THEN '## Summary' || {NL} || {NL} || summary END,
  '## Details' || {NL} || {NL} || '**Topic:**' || {NL} || genre || {NL} || {NL} || '**Name:**' || {NL} || author,
  CASE WHEN len(lines) > 0 THEN '## Key facts (with provenance)' || {NL} || {NL} || '| At | Fact |' || {NL} ||
    '|----|------|' || {NL} || {PAGE_FACTS} END,
  CASE WHEN caption <> '' THEN '## Caption' || {NL} || {NL} || caption ||
    CASE WHEN len(hs) > 0 THEN {NL} || {NL} || '**Hashtags:** #' || array_to_string(hs, ' #') ELSE '' END ||
    CASE WHEN len(ms) > 0 THEN {NL} || {NL} || '**Mentions:** @' || array_to_string(ms, ' @') ELSE '' END END,
  CASE WHEN array_to_string(odd_lines, ' ') <> '' THEN '## Transcript' || {NL} || {NL} || {PAGE_SAID} END,
  CASE WHEN len(lines) > 0 THEN '## On-screen text' || {NL} || {NL} || '- ' || array_to_string(lines, {NL} || '- ') END,
  '---' || {NL} || '*Scraped  · [original](' || url || ')*')) AS page FROM m""")
def sk5(spark, sf):
    return sinks.record_pages(stage.records(spark, sf)).select("id", F.md5("page").alias("page"))


def doc_members(spark, sf):
    """documents on the shelf of their source, in id order; languages stand for two genres with a section and two without."""
    genre = F.when(F.col("genre") == "en", "Product").when(F.col("genre") == "fr", "tutorial").when(F.col("genre") == "de", "recipe") \
        .otherwise("unknown")
    r = stage.records(spark, sf).withColumn("genre", genre)
    return r.withColumn("slug", F.concat(F.lit("c-"), "author")).withColumn("pos", F.col("id").cast("bigint")) \
        .withColumnRenamed("id", "record_id")


def doc_collections(spark, sf):
    return stage.table(spark, sf, "documents").select(
        F.concat(F.lit("c-"), "source").alias("slug"), F.upper("source").alias("title"),
        F.lit("2024-05-02").alias("updated")).distinct()


CARD_FACTS = ("array_to_string(list_transform(lines, lambda x, i: '- ' || ((i - 1) * 8 // 60) || ':' || "
              "lpad(CAST((i - 1) * 8 % 60 AS VARCHAR), 2, '0') || ' ' || x), chr(10))")


SECTION = """CASE genre WHEN 'en' THEN 'product' WHEN 'fr' THEN 'tutorial' ELSE 'other' END"""
SECTION_AT = """CASE genre WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 5 END"""


@query("sk6_collection_digest", f"""WITH {Q.REC},
m AS (SELECT *, 'c-' || author AS slug, {SECTION} AS own, {SECTION_AT} AS place FROM records)
SELECT slug, 0 AS section, -1 AS pos, '# ' || upper(any_value(author)) || ' — ' || count(*) ||
       CASE WHEN count(*) = 1 THEN ' record' ELSE ' records' END || ' · 1 creators · ' || count(DISTINCT own) || ' genres' AS text
FROM m GROUP BY slug
UNION ALL SELECT slug, place, -1, '## ' || CASE place WHEN 1 THEN 'Products & Tools' WHEN 2 THEN 'Tutorials & Walkthroughs' ELSE 'Other' END
       || ' (' || count(*) || ')' FROM m GROUP BY slug, place
UNION ALL SELECT slug, place, doc_id, concat_ws(chr(10), '### ' || title, author || ' · ' || own,
       'likes ' || format('{{:,}}', likes), CASE WHEN coalesce(summary, '') <> '' THEN summary END,
       CASE WHEN len(lines) > 0 THEN 'Facts (' || len(lines) || '):' || chr(10) || {CARD_FACTS} END,
       '<' || url || '>') FROM m""")
def sk6(spark, sf):
    out = sinks.digest_lines(doc_members(spark, sf), doc_collections(spark, sf))
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query("sk6_master_index", f"""WITH {Q.REC},
m AS (SELECT *, 'c-' || author AS slug, row_number() OVER (PARTITION BY author ORDER BY doc_id) AS nth FROM records)
SELECT slug, upper(any_value(author)) AS title, '2024-05-02' AS updated, count(*) AS records,
       coalesce(string_agg(thumbnail_path, '|' ORDER BY doc_id) FILTER (nth <= 3), '') AS thumbs
FROM m GROUP BY slug""")
def sk6_index(spark, sf):
    return sinks.master_index(doc_collections(spark, sf), doc_members(spark, sf))


@query("sk7_write_recency_index", """
SELECT '# Instagram Reels Archive' AS text UNION ALL SELECT '' UNION ALL SELECT ''
UNION ALL SELECT '| Title | Author | Date | Page | PDF |' UNION ALL SELECT '|-------|--------|------|------|-----|'
UNION ALL SELECT '**' || count(*) || '** reels archived. Each page has caption, transcript, on-screen text, AI summary, and a downloadable PDF.' FROM orders
UNION ALL SELECT '| ' || replace(o_orderpriority || '|' || o_orderkey, '|', '\\|') ||
       ' | ' || o_custkey || ' | ' || strftime(o_orderdate, '%Y-%m-%d') || ' | [open](records/' || o_orderkey ||
       '.md) | — |' FROM orders""".replace("\\\\|", "\\|"))
def sk7(spark, sf):
    o = stage.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat("o_orderpriority", F.lit("|"), "o_orderkey").alias("title"),
        F.col("o_custkey").cast("string").alias("author"), F.col("o_orderdate").alias("timestamp"),
        F.lit(None).cast("timestamp_ntz").alias("scraped_at"), F.lit(None).cast("string").alias("pdf_path"))
    path = work_folder(spark, "index")
    sinks.write_recency_index(o, path)
    return spark.read.text(path).withColumnRenamed("value", "text")

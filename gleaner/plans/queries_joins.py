"""Runnable checks of lookups between tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions import facts as C
from gleaner.functions.text import select_where
from gleaner.operators import joins as J
from gleaner.operators import markers as M
from gleaner.operators.sync import sync_result
from gleaner.plans import sqlparts as Q
from gleaner.plans import stage
from gleaner.plans.queries_io import feed_pages
from gleaner.plans.queries_records import SYNC, sync_tables
from gleaner.plans.registry import query
from gleaner.sources import feeds


@query("jn1_with_annotations", f"""WITH {Q.LISTING} SELECT id, starred, read, archived FROM listing""")
def jn1(spark, sf):
    return J.with_annotations(stage.records(spark, sf).select("id"), stage.annotations(spark, sf))


@query("jn2_with_collections", f"""WITH {Q.MEMBERSHIP},
inv AS (SELECT record_id, string_agg(DISTINCT slug, ',' ORDER BY slug) AS c FROM membership
        WHERE slug <> 'machinery' GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, coalesce(c, '') AS collections
FROM orders LEFT JOIN inv ON inv.record_id = CAST(o_custkey AS VARCHAR)""")
def jn2(spark, sf):
    o = stage.table(spark, sf, "orders").select(stage.text_of("o_orderkey").alias("order_id"),
                                                stage.text_of("o_custkey").alias("id"))
    out = J.with_collections(o, stage.membership(spark, sf).filter("slug <> 'machinery'"))
    return out.select("order_id", F.array_join("collections", ",").alias("collections"))


@query("jn4_collection_records", """
SELECT lower(c_mktsegment) AS slug, o_orderkey AS pos, c_custkey AS record_id, c_name AS title
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0""")
def jn4(spark, sf):
    c = stage.table(spark, sf, "customer")
    members = stage.table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.lower("c_mktsegment").alias("slug"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("record_id"))
    pool = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return J.collection_records(members, pool)


@query("jn5_new_ids", f"WITH {SYNC} SELECT source, id FROM fresh")
def jn5(spark, sf):
    current, pool, dead, _ = sync_tables(spark, sf)
    return J.new_ids(current, pool, dead)


@query("ag22_sync_result", f"WITH {SYNC} SELECT * FROM result")
def ag22(spark, sf):
    return sync_result(*sync_tables(spark, sf))


@query("jn6_index_gap", """
SELECT count(l.doc_id) AS indexed, count(*) - count(l.doc_id) AS not_indexed, count(*) = count(l.doc_id) AS ok
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def jn6(spark, sf):
    index = stage.table(spark, sf, "labels").select(stage.text_of("doc_id").alias("record_id"))
    return J.index_gap(stage.records(spark, sf), index)


@query("jn7_unseen_candidates", """
WITH h AS (SELECT user_id AS id, event_id AS pos FROM events)
SELECT id, min(pos) AS pos FROM h WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
  AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY id""")
def jn7(spark, sf):
    harvested = stage.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"))
    marks = stage.table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    return J.unseen_candidates(harvested, marks.filter("quality = 0"), marks.filter("toxic = 1"))


@query("jn8_fill_missing_handle", """
SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderstatus = 'O' THEN '@set' END, c_name, '') AS author_handle,
       o_orderstatus <> 'O' AND c_name IS NOT NULL AS filled
FROM orders LEFT JOIN (SELECT o_orderkey AS k, c_name FROM orders JOIN customer ON o_custkey = c_custkey
                       WHERE c_acctbal > 0) h ON h.k = o_orderkey""")
def jn8(spark, sf):
    o = stage.table(spark, sf, "orders")
    rec = o.select(F.col("o_orderkey").alias("id"),
                   F.when(F.col("o_orderstatus") == "O", "@set").otherwise("").alias("author_handle"))
    handles = o.join(stage.table(spark, sf, "customer").filter("c_acctbal > 0"),
                     F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_name").alias("handle"))
    return J.fill_missing_handle(rec, handles)


@query("jn9_sources_with_state", """
SELECT s_name AS name, s_nationkey AS nation, n_name AS last_run, n_regionkey AS records
FROM supplier LEFT JOIN nation ON 'Supplier#' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0') = s_name""", filled=["records"])
def jn9(spark, sf):
    src = stage.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    state = stage.table(spark, sf, "nation").select(
        F.concat(F.lit("Supplier#"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).alias("name"),
        F.col("n_name").alias("last_run"), F.col("n_regionkey").alias("last_current"))
    return J.sources_with_state(src, state)


@query("jn10_arm_catalog", """
WITH d AS (SELECT n_name AS name, n_nationkey AS k FROM nation WHERE n_regionkey < 3),
r AS (SELECT n_name AS name, n_nationkey AS k, n_regionkey FROM nation WHERE n_regionkey > 1),
i AS (SELECT r_name AS name FROM region UNION SELECT n_name FROM nation)
SELECT i.name, CASE WHEN d.name IS NOT NULL THEN 'cloud' WHEN r.name IS NOT NULL THEN 'local' ELSE i.name END AS kind,
       CASE WHEN d.name IS NOT NULL THEN 'm' || d.k WHEN r.name IS NOT NULL THEN 't' || r.k ELSE '' END AS model,
       CASE WHEN r.name IS NOT NULL THEN r.n_regionkey = 3 ELSE true END AS installed,
       coalesce(CASE WHEN r.name IS NOT NULL THEN 'role' END, '') AS notes,
       CASE WHEN d.name IS NOT NULL THEN 0 WHEN r.name IS NOT NULL THEN 1 ELSE 2 END AS priority
FROM i LEFT JOIN d ON d.name = i.name LEFT JOIN r ON r.name = i.name""")
def jn10(spark, sf):
    n = stage.table(spark, sf, "nation").withColumnRenamed("n_name", "name")
    declared = n.filter("n_regionkey < 3").select("name", F.lit("cloud").alias("kind"),
                                                  F.concat(F.lit("m"), "n_nationkey").alias("model"), F.lit("").alias("notes"))
    registry = n.filter("n_regionkey > 1").select("name", F.concat(F.lit("t"), "n_nationkey").alias("tag"),
                                                  (F.col("n_regionkey") == 3).alias("installed"), F.lit("role").alias("role"))
    implicit = stage.table(spark, sf, "region").select(F.col("r_name").alias("name")).union(n.select("name")).distinct()
    return J.arm_catalog(declared, registry, implicit)


@query("jn13_strip_subtitles", f"""WITH {Q.REC},
spoken AS (SELECT id, array_to_string(odd_lines, ' ') AS said, lines FROM records),
l AS (SELECT id, said, regexp_replace(regexp_replace(lower(said), '[^a-z0-9 ]', ' ', 'g'), '{Q.WS}+', ' ', 'g') AS sp,
             unnest(lines) AS line FROM spoken),
k AS (SELECT *, {Q.strip(f"regexp_replace(regexp_replace(lower(line), '[^a-z0-9 ]', ' ', 'g'), '{Q.WS}+', ' ', 'g')")}
             AS key FROM l)
SELECT id, count(*) AS kept, sum(length(line)) AS chars FROM k
WHERE said = '' OR NOT (contains(key, ' ') AND contains(sp, key)) GROUP BY id""", bigint=["chars"])
def jn13(spark, sf):
    r = select_where(stage.records(spark, sf), ["id"], C.strip_subtitles("on_screen_text", "transcript_text"), "kept",
                     lambda k: F.size(k) > 0)
    chars = F.aggregate("kept", F.lit(0), lambda s, x: s + F.length(x))
    return r.select("id", F.size("kept").cast("bigint").alias("kept"),
                                               chars.cast("bigint").alias("chars"))


MARK = r"[A-Za-z0-9]{9,}"


def doc_markers(spark, sf):
    """Long words of a document that its first line (the title) and every second line do not hold."""
    r = stage.records(spark, sf).withColumn("on_screen_text", F.array("author"))
    return M.caption_only_markers(r, MARK)


@query("jn14_exclusive_markers", f"""WITH {Q.REC},
e AS (SELECT id, regexp_replace(lower(array_to_string(odd_lines, ' ') || author || title0), '[^a-z0-9]', '', 'g') AS e,
             regexp_extract_all(caption, '{MARK}') AS ms FROM records),
m AS (SELECT id, e, unnest(ms) AS marker, generate_subscripts(ms, 1) AS pos FROM e),
k AS (SELECT id, pos, marker, lower(marker) AS key FROM m WHERE NOT contains(e, lower(marker)))
SELECT id, min(pos) OVER (PARTITION BY id, key) = pos AS first, marker FROM k
QUALIFY first""".replace("SELECT id, min(pos)", "SELECT id, marker, min(pos)").replace("first, marker FROM k", "first FROM k"))
def jn14(spark, sf):
    return doc_markers(spark, sf).select(F.col("record_id").alias("id"), F.explode("markers").alias("marker"),
                                         F.lit(True).alias("first"))


@query("jn14_ocr_markers", f"""WITH {Q.REC},
e AS (SELECT id, regexp_replace(lower(array_to_string(odd_lines, ' ') || title0), '[^a-z0-9]', '', 'g') AS e, lines
      FROM records),
m AS (SELECT id, e, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM e),
k AS (SELECT id, pos, e, {Q.strip("line")} AS marker, regexp_replace(lower(line), '[^a-z0-9]', '', 'g') AS key FROM m),
f AS (SELECT id, key, arg_min(marker, pos) AS marker, min(pos) AS pos FROM k
      WHERE length(key) >= 8 AND NOT contains(e, key) GROUP BY id, key)
SELECT id, marker FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) <= 40""")
def jn14_ocr(spark, sf):
    r = stage.records(spark, sf).withColumn("caption", F.lit(""))
    return M.ocr_only_markers(r).select(F.col("record_id").alias("id"), F.explode("markers").alias("marker"))


@query("jn15_marker_hits", f"""WITH {Q.FACTS},
marks AS (SELECT DISTINCT record_id, m FROM (
  SELECT record_id, unnest(regexp_extract_all(text, '{MARK}')) AS m FROM facts WHERE arm = 'user')),
said AS (SELECT record_id, arm, text FROM facts)
SELECT a.record_id, arm, m AS marker, bool_or(contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), lower(m))) AS found
FROM marks a JOIN said s ON s.record_id = a.record_id GROUP BY a.record_id, arm, m""")
def jn15(spark, sf):
    f = stage.facts(spark, sf)
    marks = (f.filter("arm = 'user'")
             .select("record_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(MARK), F.lit(0)))).alias("m"))
             .distinct().select("record_id", F.array("m").alias("markers")))
    variants = f.select("record_id", "arm", M.alnum_key("text").alias("key"))
    hits = M.marker_hits(marks, variants)
    return hits.groupBy("record_id", "arm", "marker").agg(F.bool_or("found").alias("found"))


@query("jn15_variant_text", f"""WITH {Q.REC}, {Q.TAGS},
j AS (SELECT id, string_agg(tag, '' ORDER BY nth) AS tags FROM tags GROUP BY id),
k AS (SELECT r.id, regexp_replace(lower(coalesce(summary, '') || array_to_string(lines, '') || array_to_string(lines, '') ||
             array_to_string(lines, '') || coalesce(tags, '') || 'topic' || genre || 'name' || author), '[^a-z0-9]', '', 'g') AS key
      FROM records r LEFT JOIN j ON j.id = r.id)
SELECT r.id, md5(key) AS key, contains(key, regexp_replace(lower(title0), '[^a-z0-9]', '', 'g')) AS title_found FROM records r JOIN k ON k.id = r.id""")
def jn15_text(spark, sf):
    """Everything a variant says as one key, and whether the record's title is in it."""
    r = stage.records(spark, sf).withColumn("key_points", F.col("on_screen_text"))
    variants = r.select(F.col("id").alias("record_id"), F.lit("a").alias("arm"), M.variant_text().alias("key"))
    hits = M.marker_hits(r.select(F.col("id").alias("record_id"), F.array("title").alias("markers")), variants)
    return variants.join(hits, "record_id").select(F.col("record_id").alias("id"), F.md5("key").alias("key"), F.col("found").alias("title_found"))


@query("jn16_cited_only", f"""WITH {Q.REC},
s AS (SELECT id, genre || ' [' || author || '] ' AS answer, ['src1', 'src2', author] AS ids,
             regexp_extract_all(genre || ' [' || author || '] ', '\\[([A-Za-z0-9_-]+)\\]', 1) AS cites FROM records),
k AS (SELECT id, list_filter(ids, lambda x: list_contains(cites, x)) AS used, ids FROM s WHERE id <> '')
SELECT id, array_to_string(CASE WHEN len(used) > 0 THEN used ELSE ids END, ',') AS kept FROM k""")
def jn16(spark, sf):
    r = stage.records(spark, sf)
    answer = F.concat_ws("", "genre", F.lit(" ["), "author", F.lit("] "))
    sources = F.array(*[F.struct(x.alias("id")) for x in (F.lit("src1"), F.lit("src2"), F.col("author"))])
    kept = J.keep_cited(sources, answer, F.regexp_extract_all(answer, F.lit(K.CITATION), F.lit(1)))
    return r.select("id", F.array_join(F.transform(kept, lambda s: s["id"]), ",").alias("kept"))


@query("jn17_index_reuse_split", """
SELECT d.doc_id AS record_id, 0 AS row_pos, l.doc_id IS NOT NULL AND l.quality = 1 AS reused
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND d.lang <> 'xx'""")
def jn17(spark, sf):
    rows = stage.table(spark, sf, "documents").select(
        F.col("doc_id").alias("record_id"), F.lit(0).alias("row_pos"), F.md5("text").alias("doc_hash"))
    marks = stage.table(spark, sf, "labels").withColumnRenamed("doc_id", "record_id")
    stored = rows.join(marks, "record_id").select(
        "record_id", "row_pos",
        F.when(F.col("quality") == 1, F.col("doc_hash")).otherwise(F.when(F.col("toxic") == 1, "stale")).alias("doc_hash"),
        F.array(F.lit(1.0)).alias("vec"))
    out = J.index_reuse_split(rows, stored)
    return out.select("record_id", "row_pos", F.col("stored_vec").isNotNull().alias("reused"))


@query("jn18_enabled_sources", """
SELECT s_name AS name FROM supplier WHERE s_acctbal > 0 AND s_name IN (
  SELECT 'Supplier#' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0') FROM nation)""")
def jn18(spark, sf):
    src = stage.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("enabled"))
    only = stage.table(spark, sf, "nation").select(
        F.concat(F.lit("Supplier#"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).alias("name"))
    return J.enabled_sources(src, only).select("name")


@query("jn19_collection_members_from_feed", """
WITH items AS (SELECT 'u' || user_id AS id, event_id AS pos, [CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR), 'all'] AS cids
  FROM events WHERE event_type IN ('view', 'purchase', 'error')),
firsts AS (SELECT id, min(pos) AS pos FROM items GROUP BY id),
tagged AS (SELECT i.id, i.pos, unnest(i.cids) AS cid FROM items i JOIN firsts f ON f.id = i.id AND f.pos = i.pos),
c AS (SELECT 'r' || r_regionkey AS slug, CAST(r_regionkey AS VARCHAR) AS cid FROM region UNION ALL SELECT 'all', 'all')
SELECT slug, id, pos FROM tagged JOIN c USING (cid)
QUALIFY slug = 'all' OR row_number() OVER (PARTITION BY slug ORDER BY pos) <= 40""")
def jn19(spark, sf):
    pages = feeds.feed_items(feeds.page_items(feed_pages(spark, sf), F.col("event_id")))
    items = pages.select("id", F.col("page").alias("pos"), "collection_ids")
    region = stage.table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("slug"),
                                                     F.col("r_regionkey").cast("string").alias("id"))
    every = region.select(F.lit("all").alias("slug"), F.lit("all").alias("id")).distinct()
    collections = region.unionByName(every).withColumn("limit", F.when(F.col("slug") != "all", 40))
    return J.collection_members_from_feed(items, collections, F.expr("pos div 100000")).select("slug", "id", "pos")


@query("ag1_invert_membership", f"""WITH {Q.MEMBERSHIP}
SELECT record_id, string_agg(DISTINCT slug, ',' ORDER BY slug) AS collections FROM membership GROUP BY record_id""")
def ag1(spark, sf):
    out = J.invert_membership(stage.membership(spark, sf))
    return out.select("record_id", F.array_join("collections", ",").alias("collections"))



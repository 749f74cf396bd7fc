"""Runnable checks of projections, filters, sorts and edits of the record table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gleaner.functions.text import renamed_tags, url_last_part
from gleaner.operators import records as R
from gleaner.operators import sync as Y
from gleaner.operators.joins import new_ids, with_annotations, with_collections
from gleaner.plans import sqlparts as Q
from gleaner.plans import stage
from gleaner.plans.queries_io import feed_pages
from gleaner.plans.registry import query
from gleaner.sources import feeds


def union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


@query("corpus_listing", f"""WITH {Q.LISTING}
SELECT l.id, title, author, genre, likes, starred, read, archived,
       CASE WHEN b.doc_id IS NULL THEN '' ELSE 'q' || b.quality || ',t' || b.toxic END AS collections
FROM listing l LEFT JOIN labels b ON CAST(b.doc_id AS VARCHAR) = l.id WHERE NOT archived""")
def corpus_listing(spark, sf):
    """The flagship: records with flags and shelves, archived ones hidden, most liked first."""
    shelves = stage.table(spark, sf, "labels").select(stage.text_of("doc_id").alias("record_id"), F.explode(F.array(
        F.concat(F.lit("q"), "quality"), F.concat(F.lit("t"), "toxic"))).alias("slug"))
    rows = with_annotations(R.summarise_records(stage.records(spark, sf)), stage.annotations(spark, sf))
    rows = R.sort_records(R.filter_records(with_collections(rows, shelves)), "likes")
    return rows.select("id", "title", "author", "genre", "likes", "starred", "read", "archived",
                       F.array_join("collections", ",").alias("collections"))


@query("pf1_summarise_records", f"""WITH {Q.REC}, {Q.TAGS},
joined AS (SELECT id, string_agg(tag, ',' ORDER BY nth) AS tags FROM tags GROUP BY id)
SELECT r.id, title, author, genre, coalesce(j.tags, '') AS tags, url, thumbnail_path, likes, duration,
       pdf_path IS NOT NULL AS has_pdf, n_chars AS tokens_in, length(genre) AS tokens_out, backend, model
FROM records r LEFT JOIN joined j ON j.id = r.id""")
def pf1(spark, sf):
    rows = R.summarise_records(stage.records(spark, sf))
    return rows.withColumn("tags", F.array_join("tags", ",")).drop("views", "comments", "timestamp")


@query("pf2_filter_records", f"""WITH {Q.LISTING}, {Q.TAGS},
hit AS (SELECT DISTINCT id FROM tags WHERE contains(tag, 'ould')),
exact AS (SELECT DISTINCT id FROM tags WHERE tag = 'the')
SELECT 'text' AS f, id FROM listing WHERE NOT archived AND (contains(lower(title), 'ould')
   OR contains(lower(author), 'ould') OR contains(lower(genre), 'ould') OR id IN (SELECT id FROM hit))
UNION ALL SELECT 'tag', id FROM listing WHERE NOT archived AND id IN (SELECT id FROM exact)
UNION ALL SELECT 'shelf', id FROM listing WHERE NOT archived AND author = 'src3' AND genre = 'en'
UNION ALL SELECT 'starred', id FROM listing WHERE NOT archived AND starred AND backend = 'local' AND model = ''
UNION ALL SELECT 'unread', id FROM listing WHERE NOT archived AND NOT read AND genre = 'fr'
UNION ALL SELECT 'archived', id FROM listing WHERE archived""")
def pf2(spark, sf):
    rows = stage.listing(spark, sf)
    asked = {
        "text": dict(q="OULD"), "tag": dict(tag="the"), "shelf": dict(collection="c-src3", genre="en"),
        "starred": dict(status="starred", arm="local"), "unread": dict(status="unread", genre="fr"),
        "archived": dict(status="archived")}
    return R.filter_by_sets(rows, asked, "f").select("f", "id")


@query("pf2_filter_by_age", """
SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 365 DAY""")
def pf2_age(spark, sf):
    o = stage.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("timestamp"), F.lit(False).alias("archived"))
    now = F.lit("2000-01-01").cast("timestamp_ntz")
    return R.filter_records(o, max_age_days=365, now=now).select("id")


@query("pf3_filter_min_metric", "SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 5000")
def pf3(spark, sf):
    c = stage.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return R.filter_min_metric(c, "c_acctbal", 5000).select("id")


@query("pf4_board_lanes", f"""WITH {Q.LISTING}
SELECT id, CASE WHEN archived THEN 'archived' WHEN starred THEN 'starred' ELSE 'unread' END AS lane
FROM listing WHERE archived OR starred OR NOT read""")
def pf4(spark, sf):
    return R.board_lanes(stage.listing(spark, sf)).select("id", "lane")


@query("pf5_apply_saved_view", f"""WITH {Q.LISTING}
SELECT v.name, id FROM listing, (VALUES ('stars'), ('fr')) v(name)
WHERE NOT archived AND ((v.name = 'stars' AND starred) OR (v.name = 'fr' AND genre = 'fr' AND author = 'src1'))""")
def pf5(spark, sf):
    rows = stage.listing(spark, sf)
    views = {"stars": {"status": "starred", "sort": "title"}, "fr": {"genre": "fr", "account": "src1"}}
    return union(R.apply_saved_view(rows, v).select(F.lit(n).alias("name"), "id") for n, v in views.items())


@query("pf5_saved_views", """
WITH v AS (SELECT n_name AS name, 'r' || n_regionkey AS genre FROM nation WHERE n_nationkey % 3 <> 0
           UNION ALL SELECT n_name, 'new' FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT r_name, 'new' FROM region)
SELECT name, genre FROM v WHERE name NOT LIKE 'A%'""")
def pf5_views(spark, sf):
    """Nations as saved views: every third is saved anew, regions are added, names on A are deleted."""
    view = lambda name, genre: [F.col(name).alias("name"), F.create_map(F.lit("genre"), genre).alias("filters")]
    nation, region = (stage.table(spark, sf, t) for t in ("nation", "region"))
    views = nation.select(*view("n_name", F.concat(F.lit("r"), "n_regionkey")))
    changes = nation.filter("n_nationkey % 3 = 0").select(*view("n_name", F.lit("new"))).unionByName(region.select(*view("r_name", F.lit("new"))))
    saved = R.save_views(views, changes)
    left = R.delete_views(saved, saved.filter("name LIKE 'A%'").select("name"))
    return left.select("name", F.col("filters")["genre"].alias("genre"))


@query("pf6_route_modality", """
SELECT CAST(doc_id AS VARCHAR) AS id, n_chars < 1000 AND text <> '' AS is_text FROM documents""")
def pf6(spark, sf):
    text, media = R.route_modality(stage.records(spark, sf))
    return text.select("id", F.lit(True).alias("is_text")).unionByName(media.select("id", F.lit(False).alias("is_text")))


@query("pf7_keep_video_items", """
SELECT event_id AS page, event_type IN ('view', 'purchase', 'error') AS listed, event_type = 'view' AS known
FROM events""")
def pf7(spark, sf):
    items = feeds.page_items(feed_pages(spark, sf), F.col("event_id"))
    return items.select("page", R.video_item(F.col("media")).alias("listed"),
                        R.video_item(F.col("media"), known_only=True).alias("known"))


@query("pf8_select_unfinished", f"""WITH {Q.REC}
SELECT 'summary' AS need, id FROM records WHERE video_path IS NOT NULL AND coalesce(summary, '') = ''
UNION ALL SELECT 'transcript', id FROM records
  WHERE video_path IS NOT NULL AND {Q.strip("array_to_string(odd_lines, ' ')")} = ''
UNION ALL SELECT 'variant', id FROM records WHERE video_path IS NOT NULL AND genre <> 'en'
UNION ALL SELECT 'redo', id FROM records WHERE video_path IS NOT NULL""")
def pf8(spark, sf):
    r = stage.records(spark, sf).withColumn("variants", F.create_map("tokens.backend", F.col("summary")))
    picked = [R.select_unfinished(r, need=n, arm="claude-cli").select(F.lit(n).alias("need"), "id")
              for n in ("summary", "transcript", "variant")]
    redo = R.select_unfinished(r, need="tags", redo=True).select(F.lit("redo").alias("need"), "id")
    return union([*picked, redo])


@query("pf9_select_by_ids", f"""WITH {Q.REC}
SELECT l.doc_id AS pos, r.id, r.title0 AS title FROM labels l JOIN records r ON r.id = CAST(l.doc_id AS VARCHAR)""")
def pf9(spark, sf):
    wanted = stage.table(spark, sf, "labels").select(
        F.col("doc_id").alias("pos"), stage.text_of("doc_id").alias("id"))
    return R.select_by_ids(stage.records(spark, sf).select("id", "title"), wanted)


def candidate_store(spark, sf):
    e = stage.table(spark, sf, "embeddings")
    state = F.when(F.col("label") < 4, "new").when(F.col("label") < 6, "accepted") \
        .when(F.col("label") < 8, "rejected").otherwise("snoozed")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding")[0].alias("score"), state.alias("state"),
                    F.concat(F.lit("https://example.org/e/"), "label").alias("url"))


STORE = """store AS (
  SELECT vec_id AS id, embedding[1] AS score, 'https://example.org/e/' || label AS url,
         CASE WHEN label < 4 THEN 'new' WHEN label < 6 THEN 'accepted' WHEN label < 8 THEN 'rejected'
              ELSE 'snoozed' END AS state FROM embeddings)"""


@query("pf10_filter_candidates", f"WITH {STORE} SELECT id, state FROM store WHERE state = 'new'")
def pf10(spark, sf):
    return R.filter_candidates(candidate_store(spark, sf)).select("id", "state")


@query("pf11_valid_ids", r"""
SELECT page_id, regexp_matches(string_split(rtrim(url, '/'), '/')[-1], '^[A-Za-z0-9_-]+$') AS ok FROM pages""")
def pf11(spark, sf):
    p = stage.table(spark, sf, "pages").select("page_id", url_last_part("url").alias("id"))
    good, bad = R.split_valid_ids(p)
    return good.select("page_id", F.lit(True).alias("ok")).unionByName(bad.select("page_id", F.lit(False).alias("ok")))


# --- sorts -------------------------------------------------------------------
def _order_rows(spark, sf):
    return stage.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_totalprice").alias("likes"))


@query("sl1_sort_records", """
SELECT 'newest' AS sort, o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders
UNION ALL SELECT 'oldest', o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) FROM orders
UNION ALL SELECT 'likes', o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) FROM orders
UNION ALL SELECT 'title', o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) FROM orders""")
def sl1(spark, sf):
    """The order itself is invisible in a set of rows, so each row shows its place."""
    rows = _order_rows(spark, sf)
    return union(R.with_rank(rows, R.sort_keys(s)).select(F.lit(s).alias("sort"), "id", "rank")
                 for s in ("newest", "oldest", "likes", "title"))


@query("sl2_sort_any_column", """
SELECT 'number' AS kind, c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer
UNION ALL SELECT 'text', c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey) FROM customer""")
def sl2(spark, sf):
    c = stage.table(spark, sf, "customer").withColumnRenamed("c_custkey", "id")
    number, text = R.column_keys(c, "c_acctbal"), R.column_keys(c, "c_mktsegment", descending=False)
    return union([R.with_rank(c, number).select(F.lit("number").alias("kind"), "id", "rank"),
                  R.with_rank(c, text).select(F.lit("text").alias("kind"), "id", "rank")])


@query("sl3_recent_n", "SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 8")
def sl3(spark, sf):
    return R.recent(_order_rows(spark, sf), 8, [F.desc("timestamp"), F.desc("id")]).select("id")


@query("sl4_random_pending", """
SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE lang <> 'en' ORDER BY md5(doc_id || ':7'), id LIMIT 50""")
def sl4(spark, sf):
    r = stage.table(spark, sf, "documents").select(
        stage.text_of("doc_id").alias("id"),
        F.when(F.col("lang") == "en", F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)))
        .otherwise(F.create_map(F.lit("a"), F.lit(1))).alias("variants"))
    return R.random_pending(r, ["a", "b"], n=50, seed=7).select("id")


# --- set operations and merges -----------------------------------------------
def sync_tables(spark, sf):
    """orders as what sources list now, shipped orders as the pool, returned lines as dead letters."""
    current = stage.table(spark, sf, "orders").select(
        F.lower("o_orderpriority").alias("source"), F.col("o_orderkey").alias("id"))
    li = stage.table(spark, sf, "lineitem")
    pool = li.filter("l_quantity > 45").select(F.col("l_orderkey").alias("id")).distinct()
    dead = (li.filter("l_returnflag = 'R' AND l_discount > 0.08").select(F.col("l_orderkey").alias("id")).distinct()
            .join(current, "id").select("source", "id"))
    landed = li.filter("l_quantity > 40").select(F.col("l_orderkey").alias("id")).distinct()
    return current, pool, dead, landed


SYNC = """current AS (SELECT lower(o_orderpriority) AS source, o_orderkey AS id FROM orders),
pool AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 45),
dead AS (SELECT source, id FROM current WHERE id IN (
  SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08)),
landed AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 40),
fresh AS (SELECT * FROM current c WHERE id NOT IN (SELECT id FROM pool)
          AND NOT EXISTS (SELECT 1 FROM dead d WHERE d.source = c.source AND d.id = c.id)),
failed AS (SELECT * FROM fresh WHERE id NOT IN (SELECT id FROM landed)),
result AS (
  SELECT c.source, count(*) AS current, count(f.id) AS new, count(*) - count(f.id) AS skipped,
         count(l.id) FILTER (f.id IS NOT NULL) AS ingested, count(f.id) FILTER (l.id IS NULL) AS failed
  FROM current c LEFT JOIN fresh f ON f.id = c.id AND f.source = c.source LEFT JOIN landed l ON l.id = c.id
  GROUP BY c.source)"""


@query("st1_advance_ids", f"""WITH {SYNC},
seen AS (SELECT source, id FROM dead UNION SELECT source, id FROM fresh),
gone AS (SELECT source, id FROM dead WHERE source <> '1-urgent' UNION SELECT source, id FROM failed)
SELECT 'seen' AS list, source, count(*) AS n, sum(id) AS ids FROM seen GROUP BY source
UNION ALL SELECT 'dead', source, count(*), sum(id) FROM gone GROUP BY source""", bigint=["ids"])
def st1_ids(spark, sf):
    current, pool, dead, landed = sync_tables(spark, sf)
    fresh = new_ids(current, pool, dead)
    failed = fresh.join(landed, "id", "left_anti")
    retry = current.select("source").distinct().filter(F.col("source").startswith("1"))
    lists = {"seen": Y.advance_ids(dead, fresh), "dead": Y.advance_dead(dead, failed, retry)}
    return union(d.groupBy("source").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
                 .withColumn("list", F.lit(n)) for n, d in lists.items())


@query("st1_advance_ledger", f"""WITH {SYNC},
state AS (SELECT lower(o_orderpriority) AS name, count(*) FILTER (o_orderstatus = 'F') AS runs,
                 count(*) AS last_current FROM orders WHERE o_totalprice < 1000000 GROUP BY 1)
SELECT name, '2024-05-02' AS last_run, s.runs + 1 AS runs,
       CASE WHEN name LIKE '5%' THEN s.last_current ELSE r.current END AS last_current,
       CASE WHEN name LIKE '5%' THEN 0 ELSE r.new END AS last_new,
       CASE WHEN name LIKE '5%' THEN 0 ELSE r.ingested END AS last_ingested,
       CASE WHEN name LIKE '5%' THEN 'limited' ELSE '' END AS error
FROM state s JOIN result r ON r.source = s.name""")
def st1_ledger(spark, sf):
    tables = sync_tables(spark, sf)
    limited = F.col("source").startswith("5")
    results = Y.sync_result(*tables).withColumn("rate_limited", limited).withColumn(
        "error", F.when(limited, "limited"))
    state = stage.table(spark, sf, "orders").groupBy(F.lower("o_orderpriority").alias("name")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("runs"), F.count("*").alias("last_current"))
    state = state.select("name", F.lit(None).cast("string").alias("last_run"), "runs", "last_current",
                         F.lit(0).alias("last_new"), F.lit(0).alias("last_ingested"), F.lit("").alias("error"))
    return Y.advance_ledger(state, results, "2024-05-02")


@query("st2_missing_arms", """
WITH have AS (SELECT conv_id, list(DISTINCT role) AS arms FROM conversations GROUP BY conv_id)
SELECT conv_id AS id, array_to_string(list_filter(['user', 'assistant', 'system', 'tool'],
       lambda a: NOT list_contains(arms, a)), ',') AS missing FROM have""")
def st2(spark, sf):
    c = stage.table(spark, sf, "conversations").select("conv_id", "role").distinct()
    rec = c.groupBy(F.col("conv_id").alias("id")).agg(F.map_from_entries(
        F.collect_list(F.struct("role", F.lit(1)))).alias("variants"))
    out = R.missing_arms(rec, ["user", "assistant", "system", "tool"])
    return out.withColumn("missing", F.array_join("missing", ","))


@query("st3_merge_variants", """
SELECT CAST(doc_id AS VARCHAR) AS id, 'claude-cli' AS arm, CASE WHEN lang = 'en' THEN 'new' ELSE 'old' END AS v
FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), CASE WHEN lang = 'en' THEN 'x' ELSE 'local' END,
  CASE WHEN lang = 'en' THEN 'old' ELSE 'new' END FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'x', 'old' FROM documents WHERE lang <> 'en'""")
def st3(spark, sf):
    r = stage.records(spark, sf)
    old = F.create_map(F.lit("claude-cli"), F.lit("old"), F.lit("x"), F.lit("old"))
    merged = r.select("id", R.variants_with(old, F.create_map(F.col("tokens.backend"), F.lit("new"))).alias("m"))
    return merged.select("id", F.explode("m").alias("arm", "v"))


@query("st4_patch_annotations", f"""WITH {Q.ANNOTATIONS},
patch AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'fr' THEN true END AS read, text AS note FROM documents)
SELECT coalesce(a.id, p.id) AS id, a.starred, coalesce(p.read, a.read) AS read, a.archived,
       md5(coalesce(substring(p.note, 1, 2000), a.note)) AS note
FROM annotations a FULL JOIN patch p ON p.id = a.id""", shown=["starred", "read", "archived"])
def st4(spark, sf):
    patches = stage.table(spark, sf, "documents").select(
        stage.text_of("doc_id").alias("id"), F.lit(None).cast("boolean").alias("starred"),
        F.when(F.col("lang") == "fr", True).alias("read"), F.lit(None).cast("boolean").alias("archived"),
        F.col("text").alias("note"))
    return Y.patch_annotations(stage.annotations(spark, sf), patches).withColumn("note", F.md5("note"))


@query("st5_rename_tag", f"""WITH {Q.TAGS},
t AS (SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(list(tag ORDER BY nth) FILTER (tag IS NOT NULL), []) AS tags
      FROM documents LEFT JOIN tags ON tags.id = CAST(doc_id AS VARCHAR) GROUP BY 1)
SELECT id, array_to_string(CASE WHEN NOT list_contains(tags, 'the') THEN tags
         WHEN list_contains(tags, 'of') THEN list_filter(tags, lambda x: x <> 'the')
         ELSE list_transform(tags, lambda x: CASE WHEN x = 'the' THEN 'of' ELSE x END) END, ',') AS merged,
       array_to_string(list_filter(tags, lambda x: x <> 'the'), ',') AS deleted, list_contains(tags, 'the') AS changed
FROM t""")
def st5(spark, sf):
    r = stage.records(spark, sf).select("id", "tags")
    both = R.rename_tag(r.withColumn("deleted", renamed_tags("tags", "the", "")), "the", "of")
    return both.select("id", F.array_join("tags", ",").alias("merged"), F.array_join("deleted", ",").alias("deleted"), "changed")


@query("st6_promote_variant", f"""WITH {Q.REC}
SELECT id, CASE WHEN genre = 'en' AND len(lines) > 0 THEN 'promoted' WHEN len(lines) > 0 AND genre <> 'fr'
           THEN 'enriched' ELSE 'unchanged' END AS outcome,
       CASE WHEN genre = 'en' AND len(lines) > 0 THEN 'fresh' ELSE coalesce(summary, '') END AS summary,
       CASE WHEN genre = 'en' AND len(lines) > 0 THEN backend || ',local' ELSE 'local' END AS arms,
       CASE WHEN genre = 'fr' AND NOT (len(lines) = 0) THEN 0 ELSE len(lines) END AS key_points FROM records""")
def st6(spark, sf):
    r = stage.records(spark, sf).withColumn("key_points", F.array().cast("array<string>"))
    texts = F.transform("facts", lambda f: f["text"])
    variant = F.struct(
        F.lit("local").alias("backend"), F.lit("m").alias("model"),
        F.when(F.col("genre") == "en", "fresh").otherwise("").alias("summary"),
        F.when(F.col("genre") == "fr", F.array().cast("array<string>")).otherwise(texts).alias("key_points"),
        F.array().cast("array<string>").alias("on_screen_text"), "genre", "tags", "structured", "facts", "tokens",
        F.lit(1.0).alias("elapsed_s"), F.lit(1).alias("frames"), F.lit("").alias("created_at"))
    out = Y.promote_variant(r.withColumn("variants", F.create_map(F.lit("local"), variant)), "local")
    return out.select("id", "outcome", F.coalesce("summary", F.lit("")).alias("summary"),
                      F.array_join(F.array_sort(F.map_keys("variants")), ",").alias("arms"),
                      F.size("key_points").cast("bigint").alias("key_points"))


@query("st7_union_sources", """
SELECT CAST(doc_id AS VARCHAR) AS id, n_chars AS likes, length(text) AS chars FROM documents
UNION ALL SELECT 'p' || page_id, NULL, length(html) FROM pages""", filled=["likes"])
def st7(spark, sf):
    media = stage.records(spark, sf).select("id", "caption", "likes")
    text = stage.table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("caption"))
    return Y.union_sources(media, text).select("id", "likes", F.length("caption").alias("chars"))


@query("st8_set_candidate_state", f"""WITH {STORE},
moved AS (SELECT id, url, CASE WHEN d.doc_id IS NOT NULL THEN 'accepted' ELSE state END AS state
          FROM store s LEFT JOIN labels d ON d.doc_id = s.id AND d.quality = 1)
SELECT 'state' AS what, state AS value, count(*) AS n FROM moved GROUP BY state
UNION ALL SELECT 'unknown', '', count(*) FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT id FROM store)
UNION ALL SELECT DISTINCT 'queue', url, 1 FROM moved WHERE state = 'accepted' AND url <> 'https://example.org/e/4'""")
def st8(spark, sf):
    changes = stage.table(spark, sf, "labels").filter("quality = 1").select(
        F.col("doc_id").alias("id"), F.lit("accepted").alias("new_state"))
    moved, unknown = Y.set_candidate_state(candidate_store(spark, sf), changes)
    queued = candidate_store(spark, sf).select("url").distinct().filter(F.col("url").endswith("/4"))
    return union([
        moved.groupBy(F.col("state").alias("value")).agg(F.count("*").alias("n")).withColumn("what", F.lit("state")),
        unknown.agg(F.count("*").alias("n")).select(F.lit("").alias("value"), "n", F.lit("unknown").alias("what")),
        Y.accept_queue(moved, queued).select(F.col("url").alias("value"), F.lit(1).cast("bigint").alias("n"),
                                             F.lit("queue").alias("what"))])

"""Runnable checks of aggregates, facets, run logs and orders inside groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import attempts as A
from gleaner.operators import facets as G
from gleaner.operators import ranking as W
from gleaner.operators.joins import first_occurrence
from gleaner.plans import sqlparts as Q
from gleaner.operators.records import with_rank
from gleaner.plans import stage
from gleaner.plans.queries_io import LOG, doc_members, log_lines
from gleaner.plans.queries_records import STORE, SYNC, candidate_store, sync_tables
from gleaner.plans.registry import query

WORDTAGS = """ht AS (
  SELECT id, genre, unnest(ws) AS tag, generate_subscripts(ws, 1) - 1 AS pos FROM (
    SELECT id, genre, regexp_extract_all(caption, '[\\p{L}\\p{N}_]{9,}') AS ws FROM records))"""


def word_tagged(spark, sf):
    """records whose hashtags are their long words (few documents hold a real `#`)."""
    return stage.records(spark, sf).withColumn(
        "hashtags", F.regexp_extract_all("caption", F.lit(r"[\p{L}\p{N}_]{9,}"), F.lit(0)))


TOPICS = f"""WITH {Q.REC}, {WORDTAGS},
tags AS (SELECT genre, lower(tag) AS tag, count(*) AS uses, min(struct_pack(id := id, pos := pos)) AS first
         FROM ht GROUP BY genre, lower(tag)),
top AS (SELECT genre, string_agg(tag, ',' ORDER BY rn) AS hashtags FROM (
  SELECT *, row_number() OVER (PARTITION BY genre ORDER BY uses DESC, first) AS rn FROM tags) WHERE rn <= 10 GROUP BY genre),
f AS (SELECT genre, id, unnest(lines) AS text, generate_subscripts(lines, 1) AS pos FROM records),
ff AS (SELECT genre, md5(string_agg(id || ':' || text, '|' ORDER BY rn)) AS facts FROM (
  SELECT *, row_number() OVER (PARTITION BY genre ORDER BY id, pos) AS rn FROM f) WHERE rn <= 40 GROUP BY genre)
SELECT r.genre AS topic, count(*) AS records, min(id) AS first_id, any_value(hashtags) AS hashtags,
       any_value(facts) AS facts
FROM records r LEFT JOIN top USING (genre) LEFT JOIN ff USING (genre) GROUP BY r.genre"""


@query("ag2_build_topics", TOPICS)
def ag2(spark, sf):
    return shown_topics(G.build_topics(word_tagged(spark, sf)))


def shown_topics(out):
    facts = F.array_join(F.transform("facts", lambda f: F.concat(f["record_id"], F.lit(":"), f["text"])), "|")
    return out.select("topic", "records", "first_id", F.array_join("hashtags", ",").alias("hashtags"),
                      F.md5(facts).alias("facts"))


@query("ag2_topic_records", f"""WITH {Q.REC} SELECT genre AS topic, id, title, author FROM records""")
def ag2_records(spark, sf):
    return G.topic_records(stage.records(spark, sf)).select("topic", "id", "title", "author")


@query("ag3_corpus_stats", """
SELECT l_returnflag AS genre, 0 AS level, count(*) AS records, sum(CAST(l_quantity AS BIGINT)) AS tokens_in,
       sum(l_linenumber) AS tokens_out,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS cost_usd FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT NULL, 1, count(*), sum(CAST(l_quantity AS BIGINT)), sum(l_linenumber),
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) FROM lineitem""", bigint=["tokens_in", "tokens_out"])
def ag3(spark, sf):
    li = stage.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("genre"), F.struct(
            F.col("l_quantity").cast("bigint").alias("input"), F.col("l_linenumber").cast("bigint").alias("output"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("cost_usd")).alias("tokens"))
    out = G.corpus_stats(li, cost=F.col("tokens.cost_usd"))
    return out.withColumn("cost_usd", F.col("cost_usd").cast("double")).withColumn("level", F.col("level").cast("int"))


@query("ag3_estimated_cost", f"""WITH {Q.REC},
c AS (SELECT id, n_chars * 3.0 + length(genre) * 15.0 AS micros FROM records)
SELECT r.genre, count(*) AS records, sum(CAST(c.micros AS BIGINT)) AS micro_usd
FROM records r JOIN c ON c.id = r.id GROUP BY r.genre""", bigint=["micro_usd"])
def ag3_cost(spark, sf):
    """Token prices in whole millionths, so that sums are exact."""
    from gleaner.functions.answers import record_cost

    t = F.col("tokens")
    micros = F.round(record_cost(t["cost_usd"], t["input"], t["output"], t["model"], None) * 1e6).cast("bigint")
    return stage.records(spark, sf).groupBy("genre").agg(
        F.count("*").alias("records"), F.sum(micros).alias("micro_usd"))


@query("ag4_tag_facets", f"""WITH {Q.ORDER_TAGS}, {Q.ORDER_MEMBERS},
n AS (SELECT tag, count(*) AS count FROM order_tags GROUP BY tag),
p AS (SELECT tag, slug, count(*) AS in_slug FROM order_tags t JOIN order_members m ON m.record_id = t.id GROUP BY tag, slug)
SELECT n.tag, n.count, p.slug, p.in_slug FROM n LEFT JOIN p ON p.tag = n.tag""")
def ag4(spark, sf):
    return G.tag_facets(stage.order_tags(spark, sf), stage.order_members(spark, sf))


@query("ag4_tag_listing", f"""WITH {Q.ORDER_TAGS}, {Q.ORDER_MEMBERS},
n AS (SELECT tag, count(*) AS count FROM order_tags GROUP BY tag),
p AS (SELECT tag, slug, count(*) AS in_slug FROM order_tags t JOIN order_members m ON m.record_id = t.id GROUP BY tag, slug)
SELECT n.tag, n.count, coalesce(string_agg(p.slug || ':' || p.in_slug, ',' ORDER BY in_slug DESC, slug), '') AS collections,
       row_number() OVER (ORDER BY n.count DESC, n.tag) AS rank FROM n LEFT JOIN p ON p.tag = n.tag GROUP BY n.tag, n.count""")
def ag4_listing(spark, sf):
    tags = G.tag_listing(stage.order_tags(spark, sf), stage.order_members(spark, sf))
    shown = tags.select("tag", "count", F.array_join(F.transform("collections", lambda c: F.concat(
        c["name"], F.lit(":"), c["count"].cast("string"))), ",").alias("collections"))
    return with_rank(shown, [F.desc("count"), F.col("tag")])


@query("ag5_top_tags", """
SELECT lower(p_name) AS tag, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, tag LIMIT 30""")
def ag5(spark, sf):
    return G.top_tags(stage.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("tag")))


@query("ag6_top_authors", """
SELECT 'c' || o_custkey AS handle, count(*) AS saves FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1
HAVING count(*) >= 2 ORDER BY saves DESC, handle LIMIT 8""")
def ag6(spark, sf):
    o = stage.table(spark, sf, "orders").select(F.when(
        F.col("o_orderstatus") != "P", F.concat(F.lit(" @c"), "o_custkey")).alias("author_handle"))
    return G.top_authors(o)


@query("ag7_top_hashtags", f"""WITH {Q.REC}, {WORDTAGS}
SELECT lower(tag) AS tag, count(*) AS uses FROM ht
WHERE regexp_matches(lower(tag), '^[\\p{{L}}\\p{{N}}]+$') AND lower(tag) NOT IN ('instagram', 'instagood', 'foryoupage')
GROUP BY 1 ORDER BY uses DESC, tag LIMIT 6""")
def ag7(spark, sf):
    return G.top_hashtags(word_tagged(spark, sf))


ORACLE_AG11 = """
WITH last AS (SELECT event_type AS arm, user_id, arg_max(value, struct_pack(ts := ts, id := event_id)) AS v,
                     event_type <> 'error' AS ok FROM events GROUP BY event_type, user_id)
SELECT arm, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed,
       CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_seconds FROM last GROUP BY arm"""


@query("ag11_attempt_stats", ORACLE_AG11)
def ag11(spark, sf):
    return A.attempt_stats(stage.attempts(spark, sf))


@query("ag12_attempt_notes", """
WITH last AS (SELECT event_type AS arm, user_id, arg_max(value, struct_pack(ts := ts, id := event_id)) AS v,
                     event_type <> 'error' AS ok FROM events GROUP BY event_type, user_id),
s AS (SELECT arm, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed,
             CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_seconds FROM last GROUP BY arm)
SELECT arm, ok, failed, avg_seconds, ok + failed AS attempted,
       CASE WHEN ok = 0 THEN 'abandoned' WHEN ok + failed < 5000 THEN 'stopped at ' || (ok + failed) || '/5000'
            ELSE '' END AS note FROM s""")
def ag12(spark, sf):
    stats = A.attempt_stats(stage.attempts(spark, sf))
    scored = stage.table(spark, sf, "events").filter("event_type <> 'error'").select(F.col("event_type").alias("arm")).distinct()
    return A.attempt_notes(stats, scored, 5000)


def outcomes(spark, sf):
    e = stage.table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("value") < 1, "skip").otherwise("ok")
    return e.select(F.col("user_id").alias("record_id"), F.substring("event_type", 1, 1).alias("stage"), status.alias("status"))


OUTCOMES = """o AS (SELECT user_id AS record_id, substring(event_type, 1, 1) AS stage,
  CASE WHEN event_type = 'error' THEN 'error' WHEN value < 1 THEN 'skip' ELSE 'ok' END AS status FROM events)"""


@query("ag13_run_summary", f"""WITH {OUTCOMES}, r AS (SELECT record_id, bool_or(status = 'error') AS bad FROM o GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (bad) AS with_errors, count(*) FILTER (NOT bad) AS clean FROM r""")
def ag13(spark, sf):
    return A.run_summary(outcomes(spark, sf))


@query("ag14_stage_tallies", f"""WITH {OUTCOMES}
SELECT stage, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skip') AS skip,
       count(*) FILTER (status = 'error') AS error FROM o GROUP BY stage""")
def ag14(spark, sf):
    return A.stage_tallies(outcomes(spark, sf))


@query("ag15_source_outcomes", f"""WITH {SYNC}
SELECT source AS name, 0 AS level, current, new, ingested, failed, (failed > 100)::BIGINT AS errors FROM result
UNION ALL SELECT NULL, 1, sum(current), sum(new), sum(ingested), sum(failed), count(*) FILTER (failed > 100) FROM result""", bigint=["current", "new", "ingested", "failed"])
def ag15(spark, sf):
    from gleaner.operators.sync import sync_result

    res = sync_result(*sync_tables(spark, sf)).select(
        F.col("source").alias("name"), F.col("current").alias("last_current"), F.col("new").alias("last_new"),
        F.col("ingested").alias("last_ingested"), "failed", F.when(F.col("failed") > 100, "many").alias("error"))
    return A.source_outcomes(res).withColumn("level", F.col("level").cast("int"))


@query("ag16_facet_values", f"""WITH {Q.LISTING}
SELECT 'genre' AS facet, genre AS value FROM listing UNION SELECT 'author', author FROM listing
UNION SELECT 'collection', 'c-' || author FROM listing UNION SELECT 'collection', 'l-' || genre FROM listing
UNION SELECT 'arm', CASE WHEN model <> '' THEN model ELSE backend END FROM listing""")
def ag16(spark, sf):
    return G.facet_values(stage.listing(spark, sf))


@query("ag17_collection_header", """
SELECT lower(c_mktsegment) AS slug, count(*) AS records, count(DISTINCT c_name) AS authors,
       count(DISTINCT CASE o_orderstatus WHEN 'O' THEN 'news' ELSE 'other' END) AS genres
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def ag17(spark, sf):
    m = stage.table(spark, sf, "orders").join(
        stage.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.lower("c_mktsegment").alias("slug"), F.col("c_name").alias("author"),
        F.when(F.col("o_orderstatus") == "O", "News").when(F.col("o_orderstatus") == "F", "entertainment").alias("genre"))
    return G.collection_header(m)


@query("ag17_collection_sections", f"""WITH {Q.REC}
SELECT 'c-' || author AS slug, CASE genre WHEN 'en' THEN 'product' WHEN 'fr' THEN 'tutorial' ELSE 'other' END AS genre,
       count(*) AS records FROM records GROUP BY ALL""")
def ag17_sections(spark, sf):
    return G.collection_sections(doc_members(spark, sf))


@query("ag18_collection_tag_breadth", f"""WITH {Q.ORDER_TAGS}, {Q.ORDER_MEMBERS}
SELECT slug, count(DISTINCT tag) AS tags FROM order_tags t JOIN order_members m ON m.record_id = t.id GROUP BY slug""")
def ag18(spark, sf):
    return G.collection_tag_breadth(stage.order_tags(spark, sf), stage.order_members(spark, sf))


@query("ag20_resource_digest", f"""WITH {Q.REC},
f AS (SELECT id, title, caption, author, unnest(lines) AS item, generate_subscripts(lines, 1) AS pos,
             title0 || ' ' || coalesce(summary, '') || ' ' || caption AS ctx FROM records),
said AS (SELECT id, {Q.strip('item')} AS item, min(pos) AS pos, any_value(ctx) AS ctx FROM f
         WHERE regexp_matches(item, '(?i)(?:https?://)?(?:www\\.)?([a-z0-9-]+\\.[a-z]{{2,}}(?:/[^\\s,)\\]]*)?)')
           AND length(item) < 200 GROUP BY 1, 2),
named AS (SELECT id, author AS item, title0 || ' ' || coalesce(summary, '') || ' ' || caption AS ctx FROM records),
every AS (SELECT id, item, ctx FROM said UNION ALL SELECT id, item, ctx FROM named),
b AS (SELECT id, item, item || ' ' || ctx AS t FROM every WHERE item <> '')
SELECT id, md5(item) AS item, CASE
  WHEN regexp_matches(t, '(?i)\\b(font|fonts|typeface|typograph\\w*|google fonts|fontshare|typewolf|satoshi|poppins|montserrat|helvetica|geist|inter\\b|serif|sans-serif)\\b') THEN 'Fonts & typography'
  WHEN regexp_matches(t, '(?i)\\b(theme|themes|colou?r scheme|colorscheme|palette|swatch|catppuccin|dracula|nord\\b|tokyo ?night|gruvbox|icon pack|wallpaper|dark mode)\\b') THEN 'Themes, palettes & color'
  WHEN regexp_matches(t, '(?i)\\b(figma|ui kit|ui/ux|wireframe|mockup|component library|shadcn|tailwind|animation|framer|webflow|design system|illustration|3d)\\b') THEN 'Design & UI resources'
  ELSE 'Tools & apps' END AS bucket FROM b""")
def ag20(spark, sf):
    return G.resource_digest(stage.records(spark, sf)).select("id", F.md5("item").alias("item"), "bucket")


@query("ag21_discover_summary", f"""WITH {STORE}
SELECT count(*) AS found, count(*) FILTER (score >= 0.1) AS kept, count(*) FILTER (state = 'new') AS pending FROM store""")
def ag21(spark, sf):
    store = candidate_store(spark, sf)
    return A.discover_summary(store, store, 0.1)


@query("ag23_coverage_report", """
SELECT count(*) FILTER (event_type IN ('view', 'click')) AS ok, count(*) FILTER (event_type IN ('signup', 'purchase')) AS silent,
       count(*) FILTER (event_type = 'error') AS failed,
       CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type <> 'error') AS DOUBLE) / 60 AS realtime FROM events""")
def ag23(spark, sf):
    e = stage.table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(
        F.col("event_type").isin("view", "click"), "ok").otherwise("silent")
    runs = e.select(status.alias("status"), F.col("value").cast("decimal(18,2)").alias("duration"))
    return A.coverage_report(runs, F.lit(60.0))


# --- orders inside groups ----------------------------------------------------
@query("wn1_latest_attempt", """
SELECT event_type AS arm, user_id AS record_id, max(struct_pack(ts := ts, id := event_id)).id AS seq
FROM events GROUP BY event_type, user_id""")
def wn1(spark, sf):
    return W.latest_attempt(stage.attempts(spark, sf)).select("arm", "record_id", "seq")


@query("wn3_stratified_sample", """
WITH s AS (SELECT lang AS genre, count(*) AS size FROM documents GROUP BY lang),
q AS (SELECT genre, least(greatest(1, CAST(round_even(50.0 * size / (SELECT sum(size) FROM s), 0) AS INT)), size) AS quota FROM s),
slots AS (SELECT genre, unnest(generate_series(1, quota)) AS slot FROM q),
kept AS (SELECT genre, count(*) AS quota FROM (SELECT * FROM slots ORDER BY slot, genre LIMIT 50) GROUP BY genre),
d AS (SELECT lang AS genre, CAST(doc_id AS VARCHAR) AS id,
             row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':3'), CAST(doc_id AS VARCHAR)) AS rn FROM documents)
SELECT d.genre, id FROM d JOIN kept ON kept.genre = d.genre WHERE rn <= kept.quota""")
def wn3(spark, sf):
    r = stage.table(spark, sf, "documents").select(stage.text_of("doc_id").alias("id"), F.col("lang").alias("genre"))
    return W.stratified_sample(r, n=50, seed=3)


@query("wn4_top_n_per_group", """
SELECT o_orderpriority AS slug, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank
FROM orders QUALIFY rank <= 3""")
def wn4(spark, sf):
    o = stage.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("slug"), F.col("o_orderkey").alias("id"), "o_totalprice")
    return G.top_n_per_group(o, ["slug"], [F.desc("o_totalprice"), "id"], 3).drop("o_totalprice")


@query("wn5_round_robin_sample", """
WITH e AS (SELECT DISTINCT role AS arm, conv_id AS id FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY id) AS round, min(id) OVER (PARTITION BY arm) AS start FROM e)
SELECT arm, id, round FROM r ORDER BY round, start, arm LIMIT 40""")
def wn5(spark, sf):
    e = stage.table(spark, sf, "conversations").select(F.col("role").alias("arm"), F.col("conv_id").alias("id")).distinct()
    return W.round_robin(e, 40)


@query("wn6_first_occurrence", f"""WITH {Q.REC},
l AS (SELECT genre, lower({Q.strip('line')}) AS key, id, pos FROM (
  SELECT genre, id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM records))
SELECT genre, md5(key) AS key, min(struct_pack(id := id, pos := pos)).id AS id FROM l GROUP BY genre, key""")
def wn6(spark, sf):
    from gleaner.functions.text import strip

    lines = stage.records(spark, sf).select("genre", "id", F.posexplode("ocr_text").alias("pos", "line"))
    first = first_occurrence(lines.withColumn("key", F.lower(strip("line"))), ["genre", "key"], ["id", "pos"])
    return first.select("genre", F.md5("key").alias("key"), "id")


@query("wn7_unique_names", """
WITH s AS (SELECT s_suppkey AS arrival, 'u' || (s_suppkey // 2) AS url, n_name AS base
           FROM supplier JOIN nation ON s_nationkey = n_nationkey),
o AS (SELECT arg_min(base, arrival) AS base, min(arrival) AS arrival, url FROM s GROUP BY url),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY arrival) AS nth FROM o)
SELECT url, base, CASE WHEN base LIKE '%1' THEN base || '-' || (nth + 2) WHEN nth = 1 THEN base
                       ELSE base || '-' || nth END AS name FROM r""")
def wn7(spark, sf):
    n = stage.table(spark, sf, "nation")
    s = stage.table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("arrival"), F.concat(F.lit("u"), F.expr("s_suppkey div 2")).alias("url"),
        F.col("n_name").alias("base"), F.expr("s_suppkey div 1000").alias("block"))
    odd = n.filter("n_name LIKE '%1'").select(F.explode(F.array("n_name", F.concat("n_name", F.lit("-2")))).alias("name"))
    return W.unique_names(s, ["block"], odd).select("url", "base", "name")


@query("wn8_grouped_listing", f"""WITH {Q.REC}
SELECT id, genre AS section, count(*) OVER (PARTITION BY genre) AS section_size FROM records""")
def wn8(spark, sf):
    r = stage.records(spark, sf).select("id", "genre", "likes")
    return W.grouped_listing(r, [F.desc("likes"), F.col("id")]).select("id", "section", "section_size")


@query("wn9_budget_cutoff", """
WITH s AS (SELECT o_orderpriority AS run, o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS cost,
  sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey
    ROWS UNBOUNDED PRECEDING) AS spent FROM orders)
SELECT run, id, CAST(spent AS DOUBLE) AS spent FROM s WHERE spent - cost < 50000000""")
def wn9(spark, sf):
    o = stage.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("day"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("cost"))
    out = W.budget_cutoff(o, ["run"], ["day"], ["id"], "cost", 50_000_000)
    return out.select("run", "id", F.col("spent").cast("double").alias("spent"))


@query("wn10_even_subsample", """
WITH r AS (SELECT event_type AS grp, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events),
k AS (SELECT DISTINCT grp, CAST(floor(k * (n / 24.0::DOUBLE)) AS BIGINT) AS idx
      FROM (SELECT DISTINCT grp, n FROM r), (SELECT unnest(generate_series(0, 23)) AS k))
SELECT r.grp, r.event_id, r.idx FROM r JOIN k ON k.grp = r.grp AND k.idx = r.idx""")
def wn10(spark, sf):
    e = stage.table(spark, sf, "events").select(F.col("event_type").alias("grp"), "event_id", "ts",
                                                F.date_trunc("day", "ts").alias("day"))
    return W.even_subsample(e, ["grp"], ["day"], ["ts", "event_id"], 24).select("grp", "event_id", "idx")


@query("ss4_newest_stage", f"""WITH {LOG}
SELECT stage, done, total FROM log WHERE stage IS NOT NULL ORDER BY log_time DESC, event_id DESC LIMIT 1""")
def ss4(spark, sf):
    """The table has no file order: the event id stands in for the line number."""
    events = A.stage_events(log_lines(spark, sf), keep=["event_id"])
    return A.newest_stage(events, ["log_time", "event_id"]).select("stage", "done", "total")


@query("sk4_write_topic_snapshot", TOPICS)
def sk4(spark, sf):
    """The snapshot is built once; the second load reads it although its builder would fail."""
    from gleaner.session import work_folder
    from gleaner.sources.sinks import load_or_build

    path = work_folder(spark, "topics")
    schema = ("topic string, records bigint, first_id string, hashtags array<string>, "
              "facts array<struct<record_id:string,text:string,timestamp:double>>")
    load_or_build(spark, path, lambda: G.build_topics(word_tagged(spark, sf)), schema)
    return shown_topics(load_or_build(spark, path, lambda: spark.range(0).selectExpr("raise_error('rebuilt')"), schema))

"""Runnable checks of text work: answers, tags, facts, claims, links, dates, ids, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions import answers as N
from gleaner.functions import facts as C
from gleaner.functions import media as D
from gleaner.functions import prompts as P
from gleaner.functions import text as X
from gleaner.plans import reports
from gleaner.plans import sqlparts as Q
from gleaner.plans import stage
from gleaner.plans.registry import query


def replies(spark, sf):
    """conversations as model replies: clean objects, sketch-then-answer, fenced, or nothing."""
    c = stage.table(spark, sf, "conversations")
    obj = F.to_json(F.struct(F.col("role").alias("genre"), F.col("text").alias("summary"), F.array("text").alias("facts")))
    reply = (F.when(F.col("role") == "user", obj)
             .when(F.col("role") == "system", F.lit("nothing { here"))
             .when(F.col("turn") >= 4, F.concat(F.lit("Sure:\n```json\n"), obj, F.lit("\n```\nbye")))
             .otherwise(F.concat(F.lit('draft {"genre": "x"} then '), obj, F.lit(' and {"a": {"b": 1, "c": 2}} ok'))))
    return c.select("conv_id", "turn", "role", "text", reply.alias("reply"))


@query("tx1_ingest_answers", """
SELECT conv_id, turn, role = 'system' AS quarantined, CASE WHEN role <> 'system' THEN role END AS genre,
       CASE WHEN role <> 'system' THEN md5(text) END AS summary FROM conversations""")
def tx1(spark, sf):
    body = N.answer_object("reply")
    a = replies(spark, sf).select("conv_id", "turn", body.alias("body")).withColumn("a", F.from_json("body", N.ANSWER))
    return a.select("conv_id", "turn", F.col("body").isNull().alias("quarantined"), F.col("a.genre").alias("genre"),
                    F.md5("a.summary").alias("summary"))


@query("tx2_coalesce_answer", f"""
SELECT conv_id, turn, CASE WHEN role <> 'system' THEN md5({Q.strip('text')}) END AS text, role = 'assistant' AS salvaged
FROM conversations""")
def tx2(spark, sf):
    c = stage.table(spark, sf, "conversations")
    said = F.when(F.col("role") == "user", F.col("text")).when(F.col("role") == "assistant", F.lit("  "))
    thought = F.when(F.col("role") == "assistant", F.col("text"))
    return c.select("conv_id", "turn", N.reply_text(said, thought).alias("r")).select(
        "conv_id", "turn", F.md5("r.text").alias("text"), "r.salvaged")


STRIPPED = f"""sl AS (
  SELECT id, {Q.strip('line')} AS line, pos, said,
         regexp_replace(regexp_replace(lower(said), '[^a-z0-9 ]', ' ', 'g'), '{Q.WS}+', ' ', 'g') AS sp FROM (
    SELECT id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos, array_to_string(odd_lines, ' ') AS said
    FROM records)),
full_lines AS (SELECT * FROM sl WHERE line <> ''),
keyed AS (SELECT *, {Q.strip(f"regexp_replace(regexp_replace(lower(line), '[^a-z0-9 ]', ' ', 'g'), '{Q.WS}+', ' ', 'g')")}
                 AS key FROM full_lines),
points AS (SELECT id, string_agg(line, '|' ORDER BY pos) AS key_points FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM full_lines) WHERE rn <= 8 GROUP BY id),
over AS (SELECT id, string_agg(line, '|' ORDER BY pos) AS overlay FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM keyed
  WHERE said = '' OR NOT (contains(key, ' ') AND contains(sp, key))) WHERE rn <= 20 GROUP BY id)"""


@query("tx3_normalise_answers", f"""WITH {Q.REC}, {Q.TAGS}, {STRIPPED},
joined AS (SELECT id, string_agg(tag, ',' ORDER BY nth) AS tags FROM tags GROUP BY id)
SELECT r.id, genre, md5(coalesce(summary, '')) AS summary, md5(coalesce(key_points, '')) AS key_points, md5(coalesce(overlay, '')) AS overlay,
       coalesce(joined.tags, '') AS tags, author AS topic,
       'Record ' || r.id || ' speaks about gardens@-|Later the harbour opens for ' || author || '@7.0' AS facts
FROM records r LEFT JOIN points ON points.id = r.id LEFT JOIN over ON over.id = r.id LEFT JOIN joined ON joined.id = r.id""")
def tx3(spark, sf):
    r = stage.records(spark, sf)
    lines = F.col("ocr_text")
    nested = F.to_json(F.create_map(F.lit("educational"), F.create_map(F.lit("topic"), F.col("author"))))
    # a bare claim, a near copy of it, a fragment, and a claim with its place
    bare = F.concat(F.lit("Record "), "id", F.lit(" speaks about gardens"))
    placed = F.to_json(F.struct(F.concat(F.lit("Later the harbour opens for "), "author").alias("text"), F.lit(7).alias("timestamp")))
    stated = F.array(bare, F.concat(bare, F.lit(".")), F.lit("and the"), placed)
    raw = F.to_json(F.struct(
        F.col("genre"), "summary", lines.alias("key_points"), lines.alias("on_screen_text"),
        F.split("caption", r"[ \t\r\n]+").alias("tags"), nested.alias("structured"), stated.alias("facts")))
    a = r.select("id", "transcript_text", F.from_json(raw, N.ANSWER).alias("a"))
    out = N.normalised_answer("a", "transcript_text")
    return a.select(
        "id", out["genre"].alias("genre"), F.md5(out["summary"]).alias("summary"), F.md5(F.array_join(out["key_points"], "|")).alias("key_points"),
        F.array_join(F.transform(out["facts"], lambda f: F.concat(f["text"], F.lit("@"), F.coalesce(
            f["timestamp"].cast("string"), F.lit("-")))), "|").alias("facts"),
        F.md5(F.array_join(out["on_screen_text"], "|")).alias("overlay"), F.array_join(out["tags"], ",").alias("tags"),
        out["structured"]["topic"].alias("topic"))


@query("tx4_normalise_tags", f"""
WITH l AS (SELECT p_partkey AS id, list_filter(list_transform(['  ' || p_name || ' ', p_type, p_brand, upper(p_name), '#!'],
  lambda t: {Q.SLUG.format(x="trim(t)")}), lambda x: x <> '') AS l FROM part)
SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS tags FROM l""")
def tx4(spark, sf):
    raw = F.array(F.concat(F.lit("  "), "p_name", F.lit(" ")), F.col("p_type"), F.col("p_brand"), F.upper("p_name"), F.lit("#!"))
    return stage.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.array_join(X.normalise_tags(raw), ",").alias("tags"))


@query("tx5_unwrap_structured", """
SELECT doc_id, CASE lang WHEN 'en' THEN source WHEN 'fr' THEN source WHEN 'de' THEN lang END AS topic,
       CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 1 ELSE 0 END AS fields FROM documents""")
def tx5(spark, sf):
    d = stage.table(spark, sf, "documents")
    m = F.create_map
    text = (F.when(F.col("lang") == "en", F.to_json(m(F.lit("educational"), m(F.lit("topic"), F.col("source")))))
            .when(F.col("lang") == "fr", F.to_json(m(F.lit("topic"), F.col("source"), F.lit("other"), F.lit("{}"))))
            .when(F.col("lang") == "de", F.to_json(m(F.lit("topic"), F.col("lang")))).otherwise("[1, 2]"))
    s = N.unwrap_structured(text, F.lit("news"))
    return d.select("doc_id", F.try_element_at(s, F.lit("topic")).alias("topic"), F.size(s).cast("bigint").alias("fields"))


HEADS = ", ".join(f"'{h}'" for h in K.FRAGMENT_HEADS)


@query("tx6_drop_fragments", f"""WITH {Q.REC},
l AS (SELECT id, rtrim({Q.strip('line')}, '.') AS t FROM (SELECT id, unnest(lines) AS line FROM records)),
w AS (SELECT id, t, list_filter(string_split_regex(t, '{Q.WS}+'), lambda x: x <> '') AS ws FROM l)
SELECT id, count(*) AS kept, sum(length(t)) AS chars FROM w
WHERE len(ws) >= 4 AND NOT regexp_matches(lower(t), '( and| the| a| to| of| so| but| that| with)$')
  AND NOT (regexp_matches(t, '^\\p{{Ll}}') AND list_contains([{HEADS}], lower(ws[1]))) GROUP BY id""", bigint=["chars"])
def tx6(spark, sf):
    lines = stage.records(spark, sf).select("id", F.explode("ocr_text").alias("line"))
    kept = lines.filter(~C.is_fragment("line"))
    return kept.groupBy("id").agg(F.count("*").alias("kept"), F.sum(F.length(F.rtrim(X.strip("line"), F.lit(".")))).alias("chars"))


@query("tx7_dedupe_facts", """
WITH RECURSIVE l AS (
  SELECT conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
    SELECT conv_id, turn, list_concat(string_split(text, chr(10)), string_split(lower(text), chr(10))) AS ls FROM conversations)),
w AS (SELECT conv_id, turn, i, line, list_distinct(list_filter(regexp_extract_all(lower(line), '[a-z0-9]+'),
             lambda x: length(x) > 2)) AS ws FROM l),
dup AS (SELECT a.conv_id, a.turn, a.i, list(b.i) AS ks FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.i < a.i
  WHERE len(a.ws) > 0 AND len(b.ws) > 0
    AND len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) > 0.7 GROUP BY ALL),
n AS (SELECT conv_id, turn, max(i) AS n FROM w GROUP BY ALL),
s AS (
  SELECT conv_id, turn, 1 AS i, [1]::BIGINT[] AS kept FROM n
  UNION ALL
  SELECT s.conv_id, s.turn, s.i + 1, CASE WHEN d.ks IS NOT NULL AND list_has_any(s.kept, d.ks) THEN s.kept
         ELSE list_append(s.kept, s.i + 1) END
  FROM s JOIN n ON n.conv_id = s.conv_id AND n.turn = s.turn AND s.i < n.n
  LEFT JOIN dup d ON d.conv_id = s.conv_id AND d.turn = s.turn AND d.i = s.i + 1)
SELECT s.conv_id, s.turn, len(kept) AS kept, list_sum(kept) AS positions FROM s JOIN n ON n.conv_id = s.conv_id AND n.turn = s.turn AND s.i = n.n""", bigint=["positions"])
def tx7(spark, sf):
    c = stage.table(spark, sf, "conversations")
    lines = F.concat(F.split("text", "\n"), F.split(F.lower("text"), "\n"))
    facts = F.transform(lines, lambda t, i: F.struct(t.alias("text"), (i + 1).alias("i")))
    kept = c.select("conv_id", "turn", C.dedupe_facts(facts, "array<struct<text:string,i:int>>").alias("k"))
    total = F.aggregate("k", F.lit(0).cast("bigint"), lambda s, f: s + f["i"])
    return kept.select("conv_id", "turn", F.size("k").cast("bigint").alias("kept"), total.alias("positions"))


STOP = ", ".join(f"'{w}'" for w in K.CLAIM_STOP_WORDS)


def sql_claim_words(x: str) -> str:
    prefix = K.CLAIM_FRAME_PREFIX.replace("(?iU)", "(?i)")
    return (f"list_distinct(list_filter(regexp_extract_all(lower(regexp_replace({Q.strip(x)}, '{prefix}', '')), '[a-z0-9]+'), "
            f"lambda w: length(w) > 2 AND NOT list_contains([{STOP}], w)))")


def sql_claim_phrases(x: str) -> str:
    quoted, shouted = K.CLAIM_QUOTED.replace("'", "''"), K.CLAIM_SHOUTED.replace("(?U)", "")
    return (f"list_distinct(list_filter(list_transform(list_concat(regexp_extract_all({x}, '{quoted}', 1), "
            f"regexp_extract_all({x}, '{shouted}', 1)), lambda m: array_to_string(list_filter(regexp_extract_all(lower(m), "
            "'[a-z0-9]+'), lambda w: length(w) > 2), ' ')), lambda k: contains(k, ' ')))")


def sql_claim_score(wa: str, pa: str, wb: str, pb: str) -> str:
    inter = f"CAST(len(list_intersect({wa}, {wb})) AS DOUBLE)"
    short = f"least(len({wa}), len({wb}))"
    jac = f"({inter} / (len({wa}) + len({wb}) - {inter}))"
    return (f"CASE WHEN len({wa}) = 0 AND len({wb}) = 0 THEN 1.0::DOUBLE WHEN len({wa}) = 0 OR len({wb}) = 0 THEN 0.0::DOUBLE "
            f"WHEN list_has_any({pa}, {pb}) THEN 0.8::DOUBLE WHEN {short} >= 2 AND {inter} / {short} >= 0.7 "
            f"THEN greatest({jac}, {inter} / {short}) ELSE {jac} END")


SAID = """said AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN 'In frame 3, the shows that ' || text
  WHEN role = 'system' THEN '"BIG RED label" and NEW SHELF ' || text ELSE text END AS text FROM conversations)"""


def said(spark, sf):
    c = stage.table(spark, sf, "conversations")
    text = (F.when(F.col("role") == "assistant", F.concat(F.lit("In frame 3, the shows that "), "text"))
            .when(F.col("role") == "system", F.concat(F.lit('"BIG RED label" and NEW SHELF '), "text")).otherwise(F.col("text")))
    return c.select("conv_id", "turn", "role", text.alias("text"))


@query("tx8_claim_words", f"""WITH {SAID}
SELECT conv_id, turn, array_to_string(list_sort({sql_claim_words('text')}), ' ') AS words,
       len({sql_claim_phrases('text')}) > 0 AS labelled FROM said""")
def tx8(spark, sf):
    return said(spark, sf).select(
        "conv_id", "turn", F.array_join(F.array_sort(C.claim_words("text")), " ").alias("words"),
        (F.size(C.claim_phrases("text")) > 0).alias("labelled"))


@query("tx9_claim_similarity", f"""WITH {SAID},
k AS (SELECT conv_id, turn, {sql_claim_words('text')} AS w, {sql_claim_phrases('text')} AS p FROM said)
SELECT a.conv_id, a.turn, round({sql_claim_score('a.w', 'a.p', 'b.w', 'b.p')}, 9) AS score
FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def tx9(spark, sf):
    a = said(spark, sf)
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return a.join(b, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(C.claim_similarity("text", "next"), 9).alias("score"))


@query("tx10_caption_entities", f"""WITH {Q.REC}
SELECT id, title0 AS title, array_to_string(regexp_extract_all(caption, '#([\\p{{L}}\\p{{N}}_]+)', 1), ',') AS hashtags,
       array_to_string(regexp_extract_all(caption, '@([\\p{{L}}\\p{{N}}_.]+)', 1), ',') AS mentions FROM records""")
def tx10(spark, sf):
    return stage.records(spark, sf).select("id", "title", F.array_join("hashtags", ",").alias("hashtags"),
                                           F.array_join("mentions", ",").alias("mentions"))


@query("tx11_clean_markup", f"""SELECT page_id, md5({Q.strip(
    f"regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{Q.WS}+', ' ', 'g')")}) AS text FROM pages""")
def tx11(spark, sf):
    return stage.table(spark, sf, "pages").select("page_id", F.md5(X.clean_markup("html")).alias("text"))


@query("tx12_parse_dates", """
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN NULL
  WHEN o_orderstatus = 'O' THEN strftime(o_orderdate + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S')
  ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS at FROM orders""")
def tx12(spark, sf):
    o = stage.table(spark, sf, "orders")
    fmt = lambda f: F.date_format("o_orderdate", f)
    text = (F.when(F.col("o_orderpriority").startswith("5"), F.concat(fmt("dd/MM/yyyy"), F.lit(" noon")))
            .when(F.col("o_orderstatus") == "O", F.concat(fmt("yyyy-MM-dd"), F.lit("T00:00:00-0100")))
            .when(F.col("o_orderstatus") == "F", F.concat(fmt("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
            .otherwise(F.concat(F.lit(" "), fmt("yyyy-MM-dd"), F.lit(" "))))
    return o.select("o_orderkey", F.date_format(X.parse_date(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("tx13_stable_id", "SELECT page_id, 'rs_' || substring(sha1(url), 1, 14) AS id FROM pages")
def tx13(spark, sf):
    return stage.table(spark, sf, "pages").select("page_id", X.stable_id("rss", "url").alias("id"))


@query("tx14_url_keys", r"""
WITH u AS (SELECT page_id, url, url || '/saved/My Shelf ' || page_id || '!/' || page_id || '/' AS saved,
                  'https://www.instagram.com/reel/A-' || page_id || '_x/?k=1' AS link, 'http://instagram.com/some.one' || page_id || '/' AS prof FROM pages)
SELECT page_id, 'A-' || page_id || '_x' AS linked, right(regexp_replace(url, '[^\p{L}\p{N}_]+', '_', 'g'), 20) AS flat,
       'my-shelf-' || page_id AS slug, CAST(page_id AS VARCHAR) AS collection, 'some.one' || page_id AS profile,
       coalesce(nullif(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'collection') AS slugged FROM u""")
def tx14(spark, sf):
    pid = F.col("page_id").cast("string")
    c = X.url_collection(F.concat("url", F.lit("/saved/My Shelf "), pid, F.lit("!/"), pid, F.lit("/")))
    link = F.concat(F.lit("https://www.instagram.com/reel/A-"), pid, F.lit("_x/?k=1"))
    prof = F.concat(F.lit("http://instagram.com/some.one"), pid, F.lit("/"))
    return stage.table(spark, sf, "pages").select(
        "page_id", X.url_record_id(link).alias("linked"), X.url_record_id("url").alias("flat"),
        c["slug"].alias("slug"), c["id"].alias("collection"), X.url_profile(prof).alias("profile"),
        X.slugify("url").alias("slugged"))


DOC = """doc AS (SELECT *, array_to_string(list_filter([title0, genre, coalesce(summary, ''), 'topic: ' || genre,
  'name: ' || author, array_to_string(odd_lines, ' ')], lambda p: p <> ''), chr(10)) AS document FROM records)"""


@query("tx15_record_document", f"WITH {Q.REC}, {DOC} SELECT id, md5(document) AS document FROM doc")
def tx15(spark, sf):
    doc = X.record_document("title", "genre", "summary", "structured", "transcript_text")
    return stage.records(spark, sf).select("id", F.md5(doc).alias("document"))


@query("tx16_document_hash", f"""WITH {Q.REC}, {DOC}
SELECT id, substring(sha1(array_to_string(list_concat([document], lines), chr(0))), 1, 16) AS doc_hash FROM doc""")
def tx16(spark, sf):
    doc = X.record_document("title", "genre", "summary", "structured", "transcript_text")
    return stage.records(spark, sf).select("id", X.document_hash(doc, "ocr_text").alias("doc_hash"))


@query("tx17_price_arm", """
SELECT event_id, CASE event_type WHEN 'view' THEN 5.0 WHEN 'click' THEN 1.0 WHEN 'error' THEN 0.0 ELSE 3.0 END AS price_in,
       CASE event_type WHEN 'view' THEN 25.0 WHEN 'click' THEN 5.0 WHEN 'error' THEN 0.0 ELSE 15.0 END AS price_out FROM events""", double=["price_in", "price_out"])
def tx17(spark, sf):
    model = (F.when(F.col("event_type") == "view", "Big-OPUS-9").when(F.col("event_type") == "click", "haiku-x")
             .when(F.col("event_type") == "error", "qwen-opus").when(F.col("event_type") == "signup", "sonnet").otherwise("other"))
    return stage.table(spark, sf, "events").select("event_id", N.model_price(model).alias("p")).select("event_id", "p.*")


@query("tx18_winning_model", """
SELECT event_id, CASE WHEN value > 20 THEN 'plain-a' ELSE event_type END AS model FROM events""")
def tx18(spark, sf):
    one = lambda n, name: F.struct(n.cast("bigint").alias("outputTokens"), name.alias("canonicalModel"))
    usage = F.create_map(F.col("event_type"), one(F.lit(2000), F.lit("")),
                         F.lit("a[1m]"), one(F.round(F.col("value") * 100), F.lit("plain-a")),
                         F.lit("last"), one(F.lit(2000), F.lit("late tie")))
    return stage.table(spark, sf, "events").select("event_id", N.winning_model(usage).alias("model"))


@query("tx19_build_prompt_batch", f"""WITH {Q.REC},
c AS (SELECT *, {Q.strip('caption')} AS cap, {Q.strip("array_to_string(odd_lines, ' ')")} AS spoken,
             list_filter(lines, lambda x: {Q.strip('x')} <> '') AS ocr FROM records),
h AS (SELECT *, regexp_extract_all(substring(cap, 1201), '#[\\p{{L}}\\p{{N}}_]+') AS ht FROM c),
p AS (SELECT *, CASE WHEN cap = '' THEN '(none)' WHEN length(cap) <= 1200 THEN cap ELSE
  rtrim(substring(cap, 1, 1200), {Q.WS_CHARS}) || '… [trimmed]' || CASE WHEN len(ht) > 0 THEN chr(10) || 'Hashtags: ' ||
    array_to_string(list_filter(ht, lambda x, i: list_position(ht, x) = i), ' ') ELSE '' END END AS capped FROM h)
SELECT id, md5('Frames of one short clip, in order.' || chr(10) || 'Caption: ' || capped || chr(10) ||
  CASE WHEN spoken <> '' THEN chr(10) || 'Spoken words (transcript):' || chr(10) || substring(spoken, 1, 2500) ||
    CASE WHEN length(spoken) > 2500 THEN '… [trimmed]' ELSE '' END || chr(10) ELSE '' END ||
  CASE WHEN len(ocr) > 0 THEN chr(10) || 'Text read off the frames (unordered, may be wrong):' || chr(10) ||
    array_to_string(ocr[1:15], ' | ') || CASE WHEN len(ocr) > 15 THEN ' … [+' || (len(ocr) - 15) || ' more]' ELSE '' END || chr(10)
    ELSE '' END || chr(10) || 'Return JSON.' || chr(10)) AS media,
  md5('Title: ' || CASE WHEN title0 <> '' THEN title0 ELSE '(none)' END || chr(10) || 'Author: ' || author || chr(10) || chr(10) ||
  'TEXT:' || chr(10) || substring(caption, 1, 12000) || chr(10) || chr(10) || 'Return JSON.' || chr(10)) AS body FROM p""")
def tx19(spark, sf):
    r = stage.records(spark, sf)
    media = P.media_request("caption", "transcript_text", "transcript_translated", "ocr_text", "Return JSON.", P.MediaFrame(
        "Frames of one short clip, in order.", "Caption: ", "Spoken words (transcript{}):", ", translated",
        "Text read off the frames (unordered, may be wrong):"))
    text = P.text_request("title", "author", "caption", "transcript_text", "Return JSON.")
    return r.select("id", F.md5(media).alias("media"), F.md5(text).alias("body"))


@query("tx20_build_question_batch", """
WITH h AS (SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS convo FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6 GROUP BY conv_id),
s AS (SELECT conv_id, string_agg('[t' || turn || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY rn) AS src FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rn FROM conversations) WHERE rn <= 3 GROUP BY conv_id),
q AS (SELECT conv_id, arg_max(text, turn) AS question FROM conversations GROUP BY conv_id)
SELECT q.conv_id AS question_id, md5('Answer.' || chr(10) || chr(10) || '=== SOURCES ===' || chr(10) || src || chr(10) || chr(10) ||
  '=== CONVERSATION ===' || chr(10) || convo || chr(10) || 'QUESTION: ' || question || chr(10) || chr(10) ||
  'ANSWER (with [id] citations):') AS request FROM q JOIN h USING (conv_id) JOIN s USING (conv_id)""")
def tx20(spark, sf):
    c = stage.table(spark, sf, "conversations")
    questions = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question")).withColumn("question_id", F.col("conv_id"))
    from gleaner.operators.facets import top_n_per_group

    sources = top_n_per_group(c, ["conv_id"], [F.desc(F.length("text")), "turn"], 3).select(
        F.col("conv_id").alias("question_id"), "rank", F.concat(F.lit("t"), "turn").alias("id"), F.col("role").alias("title"), "text")
    out = reports.question_batch(questions, sources, c.withColumnRenamed("text", "content"), "Answer.")
    return out.withColumn("request", F.md5("request"))


@query("tx21_extract_links", f"""
WITH h AS (SELECT page_id, url, html, regexp_extract_all(html || chr(10) || url, '{K.LINK}') AS l FROM pages),
u AS (SELECT page_id, url AS link FROM h UNION SELECT page_id, CASE WHEN starts_with(x, 'http') THEN x ELSE 'https://' || x END
      FROM (SELECT page_id, unnest(l) AS x FROM h))
SELECT page_id, link FROM u""")
def tx21(spark, sf):
    return stage.table(spark, sf, "pages").select("page_id", F.explode(X.extract_links("url", "html", "url")).alias("link"))


@query("tx22_classify_markers", """
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{8,}')) AS w FROM documents),
m AS (SELECT doc_id, CASE WHEN length(w) > 9 THEN '#' || w ELSE w END AS m FROM w)
SELECT doc_id, CASE WHEN NOT starts_with(m, '#') THEN 'link'
  WHEN regexp_matches(lower(m), 'ad|sponsored|paidpartnership|partner|gifted|collab') THEN 'sponsorship' ELSE 'tag' END AS kind,
  count(*) AS n FROM m GROUP BY ALL""")
def tx22(spark, sf):
    w = stage.table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("w"))
    m = F.when(F.length("w") > 9, F.concat(F.lit("#"), "w")).otherwise(F.col("w"))
    return w.select("doc_id", X.marker_kind(m).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def sql_redact(x: str, term: str, stand_in: str) -> str:
    edge = r"[^\p{L}\p{N}\p{M}_]"
    once = f"regexp_replace({x}, '(^|{edge}){term}($|{edge})', '\\1{stand_in}\\2', 'g')"
    return f"regexp_replace({once}, '(^|{edge}){term}($|{edge})', '\\1{stand_in}\\2', 'g')"


@query("tx23_redact_terms", f"""
SELECT doc_id, md5({sql_redact(sql_redact('text', 'the', 'THE-1'), 'der', 'D_2')}) AS text,
       (regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])the($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])'))::INT +
       (regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])der($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])'))::INT AS hits FROM documents""")
def tx23(spark, sf):
    d = stage.table(spark, sf, "documents").select("doc_id", "text")
    return D.redact_terms(d, "text", {"the": "THE-1", "der": "D_2"}).withColumn("text", F.md5("text"))


@query("tx24_filter_ocr_lines", f"""WITH {Q.REC},
l AS (SELECT id, {Q.strip('line')} AS text, pos, (pos % 10) / 10.0 AS confidence FROM (
  SELECT id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM records))
SELECT id AS record_id, md5(arg_min(text, pos)) AS text, min(pos) AS pos FROM l
WHERE confidence >= 0.45 AND length(text) >= 3 AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]') GROUP BY id, lower(text)""")
def tx24(spark, sf):
    det = stage.records(spark, sf).select(F.col("id").alias("record_id"), F.posexplode("ocr_text").alias("pos", "text"))
    det = det.withColumn("frame", F.lit(0)).withColumn("confidence", F.col("pos") % 10 / 10.0)
    return D.filter_ocr_lines(det).select("record_id", F.md5("text").alias("text"), F.col("pos").cast("bigint").alias("pos"))


@query("tx25_filter_segments", f"""WITH {Q.REC},
l AS (SELECT id, genre, {Q.strip('line')} AS text, pos FROM (
  SELECT id, genre, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM records)),
k AS (SELECT id, count(*) AS n, string_agg(text, ' ' ORDER BY pos) AS t FROM l
      WHERE text <> '' AND NOT ((pos % 4) / 4.0 > 0.6 AND -(pos % 3) < -0.8) GROUP BY id)
SELECT r.id, coalesce(n, 0) AS n, md5(coalesce(t, '')) AS text, genre <> 'en' AS translated FROM records r LEFT JOIN k ON k.id = r.id""")
def tx25(spark, sf):
    seg = F.transform("ocr_text", lambda t, i: F.struct(
        i.cast("double").alias("start"), (i + 1).cast("double").alias("end"), t.alias("text"),
        (i % 4 / 4.0).cast("double").alias("no_speech_prob"), (-(i % 3)).cast("double").alias("avg_logprob")))
    r = stage.records(spark, sf).withColumn("transcript_language", F.col("genre")).withColumn("segments", seg)
    out = D.filter_segments(r.select("id", "transcript_language", "segments"), translate=True)
    return out.select("id", F.size("transcript").cast("bigint").alias("n"), F.md5("transcript_text").alias("text"),
                      F.col("transcript_translated").alias("translated"))

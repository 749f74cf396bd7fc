"""Runnable checks of claim matching, scoreboards and the composite reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import markers as M
from gleaner.operators import matching as V
from gleaner.operators.ranking import stratified_sample
from gleaner.plans import reports
from gleaner.plans import sqlparts as Q
from gleaner.plans import stage
from gleaner.plans.queries_text import sql_claim_phrases, sql_claim_score, sql_claim_words
from gleaner.plans.registry import query

REFERENCE = "user"


def claims(spark, sf):
    """conversations as facts of arms; every second-arm turn also repeats what was said before it.

    The driver's texts are random, so an arm's own words rarely match the other's: the answer to a turn
    is given that turn's first line too, which makes real partial matches.
    """
    c = stage.facts(spark, sf)
    before = c.select("record_id", (F.col("pos") + 1).alias("pos"), F.split("text", "\n")[0].alias("_prev"))
    told = c.join(before, ["record_id", "pos"], "left")
    text = F.when((F.col("arm") != REFERENCE) & F.col("_prev").isNotNull(), F.col("_prev")).otherwise(F.col("text"))
    return told.select("record_id", "arm", "pos", text.alias("text"))


CLAIMS = """claims AS (
  SELECT a.conv_id AS record_id, a.role AS arm, a.turn AS pos,
         CASE WHEN a.role <> 'user' AND b.text IS NOT NULL THEN string_split(b.text, chr(10))[1] ELSE a.text END AS text
  FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"""

MATCH = f"""{CLAIMS},
keyed AS (SELECT *, {sql_claim_words('text')} AS w, {sql_claim_phrases('text')} AS p FROM claims),
l AS (SELECT * FROM keyed WHERE arm = 'user'), r AS (SELECT * FROM keyed WHERE arm <> 'user'),
cand AS (SELECT l.record_id, r.arm, l.pos AS l, r.pos AS r, {sql_claim_score('l.w', 'l.p', 'r.w', 'r.p')} AS score
         FROM l JOIN r ON l.record_id = r.record_id),
ord AS (SELECT *, row_number() OVER (PARTITION BY record_id, arm ORDER BY l, score DESC, r) AS i FROM cand WHERE score >= 0.5),
steps AS (
  SELECT record_id, arm, 0 AS i, []::BIGINT[] AS ls, []::BIGINT[] AS rs, []::DOUBLE[] AS ss FROM ord GROUP BY ALL
  UNION ALL
  SELECT s.record_id, s.arm, s.i + 1,
         CASE WHEN list_contains(s.ls, o.l) OR list_contains(s.rs, o.r) THEN s.ls ELSE list_append(s.ls, o.l) END,
         CASE WHEN list_contains(s.ls, o.l) OR list_contains(s.rs, o.r) THEN s.rs ELSE list_append(s.rs, o.r) END,
         CASE WHEN list_contains(s.ls, o.l) OR list_contains(s.rs, o.r) THEN s.ss ELSE list_append(s.ss, o.score) END
  FROM steps s JOIN ord o ON o.record_id = s.record_id AND o.arm = s.arm AND o.i = s.i + 1),
done AS (SELECT record_id, arm, arg_max(ls, i) AS ls, arg_max(rs, i) AS rs, arg_max(ss, i) AS ss FROM steps GROUP BY ALL),
pairs AS (SELECT record_id, arm, unnest(ls) AS l, unnest(rs) AS r, unnest(ss) AS score FROM done),
arms AS (SELECT DISTINCT r.record_id, r.arm FROM r JOIN l ON l.record_id = r.record_id),
matched AS (
  SELECT a.record_id, a.arm, 'ref' AS side, l.pos, l.text, p.r AS other_pos, p.score
  FROM arms a JOIN l ON l.record_id = a.record_id
  LEFT JOIN pairs p ON p.record_id = a.record_id AND p.arm = a.arm AND p.l = l.pos
  UNION ALL
  SELECT a.record_id, a.arm, 'cand', r.pos, r.text, p.l, p.score
  FROM arms a JOIN r ON r.record_id = a.record_id AND r.arm = a.arm
  LEFT JOIN pairs p ON p.record_id = a.record_id AND p.arm = a.arm AND p.r = r.pos)"""


@query("jn11_match_facts", f"""WITH RECURSIVE {MATCH}
SELECT record_id, arm, side, pos, other_pos, round(score, 9) AS score FROM matched""", filled=["other_pos", "score"])
def jn11(spark, sf):
    out = V.match_facts(claims(spark, sf), REFERENCE)
    return out.select("record_id", "arm", "side", "pos", "other_pos", F.round("score", 9).alias("score"))


@query("jn11_match_by_rounds", f"""WITH RECURSIVE {MATCH}
SELECT record_id, arm, side, pos, other_pos, round(score, 9) AS score FROM matched""", filled=["other_pos", "score"])
def jn11_rounds(spark, sf):
    """The same matches with every record treated as too long for one row."""
    out = V.match_by_rounds(claims(spark, sf), REFERENCE)
    return out.select("record_id", "arm", "side", "pos", "other_pos", F.round("score", 9).alias("score"))


@query("jn12_variant_pairs", """
WITH v AS (SELECT DISTINCT conv_id AS record_id, role AS arm FROM conversations)
SELECT a.record_id, a.arm AS ref, b.arm AS cand FROM v a JOIN v b ON a.record_id = b.record_id
WHERE a.arm = 'user' AND b.arm <> 'user'""")
def jn12(spark, sf):
    v = stage.facts(spark, sf).select("record_id", "arm").distinct()
    return V.variant_pairs(v, REFERENCE).select("record_id", F.col("ref.arm").alias("ref"), F.col("cand.arm").alias("cand"))


def measures(spark, sf):
    """Variant measures of conversations; seconds and cost are binary fractions, so sums are exact."""
    f = stage.facts(spark, sf)
    size = F.sum(F.length("text"))
    return f.groupBy("record_id", "arm").agg(
        F.lit("m").alias("model"), F.count_if(F.length("text") > 300).alias("facts"), F.count("*").alias("tags"),
        F.length(F.min_by("text", "pos")).alias("summary_chars"), (size / F.lit(8.0)).alias("seconds"),
        (size / F.lit(1024.0)).alias("cost_usd"), F.max("pos").alias("structured_fields"),
        (F.max("pos") > 5).alias("salvaged"))


MEASURES = """measures AS (
  SELECT conv_id AS record_id, role AS arm, count(*) FILTER (length(text) > 300) AS facts, count(*) AS tags,
         length(arg_min(text, turn)) AS summary_chars, sum(length(text)) / 8.0::DOUBLE AS seconds,
         sum(length(text)) / 1024.0::DOUBLE AS cost_usd, max(turn) AS structured_fields, max(turn) > 5 AS salvaged
  FROM conversations GROUP BY conv_id, role)"""


def board(where: str = "") -> str:
    return f"""SELECT arm, count(*) AS records, sum(facts) AS facts, sum(tags) AS tags, sum(summary_chars) AS summary_chars,
  sum(seconds) AS seconds, sum(structured_fields) AS structured_fields, sum(cost_usd) AS cost_usd,
  count(*) FILTER (facts = 0) AS empty, count(*) FILTER (salvaged) AS salvaged,
  sum(facts)::DOUBLE / count(*) AS avg_facts, sum(tags)::DOUBLE / count(*) AS avg_tags,
  sum(summary_chars)::DOUBLE / count(*) AS avg_summary_chars, sum(seconds) / count(*) AS avg_seconds,
  sum(structured_fields)::DOUBLE / count(*) AS avg_structured_fields, sum(cost_usd) / count(*) AS cost_per_record,
  (count(*) FILTER (facts = 0))::DOUBLE / count(*) AS empty_rate FROM measures {where} GROUP BY arm"""


@query("ag8_arm_scoreboard", f"WITH {MEASURES} {board()}", bigint=["facts", "tags", "summary_chars", "structured_fields"])
def ag8(spark, sf):
    return V.scoreboard(measures(spark, sf))


@query("ag8_scoreboard_of_sample", f"""WITH {MEASURES}
{board("WHERE record_id IN (SELECT doc_id FROM labels WHERE quality = 1)")}""", bigint=["facts", "tags", "summary_chars", "structured_fields"])
def ag8_sample(spark, sf):
    sample = stage.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return V.scoreboard(measures(spark, sf), sample)


@query("ag9_arm_agreement", f"""WITH RECURSIVE {MATCH},
c AS (SELECT arm, count(DISTINCT record_id) AS records, count(*) FILTER (side = 'ref' AND other_pos IS NOT NULL) AS shared,
             count(*) FILTER (side = 'ref' AND other_pos IS NULL) AS only_ref,
             count(*) FILTER (side = 'cand' AND other_pos IS NULL) AS only_cand FROM matched GROUP BY arm)
SELECT *, shared::DOUBLE / nullif(shared + only_ref + only_cand, 0) AS agreement,
       only_ref::DOUBLE / records AS missed_per_record, only_cand::DOUBLE / records AS added_per_record FROM c""")
def ag9(spark, sf):
    f = claims(spark, sf)
    return V.arm_agreement(f.select("record_id", "arm"), V.match_facts(f, REFERENCE), REFERENCE)


@query("ag10_avg_disagreement", f"""WITH RECURSIVE {MATCH},
two AS (SELECT record_id FROM claims GROUP BY record_id HAVING count(DISTINCT arm) = 2),
c AS (SELECT record_id, count(*) FILTER (side = 'ref' AND other_pos IS NOT NULL) AS shared,
             count(*) FILTER (other_pos IS NULL) AS alone FROM matched WHERE record_id IN (SELECT record_id FROM two) GROUP BY 1)
SELECT round(avg(alone::DOUBLE / (alone + shared)), 9) AS avg_disagreement FROM c""")
def ag10(spark, sf):
    f = claims(spark, sf)
    two = f.groupBy("record_id").agg(F.count_distinct("arm").alias("n")).filter("n = 2")
    matched = V.match_facts(f.join(two.select("record_id"), "record_id", "left_semi"), REFERENCE)
    counts = V.agreement_counts(matched, ["record_id"]).withColumnsRenamed({"only_ref": "only_a", "only_cand": "only_b"})
    return V.avg_disagreement(counts).withColumn("avg_disagreement", F.round("avg_disagreement", 9))


@query("ag19_marker_recall", f"""WITH {Q.FACTS},
marks AS (SELECT DISTINCT record_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]{{9,}}')) AS m FROM facts WHERE arm = 'user'),
kinds AS (SELECT record_id, CASE WHEN length(m) > 11 THEN '#' || m ELSE m END AS m FROM marks),
k AS (SELECT record_id, m, CASE WHEN NOT starts_with(m, '#') THEN 'link'
   WHEN regexp_matches(lower(m), 'ad|sponsored|paidpartnership|partner|gifted|collab') THEN 'sponsorship' ELSE 'tag' END AS kind FROM kinds),
said AS (SELECT record_id, arm, regexp_replace(lower(string_agg(text, ' ')), '[^a-z0-9]', '', 'g') AS key
         FROM facts WHERE arm IN ('user', 'assistant') GROUP BY ALL),
whole AS (SELECT record_id FROM said GROUP BY record_id HAVING count(*) = 2),
h AS (SELECT arm, kind, contains(key, regexp_replace(lower(m), '[^a-z0-9]', '', 'g')) AS found
      FROM k JOIN said USING (record_id) WHERE record_id IN (SELECT record_id FROM whole)),
x AS (SELECT arm, kind, count(*) AS markers, count(*) FILTER (found) AS found, (count(*) FILTER (found))::DOUBLE / count(*) AS recall
      FROM h GROUP BY GROUPING SETS ((arm), (arm, kind)))
SELECT a.arm, k.kind, coalesce(markers, 0) AS markers, coalesce(found, 0) AS found, recall
FROM (VALUES ('user'), ('assistant')) a(arm) CROSS JOIN (VALUES ('link'), ('sponsorship'), ('tag'), (NULL)) k(kind)
LEFT JOIN x ON x.arm = a.arm AND x.kind IS NOT DISTINCT FROM k.kind""", filled=["recall"])
def ag19(spark, sf):
    f = stage.facts(spark, sf)
    words = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{9,}"), F.lit(0))
    marker = F.when(F.length("m") > 11, F.concat(F.lit("#"), "m")).otherwise(F.col("m"))
    marks = (f.filter("arm = 'user'").select("record_id", F.explode(words).alias("m")).distinct()
             .select("record_id", F.array(marker).alias("markers")))
    arms = ["user", "assistant"]
    # a variant's text is all its turns; a long one is several rows, so a marker counts once per arm
    turns = f.filter(F.col("arm").isin(arms)).select("record_id", "arm", "pos", M.alnum_key("text").alias("key"))
    hits = M.marker_hits(marks, M.arm_texts(turns, marks)).groupBy("record_id", "arm", "marker", "kind").agg(F.bool_or("found").alias("found"))
    runs = f.select("record_id", "arm", F.lit(True).alias("ok"))
    return M.marker_recall(hits, runs, arms)


@query("ag19_variant_means", f"""WITH {MEASURES},
whole AS (SELECT conv_id FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id HAVING count(DISTINCT role) = 2)
SELECT arm, count(*) AS records, avg(facts) AS mean_facts, avg(tags) AS mean_on_screen, avg(summary_chars) AS mean_summary_chars,
       avg(seconds) AS mean_seconds FROM measures WHERE arm IN ('user', 'assistant') AND record_id IN (SELECT conv_id FROM whole) GROUP BY arm""")
def ag19_means(spark, sf):
    m = measures(spark, sf).withColumnRenamed("tags", "on_screen")
    return M.variant_means(m, m.select("record_id", "arm", F.lit(True).alias("ok")), ["user", "assistant"])


def summaries(spark, sf):
    return claims(spark, sf).groupBy("record_id", "arm").agg(F.min_by("text", "pos").alias("summary"))


@query("rp2_disagreement_examples", f"""WITH RECURSIVE {MATCH},
s AS (SELECT record_id, arm, substring(arg_min(text, pos), 1, 400) AS s FROM claims GROUP BY ALL),
alone AS (SELECT *, row_number() OVER (PARTITION BY record_id, arm, side ORDER BY pos) AS rn FROM matched WHERE other_pos IS NULL),
e AS (SELECT record_id AS id, arm, string_agg(CASE WHEN side = 'ref' THEN text END, '|' ORDER BY pos) AS only_ref,
             string_agg(CASE WHEN side = 'cand' THEN text END, '|' ORDER BY pos) AS only_cand FROM alone WHERE rn <= 6 GROUP BY ALL),
turn AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY id) AS round, min(id) OVER (PARTITION BY arm) AS start FROM e)
SELECT t.id, t.arm, round, md5(coalesce(only_ref, '')) AS only_ref, md5(coalesce(only_cand, '')) AS only_cand,
       md5(a.s) AS reference_summary, md5(b.s) AS candidate_summary
FROM turn t JOIN s a ON a.record_id = t.id AND a.arm = 'user' JOIN s b ON b.record_id = t.id AND b.arm = t.arm
ORDER BY round, start, t.arm LIMIT 40""")
def rp2(spark, sf):
    f = claims(spark, sf)
    out = V.disagreement_examples(V.match_facts(f, REFERENCE), summaries(spark, sf), REFERENCE, 40)
    md5 = lambda c: F.md5(F.array_join(c, "|"))
    return out.select("id", "arm", "round", md5("only_reference").alias("only_ref"), md5("only_candidate").alias("only_cand"),
                      F.md5("reference_summary").alias("reference_summary"), F.md5("candidate_summary").alias("candidate_summary"))


@query("rp3_variants_diff", f"""WITH {Q.REC},
v AS (SELECT id, lines[1] AS x, genre FROM records),
k AS (SELECT *, {sql_claim_words("coalesce(x, '')")} AS w FROM v)
SELECT id, CASE WHEN genre = 'en' THEN 'claude-cli' ELSE 'arm-a' END AS a, CASE WHEN genre = 'en' THEN 'arm-b' ELSE 'local' END AS b,
       CASE WHEN x IS NULL THEN 0 ELSE 1 END AS shared, CASE WHEN x IS NULL OR genre <> 'en' THEN 0 ELSE 1 END AS only_a,
       CASE WHEN x IS NULL THEN 0 ELSE 0 END AS only_b FROM k""")
def rp3(spark, sf):
    """Both arms state the first line; the reference arm adds a claim of its own."""
    r = stage.records(spark, sf)
    line = F.when(F.size("ocr_text") > 0, F.col("ocr_text")[0])

    def facts(*texts):
        return F.struct(F.transform(F.filter(F.array(*texts), lambda t: t.isNotNull()),
                                    lambda t: F.struct(t.alias("text"))).alias("facts"))

    own = F.when(line.isNotNull(), F.lit("zebra quartz meridian unmatched"))
    variants = F.when(F.col("genre") == "en", F.create_map(
        F.lit("claude-cli"), facts(line, own), F.lit("arm-b"), facts(line))).otherwise(
        F.create_map(F.lit("local"), facts(line), F.lit("arm-a"), facts(line)))
    out = V.variants_diff(r.select("id", variants.alias("variants")))
    count = lambda c: F.size(f"diff.{c}").cast("bigint").alias(c)
    return out.select("id", "a", "b", count("shared"), count("only_a"), count("only_b"))


# numbers of the report with two places and thousands marks, and a table row
def two(x: str) -> str:
    return f"format('{{:,.2f}}', CAST(coalesce({x}, 0) AS DOUBLE))"


def cells(*x: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(x) + " || ' |'"


RP1 = f"""WITH RECURSIVE {MATCH}, {MEASURES},
g AS (SELECT conv_id AS id, CAST(max(turn) AS VARCHAR) AS genre FROM conversations GROUP BY conv_id),
z AS (SELECT genre, count(*) AS size FROM g GROUP BY genre),
quota AS (SELECT genre, least(greatest(1, CAST(round_even(30.0 * size / (SELECT sum(size) FROM z), 0) AS INT)), size) AS quota FROM z),
slots AS (SELECT genre, unnest(generate_series(1, quota)) AS slot FROM quota),
kept AS (SELECT genre, count(*) AS quota FROM (SELECT * FROM slots ORDER BY slot, genre LIMIT 30) GROUP BY genre),
drawn AS (SELECT id, genre, row_number() OVER (PARTITION BY genre ORDER BY md5(id || ':1'), id) AS rn FROM g),
sample AS (SELECT id FROM drawn JOIN kept USING (genre) WHERE rn <= kept.quota),
board AS ({board("WHERE record_id IN (SELECT id FROM sample)")}),
mm AS (SELECT * FROM matched WHERE record_id IN (SELECT id FROM sample)),
stored AS (SELECT DISTINCT record_id, arm FROM measures WHERE record_id IN (SELECT id FROM sample)),
per AS (SELECT arm, count(*) AS records FROM stored WHERE arm <> 'user' AND record_id IN (SELECT record_id FROM stored WHERE arm = 'user') GROUP BY arm),
c AS (SELECT arm, count(*) FILTER (side = 'ref' AND other_pos IS NOT NULL) AS shared, count(*) FILTER (side = 'ref' AND other_pos IS NULL) AS only_ref,
             count(*) FILTER (side = 'cand' AND other_pos IS NULL) AS only_cand FROM mm GROUP BY arm),
agree AS (SELECT per.arm, records, coalesce(shared, 0)::DOUBLE / nullif(coalesce(shared, 0) + coalesce(only_ref, 0) + coalesce(only_cand, 0), 0) AS agreement,
                 coalesce(only_ref, 0)::DOUBLE / records AS missed, coalesce(only_cand, 0)::DOUBLE / records AS added FROM per LEFT JOIN c USING (arm)),
last AS (SELECT role AS arm, conv_id, arg_max(length(text), turn) AS chars FROM conversations GROUP BY ALL),
runs AS (SELECT arm, count(*) FILTER (chars > 100) AS ok, count(*) FILTER (chars <= 100) AS failed, sum(chars / 8.0) / count(*) AS seconds FROM last GROUP BY arm),
noted AS (SELECT runs.*, CASE WHEN board.arm IS NULL AND ok = 0 THEN 'abandoned' WHEN ok + failed < (SELECT count(*) FROM sample)
                 THEN 'stopped at ' || (ok + failed) || '/' || (SELECT count(*) FROM sample) ELSE '' END AS note FROM runs LEFT JOIN board USING (arm)),
alone AS (SELECT *, row_number() OVER (PARTITION BY record_id, arm, side ORDER BY pos) AS rn FROM mm WHERE other_pos IS NULL),
e AS (SELECT record_id AS id, arm, coalesce(string_agg(CASE WHEN side = 'ref' THEN text END, '; ' ORDER BY pos), '') AS only_ref,
             coalesce(string_agg(CASE WHEN side = 'cand' THEN text END, '; ' ORDER BY pos), '') AS only_cand FROM alone WHERE rn <= 6 GROUP BY ALL),
turns AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY id) AS round, min(id) OVER (PARTITION BY arm) AS start FROM e),
shown AS (SELECT * FROM turns ORDER BY round, start, arm LIMIT 40)
SELECT '1 metrics' AS section, lpad(CAST(1000000000 - CAST(floor(avg_facts * 100) AS BIGINT) AS VARCHAR), 12, '0') || arm AS position,
       {cells("arm", "records", two("avg_facts"), two("avg_tags"), two("avg_summary_chars"), two("avg_structured_fields"), "empty", "salvaged",
              two("avg_seconds"), two("cost_per_record").replace(".2f", ".4f"))} AS text FROM board
UNION ALL SELECT '2 agreement with user', lpad(CAST(1000000 - CAST(floor(coalesce(agreement, 0) * 1000000) AS BIGINT) AS VARCHAR), 8, '0') || arm,
       {cells("arm", "records", "CASE WHEN agreement IS NULL THEN 'no overlap' ELSE CAST(CAST(round_even(agreement * 100, 0) AS INT) AS VARCHAR) || '%' END",
              two("missed"), two("added"))} FROM agree
UNION ALL SELECT '3 attempts', arm, {cells("arm", "ok", "failed", two("seconds"), "note")} FROM noted
UNION ALL SELECT '4 examples', lpad(CAST(round AS VARCHAR), 6, '0') || arm, '- ' || arm || ': missed ' || only_ref || ' / added ' || only_cand FROM shown"""


@query("rp1_bench_report", RP1)
def rp1(spark, sf):
    """Sample, scoreboard, agreement, attempts and examples over one corpus of conversations."""
    f = claims(spark, sf)
    c = stage.table(spark, sf, "conversations")
    genre = c.groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").cast("string").alias("genre"))
    sample = stratified_sample(genre, n=30, seed=1).select("id")
    attempts = c.select(F.col("role").alias("arm"), F.col("conv_id").alias("record_id"), F.col("turn").alias("at"),
                        F.col("turn").alias("seq"), (F.length("text") > 100).alias("ok"), (F.length("text") / 8.0).alias("seconds"))
    tables = reports.bench_tables(measures(spark, sf), f, summaries(spark, sf), attempts, sample, REFERENCE)
    return reports.bench_report(tables, REFERENCE)



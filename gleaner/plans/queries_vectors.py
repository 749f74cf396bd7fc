"""Runnable checks of embeddings, exact search, centroids and candidate scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import cells as C
from gleaner.operators import vectors as E
from gleaner.operators.joins import hits_with_collections
from gleaner.operators.ranking import best_hit_per_record
from gleaner.plans import reports
from gleaner.plans import sqlparts as Q
from gleaner.plans import stage
from gleaner.plans.queries_text import DOC
from gleaner.plans.registry import query
from gleaner.session import work_folder
from gleaner.sources import folders

# scores in the SQL are rounded like the engine's before they are ranked
VEC = """e AS (SELECT vec_id AS id, 'c' || label AS slug, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT id, slug, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e)"""
COS = "round(list_inner_product(a.v, b.v) / (a.n * b.n), 9)"
ASKED = "q AS (SELECT * FROM u WHERE id % 50 = 0)"


def asked_vectors(spark, sf):
    """Every fiftieth vector, as queries."""
    return stage.vectors(spark, sf).filter("id % 50 = 0")


@query("vx3_knn_search", f"""WITH {VEC}, {ASKED}
SELECT a.id AS query_id, b.id AS row_id, row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) AS rank,
       round({COS}, 6) AS score FROM q a, u b QUALIFY rank <= 8""")
def vx3(spark, sf):
    hits = E.nearest(asked_vectors(spark, sf), stage.vectors(spark, sf), 8)
    return hits.select("query_id", "row_id", "rank", F.round("score", 6).alias("score"))


@query("vx3_knn_in_blocks", f"""WITH {VEC}, {ASKED}
SELECT a.id AS query_id, b.id AS row_id, row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) AS rank
FROM q a, u b QUALIFY rank <= 8""")
def vx3_blocks(spark, sf):
    """The same search with no side broadcast whole: the index comes in blocks."""
    return E.nearest(asked_vectors(spark, sf), stage.vectors(spark, sf), 8, most=0).select("query_id", "row_id", "rank")


@query("vx4_similar_records", f"""WITH {VEC},
h AS (SELECT a.id AS query_id, b.id AS row_id, row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) AS r FROM u a, u b QUALIFY r <= 9)
SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM h WHERE row_id <> query_id QUALIFY rank <= 6""")
def vx4(spark, sf):
    index = stage.vectors(spark, sf).withColumn("record_id", F.col("id"))
    return E.similar_records(stage.vectors(spark, sf), index, 6).select("query_id", "row_id", "rank")


@query("vx4_similar_to_all", f"""WITH {VEC},
h AS (SELECT a.id AS query_id, b.id AS row_id, row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) AS r FROM u a, u b QUALIFY r <= 9)
SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM h WHERE row_id <> query_id QUALIFY rank <= 6""")
def vx4_all(spark, sf):
    """The same for every record over a stored cell index that need not be read whole."""
    v = stage.vectors(spark, sf).select("id", "vec")
    index = C.write_cells(v, work_folder(spark, "cells"))
    return C.similar_to_all(v, index, v.select("id", F.col("id").alias("record_id"))).select("query_id", "row_id", "rank")


MEAN = """m AS (SELECT slug, dim, avg(x) AS x, count(*) AS records FROM (
  SELECT slug, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM u) GROUP BY slug, dim),
nn AS (SELECT slug, sqrt(sum(x * x)) AS n FROM m GROUP BY slug),
cent AS (SELECT m.slug, m.dim, m.x / nn.n AS x, m.records FROM m JOIN nn ON nn.slug = m.slug WHERE m.records >= 3)"""


@query("vx5_collection_centroids", f"WITH {VEC}, {MEAN} SELECT slug, dim, records, round(x, 6) + 0.0 AS x FROM cent")
def vx5(spark, sf):
    c = E.collection_centroids(stage.vectors(spark, sf))
    return c.select("slug", "records", F.posexplode("vec").alias("dim", "x")).select(
        "slug", "dim", "records", (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query("vx6_score_candidates", f"""WITH {VEC}, {MEAN},
cv AS (SELECT slug AS cslug, list(x ORDER BY dim) AS v, 1.0::DOUBLE AS n FROM cent GROUP BY slug),
s AS (SELECT a.id, b.cslug, {COS} AS score FROM u a, cv b),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, cslug) = 1)
SELECT id, cslug AS collection, round(score, 3) AS score, 'closest to ' || cslug || ' · via feed' AS why FROM best
WHERE round(score, 3) >= 0.1""")
def vx6(spark, sf):
    v = stage.vectors(spark, sf)
    cands = v.select("id", "vec", F.lit("feed").alias("source"))
    scored = E.score_candidates(cands, E.collection_centroids(v))
    return E.keep_scored(scored, 0.1).select("id", "collection", "score", "why")


@query("wn2_best_hit_per_record", f"""WITH {VEC}, {ASKED},
h AS (SELECT a.id AS question_id, b.slug AS record_id, row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) AS rank FROM q a, u b QUALIFY rank <= 20)
SELECT question_id, record_id, min(rank) AS rank FROM h GROUP BY ALL""")
def wn2(spark, sf):
    v = stage.vectors(spark, sf)
    hits = E.nearest(asked_vectors(spark, sf), v, 20)
    named = hits.join(v.select(F.col("id").alias("row_id"), F.col("slug").alias("record_id")), "row_id") \
        .withColumnRenamed("query_id", "question_id")
    return best_hit_per_record(named).select("question_id", "record_id", "rank")


@query("jn3_hits_with_collections", f"""WITH {VEC}, {ASKED},
h AS (SELECT a.id AS query_id, b.id AS record_id, b.slug, row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) AS rank FROM q a, u b QUALIFY rank <= 5)
SELECT query_id, record_id, rank, CASE WHEN slug = 'c0' THEN '' ELSE 'all,' || slug END AS collections FROM h""")
def jn3(spark, sf):
    v = stage.vectors(spark, sf)
    members = v.filter("slug <> 'c0'").select(F.col("id").alias("record_id"), F.explode(F.array("slug", F.lit("all"))).alias("slug"))
    hits = E.nearest(asked_vectors(spark, sf), v, 5).withColumnRenamed("row_id", "record_id")
    return hits_with_collections(hits, members).select(
        "query_id", "record_id", "rank", F.array_join("collections", ",").alias("collections"))


@query("vx1_embed_texts", r"""
SELECT doc_id, 64 AS dim, CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 1.0 ELSE 0.0 END AS norm FROM documents""", double=["norm"])
def vx1(spark, sf):
    """Every text with a word has a unit vector of the asked size; others have the zero vector."""
    out = E.hashing_embedder(64)(stage.table(spark, sf, "documents"), "text", "vec")
    norm = F.sqrt(E.dot("vec", "vec"))
    return out.select("doc_id", F.size("vec").alias("dim"), F.round(norm, 4).alias("norm"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query("vx1_model_embedder", f"""
WITH n AS (SELECT doc_id, [CAST(length(text) - length(replace(replace(text, c, ''), upper(c), '')) AS DOUBLE) FOR c IN string_split('{LETTERS}', '')] AS v FROM documents),
u AS (SELECT doc_id, v, sqrt(list_sum([x * x FOR x IN v])) AS norm FROM n)
SELECT doc_id, generate_subscripts(v, 1) - 1 AS dim, round(CAST(CAST(unnest(v) / CASE WHEN norm = 0 THEN 1 ELSE norm END AS FLOAT) AS DOUBLE), 5) + 0.0 AS x FROM u""")
def vx1_model(spark, sf):
    """Every number of the vectors that a small model, loaded once per worker, gives the texts."""
    out = E.model_embedder(E.letter_model(LETTERS), len(LETTERS))(stage.table(spark, sf, "documents").select("doc_id", "text"), "text", "vec")
    return out.select("doc_id", F.posexplode("vec").alias("dim", "x")).select(
        "doc_id", F.col("dim").cast("bigint").alias("dim"), (F.round(F.col("x").cast("double"), 5) + F.lit(0.0)).alias("x"))


@query("vx2_build_index", f"""WITH {Q.REC}, {DOC},
h AS (SELECT id, title0 AS title, lines, summary, substring(sha1(array_to_string(list_concat([document], lines), chr(0))), 1, 16) AS doc_hash FROM doc),
rows AS (
  SELECT id AS record_id, 0 AS row_pos, 'record' AS kind, CASE WHEN coalesce(summary, '') <> '' THEN summary ELSE title END AS text, doc_hash FROM h
  UNION ALL SELECT id, generate_subscripts(lines, 1), 'fact', unnest(lines), doc_hash FROM h)
SELECT record_id, row_pos, kind, md5(text) AS text, doc_hash, l.doc_id IS NOT NULL AS reused
FROM rows LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = record_id""")
def vx2(spark, sf):
    """An incremental build over an index that holds the labelled records already."""
    r = stage.records(spark, sf)
    embed = E.hashing_embedder(64)
    had = stage.table(spark, sf, "labels").select(stage.text_of("doc_id").alias("id"))
    stored = E.build_index(r.join(had, "id", "left_semi"), embed)
    out = E.build_index(r, embed, stored)
    return out.select("record_id", F.col("row_pos").cast("bigint").alias("row_pos"), "kind", F.md5("text").alias("text"),
                      "doc_hash", "reused")


MOST_HELD = 2_000_000    # numbers of records sent to all tasks


@query("vx2_update_index", f"""WITH {Q.REC}, {DOC},
h AS (SELECT id, title0 AS title, lines, summary, substring(sha1(array_to_string(list_concat([document], lines), chr(0))), 1, 16) AS doc_hash FROM doc)
SELECT id AS record_id, 0 AS row_pos, 'record' AS kind, md5(CASE WHEN coalesce(summary, '') <> '' THEN summary ELSE title END) AS text, doc_hash FROM h
UNION ALL SELECT id, generate_subscripts(lines, 1), 'fact', md5(unnest(lines)), doc_hash FROM h""")
def vx2_folders(spark, sf):
    """A stored index of the labelled records brought up to date with all of them."""
    r = stage.records(spark, sf)
    embed = E.hashing_embedder(64)
    path = work_folder(spark, "index")
    had = stage.table(spark, sf, "labels").select(F.col("doc_id").alias("held"))
    # counted first; a join of two exchanged sides would write every record with its texts to disk
    had = F.broadcast(had) if had.limit(MOST_HELD + 1).count() <= MOST_HELD else had
    schema = E.build_index(r.limit(0), embed).schema
    for wanted in (r.join(had, F.col("id").cast("bigint") == F.col("held"), "left_semi"), r):
        folders.update_index(wanted, embed, path, parts=8)
    out = folders.read_index(spark, path, schema)
    return out.select("record_id", F.col("row_pos").cast("bigint").alias("row_pos"), "kind", F.md5("text").alias("text"), "doc_hash")


@query("rp4_answer_batch", f"""WITH {VEC}, {ASKED},
h AS (SELECT a.id AS qid, b.id, b.slug, row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) AS rank FROM q a, u b QUALIFY rank <= 8),
best AS (SELECT qid, slug, min(rank) AS rank FROM h GROUP BY ALL),
ans AS (SELECT id AS qid, CASE WHEN slug = 'c1' THEN NULL WHEN slug = 'c2' THEN 'no cite' ELSE 'see [' || slug || '] and [zz]' END AS answer, slug AS own FROM q),
used AS (SELECT b.qid, string_agg(b.slug, ',' ORDER BY b.rank) FILTER (a.own NOT IN ('c1', 'c2') AND b.slug = a.own) AS cited,
                string_agg(b.slug, ',' ORDER BY b.rank) AS every FROM best b JOIN ans a ON a.qid = b.qid GROUP BY b.qid)
SELECT a.qid AS question_id, a.answer, CASE WHEN a.answer IS NULL THEN 'synthesis unavailable: down' END AS note,
       coalesce(cited, every) AS cites FROM ans a JOIN used USING (qid)""")
def rp4(spark, sf):
    v = stage.vectors(spark, sf)
    index = v.select("id", F.col("slug").alias("record_id"), F.lit("t").alias("title"), F.lit("u").alias("url"),
                     F.lit("x").alias("text"), F.lit(None).cast("double").alias("timestamp"), "vec")
    q = asked_vectors(spark, sf)
    answer = F.when(F.col("slug") == "c1", None).when(F.col("slug") == "c2", "no cite").otherwise(
        F.concat(F.lit("see ["), "slug", F.lit("] and [zz]")))
    answers = q.select(F.col("id").alias("question_id"), answer.alias("answer"), F.lit("down").alias("error"))
    members = v.select(F.col("slug").alias("record_id"), F.lit("all").alias("slug")).distinct()
    out = reports.answer_batch(q, index, members, answers)
    return out.select("question_id", "answer", "note",
                      F.array_join(F.transform("citations", lambda c: c["id"]), ",").alias("cites"))


@query("vx4_similar_queries", f"""WITH {Q.REC}, {Q.TAGS},
j AS (SELECT id, string_agg(tag, ' ' ORDER BY nth) AS tags FROM tags GROUP BY id)
SELECT r.id, md5(substring(concat_ws(' ', nullif(title0, ''), nullif(summary, ''), j.tags), 1, 500)) AS text FROM records r LEFT JOIN j ON j.id = r.id""")
def vx4_queries(spark, sf):
    """What every record is looked up by."""
    return E.similar_queries(stage.records(spark, sf)).select("id", F.md5("text").alias("text"))

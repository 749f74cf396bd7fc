"""The registered queries of the operators here and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import compact_windows, decontamination, html_extract, importance, knn_join, language_crf, max_sketch, minhash, packing, secrets, sharding, token_counts, url_filter
from gleaner.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(ws)) AS k, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS g
       FROM i, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS u(p) WHERE len(ws) > 0),
dw AS (SELECT doc_id, p, k, array_to_string(ws[p:p + k - 1], ' ') AS g
       FROM w, (SELECT DISTINCT k FROM iw), unnest(generate_series(1, len(ws) - k + 1)) AS u(p) WHERE len(ws) >= k),
h AS (SELECT dw.doc_id, dw.p, dw.k, iw.item FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM h, unnest(generate_series(p, p + k - 1)) AS u(q) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query("op6_benchmark_decontamination", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside any 10-word window of a benchmark item."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


@query("op9_histogram_sort_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes; equal texts side by side."""
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16, payload=F.crc32(F.coalesce("text", F.lit(""))))
    return placed.select("doc_id", "size", F.col("payload").alias("text_crc32"), F.lit("bytes").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP2_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query("op2_url_filter")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the rules; the rest by trees that learned from the urls the rules decide."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rule = url_filter.matching_rule(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), OP2_RULES)
    model = url_filter.train(pages.select("url", (rule["verdict"] == "block").alias("blocked")))
    return url_filter.judge(pages, OP2_RULES, model).select("page_id", "judged.*")


@query("op5_site_template_removal")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


OP1_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, p.e)]) AS BIGINT) AS score
      FROM v q JOIN v p ON q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@query("op1_voronoi_knn_join", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten highest integer inner products of every hundredth vector against all others."""
    return knn_join.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: the fixed patterns and what the character models add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.labelled_tokens(docs)))
    n = [secrets.count_kind(F.col("found.base"), k).alias(f"n_{name}") for k, (name, *_) in enumerate(secrets.BASE)]
    return found.select("doc_id", *n, F.sha2(secrets.shown(F.col("found.base")), 256).alias("base_sha256"),
                        secrets.shown(F.col("found.spans")).alias("spans"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + least(4, len(ws)) - 1], ' ') AS g
      FROM w, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS u(p) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id AND r.root < e.b),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN m ON m.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""


@query("op8_bbit_minhash_near_dedup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the documents by 4-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


@query("op10_compact_windows")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents that share passages of 50 words or more."""
    return compact_windows.passage_classes(table(spark, sf_dir, "documents"))


@query("op7_language_crf")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document's text; learned from three quarters of the documents."""
    docs = table(spark, sf_dir, "documents")
    out = language_crf.held_out(F.col("doc_id"))
    model = language_crf.fit(language_crf.sample(docs.filter(~out)))
    found = language_crf.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op4_lexical_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 32k piece model."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_counts.with_token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), "n_tokens",
                        (F.col("n_tokens") > 4096).alias("over_limit"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
df AS (SELECT r, array_to_string(ws[p:p + k - 1], ' ') AS f, count(*) AS n
       FROM d, unnest(generate_series(1, 3)) AS u(k), unnest(generate_series(1, len(ws) - k + 1)) AS v(p) GROUP BY ALL),
bf AS (SELECT array_to_string(ws[p:p + k - 1], ' ') AS f, count(*) AS n
       FROM b, unnest(generate_series(1, 3)) AS u(k), unnest(generate_series(1, len(ws) - k + 1)) AS v(p) GROUP BY ALL),
x AS (SELECT f, CAST(encode(f) AS BIT) AS z FROM (SELECT f FROM df UNION SELECT f FROM bf)),
h AS (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
             [CAST(get_bit(z, CAST((i // 8) * 8 + 7 - i % 8 AS INTEGER)) AS BIGINT) FOR i IN range(bit_length(z))]),
             lambda c, v: xor(c >> 1, CAST(3988292384 AS BIGINT) * (xor(c, v) & 1))), CAST(4294967295 AS BIGINT)) % 10000 AS bucket FROM x),
s AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM df JOIN h USING (f) GROUP BY bucket),
t AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM bf JOIN h USING (f) GROUP BY bucket),
g AS (SELECT i AS bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (coalesce((SELECT sum(n) FROM s), 0) + 10000) AS DOUBLE)
             / CAST((coalesce(s.n, 0) + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000) AS DOUBLE))) AS BIGINT) AS gain
      FROM range(10000) AS q(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
w AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY r),
e AS (SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
      FROM d LEFT JOIN w USING (r)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER (PARTITION BY n_words >= 20) // 100 AS most FROM e)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= most THEN place END AS rank FROM k"""


@query("op12_importance_resampling", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five in a hundred documents drawn towards the benchmark's word runs."""
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, text, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, count(*) AS times
      FROM (SELECT item_id, text, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM i) GROUP BY ALL),
f AS (SELECT r, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(ws) > 0) AS N, coalesce(sum(len(ws)), 0) AS L FROM d),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * N + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, s GROUP BY t, N),
m AS (SELECT r, doc_id, CAST(100 - 25 + (25 * len(ws) * N) // L AS BIGINT) AS m FROM d, s WHERE len(ws) > 0),
p AS (SELECT item_id, text, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT * FROM k WHERE rank <= 20"""


@query("op13_ranked_search", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents that score highest for each benchmark item."""
    return max_sketch.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

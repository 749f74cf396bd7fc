"""The driver's tables seen as the engine's tables (records, facts, membership, attempts, …).

Pure projections: each one is lazy, reads only what a query uses, and keeps every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import caption_title, hashtags, mentions, normalise_tags


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(c: str) -> Column:
    return F.col(c).cast("string")


def lines(c: Column | str = "text") -> Column:
    return F.filter(F.split(F.col(c) if isinstance(c, str) else c, "\n"), lambda x: x != "")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records: language is the genre, source the author, lines the facts and overlay."""
    facts = F.transform(lines(), lambda t, i: F.struct(
        t.alias("text"), (i * 8).cast("double").alias("timestamp"), i.alias("frame")))
    rid = text_of("doc_id")
    return table(spark, sf_dir, "documents").select(
        rid.alias("id"), F.concat(F.lit("https://example.org/d/"), rid).alias("url"),
        F.col("source").alias("author"), F.concat(F.lit("@"), "source").alias("author_handle"),
        caption_title("text", rid).alias("title"), F.lit(None).cast("timestamp").alias("timestamp"),
        F.col("text").alias("caption"), hashtags("text").alias("hashtags"), mentions("text").alias("mentions"),
        F.col("n_chars").alias("likes"), F.lit(None).cast("bigint").alias("views"),
        F.lit(None).cast("bigint").alias("comments"), (F.col("n_chars") / 8.0).alias("duration"),
        F.when(F.col("n_chars") >= 1000, F.concat(rid, F.lit(".mp4"))).alias("video_path"),
        F.when(F.col("n_chars") >= 500, F.concat(rid, F.lit(".jpg"))).alias("thumbnail_path"),
        F.when(F.col("n_chars") >= 2000, F.concat(rid, F.lit(".pdf"))).alias("pdf_path"),
        F.transform(lines(), lambda t, i: F.struct(
            (i * 4).cast("double").alias("start"), (i * 4 + 4).cast("double").alias("end"),
            t.alias("text"))).alias("transcript"),
        F.array_join(F.filter(lines(), lambda t, i: i % 2 == 0), " ").alias("transcript_text"),
        F.lit(False).alias("transcript_translated"), lines().alias("ocr_text"),
        F.when(F.col("n_chars") >= 300, F.try_element_at(lines(), F.lit(1))).otherwise("").alias("summary"),
        lines().alias("on_screen_text"), F.col("lang").alias("genre"),
        normalise_tags(F.split("text", r"[ \t\r\n]+")).alias("tags"), facts.alias("facts"),
        F.create_map(F.lit("topic"), F.col("lang"), F.lit("name"), F.col("source")).alias("structured"),
        F.struct(F.col("n_chars").alias("input"), F.length("lang").cast("bigint").alias("output"),
                 F.lit(None).cast("double").alias("cost_usd"),
                 F.when(F.col("lang") == "en", "claude-cli").otherwise("local").alias("backend"),
                 F.when(F.col("n_chars") >= 1000, "sonnet").otherwise("").alias("model")).alias("tokens"),
        F.lit(None).cast("timestamp").alias("scraped_at"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as annotations: quality stars, toxic archives, neither marks as read."""
    return table(spark, sf_dir, "labels").select(
        text_of("doc_id").alias("id"), (F.col("quality") == 1).alias("starred"),
        ((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("read"), (F.col("toxic") == 1).alias("archived"),
        F.concat(F.lit("q"), text_of("quality")).alias("note"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary rows with the user's flags and shelves (source and language)."""
    from gleaner.operators.joins import with_annotations
    from gleaner.operators.records import summarise_records

    rows = with_annotations(summarise_records(records(spark, sf_dir)), annotations(spark, sf_dir))
    return rows.withColumn("collections", F.array(F.concat(F.lit("c-"), "author"), F.concat(F.lit("l-"), "genre")))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on the shelves of their nation and their market segment: (slug, pos, record_id)."""
    c = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("pos"), text_of("c_custkey").alias("record_id"),
                    F.explode(F.array(F.lower("n_name"), F.lower("c_mktsegment"))).alias("slug")) \
        .select("slug", "pos", "record_id")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as facts of arms: (record_id, arm, pos, text)."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("record_id"), F.col("role").alias("arm"), F.col("turn").alias("pos"), "text")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as attempts: (arm, record_id, at, seq, ok, seconds); seconds are exact decimals."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("arm"), F.col("user_id").alias("record_id"), F.col("ts").alias("at"),
        F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"),
        F.col("value").cast("decimal(18,2)").alias("seconds"))


def order_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ part as tagged records: (id = order, tag = part type), each tag once per order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("tag"))
    return (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_orderkey").alias("id"), "tag").distinct())


def order_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders on the shelf of their priority: (slug, record_id)."""
    return table(spark, sf_dir, "orders").select(
        F.lower("o_orderpriority").alias("slug"), F.col("o_orderkey").alias("record_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"),
        F.concat(F.lit("c"), text_of("label")).alias("slug"))

"""Aggregates over records: topics, statistics, tags, facets, headers, digests.

Sizes of groups never matter: counts are partial aggregates, and every list that is
returned nested is cut to its top N before it is collected. Lists that are whole
(record references, cards) come back as ordered rows, not as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.answers import record_cost
from gleaner.functions.text import col, empty_strings, explode_once, or_else, present, strip


BLOCK_ROWS = 100_000      # rows of a group that one task ranks, where Spark does not cut groups itself


def top_n_per_group(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """First n rows per group.

    For n up to a setting of the session Spark cuts each map task to n rows per group before the shuffle. Beyond it the rows are
    counted and groups dealt into blocks of about `block_rows` rows at most; each block is ranked and cut to n, and only those rows
    are ranked together.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    if n >= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        blocks = max(-(-df.count() // block_rows), 1)
        dealt = df.withColumn("_block", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in keys]), F.lit(blocks)))
        inside = Window.partitionBy(*keys, "_block").orderBy(*order)
        df = dealt.withColumn("_in_block", F.row_number().over(inside)).filter(F.col("_in_block") <= n).drop("_block", "_in_block")
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def topic_key(genre: Column | str = "genre") -> Column:
    return F.lower(strip(or_else(genre, "uncategorized")))


def stat_genre(genre: Column | str = "genre") -> Column:
    return or_else(genre, "uncategorized")


def section_genre(genre: Column | str = "genre") -> Column:
    """The digest section of a genre; whatever has no section of its own goes to `other`."""
    g = F.lower(or_else(genre, "other"))
    return F.when(g.isin([s for s, _ in K.SECTIONS]), g).otherwise("other")


def section_order(section: Column) -> Column:
    """1-based place of a section in the digest."""
    return F.array_position(F.array(*[F.lit(s) for s, _ in K.SECTIONS]), section).cast("int")


def section_label(section: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for s in K.SECTIONS for x in s]), section)


def topic_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(topic_key().alias("topic")).agg(
        F.count(F.lit(1)).alias("records"), F.min("id").alias("first_id"))


def topic_hashtags(records: DataFrame, n: int = 10) -> DataFrame:
    """(topic, tag, uses, rank): most used lower-cased hashtags, first seen first on ties."""
    keyed = records.select(topic_key().alias("topic"), "id", "hashtags")   # before the explode, not per tag
    tags = explode_once(keyed, ["topic", "id"], "hashtags", "pos", "tag")
    uses = tags.groupBy("topic", F.lower("tag").alias("tag")).agg(
        F.count(F.lit(1)).alias("uses"), F.min(F.struct("id", "pos")).alias("first"))
    return top_n_per_group(uses, ["topic"], [F.desc("uses"), "first"], n).drop("first")


def topic_facts(records: DataFrame, n: int = 40) -> DataFrame:
    """(topic, id, pos, text, timestamp, rank): first facts in record order."""
    keyed = records.select(topic_key().alias("topic"), "id", "facts")
    facts = explode_once(keyed, ["topic", "id"], "facts", "pos", "fact")
    return (top_n_per_group(facts, ["topic"], ["id", "pos"], n)
            .select("topic", "id", "pos", "fact.text", "fact.timestamp", "rank"))


def topic_records(records: DataFrame) -> DataFrame:
    """Every record of every topic as rows (whole; ordered by topic and id when written)."""
    return records.select(topic_key().alias("topic"), "id", or_else("title", F.col("id")).alias("title"),
                          "url", "author", "summary", "thumbnail_path")


def build_topics(records: DataFrame, max_facts: int = 40, max_hashtags: int = 10) -> DataFrame:
    """One row per topic: count, top hashtags, first facts (record references: `topic_records`)."""
    tags = topic_hashtags(records, max_hashtags).groupBy("topic").agg(
        F.sort_array(F.collect_list(F.struct("rank", "tag"))).alias("_tags"))
    facts = topic_facts(records, max_facts).groupBy("topic").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "text", "timestamp"))).alias("_facts"))
    return (topic_counts(records).join(tags, "topic", "left").join(facts, "topic", "left")
            .select("topic", "records", "first_id",
                    F.coalesce(F.transform("_tags", lambda t: t["tag"]), empty_strings()).alias("hashtags"),
                    F.transform("_facts", lambda f: F.struct(
                        f["id"].alias("record_id"), f["text"].alias("text"),
                        f["timestamp"].alias("timestamp"))).alias("facts"))
            .orderBy(F.desc("records"), "topic"))


def corpus_stats(records: DataFrame, default_model: str = "", cost: Column | None = None,
                 places: int | None = 4) -> DataFrame:
    """Per genre and overall (`level` 1): records, tokens and cost."""
    t = F.col("tokens")
    if cost is None:
        cost = record_cost(t["cost_usd"], t["input"], t["output"], or_else(t["model"], default_model), places)
    return (records.select(stat_genre().alias("genre"), t["input"].alias("i"), t["output"].alias("o"),
                           cost.alias("c"))
            .rollup("genre")
            .agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("records"),
                 F.coalesce(F.sum("i"), F.lit(0)).alias("tokens_in"),
                 F.coalesce(F.sum("o"), F.lit(0)).alias("tokens_out"), F.sum("c").alias("cost_usd")))


def tag_counts(tags: DataFrame) -> DataFrame:
    """tags(id, tag) -> (tag, count)."""
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("count"))


def tag_facets(tags: DataFrame, membership: DataFrame) -> DataFrame:
    """(tag, count, slug, in_slug): tag counts from the tag side alone, so shelves cannot inflate them."""
    shelves = membership.select(F.col("record_id").alias("id"), "slug").distinct()
    per_shelf = tags.join(shelves, "id").groupBy("tag", "slug").agg(F.count(F.lit(1)).alias("in_slug"))
    return tag_counts(tags).join(per_shelf, "tag", "left")


def tag_listing(tags: DataFrame, membership: DataFrame) -> DataFrame:
    """(tag, count, collections): every tag with how often each shelf holds it, most used first, then by name."""
    per = tag_facets(tags, membership)
    shelf = F.when(F.col("slug").isNotNull(), F.struct((-F.col("in_slug")).alias("n"), "slug"))
    listed = F.transform(F.sort_array(F.collect_list(shelf)), lambda s: F.struct(s["slug"].alias("name"), (-s["n"]).alias("count")))
    return per.groupBy("tag", "count").agg(listed.alias("collections")).orderBy(F.desc("count"), "tag")


def top_tags(tags: DataFrame, n: int = 30) -> DataFrame:
    return tag_counts(tags).orderBy(F.desc("count"), "tag").limit(n)


def top_authors(records: DataFrame, min_saves: int = 2, limit: int = 8) -> DataFrame:
    """Handles (never display names) saved at least `min_saves` times, most saved first."""
    handle = F.ltrim(strip(F.coalesce(F.col("author_handle"), F.lit(""))), F.lit("@"))
    return (records.select(handle.alias("handle")).filter("handle <> ''")
            .groupBy("handle").agg(F.count(F.lit(1)).alias("saves"))
            .filter(F.col("saves") >= min_saves)
            .orderBy(F.desc("saves"), "handle").limit(limit))


def top_hashtags(records: DataFrame, limit: int = 6, min_chars: int = 3) -> DataFrame:
    """Caption hashtags worth following: letters and digits only, no reach tags."""
    tags = F.transform("hashtags", lambda h: strip(F.lower(F.ltrim(h, F.lit("#")))))
    wanted = F.filter(tags, lambda t: (F.length(t) >= min_chars) & t.rlike(r"^[\p{L}\p{N}]+\z")
                      & ~t.isin(K.JUNK_HASHTAGS))
    return (explode_once(records, [], wanted, "pos", "tag")
            .groupBy("tag").agg(F.count(F.lit(1)).alias("uses"))
            .orderBy(F.desc("uses"), "tag").limit(limit))


def facet_values(listing: DataFrame) -> DataFrame:
    """(facet, value): distinct non-empty genres, authors, collections and arms."""
    pairs = F.array(
        F.struct(F.lit("genre").alias("facet"), F.array("genre").alias("v")),
        F.struct(F.lit("author").alias("facet"), F.array("author").alias("v")),
        F.struct(F.lit("collection").alias("facet"), F.col("collections").alias("v")),
        F.struct(F.lit("arm").alias("facet"), F.array(or_else("model", F.col("backend"))).alias("v")))
    return (listing.select(F.explode(pairs).alias("p"))
            .select("p.facet", F.explode("p.v").alias("value"))
            .filter(present("value")).distinct())


def collection_header(members: DataFrame) -> DataFrame:
    """Per collection: records, distinct non-empty authors, sections used."""
    author = F.when(present("author"), F.col("author"))
    return members.groupBy("slug").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct(author).alias("authors"),
        F.countDistinct(section_genre()).alias("genres"))


def collection_sections(members: DataFrame) -> DataFrame:
    return members.groupBy("slug", section_genre().alias("genre")).agg(F.count(F.lit(1)).alias("records"))


def collection_tag_breadth(tags: DataFrame, membership: DataFrame) -> DataFrame:
    """(slug, tags): distinct tags per collection."""
    shelves = membership.select(F.col("record_id").alias("id"), "slug").distinct()
    return (tags.select("id", "tag").join(shelves, "id").select("slug", "tag").distinct()
            .groupBy("slug").agg(F.count(F.lit(1)).alias("tags")))


# --- resource digest ---------------------------------------------------------
def named_resources(structured: Column | str, facts: Column | str) -> Column:
    """Resources a record names: list fields, `name — link`, and short facts holding a url."""
    s = col(structured)

    def listed(key: str) -> Column:
        value = F.try_element_at(s, F.lit(key))
        return F.filter(F.coalesce(F.from_json(value, "array<string>"), empty_strings()), present)

    name, link = F.try_element_at(s, F.lit("name")), F.try_element_at(s, F.lit("link"))
    named = F.when(present(name), F.array(F.concat(
        name, F.when(present(link), F.concat(F.lit(" — "), link)).otherwise("")))).otherwise(empty_strings())
    said = F.filter(F.transform(F.coalesce(col(facts), empty_strings()), lambda f: f),
                    lambda f: f.rlike(K.RESOURCE_URL) & (F.length(f) < K.RESOURCE_FACT_CHARS))
    everything = F.concat(listed("tools"), listed("resources"), listed("links"), named, said)
    kept = F.filter(F.transform(everything, strip), lambda x: (x != "") & ~x.rlike(K.RESOURCE_NOISE))
    return F.array_distinct(kept)


# as far as a bucket pattern can reach into the context from the item before it: an alternative matches no more characters
# than it is written with, and then word characters
CONTEXT_HEAD = r"(?sU)^.{0,%d}\w*" % max(len(p) for _, p in K.RESOURCE_BUCKETS)


def resource_bucket(item: Column, context_hits: Column, context_head: Column) -> Column:
    """First bucket whose pattern is in `item context`.

    The context is searched once per record (`context_hits`, one flag per bucket); per item only the item
    and the words it touches are searched.
    """
    text = F.concat_ws(" ", item, context_head)
    chosen = None
    for i, (name, pattern) in enumerate(K.RESOURCE_BUCKETS):
        hit = context_hits[i] | text.rlike(pattern)
        chosen = F.when(hit, name) if chosen is None else chosen.when(hit, name)
    return chosen.otherwise(K.RESOURCE_DEFAULT_BUCKET)


def resource_digest(records: DataFrame, membership: DataFrame | None = None) -> DataFrame:
    """(bucket, id, pos, item, title, url[, collections]): one row per named resource."""
    context = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "summary", "caption")])
    per_record = records.select(
        "id", "url", strip("title").alias("title"), F.regexp_extract(context, CONTEXT_HEAD, 0).alias("_head"),
        F.array(*[context.rlike(pattern) for _, pattern in K.RESOURCE_BUCKETS]).alias("_hits"),
        named_resources("structured", F.transform("facts", lambda f: f["text"])).alias("_items"))
    found = explode_once(per_record, ["id", "url", "title", "_head", "_hits"], "_items", "pos", "item")
    rows = found.select(resource_bucket(F.col("item"), F.col("_hits"), F.col("_head")).alias("bucket"),
                        "id", "pos", "item", "title", "url")
    if membership is None:
        return rows
    from gleaner.operators.joins import with_collections

    return with_collections(rows, membership)

"""Landed feed files to records: RSS, Atom, paper feeds, releases, social feed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from gleaner import constants as K
from gleaner import schemas as S
from gleaner.functions.text import clean_markup, or_else, parse_date, present, stable_id, strip
from gleaner.operators.facets import top_n_per_group
from gleaner.operators.joins import first_occurrence
from gleaner.operators.records import video_item

TITLE_CHARS = 300


def feed_record(kind: str, url: Column, title: Column, body: Column, author: Column, published: Column) -> list[Column]:
    """The record columns a text item fills."""
    return [stable_id(kind, url).alias("id"), url.alias("url"),
            or_else(F.substring(clean_markup(title), 1, TITLE_CHARS), url).alias("title"),
            clean_markup(author).alias("author"), clean_markup(body).alias("caption"),
            parse_date(published).alias("timestamp")]


def _place(items: DataFrame) -> list[str]:
    """Where an item stands in its feed, if the scan says so."""
    return [c for c in ("source", "pos") if c in items.columns]


def rss_records(items: DataFrame) -> DataFrame:
    """RSS 2.0 items; items without a link are skipped."""
    link = strip(F.coalesce("link", F.lit("")))
    body = or_else("`content:encoded`", F.coalesce("description", F.lit("")))
    return items.filter(link != "").select(*feed_record(
        "rss", link, F.col("title"), body, F.col("`dc:creator`"), F.col("pubDate")), *_place(items))


def atom_records(entries: DataFrame) -> DataFrame:
    link = F.coalesce(F.get("link", F.lit(0))["_href"], F.lit(""))
    body = or_else(F.col("content._VALUE"), F.coalesce("summary._VALUE", F.lit("")))
    author = F.get("author", F.lit(0))["name"]
    return entries.filter(link != "").select(*feed_record(
        "rss", link, F.col("title"), body, author, or_else("published", F.col("updated"))), *_place(entries))


def paper_records(entries: DataFrame) -> DataFrame:
    authors = F.array_join(F.transform("author", lambda a: F.coalesce(a["name"], F.lit(""))), ", ")
    return entries.select(*feed_record(
        "arxiv", F.coalesce("id", F.lit("")), F.col("title"), F.col("summary._VALUE"), authors, F.col("published")), *_place(entries))


def release_records(releases: DataFrame, repo_url: Column) -> DataFrame:
    """Release objects with the repo url they came from; title is `repo tag: name`."""
    owner = F.regexp_extract(repo_url, K.RELEASE_REPO, 1)
    repo = F.regexp_replace(F.regexp_extract(repo_url, K.RELEASE_REPO, 2), r"\.git\z", "")
    text = lambda c: F.coalesce(c, F.lit(""))
    title = F.concat(repo, F.lit(" "), text("tag_name"), F.lit(": "), text("name"))
    return releases.filter(owner != "").select(*feed_record(
        "github", or_else("html_url", repo_url), title, F.col("body"), owner, F.col("published_at")))


def per_source_limit(records: DataFrame, limit: int, source: str = "source", order: str = "pos") -> DataFrame:
    """The first `limit` items of every source (the source's own setting)."""
    return top_n_per_group(records, [source], [order], limit, "_rn").drop("_rn")


CORRUPT = "_corrupt_record"


def _xml(spark: SparkSession, path: str, tag: str, schema) -> DataFrame:
    """The elements of a feed file with `source`, the file, and `pos`, their order in it; one that does not parse has only its text."""
    rows = (spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .schema(f"{schema}, {CORRUPT} string").load(path))
    return rows.withColumn("source", F.col("_metadata.file_path")).withColumn("pos", F.monotonically_increasing_id())


def _elements(spark: SparkSession, path: str, tag: str, schema, strict: bool) -> DataFrame:
    """The elements that parse. `strict` fails where a file holds more than that."""
    if strict:
        bad = feed_rejects(spark, path, [tag]).first()
        if bad:
            raise ValueError(f"{bad.file}: {bad.read} of {bad.opened} {tag} elements can be read")
    return _xml(spark, path, tag, schema).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def feed_rejects(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """(file, tag, opened, read): feed files in which fewer elements can be read than are opened, by a stray end tag or a file cut
    short, say. Openings inside comments and CDATA do not count."""
    schemas = {"item": S.RSS_ITEM, "entry": S.ATOM_ENTRY}
    text = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "").alias("value"))
    out = None
    for tag in tags or list(schemas):
        opened = text.select("file", F.regexp_count("value", F.lit(rf"<{tag}(?=[\s/>])")).cast("bigint").alias("opened")).filter("opened > 0")
        # Spark does not look at the damaged text alone, so another column is asked for too
        read = _xml(spark, path, tag, schemas[tag]).groupBy(F.col("source").alias("file")).agg(
            F.count_if(F.col(CORRUPT).isNull() & (F.coalesce(F.length("title"), F.lit(0)) >= 0)).alias("read"))
        found = opened.join(read, "file", "left").select("file", F.lit(tag).alias("tag"), "opened", F.coalesce("read", F.lit(0)).alias("read")) \
            .filter(F.col("read") < F.col("opened"))
        out = found if out is None else out.unionAll(found)
    return out


def _limited(records: DataFrame, limit: int | None) -> DataFrame:
    """The first `limit` items of every feed (all without a limit)."""
    return (records if limit is None else per_source_limit(records, limit)).drop("source", "pos")


def scan_rss_atom(spark: SparkSession, path: str, limit: int | None = None, strict: bool = False) -> DataFrame:
    """Items of the landed RSS and Atom files, at most `limit` of each file. Damaged elements are left out and can be had from
    `feed_rejects`, or fail the scan if it is strict."""
    return _limited(rss_records(_elements(spark, path, "item", S.RSS_ITEM, strict)).unionByName(
        atom_records(_elements(spark, path, "entry", S.ATOM_ENTRY, strict))), limit)


def scan_paper_atom(spark: SparkSession, path: str, limit: int | None = None, strict: bool = False) -> DataFrame:
    return _limited(paper_records(_elements(spark, path, "entry", S.ATOM_ENTRY, strict)), limit)


def scan_releases(spark: SparkSession, path: str, repo_url: str, strict: bool = False) -> DataFrame:
    """Release objects of JSON files, one or a list each; files that do not parse are left out and can be had from
    `release_rejects`, or fail the scan if it is strict."""
    read = _releases(spark, path)
    listed = F.col("listed")
    if strict:
        listed = F.coalesce(listed, F.raise_error(F.concat(F.lit("no releases: "), "file")).cast(read.schema["listed"].dataType))
    return release_records(read.select(F.explode(listed).alias("r")).select("r.*"), F.lit(repo_url))


def release_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of what holds no releases."""
    return _releases(spark, path).filter("listed IS NULL").select("file", "text")


def _releases(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, listed): the releases of every file, null where it does not parse."""
    one = StructType.fromDDL(S.RELEASE)
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"), F.from_json("value", ArrayType(one)).alias("listed"))


# --- social feed pages -------------------------------------------------------
def page_items(pages: DataFrame, page_order: Column) -> DataFrame:
    """(page, pos, media): the post of every item, wrapped in `media` or not."""
    fields = ("media_type", "code", "saved_collection_ids", "carousel_media", "user", "caption")
    own = lambda i: F.struct(*[i[f].alias(f) for f in fields])
    items = F.transform("items", lambda i: F.coalesce(i["media"], own(i)))
    return pages.select(page_order.alias("page"), F.posexplode(items).alias("pos", "media"))


def feed_items(items: DataFrame, known_only: bool = False) -> DataFrame:
    """(page, pos, id, handle, caption, collection_ids): first sight of every video post."""
    m = F.col("media")
    kept = items.filter(video_item(m, known_only) & present(m["code"])).select(
        "page", "pos", m["code"].alias("id"), F.coalesce(m["user"]["username"], F.lit("")).alias("handle"),
        F.coalesce(m["caption"]["text"], F.lit("")).alias("caption"),
        F.coalesce(m["saved_collection_ids"], F.array().cast("array<string>")).alias("collection_ids"))
    return first_occurrence(kept, ["id"], ["page", "pos"])


def item_url(code: Column | str) -> Column:
    return F.concat(F.lit("https://www.instagram.com/reel/"), F.col(code) if isinstance(code, str) else code, F.lit("/"))


def candidates_from_items(items: DataFrame, source: str, found_on: str, caption_chars: int = 600) -> DataFrame:
    """Candidate rows from `feed_items(..., known_only=True)`."""
    return items.select(
        "id", item_url("id").alias("url"), F.substring("caption", 1, caption_chars).alias("caption"),
        F.col("handle").alias("author"), F.lit(source).alias("source"), F.lit("new").alias("state"),
        F.lit(found_on).alias("found_on"), "page", "pos")


def name_order(name: Column) -> Column:
    """(order, name): compares names by their text, and numbers in them as numbers: page-9 stands before page-10."""
    digits = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    parts = F.transform(F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), lambda x: F.when(
        x.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 3, "0"), digits(x))).otherwise(x))
    return F.struct(F.array_join(parts, "").alias("order"), name.alias("name"))


def feed_page_items(spark: SparkSession, path: str) -> DataFrame:
    """(page, pos, media) of the landed pages; a page is named by its file, see `name_order`."""
    pages = spark.read.schema(S.FEED_PAGE).option("multiLine", True).json(path)
    return page_items(pages, name_order(F.col("_metadata.file_name")))


def scan_feed_pages(spark: SparkSession, path: str, known_only: bool = False) -> DataFrame:
    """Landed pages in file-name order, numbers in names compared as numbers."""
    return feed_items(feed_page_items(spark, path), known_only)

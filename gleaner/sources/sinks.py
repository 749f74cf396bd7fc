"""Writers: versions of the record table, CSV and markdown exports, topic snapshots, pages and digests.

Text outputs are built as ordered line rows, range-partitioned and sorted inside the
partitions, so a document of any length is written by as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.text import clock, col, empty_strings, or_else, present
from gleaner.operators.facets import section_genre, section_label, section_order, stat_genre
from gleaner.operators.sync import upsert


# --- records -----------------------------------------------------------------
def write_records(current: DataFrame, changes: DataFrame, path: str, order: str | None = None) -> DataFrame:
    """Upsert by id into a new version folder; the version that was read is never overwritten."""
    spark = current.sparkSession
    upsert(current, changes, "id", order).write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


# --- CSV and markdown exports ------------------------------------------------
def _blank_zero(c: str) -> Column:
    """A number as text; null and zero are blank."""
    return F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.col(c).cast("string")).otherwise("")


def _one_line(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\n", " ")


def export_rows(records: DataFrame) -> DataFrame:
    """The 14 export columns."""
    t = F.col("tokens")
    return records.select(
        "id", "title", "author", "genre", F.array_join(F.coalesce("tags", empty_strings()), ", ").alias("tags"),
        *[_blank_zero(c).alias(c) for c in ("likes", "comments", "views", "duration")],
        F.coalesce(t["input"], F.lit(0)).alias("tokens_in"), F.coalesce(t["output"], F.lit(0)).alias("tokens_out"),
        _one_line("summary").alias("summary"), _one_line("transcript_text").alias("transcript"), "url")


# as spreadsheets read it; white space at the ends of a field belongs to it
CSV = {"header": True, "quoteAll": False, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export_csv(records: DataFrame, path: str) -> None:
    export_rows(records).write.options(**CSV).csv(path)


def export_lines(records: DataFrame) -> DataFrame:
    """(genre, id, line_no, text): the title, then one bullet per record and its summary, under a genre heading.

    Heading lines have id '', the title line no genre either. Sorting by (genre, id, line_no) gives the document.
    """
    tags = F.array_join(F.transform(F.coalesce("tags", empty_strings()), lambda t: F.concat(F.lit("#"), t)), " ")
    bullet = F.concat(F.lit("- **["), or_else("title", F.col("id")), F.lit("]("), "url", F.lit(")** — "),
                      F.coalesce("author", F.lit("")), F.lit("  "), tags)
    lines = F.filter(F.array(
        F.struct(F.lit(1).alias("line_no"), bullet.alias("text")),
        F.struct(F.lit(2).alias("line_no"),
                 F.when(present("summary"), F.concat(F.lit("  - "), "summary")).alias("text"))),
        lambda x: x["text"].isNotNull())
    rows = records.select(stat_genre().alias("genre"), "id", F.inline_outer(lines))   # never empty: see explode_once
    heads = records.select(stat_genre().alias("genre")).distinct().select(
        "genre", F.lit("").alias("id"), F.lit(0).alias("line_no"),
        F.concat(F.lit("## "), "genre").alias("text"))
    title = records.sparkSession.createDataFrame([("", "", -1, K.EXPORT_TITLE)], "genre string, id string, line_no int, text string")
    return title.unionByName(heads).unionByName(rows)


def write_lines(lines: DataFrame, keys: list[str], path: str, partition_by: list[str] | None = None) -> None:
    """Ordered text files: part files in name order are the document."""
    ordered = lines.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    if partition_by:
        ordered.select(*partition_by, "text").write.partitionBy(*partition_by).text(path)
    else:
        ordered.select("text").write.text(path)


def export_markdown(records: DataFrame, path: str) -> None:
    write_lines(export_lines(records), ["genre", "id", "line_no"], path)


# --- topic snapshot ----------------------------------------------------------
def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], schema: str,
                  rebuild: bool = False) -> DataFrame:
    """The JSON snapshot at `path`; built and written first when missing or when asked to."""
    if not rebuild:
        try:
            return spark.read.schema(schema).json(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    build().write.mode("overwrite").json(path)
    return spark.read.schema(schema).json(path)


# --- record pages ------------------------------------------------------------
def _title_case(c: Column) -> Column:
    return F.initcap(F.regexp_replace(c, "_", " "))


def _section(heading: str, body: Column, when: Column) -> Column:
    return F.when(when, F.concat(F.lit(f"## {heading}\n\n"), body))


def _bullets(items: Column, form: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(items, form), "\n")


def record_pages(records: DataFrame) -> DataFrame:
    """(id, page): one markdown text per record; blank sections are left out."""
    day = F.coalesce(F.date_format("timestamp", "yyyy-MM-dd"), F.lit(""))
    text = lambda c: F.coalesce(col(c), F.lit(""))
    front = F.concat(
        F.lit('---\ntitle: "'), text("title"), F.lit('"\nauthor: "'), text("author"), F.lit('"\ndate: "'), day,
        F.lit('"\nsource: "'), text("url"), F.lit('"\nid: "'), "id", F.lit('"\n---\n\n# '), text("title"))

    def row(name: str, value: Column, when: Column) -> Column:
        return F.when(when, F.concat(F.lit(f"| **{name}** | "), value, F.lit(" |")))

    stamp = F.coalesce(F.date_format("timestamp", "yyyy-MM-dd HH:mm 'UTC'"), F.lit("—"))
    metrics = F.array_join(F.filter(F.array(
        F.lit("| | |\n|---|---|"), row("Author", or_else("author", "—"), F.lit(True)), row("Date", stamp, F.lit(True)),
        row("Source", F.concat(F.lit("["), text("url"), F.lit("]("), text("url"), F.lit(")")), F.lit(True)),
        *[row(n, F.format_number(c, 0), F.col(c).isNotNull())
          for n, c in (("Likes", "likes"), ("Views", "views"), ("Comments", "comments"))],
        row("Duration", F.concat(F.bround("duration", 0).cast("bigint").cast("string"), F.lit("s")),
            F.coalesce(F.col("duration"), F.lit(0.0)) != 0)), lambda x: x.isNotNull()), "\n")

    def field(e: Column) -> Column:
        items = F.when(e["value"].startswith("["), F.from_json(e["value"], "array<string>"))
        body = F.when(items.isNotNull(), _bullets(items, lambda i: F.concat(F.lit("- "), i))).otherwise(e["value"])
        return F.concat(F.lit("**"), _title_case(e["key"]), F.lit(":**\n"), body)

    shown = F.filter(F.map_entries("structured"), lambda e: present(e["value"]) & ~e["value"].isin("[]", "{}"))
    facts = F.concat(F.lit("| At | Fact |\n|----|------|\n"), _bullets(F.col("facts"), lambda f: F.concat(
        F.lit("| `"), clock(f["timestamp"]), F.lit("` | "), f["text"], F.lit(" |"))))
    marks = F.concat_ws("\n", *[
        F.when(F.size(c) > 0, F.concat(F.lit(f"\n**{name}:** {sign}"), F.array_join(c, f" {sign}")))
        for name, c, sign in (("Hashtags", "hashtags", "#"), ("Mentions", "mentions", "@"))])
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0)) > 0
    parts = [
        front, metrics,
        F.when(present("genre"), F.concat(F.lit("**Genre:** `"), "genre", F.lit("`"))),
        _section("Summary", F.col("summary"), present("summary")),
        _section("Details", F.array_join(F.transform(shown, field), "\n\n"), F.coalesce(F.size(shown), F.lit(0)) > 0),
        _section("Key facts (with provenance)", facts, size("facts")),
        _section("Caption", F.concat_ws("\n", "caption", F.when(marks != "", marks)), present("caption")),
        _section("Transcript", _bullets(F.col("transcript"), lambda s: F.concat(
            F.lit("- `["), F.format_string("%.1f", s["start"]), F.lit("s]` "), s["text"])), present("transcript_text")),
        _section("On-screen text", _bullets(F.col("ocr_text"), lambda x: F.concat(F.lit("- "), x)), size("ocr_text")),
        F.concat(F.lit("---\n*Scraped "), F.coalesce(F.date_format("scraped_at", "yyyy-MM-dd"), F.lit("")),
                 F.lit(" · [original]("), text("url"), F.lit(")*")),
    ]
    return records.select("id", F.concat_ws("\n\n", *parts).alias("page"))


# --- collection digests ------------------------------------------------------
def digest_cards(members: DataFrame) -> DataFrame:
    """(slug, section, genre, pos, id, text): one card per member; sections in their fixed order."""
    genre = section_genre()
    metric = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label} "), F.format_number(c, 0)))
    meta = F.concat_ws(" · ", metric("likes", "likes"), metric("comments", "comments"), metric("views", "views"),
                       F.date_format("timestamp", "MMM dd, yyyy"))
    facts = F.when(F.array_size("facts") > 0, F.concat(
        F.lit("Facts ("), F.array_size("facts").cast("string"), F.lit("):\n"),
        _bullets(F.col("facts"), lambda f: F.concat(F.lit("- "), clock(f["timestamp"]), F.lit(" "), f["text"]))))
    card = F.concat_ws("\n", F.concat(F.lit("### "), or_else("title", F.col("record_id"))),
                       F.concat(or_else("author", "Unknown"), F.lit(" · "), genre),
                       F.when(meta != "", meta), F.when(present("summary"), F.col("summary")), facts,
                       F.concat(F.lit("<"), F.coalesce("url", F.lit("")), F.lit(">")))
    return members.select("slug", section_order(genre).alias("section"), genre.alias("genre"), "pos",
                          F.col("record_id").alias("id"), card.alias("text"))


def digest_lines(members: DataFrame, collections: DataFrame) -> DataFrame:
    """(slug, section, pos, text): header, section headings with counts, then every card."""
    from gleaner.operators.facets import collection_header, collection_sections

    cards = digest_cards(members)
    heads = collection_header(members).join(collections.select("slug", "title"), "slug")
    plural = lambda n: F.when(F.col(n) == 1, "record").otherwise("records")
    header = heads.select("slug", F.lit(0).alias("section"), F.lit(-1).alias("pos"), F.concat(
        F.lit("# "), "title", F.lit(" — "), F.col("records").cast("string"), F.lit(" "), plural("records"),
        F.lit(" · "), F.col("authors").cast("string"), F.lit(" creators · "), F.col("genres").cast("string"),
        F.lit(" genres")).alias("text"))
    genre = F.col("genre")
    sections = collection_sections(members).select("slug", section_order(genre).alias("section"), F.lit(-1).alias("pos"), F.concat(
        F.lit("## "), section_label(genre), F.lit(" ("), F.col("records").cast("string"), F.lit(")")).alias("text"))
    return header.unionByName(sections).unionByName(cards.select("slug", "section", "pos", "text"))


def master_index(collections: DataFrame, members: DataFrame, thumbs: int = 3) -> DataFrame:
    """(slug, title, updated, records, thumbs): every collection with its size and first thumbnails.

    The first three members are looked at, as listed; those without a thumbnail leave a gap.
    """
    from gleaner.operators.facets import top_n_per_group

    sizes = members.groupBy("slug").agg(F.count(F.lit(1)).alias("records"))
    first = top_n_per_group(members.select("slug", "pos", "thumbnail_path"), ["slug"], ["pos"], thumbs)
    shown = first.filter(present("thumbnail_path")).groupBy("slug").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "thumbnail_path"))),
                                 lambda t: t["thumbnail_path"]), "|").alias("thumbs"))
    return (collections.select("slug", "title", "updated").join(sizes, "slug", "left").join(shown, "slug", "left")
            .select("slug", "title", "updated", F.coalesce("records", F.lit(0)).alias("records"),
                    F.coalesce("thumbs", F.lit("")).alias("thumbs"))
            .orderBy(F.lower("title"), "slug"))


# --- recency index -----------------------------------------------------------
def recency_rows(records: DataFrame) -> DataFrame:
    """(sort_time, id, text): a markdown table row per record; newest first when sorted."""
    title = F.substring(F.regexp_replace(or_else("title", F.col("id")), r"\|", r"\\|"), 1, 60)
    text = F.concat(
        F.lit("| "), title, F.lit(" | "), or_else("author", "—"), F.lit(" | "),
        F.coalesce(F.date_format("timestamp", "yyyy-MM-dd"), F.lit("—")), F.lit(" | [open](records/"), "id",
        F.lit(".md) | "), F.when(present("pdf_path"), F.concat(F.lit("[PDF](pdfs/"), "id", F.lit(".pdf)"))).otherwise("—"),
        F.lit(" |"))
    return records.select(F.coalesce("timestamp", "scraped_at").alias("sort_time"), "id", text.alias("text"))


def recency_lines(records: DataFrame) -> DataFrame:
    """(head, sort_time, id, text): the title, how many records there are, the table's head, then a row per record (head 9)."""
    rows = recency_rows(records).withColumn("head", F.lit(9))
    count = records.agg(F.concat(F.lit("**"), F.count(F.lit(1)).cast("string"), F.lit(f"** {K.INDEX_INTRO}")).alias("text"))
    fixed = [(0, K.INDEX_TITLE), (1, ""), (3, ""), *enumerate(K.INDEX_HEAD, 4)]
    heads = records.sparkSession.createDataFrame(fixed, "head int, text string").unionByName(count.withColumn("head", F.lit(2)))
    return heads.select("head", F.lit(None).cast(rows.schema["sort_time"].dataType).alias("sort_time"), F.lit("").alias("id"), "text") \
        .unionByName(rows.select("head", "sort_time", "id", "text"))


def write_recency_index(records: DataFrame, path: str) -> None:
    newest = [F.asc("head"), F.desc_nulls_last("sort_time"), F.asc("id")]
    recency_lines(records).repartitionByRange(*newest).sortWithinPartitions(*newest).select("text").write.text(path)



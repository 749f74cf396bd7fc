"""Projections, filters, sorts and edits of the record table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import col, empty_strings, let, or_else, present, renamed_tags, strip, valid_id
from gleaner.session import cut_lineage


def summarise_records(records: DataFrame) -> DataFrame:
    """One listing row per record: display title, token counts, provenance, has-PDF flag."""
    token = F.col("tokens")
    return records.select(
        "id", or_else("title", F.col("id")).alias("title"), "author", "genre", "tags", "url",
        "thumbnail_path", "likes", "views", "comments", "duration", "timestamp",
        present("pdf_path").alias("has_pdf"),
        F.coalesce(token["input"], F.lit(0)).cast("bigint").alias("tokens_in"),
        F.coalesce(token["output"], F.lit(0)).cast("bigint").alias("tokens_out"),
        F.coalesce(token["backend"], F.lit("")).alias("backend"),
        F.coalesce(token["model"], F.lit("")).alias("model"))


def arm_of(model: Column | str = "model", backend: Column | str = "backend") -> Column:
    """The model of a listing row, else its backend, else ''."""
    return or_else(model, F.coalesce(col(backend), F.lit("")))


def text_match(needle: str) -> Column:
    low = needle.lower()
    fields = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(low))
              for c in ("title", "author", "genre")]
    tagged = F.exists(F.coalesce(F.col("tags"), empty_strings()), lambda t: F.contains(t, F.lit(low)))
    return reduce(lambda a, b: a | b, [*fields, tagged])


def record_filter(*, q: str = "", tag: str = "", genre: str = "", author: str = "", collection: str = "", arm: str = "",
                  status: str = "all", max_age_days: int | None = None, now: Column | None = None) -> Column:
    """AND of the given predicates; archived rows only under status='archived'."""
    keep = [F.col("archived") if status == "archived" else ~F.col("archived")]
    if q:
        keep.append(text_match(q))
    if tag:
        keep.append(F.array_contains("tags", tag))
    if genre:
        keep.append(F.col("genre") == genre)
    if author:
        keep.append(F.col("author") == author)
    if collection:
        keep.append(F.array_contains("collections", collection))
    if arm:
        keep.append(arm_of() == ("" if arm == "none" else arm))
    if status == "starred":
        keep.append(F.col("starred"))
    if status == "unread":
        keep.append(~F.col("read"))
    if max_age_days is not None:
        now = F.current_timestamp() if now is None else now
        keep.append(F.col("timestamp") >= now - F.make_dt_interval(F.lit(max_age_days)))
    return reduce(lambda a, b: a & b, keep)


def filter_records(listing: DataFrame, **asked) -> DataFrame:
    """The rows of one filter set; see `record_filter`."""
    return listing.filter(record_filter(**asked))


def filter_by_sets(listing: DataFrame, sets: dict[str, dict], name: str = "view") -> DataFrame:
    """Every row once for each named filter set it passes, in one pass: adds the set's name."""
    passed = [F.when(record_filter(**asked), F.lit(n)) for n, asked in sets.items()]
    return listing.withColumn(name, F.explode(F.filter(F.array(*passed), lambda n: n.isNotNull())))


def filter_min_metric(listing: DataFrame, column: str, minimum: float) -> DataFrame:
    return listing.filter(F.coalesce(F.col(column), F.lit(0)) >= minimum)


def board_lane() -> Column:
    """unread / starred / archived, or null for rows that are only read."""
    return (F.when(F.col("archived"), "archived")
            .when(F.col("starred"), "starred")
            .when(~F.col("read"), "unread"))


def board_lanes(listing: DataFrame) -> DataFrame:
    return listing.withColumn("lane", board_lane()).filter(F.col("lane").isNotNull())


VIEW_FILTERS = {"genre": "genre", "account": "author", "collection": "collection", "model": "arm",
                "tag": "tag", "status": "status"}


def apply_saved_view(listing: DataFrame, view: dict[str, str]) -> DataFrame:
    """One named filter set: its predicates, then its sort (likes by default)."""
    given = {arg: view[key] for key, arg in VIEW_FILTERS.items() if view.get(key)}
    return sort_records(filter_records(listing, **given), view.get("sort") or "likes")


def save_views(views: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert of saved views by name."""
    return views.join(changes.select("name"), "name", "left_anti").unionByName(changes)


def delete_views(views: DataFrame, names: DataFrame) -> DataFrame:
    return views.join(names.select("name"), "name", "left_anti")


def is_text_record() -> Column:
    return ~present("video_path") & (present("caption") | present("transcript_text"))


def route_modality(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text records, media records)."""
    flagged = F.coalesce(is_text_record(), F.lit(False))
    return records.filter(flagged), records.filter(~flagged)


def select_unfinished(records: DataFrame, *, need: str, arm: str | None = None, redo: bool = False,
                      limit: int = 0) -> DataFrame:
    """Media records missing a summary, tags, transcript, or the named arm's variant."""
    missing = {
        "summary": lambda: ~present("summary"),
        "tags": lambda: F.size(F.coalesce(F.col("tags"), empty_strings())) == 0,
        "transcript": lambda: ~present(strip(F.coalesce(F.col("transcript_text"), F.lit("")))),
        "variant": lambda: ~F.coalesce(F.map_contains_key("variants", arm), F.lit(False)),
    }
    out = records.filter(present("video_path"))
    if not redo:
        out = out.filter(missing[need]())
    return out.orderBy("id").limit(limit) if limit else out


def select_by_ids(records: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Records in the order of `wanted(pos, id)`; unknown ids are skipped."""
    return records.join(wanted.select("pos", F.col(key)), key).orderBy("pos")




def filter_candidates(candidates: DataFrame, state: str = "new") -> DataFrame:
    kept = candidates if state == "all" else candidates.filter(F.col("state") == state)
    return kept.orderBy(F.desc("score"), "id")


def split_valid_ids(df: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    ok = valid_id(key)
    return df.filter(ok), df.filter(~ok)


# --- sorts -------------------------------------------------------------------
def sort_keys(sort: str) -> list[Column]:
    epoch = F.lit(0).cast("timestamp")
    when = F.coalesce(F.col("timestamp"), epoch) if sort in ("newest", "oldest") else None
    if sort == "title":
        return [F.col("title").asc(), F.col("id").asc()]
    if sort == "newest":
        return [when.desc(), F.col("id").asc()]
    if sort == "oldest":
        return [when.asc(), F.col("id").asc()]
    if sort == "tokens":
        metric = F.col("tokens_in") + F.col("tokens_out")
    else:
        metric = F.col(sort if sort in ("likes", "comments", "duration") else "likes")
    return [F.coalesce(metric, F.lit(0)).desc(), F.col("id").asc()]


def sort_records(listing: DataFrame, sort: str = "likes") -> DataFrame:
    return listing.orderBy(*sort_keys(sort))


def with_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Adds the 1-based place of every row in the order. The rows are range-sorted once; each then counts from the sizes of
    the ranges before its own, so no task sees more than its range."""
    low = (1 << 33) - 1
    placed = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranges = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (placed.withColumn("_range", F.shiftright("_at", 33)).join(ranges.select("_range", before.alias("_before")), "_range")
            .withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit(low)) + 1).drop("_at", "_range", "_before"))


def sort_any_column(df: DataFrame, column: str, descending: bool = True, key: str = "id") -> DataFrame:
    """Numbers sort as numbers, text as text (null as '')."""
    return df.orderBy(*column_keys(df, column, descending, key))


def column_keys(df: DataFrame, column: str, descending: bool = True, key: str = "id") -> list[Column]:
    numeric = dict(df.dtypes)[column] in ("int", "bigint", "double", "float", "smallint", "tinyint")
    value = F.col(column) if numeric else F.coalesce(F.col(column).cast("string"), F.lit(""))
    return [value.desc() if descending else value.asc(), F.col(key)]


def recent(records: DataFrame, n: int = 8, order: list[Column] | None = None) -> DataFrame:
    """The last n in pool order, newest first."""
    return records.orderBy(*(order or [F.col("id").desc()])).limit(n)


def seeded_order(key: Column | str, seed: int) -> Column:
    return F.md5(F.concat(col(key).cast("string"), F.lit(f":{seed}")))


def random_pending(records: DataFrame, arms: list[str], n: int = 10, seed: int = 0,
                   only_missing: bool = True) -> DataFrame:
    """Seeded draw of 1 to 200 records that lack any requested arm."""
    todo = records
    if only_missing:
        have = F.coalesce(F.map_keys("variants"), empty_strings())
        todo = records.filter(F.size(F.array_except(F.array(*map(F.lit, arms)), have)) > 0)
    return todo.orderBy(seeded_order("id", seed), "id").limit(max(1, min(n, 200)))


# --- edits -------------------------------------------------------------------
def rename_tag(records: DataFrame, old: str, new: str) -> DataFrame:
    """Adds the edited `tags` and a `changed` flag."""
    return (records.withColumn("_tags", renamed_tags("tags", old, new))
            .withColumn("changed", ~F.col("_tags").eqNullSafe(F.col("tags")))
            .withColumn("tags", F.col("_tags")).drop("_tags"))


def missing_arms(records: DataFrame, arms: list[str]) -> DataFrame:
    have = F.coalesce(F.map_keys("variants"), empty_strings())
    return records.select("id", F.array_except(F.array(*map(F.lit, arms)), have).alias("missing"))


def variants_with(old: Column | str, new: Column | str) -> Column:
    """Map union in which the new arms win."""
    return let(col(new), lambda n: F.map_concat(
        F.map_filter(col(old), lambda k, v: ~F.map_contains_key(n, k)), n))


def video_item(media: Column, known_only: bool = False) -> Column:
    """Feed items worth ingesting: no photos, no all-photo carousels; unknown types pass unless asked."""
    kind = media["media_type"]
    if known_only:
        return F.coalesce(kind == 2, F.lit(False))
    has_video = F.coalesce(F.exists(media["carousel_media"], lambda c: c["media_type"] == 2), F.lit(False))
    return ~F.coalesce((kind == 1) | ((kind == 8) & ~has_video), F.lit(False))

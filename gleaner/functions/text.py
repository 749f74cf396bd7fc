"""String columns: cleaning, tags, ids, links, dates, documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import constants as K

# one Unicode white-space character, as Python's str.split sees it
WS = r"(?U:[\s\x{1c}-\x{1f}])"
WS_CHARS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD_CHAR = r"[\p{L}\p{N}_]"
FIRST_LINE = r"^[^\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]*"

def empty_strings() -> Column:
    return F.array().cast("array<string>")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value worked out once per row.

    Inside a lambda a plain column expression is evaluated again for every array element;
    bound as a lambda variable it is not.
    """
    return F.transform(F.array(value), body)[0]


def select_where(df: DataFrame, keys: list[str | Column], value: Column, name: str,
                 keep: Callable[[Column], Column]) -> DataFrame:
    """`keys` and `value` where `keep(value)`, with the value worked out once.

    A filter on a projected expression is pushed below the projection and runs the expression twice;
    an outer generator is a barrier to that. Null values are left out too.
    """
    one = F.array(F.struct(value.alias(name)))
    return df.select(*keys, F.inline_outer(F.filter(one, lambda s: keep(s[name])))).filter(F.col(name).isNotNull())


def explode_once(df: DataFrame, keys: list[str | Column], items: Column | str, pos: str, name: str) -> DataFrame:
    """posexplode of an array expression that is worked out once.

    For a plain explode Spark adds "array is not empty" filters below it, and each evaluates the
    array again; the outer form gets none.
    """
    return df.select(*keys, F.posexplode_outer(items).alias(pos, name)).filter(F.col(pos).isNotNull())


def present(c: Column | str) -> Column:
    """Truthiness of a text column: neither null nor empty."""
    return F.coalesce(col(c), F.lit("")) != ""


def or_else(c: Column | str, fallback: Column | str) -> Column:
    """The text, or the fallback where it is null or empty."""
    fb = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(present(c), col(c)).otherwise(fb)


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WS_CHARS))


def squash(c: Column | str) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(col(c), WS + "+", " ")


def words(c: Column | str) -> Column:
    return F.filter(F.split(col(c), WS + "+"), lambda w: w != "")


def alnum_key(c: Column | str) -> Column:
    """Lower case, ASCII letters and digits only: the key markers compare on."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]", "")


# --- tags --------------------------------------------------------------------
TAG_STRETCH = 32


def slugs(raw: Column) -> Column:
    """The tags of an array as slugs, those without any character left out.

    They are cleaned as one NUL-separated string: a few passes over a string are far cheaper than the same expressions once per
    array element.
    """
    sep = "\\x{0}"
    joined = F.array_join(F.transform(raw, lambda t: F.replace(t, F.lit("\0"), F.lit(""))), "\0")
    found = F.regexp_replace(F.lower(joined), f"{WS}*{sep}{WS}*", "\0")
    found = F.regexp_replace(strip(found), WS + "+", "-")
    found = F.regexp_replace(found, f"[^a-z0-9{sep}-]", "")
    found = F.regexp_replace(found, f"-*(?:{sep}-*)+", "\0")
    return F.filter(F.split(F.btrim(found, F.lit("-\0")), sep), lambda s: s != "")


def normalise_tags(raw: Column | str, limit: int = K.MAX_TAGS) -> Column:
    """Lower case, white space to hyphens, ASCII slugs only, no repeats, the first `limit`.

    The array is read in stretches until `limit` are found, so a long list costs what its first few tags cost.
    """
    def read(tags: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(tags), F.lit(1)), F.lit(TAG_STRETCH))
        return F.aggregate(starts, empty_strings(), lambda found, at: F.when(F.size(found) >= limit, found).otherwise(
            F.slice(F.array_union(found, slugs(F.slice(tags, at, TAG_STRETCH))), 1, limit)))

    return F.coalesce(let(col(raw), read), empty_strings())


def renamed_tags(tags: Column | str, old: str, new: str) -> Column:
    """`old` becomes `new` in place; merges into an existing `new`; empty `new` deletes.

    The new tag takes the first place `old` had unless `new` is already there.
    """
    old, new = old.strip().lower(), new.strip().lower()

    def without(tags: Column) -> Column:
        return F.filter(tags, lambda t: t != old)

    def folded(tags: Column) -> Column:
        return F.filter(tags, lambda t, i: (t != old) | (F.array_position(tags, old) == i + 1))

    def edited(tags: Column) -> Column:
        if not new:
            return without(tags)
        if new == old:
            return folded(tags)
        placed = F.transform(folded(tags), lambda t: F.when(t == old, F.lit(new)).otherwise(t))
        return (F.when(~F.array_contains(tags, old), tags)
                .when(F.array_contains(tags, new), without(tags)).otherwise(placed))

    return let(col(tags), edited)


# --- captions, links, markers ------------------------------------------------
def hashtags(caption: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(col(caption), F.lit("")), F.lit(f"#({WORD_CHAR}+)"), F.lit(1))


def mentions(caption: Column | str) -> Column:
    return F.regexp_extract_all(
        F.coalesce(col(caption), F.lit("")), F.lit(r"@([\p{L}\p{N}_.]+)"), F.lit(1))


def caption_title(caption: Column | str, record_id: Column | str, chars: int = 120) -> Column:
    first = F.substring(F.regexp_extract(col(caption), FIRST_LINE, 0), 1, chars)
    return F.when(present(caption), first).otherwise(col(record_id))


def extract_links(url: Column | str, *texts: Column | str) -> Column:
    """The record's own url first, then every url or bare domain path in the texts."""
    body = F.concat_ws("\n", *[F.coalesce(col(t), F.lit("")) for t in texts])
    found = F.transform(
        F.regexp_extract_all(body, F.lit(K.LINK), F.lit(0)),
        lambda h: F.when(h.startswith("http"), h).otherwise(F.concat(F.lit("https://"), h)))
    return F.array_distinct(F.concat(F.array(col(url)), found))


def marker_kind(marker: Column | str) -> Column:
    m = col(marker)
    return (F.when(~m.startswith("#"), "link")
            .when(F.lower(m).rlike("|".join(K.SPONSOR_WORDS)), "sponsorship")
            .otherwise("tag"))


# --- markup, dates, ids ------------------------------------------------------
def clean_markup(c: Column | str) -> Column:
    return strip(squash(F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", " ")))


_WEEKDAY = "^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), "


def parse_date(c: Column | str) -> Column:
    """First format that fits: ISO date-time with zone, mail date, plain date; else null.

    A date without a zone is read as UTC (the session zone).
    """
    s = strip(col(c))
    mail = F.when(s.rlike(_WEEKDAY), F.regexp_replace(
        F.regexp_replace(s, _WEEKDAY, ""), " (GMT|UTC)$", " +0000"))

    def tried(value: Column, fmt: str) -> Column:
        return F.try_to_timestamp(value, F.lit(fmt))

    return F.coalesce(
        tried(s, "yyyy-MM-dd'T'HH:mm:ssXXX"),
        tried(s, "yyyy-MM-dd'T'HH:mm:ssXX"),
        tried(mail, "d MMM yyyy HH:mm:ss XX"),
        tried(mail, "d MMM yyyy HH:mm:ss XXX"),
        tried(s, "yyyy-MM-dd"))


def stable_id(kind: Column | str, url: Column | str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.substring(kind, 1, 2), F.lit("_"), F.substring(F.sha1(col(url)), 1, 14))


def slugify(name: Column | str) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(strip(col(name))), "[^a-z0-9]+", "-"), F.lit("-"))
    return or_else(slug, "collection")


def url_record_id(url: Column | str) -> Column:
    """Id in a permalink, else the last 20 characters of the url with other runs as `_`."""
    u = col(url)
    found = F.regexp_extract(u, K.PERMALINK_ID, 1)
    flat = F.regexp_replace(u, r"[^\p{L}\p{N}_]+", "_")
    return or_else(found, F.right(flat, F.lit(20)))


def url_last_part(url: Column | str) -> Column:
    return F.element_at(F.split(F.rtrim(col(url), F.lit("/")), "/"), -1)


def url_collection(url: Column | str) -> Column:
    """struct(slug, id) of a saved-collection url or a bare number; null when neither."""
    u = col(url)
    number = F.regexp_extract(u, K.COLLECTION_PATH, 2)
    return (F.when(u.rlike(r"^[0-9]+\z"), F.struct(u.alias("slug"), u.alias("id")))
            .when(number != "", F.struct(
                slugify(F.regexp_extract(u, K.COLLECTION_PATH, 1)).alias("slug"), number.alias("id"))))


def url_profile(url: Column | str) -> Column:
    u = col(url)
    found = F.regexp_extract(u, K.PROFILE_PATH, 1)
    return F.btrim(or_else(found, u), F.lit("/@"))


def valid_id(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(K.VALID_ID), F.lit(False))


# --- index documents ---------------------------------------------------------
def structured_lines(structured: Column | str) -> Column:
    """`key: a; b` for list values, `key: value` for others; blank values dropped.

    `structured` is a map whose values are JSON text for lists and plain text otherwise.
    """
    entries = F.map_entries(F.coalesce(col(structured), F.create_map().cast("map<string,string>")))

    def line(e: Column) -> Column:
        items = F.from_json(e["value"], "array<string>")
        listed = e["value"].startswith("[") & items.isNotNull()
        return (F.when(listed, F.concat(e["key"], F.lit(": "), F.array_join(items, "; ")))
                .when(present(e["value"]), F.concat(e["key"], F.lit(": "), e["value"])))

    return F.filter(F.transform(entries, line), lambda x: x.isNotNull())


def record_document(title, genre, summary, structured, transcript) -> Column:
    parts = F.concat(
        F.array(*[F.coalesce(col(c), F.lit("")) for c in (title, genre, summary)]),
        structured_lines(structured) if structured is not None else empty_strings(),
        F.array(F.coalesce(col(transcript), F.lit(""))))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def document_hash(document: Column | str, fact_texts: Column | str) -> Column:
    texts = F.concat(F.array(col(document)), F.coalesce(col(fact_texts), empty_strings()))
    return F.substring(F.sha1(F.array_join(texts, "\x00")), 1, 16)


def clock(seconds: Column | str) -> Column:
    """`m:ss`, or a dash when unknown."""
    s = col(seconds).cast("bigint")
    return F.when(s.isNull(), F.lit("—")).otherwise(
        F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0")))

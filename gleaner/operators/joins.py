"""Lookups between tables: annotations, collections, pools, ledgers, indexes.

All are equi-joins. No side is force-broadcast: the size-based broadcast and the
skew-join splitting are left to Catalyst and AQE, which see the real sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import empty_strings, let, present
from gleaner.operators.prefix import running_rank

FLAGS = ("starred", "read", "archived")


def with_annotations(listing: DataFrame, annotations: DataFrame) -> DataFrame:
    """Left join of the user's flags; a row never annotated has all flags off."""
    joined = listing.join(annotations.select("id", *FLAGS), "id", "left")
    return joined.select(*listing.columns, *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in FLAGS])


def invert_membership(membership: DataFrame, key: str = "record_id") -> DataFrame:
    """record -> sorted distinct collection slugs."""
    return membership.groupBy(key).agg(F.sort_array(F.collect_set("slug")).alias("collections"))


def with_collections(rows: DataFrame, membership: DataFrame, key: str = "id") -> DataFrame:
    """Rows of any table keyed by record, with their collection slugs (empty when in none)."""
    shelves = invert_membership(membership).withColumnRenamed("record_id", key)
    return (rows.join(shelves, key, "left")
            .withColumn("collections", F.coalesce("collections", empty_strings())))


def hits_with_collections(hits: DataFrame, membership: DataFrame) -> DataFrame:
    """Search hits with their shelves; only memberships of hit records are inverted."""
    mine = membership.join(hits.select("record_id").distinct(), "record_id", "left_semi")
    return with_collections(hits, mine, "record_id")


def collection_records(membership: DataFrame, records: DataFrame) -> DataFrame:
    """(slug, pos, record columns); members missing from the pool are skipped."""
    return membership.join(records.withColumnRenamed("id", "record_id"), "record_id")


def new_ids(current: DataFrame, pool: DataFrame, dead: DataFrame) -> DataFrame:
    """current(source, id) without what is pooled or dead-lettered for that source."""
    return (current.join(pool.select("id"), "id", "left_anti")
            .join(dead.select("source", "id"), ["source", "id"], "left_anti"))


def index_gap(records: DataFrame, index_rows: DataFrame) -> DataFrame:
    """One row: how many pooled records are indexed, how many are not, and whether all are."""
    indexed = index_rows.select(F.col("record_id").alias("id")).distinct().withColumn("_in", F.lit(True))
    return (records.select("id").join(indexed, "id", "left")
            .agg(F.count_if(F.col("_in").isNotNull()).alias("indexed"),
                 F.count_if(F.col("_in").isNull()).alias("not_indexed"))
            .withColumn("ok", F.col("not_indexed") == 0))


def first_occurrence(df: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """First row per key. The limit of 1 is applied before the shuffle, so hot keys stay small."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def unseen_candidates(harvested: DataFrame, pool: DataFrame, store: DataFrame) -> DataFrame:
    """Harvested(id, pos, …) not pooled and not proposed before; first occurrence wins."""
    fresh = (harvested.join(pool.select("id"), "id", "left_anti")
             .join(store.select("id"), "id", "left_anti"))
    return first_occurrence(fresh, ["id"], ["pos"])


def fill_missing_handle(records: DataFrame, handles: DataFrame) -> DataFrame:
    """Sets `author_handle` only where it is empty; `filled` marks the edited rows."""
    joined = records.join(handles.select("id", F.col("handle").alias("_handle")), "id", "left")
    filled = ~present("author_handle") & present("_handle")
    return (joined.withColumn("filled", filled)
            .withColumn("author_handle", F.when(filled, F.col("_handle")).otherwise(F.col("author_handle")))
            .drop("_handle"))


def sources_with_state(sources: DataFrame, state: DataFrame) -> DataFrame:
    return sources.join(state.select("name", "last_run", F.col("last_current").alias("records")), "name", "left")


def enabled_sources(sources: DataFrame, only: DataFrame | None = None) -> DataFrame:
    kept = sources.filter("enabled")
    return kept if only is None else kept.join(only.select("name"), "name", "left_semi")


def arm_catalog(declared: DataFrame, registry: DataFrame, implicit: DataFrame) -> DataFrame:
    """(name, kind, model, installed, notes): declared beats registry beats implicit.

    declared(name, kind, model, notes), registry(name, tag, installed, role), implicit(name).
    """
    full = (declared.select("name", F.lit(True).alias("_d"), "kind", "model", "notes")
            .join(registry.select("name", F.lit(True).alias("_r"), "tag", "installed", "role"), "name", "full")
            .join(implicit.select("name", F.lit(True).alias("_i")), "name", "full"))
    kind = (F.when(F.col("_d"), F.col("kind"))
            .when(F.col("_r") | (F.col("name") == "local"), "local").otherwise(F.col("name")))
    text = lambda a, b: F.when(present(a), F.col(a)).otherwise(F.coalesce(F.col(b), F.lit("")))
    return full.select(
        "name", kind.alias("kind"), text("model", "tag").alias("model"),
        F.coalesce("installed", F.lit(True)).alias("installed"), text("notes", "role").alias("notes"),
        F.when(F.col("_d"), 0).when(F.col("_r"), 1).otherwise(2).alias("priority"))


def collection_members_from_feed(items: DataFrame, collections: DataFrame, block: Column | None = None) -> DataFrame:
    """(slug, pos, id): the feed's items by the collection ids they carry, all collections in one pass.

    items(id, pos, collection_ids), collections(slug, id, limit). First occurrence of an item counts;
    `limit` is the source's own cap; a null one is no cap. `block` rises with `pos` and cuts a long feed into pieces of a
    task's size.
    """
    tagged = items.select("id", "pos", F.explode(F.array_distinct("collection_ids")).alias("_cid"))
    mine = tagged.join(collections.select("slug", F.col("id").alias("_cid"), "limit"), "_cid")
    once = mine.groupBy("slug", "id", "limit").agg(F.min("pos").alias("pos"))
    capped = running_rank(once.filter("limit IS NOT NULL").withColumn("_block", F.lit(0) if block is None else block), ["slug"], ["_block"], ["pos"], "_rn")
    return (capped.filter("_rn <= limit").select("slug", "pos", "id")
            .unionByName(once.filter("limit IS NULL").select("slug", "pos", "id")))


def keep_cited(sources: Column, answer: Column, cite: Column) -> Column:
    """In-row: the cited sources when the answer cites at least one of them, else all of them."""
    used = let(cite, lambda c: F.filter(sources, lambda s: F.array_contains(c, s["id"])))
    return F.when(answer.isNotNull() & (F.size(used) > 0), used).otherwise(sources)


def index_reuse_split(rows: DataFrame, stored: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Index rows with `stored_vec` where record, row and document hash still match, else null.

    Rows of records gone from the pool fall out because `rows` drives the join. Both sides may have columns `also` that follow from
    the record, by which they are dealt already.
    """
    keys = [*also, "record_id", "row_pos", "doc_hash"]
    # what an inner join on them would ask for too, so that Spark sees the same rows in either
    usable = F.col("doc_hash").isNotNull() & F.col("row_pos").isNotNull() & F.col("vec").isNotNull()
    old = stored.filter(usable).select(*keys, F.col("vec").alias("stored_vec"))
    return rows.join(old, keys, "left")

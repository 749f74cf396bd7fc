"""Incremental sync in batch form: diffs, ledgers, dead letters, keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.text import empty_strings, present
from gleaner.operators.joins import FLAGS
from gleaner.operators.records import variants_with


def sync_result(current: DataFrame, pool: DataFrame, dead: DataFrame, landed: DataFrame) -> DataFrame:
    """Per source: current, new, skipped, ingested, failed. One pass over flagged ids.

    current(source, id), pool(id), dead(source, id), landed(id) = the pool after the run.
    """
    flagged = flag_ids(current, pool, dead, landed)
    return flagged.groupBy("source").agg(
        F.count(F.lit(1)).alias("current"), F.count_if("is_new").alias("new"),
        F.count_if(~F.col("is_new")).alias("skipped"),
        F.count_if(F.col("is_new") & F.col("landed")).alias("ingested"),
        F.count_if(F.col("is_new") & ~F.col("landed")).alias("failed"))


def flag_ids(current: DataFrame, pool: DataFrame, dead: DataFrame, landed: DataFrame) -> DataFrame:
    """current(source, id) with `is_new` and `landed`."""
    yes = F.lit(True)
    return (current.select("source", "id")
            .join(pool.select("id").distinct().withColumn("_p", yes), "id", "left")
            .join(dead.select("source", "id").distinct().withColumn("_d", yes), ["source", "id"], "left")
            .join(landed.select("id").distinct().withColumn("_l", yes), "id", "left")
            .select("source", "id", (F.col("_p").isNull() & F.col("_d").isNull()).alias("is_new"),
                    F.col("_l").isNotNull().alias("landed")))


def advance_ids(known: DataFrame, found: DataFrame) -> DataFrame:
    """Union of two (source, id) tables."""
    return known.select("source", "id").unionByName(found.select("source", "id")).distinct()


def advance_dead(dead: DataFrame, failed: DataFrame, retry: DataFrame | None = None) -> DataFrame:
    """Dead letters carried forward plus this run's failures; sources in `retry` start empty."""
    kept = dead if retry is None else dead.join(retry.select("source"), "source", "left_anti")
    return advance_ids(kept, failed)


def advance_ledger(state: DataFrame, results: DataFrame, run_date: str | Column) -> DataFrame:
    """state(name, last_run, runs, last_current, last_new, last_ingested, error) after one sync.

    Sources not polled keep their row. A rate-limited source keeps its counts and notes the error.
    """
    run_date = F.lit(run_date) if isinstance(run_date, str) else run_date
    r = results.select(F.col("source").alias("name"), F.lit(True).alias("_polled"),
                       F.coalesce("rate_limited", F.lit(False)).alias("_limited"),
                       F.col("current").alias("_c"), F.col("new").alias("_n"), F.col("ingested").alias("_i"),
                       F.coalesce("error", F.lit("")).alias("_e"))
    j = state.join(r, "name", "full")
    polled = F.coalesce("_polled", F.lit(False))
    fresh = polled & ~F.coalesce("_limited", F.lit(False))
    pick = lambda new, old: F.when(fresh, F.col(new)).otherwise(F.coalesce(old, F.lit(0))).cast("bigint").alias(old)
    return j.select(
        "name", F.when(polled, run_date).otherwise(F.col("last_run")).alias("last_run"),
        (F.coalesce("runs", F.lit(0)) + polled.cast("int")).cast("bigint").alias("runs"),
        pick("_c", "last_current"), pick("_n", "last_new"), pick("_i", "last_ingested"),
        F.when(polled, F.col("_e")).otherwise(F.coalesce("error", F.lit(""))).alias("error"))


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Keyed merge: the last change of a key wins, columns not in `changes` stay as they are."""
    cols = [c for c in changes.columns if c not in (key, order)]
    latest = changes.select(key, F.struct(*cols).alias("_new"), *([order] if order else []))
    if order:
        latest = latest.groupBy(key).agg(F.max_by("_new", order).alias("_new"))
    joined = current.join(latest, key, "full")
    changed = F.col("_new").isNotNull()
    return joined.select(key, *[
        (F.when(changed, F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in cols else F.col(c))
        for c in current.columns if c != key])


def patch_annotations(annotations: DataFrame, patches: DataFrame) -> DataFrame:
    """annotations(id, starred, read, archived, note) merged with patches of the same shape.

    A null in a patch leaves the stored value alone; notes are cut at 2000 characters.
    """
    p = patches.select("id", *[F.col(f).alias(f"_{f}") for f in FLAGS],
                       F.substring("note", 1, K.NOTE_CHARS).alias("_note"))
    return annotations.join(p, "id", "full").select(
        "id", *[F.coalesce(f"_{c}", c).alias(c) for c in (*FLAGS, "note")])


def union_sources(media: DataFrame, text: DataFrame) -> DataFrame:
    """One record table from media and text sources; columns a side lacks are null."""
    return media.unionByName(text, allowMissingColumns=True)




def set_candidate_state(store: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store after the transitions, changes whose id is unknown). changes(id, new_state)."""
    moved = store.join(changes, "id", "left").withColumn("state", F.coalesce("new_state", "state")).drop("new_state")
    return moved, changes.join(store.select("id"), "id", "left_anti")


def accept_queue(store: DataFrame, queued: DataFrame) -> DataFrame:
    """Urls of accepted candidates not queued yet, each once."""
    return store.filter("state = 'accepted'").select("url").distinct().join(queued.select("url"), "url", "left_anti")


# --- promotion of a fresh variant --------------------------------------------
def promote_variant(records: DataFrame, arm: str) -> DataFrame:
    """Makes the arm's stored variant the active one where it is better, else fills what is missing.

    Better: it adds key points or overlay lines, has a summary, and lists at least as many facts. The
    replaced record is archived as a variant under its own backend name first. `outcome` is promoted,
    enriched or unchanged.
    """
    v = F.try_element_at("variants", F.lit(arm))
    some = lambda a: F.coalesce(F.array_size(a), F.lit(0)) > 0
    size = lambda a: F.coalesce(F.array_size(a), F.lit(0))
    better = (v.isNotNull() & (some(v["key_points"]) | some(v["on_screen_text"])) & present(F.trim(v["summary"]))
              & (size(v["facts"]) >= size("facts")))
    t = F.col("tokens")
    name = F.when(present(t["backend"]), t["backend"]).otherwise("previous")
    name = F.when(F.map_contains_key("variants", name), F.concat(name, F.lit("-prev"))).otherwise(name)
    variant_type = records.schema["variants"].dataType.valueType
    old = {"backend": name, "model": F.coalesce(t["model"], F.lit("")), "elapsed_s": F.lit(0.0),
           "frames": F.lit(0), "created_at": F.lit("archived")}
    archived = F.struct(*[old.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in variant_type.fields])
    kept = F.when(better, variants_with("variants", F.create_map(name, archived))).otherwise(F.col("variants"))
    fill = lambda c: F.when(~some(F.col(c)) & some(v[c]), v[c]).otherwise(F.col(c))
    enriched = v.isNotNull() & ((~some("key_points") & some(v["key_points"]))
                                | (~some("on_screen_text") & some(v["on_screen_text"])))
    size_map = F.coalesce(F.size(F.map_keys(v["structured"])), F.lit(0))
    active = {
        "summary": F.when(better, v["summary"]).otherwise(F.col("summary")),
        "genre": F.when(better & present(v["genre"]), v["genre"]).otherwise(F.col("genre")),
        "tags": F.when(better & some(v["tags"]), v["tags"]).otherwise(F.col("tags")),
        "structured": F.when(better & (size_map > 0), v["structured"]).otherwise(F.col("structured")),
        "key_points": F.when(better, F.coalesce(v["key_points"], empty_strings())).otherwise(fill("key_points")),
        "on_screen_text": F.when(better, F.coalesce(v["on_screen_text"], empty_strings()))
        .otherwise(fill("on_screen_text")),
        "facts": F.when(better, v["facts"]).otherwise(F.col("facts")),
        "tokens": F.when(better, v["tokens"]).otherwise(t),
        "variants": kept,
    }
    outcome = F.when(better, "promoted").when(enriched, "enriched").otherwise("unchanged")
    return records.select(*[active.get(c, F.col(c)).alias(c) for c in records.columns], outcome.alias("outcome"))

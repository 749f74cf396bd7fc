"""Tables in folders: what a change rewrites, and that the result is that of rewriting all."""

import os
import re

import pytest
from pyspark.sql import functions as F

from gleaner.operators import vectors as E
from gleaner.operators.sync import upsert
from gleaner.session import shared_folder
from gleaner.sources import folders


def files(path):
    return {part: sorted(f for f in os.listdir(f"{path}/{part}") if f.endswith(".parquet")) for part in os.listdir(path) if part.startswith("part=")}


def changed(before, after):
    return sorted(int(p.removeprefix("part=")) for p in after if before.get(p) != after[p])


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_one_changed_row_rewrites_one_folder(spark, tmp_path):
    path = str(tmp_path / "t")
    cur = spark.createDataFrame([(f"R{i}", f"t{i}", i) for i in range(200)], "id string, title string, likes long")
    folders.write_folders(cur, path, "id", 16)
    before = files(path)
    changes = spark.createDataFrame([("R7", "new", 1), ("R7", "newer", 2), (None, "lost", 3)], "id string, title string, seq int")
    touched = folders.upsert_records(changes, path, cur.schema, "seq", parts=16)
    assert len(touched) == 1 and changed(before, files(path)) == touched
    got = folders.read_folders(spark, path, cur.schema, "id").drop("part")
    assert rows(got) == rows(upsert(cur, changes.filter("id IS NOT NULL"), "id", "seq"))
    assert rows(got.filter("id = 'R7'")) == ["('R7', 'newer', 7)"]


def test_into_nothing_and_nothing_into_it(spark, tmp_path):
    path = str(tmp_path / "t")
    changes = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    folders.upsert_records(changes, path, changes.schema, parts=4)
    before = files(path)
    assert folders.upsert_records(changes.limit(0), path, changes.schema, parts=4) == [] and files(path) == before
    assert rows(folders.read_folders(spark, path, changes.schema, "id").drop("part")) == rows(changes)


@pytest.fixture
def records(spark):
    kind = "id string, title string, url string, genre string, summary string, structured map<string,string>, transcript_text string, " \
           "facts array<struct<text:string,timestamp:double,frame:int>>"
    return spark.createDataFrame([(f"R{i}", f"t{i}", "u", "g", f"words of {i}", {}, "", [(f"fact {i}", 1.0, 1)]) for i in range(60)], kind)


def test_index_follows_the_records(spark, tmp_path, records):
    path = str(tmp_path / "i")
    embed = E.hashing_embedder(16)
    schema = E.build_index(records.limit(0), embed).schema
    index = lambda: folders.read_index(spark, path, schema)
    plain = lambda df: rows(df.drop("reused"))
    assert folders.update_index(records, embed, path, parts=12) == sorted({r[0] for r in records.select(folders.part_of("id", 12)).collect()})
    assert plain(index()) == plain(E.build_index(records, embed))
    before = files(path)
    assert folders.update_index(records, embed, path, parts=12) == [] and files(path) == before
    # one text changed, one title only, one dropped, one added
    edited = records.withColumn("summary", F.when(F.col("id") == "R3", "other words").otherwise(F.col("summary"))) \
        .withColumn("title", F.when(F.col("id") == "R4", "other title").otherwise(F.col("title"))).filter("id <> 'R5'")
    edited = edited.unionByName(records.filter("id = 'R6'").withColumn("id", F.lit("R99")))
    touched = folders.update_index(edited, embed, path, parts=12)
    ids = spark.createDataFrame([(i,) for i in ("R3", "R4", "R5", "R99")], "id string")
    assert touched == folders.touched_parts(ids, "id", 12) == changed(before, files(path))
    assert plain(index()) == plain(E.build_index(edited, embed))
    # rows of touched folders that are still right keep their vectors
    assert {r.record_id for r in index().filter("NOT reused").collect()} >= {"R3", "R99"}
    assert index().filter("reused").count() > 0


def test_a_folder_may_become_empty(spark, tmp_path, records):
    path = str(tmp_path / "i")
    embed = E.hashing_embedder(16)
    schema = E.build_index(records.limit(0), embed).schema
    folders.update_index(records, embed, path, parts=3)
    folders.update_index(records.filter(folders.part_of("id", 3) != 1), embed, path, parts=3)
    left = folders.read_index(spark, path, schema)
    assert left.filter(folders.part_of("record_id", 3) == 1).count() == 0 and left.count() > 0


def test_rows_are_not_written_twice(spark, tmp_path, records):
    """What replaces the folders is no copy of a table written elsewhere first."""
    kept = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(kept)) if os.path.isdir(kept) else set()
    path, embed = str(tmp_path / "i"), E.hashing_embedder(16)
    folders.update_index(records.filter("id < 'R3'"), embed, path, parts=4)
    folders.update_index(records, embed, path, parts=4)
    assert not [x for x in (os.listdir(kept) if os.path.isdir(kept) else []) if x not in before and x.startswith("folders")]
    index = folders.read_index(spark, path, E.build_index(records.limit(0), embed).schema)
    assert rows(index.drop("reused")) == rows(E.build_index(records, embed).drop("reused"))


def test_records_and_stored_rows_are_dealt_once(spark, tmp_path, records, monkeypatch):
    """Neither the exploded rows with their texts nor the vectors embedded anew are exchanged."""
    seen, replace = [], folders.replace_folders
    monkeypatch.setattr(folders, "replace_folders", lambda df, *a: (seen.append(df._jdf.queryExecution().executedPlan().toString()), replace(df, *a)))
    path, embed = str(tmp_path / "i"), E.hashing_embedder(16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    try:
        folders.update_index(records.filter("id < 'R3'"), embed, path, parts=4)
        folders.update_index(records, embed, path, parts=4)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [re.sub(r"#\d+", "", x) for x in re.findall(r"hashpartitioning\(([^)]*), \d+\)", seen[-1])]
    assert set(dealt) == {"part, _own"} and "SortMergeJoin" in seen[-1]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    # rows that repeat meet all stored rows of their key, as they did
    twice = records.unionByName(records)
    folders.update_index(twice, embed, path, parts=4)
    index = folders.read_index(spark, path, E.build_index(records.limit(0), embed).schema)
    assert rows(index) == rows(E.build_index(twice, embed, E.build_index(records, embed)))

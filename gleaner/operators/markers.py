"""Markers (urls, handles, hashtags, read lines) and how many of them a variant reproduces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.facts import exclusive_markers
from gleaner.functions.text import alnum_key, col, empty_strings, marker_kind, select_where, strip
from gleaner.operators.prefix import running_total


def _text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def caption_only_markers(records: DataFrame, pattern: str = K.MARKER) -> DataFrame:
    """(record_id, markers): markers a reader could only know from the caption."""
    elsewhere = alnum_key(F.concat(
        _text("transcript_text"), F.array_join(F.coalesce("on_screen_text", empty_strings()), " "), _text("title")))
    found = F.regexp_extract_all(_text("caption"), F.lit(pattern), F.lit(0))
    return select_where(records, [F.col("id").alias("record_id")],
                        exclusive_markers(found, elsewhere, K.CAPTION_MARKER_MIN), "markers", lambda m: F.size(m) > 0)


def ocr_only_markers(records: DataFrame) -> DataFrame:
    """(record_id, markers): read lines that neither caption, transcript nor title contain (first 40)."""
    elsewhere = alnum_key(F.concat(_text("caption"), _text("transcript_text"), _text("title")))
    markers = exclusive_markers(F.coalesce("ocr_text", empty_strings()), elsewhere, K.OCR_MARKER_MIN, K.OCR_MARKER_MAX)
    return select_where(records, [F.col("id").alias("record_id")], F.transform(markers, strip), "markers",
                        lambda m: F.size(m) > 0)


def variant_text() -> Column:
    """Everything a variant says, as one comparison key."""
    texts = F.concat(
        F.array(_text("summary")), F.coalesce("key_points", empty_strings()),
        F.transform("facts", lambda f: f["text"]), F.coalesce("on_screen_text", empty_strings()),
        F.coalesce("tags", empty_strings()), F.array(_text(F.to_json("structured"))))
    return alnum_key(F.array_join(texts, " "))


def arm_texts(turns: DataFrame, markers: DataFrame, size: int = 4_096) -> DataFrame:
    """(record_id, arm, key): what an arm says in all its turns, one after another, for the records that have markers.

    turns(record_id, arm, pos, key), markers(record_id, markers). A long text comes as several rows; these overlap by one less than
    the record's longest marker, so every marker that stands in the text stands in a row, also one that goes over several turns.
    """
    longest = markers.select("record_id", F.explode("markers").alias("m")).groupBy("record_id").agg(F.max(F.length(alnum_key("m"))).alias("_longest"))
    blocks = turns.withColumn("_block", F.expr("pos div 1000")).withColumn("_n", F.length("key"))
    placed = running_total(blocks, ["record_id", "arm"], ["_block"], ["pos", "key"], F.col("_n"), "_end").join(longest, "record_id").withColumn(
        "_start", F.col("_end") - F.col("_n")).withColumn("_size", F.greatest(F.lit(size), "_longest"))
    first = F.greatest(F.lit(0), F.expr("(_start - _longest + 1) div _size"))
    last = F.expr("greatest(_end - 1, _start) div _size")
    cut = placed.withColumn("_row", F.explode(F.sequence(first, last))).withColumn("_from", F.greatest("_start", F.col("_row") * F.col("_size")))
    upto = F.least("_end", (F.col("_row") + 1) * F.col("_size") + F.col("_longest") - 1)
    piece = F.substring("key", (F.col("_from") - F.col("_start") + 1).cast("int"), (upto - F.col("_from")).cast("int"))
    pieces = F.sort_array(F.collect_list(F.when(F.length(piece) > 0, F.struct("_from", piece.alias("x")))))
    return cut.groupBy("record_id", "arm", "_row").agg(pieces.alias("p")).select(
        "record_id", "arm", F.array_join(F.transform("p", lambda x: x["x"]), "").alias("key"))


def marker_hits(markers: DataFrame, variants: DataFrame) -> DataFrame:
    """(record_id, arm, marker, kind, found): one row per marker and stored variant.

    variants(record_id, arm, key) carry their text as a `variant_text` key.
    """
    joined = markers.join(variants.select("record_id", "arm", "key"), "record_id")
    return (joined.select("record_id", "arm", "key", F.explode("markers").alias("marker"))
            .select("record_id", "arm", "marker", marker_kind("marker").alias("kind"),
                    F.contains(F.col("key"), alnum_key("marker")).alias("found")))


def complete_records(runs: DataFrame, arms: list[str]) -> DataFrame:
    """record_id of records that succeeded under every one of `arms`."""
    return (runs.filter(F.col("ok") & F.col("arm").isin(arms)).groupBy("record_id").agg(F.count_distinct("arm").alias("n"))
            .filter(F.col("n") == len(arms)).select("record_id"))


def marker_recall(hits: DataFrame, runs: DataFrame, arms: list[str]) -> DataFrame:
    """(arm, kind, markers, found, recall), `kind` null for all kinds together; a kind without markers has a null recall.

    runs(record_id, arm, ok): only records that succeeded under every one of `arms` count.
    """
    complete = complete_records(runs, arms)
    counts = (hits.filter(F.col("arm").isin(arms)).join(complete, "record_id", "left_semi")
              .groupingSets([("arm",), ("arm", "kind")], "arm", "kind")
              .agg(F.count(F.lit(1)).alias("markers"), F.count_if("found").alias("found")))
    every = hits.sparkSession.createDataFrame([(a, k) for a in arms for k in (*K.MARKER_KINDS, None)], "arm string, kind string")
    same = (F.col("e.arm") == F.col("c.arm")) & F.col("e.kind").eqNullSafe(F.col("c.kind"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (every.alias("e").join(counts.alias("c"), same, "left").select("e.arm", "e.kind", zero("markers"), zero("found"))
            .withColumn("recall", F.try_divide("found", "markers")))


MEANS = ("facts", "on_screen", "summary_chars", "seconds")


def variant_means(measures: DataFrame, runs: DataFrame, arms: list[str]) -> DataFrame:
    """(arm, records, mean of facts, overlay lines, summary characters and seconds) over the records `marker_recall` counts.

    measures(record_id, arm, facts, on_screen, summary_chars, seconds).
    """
    return (measures.filter(F.col("arm").isin(arms)).join(complete_records(runs, arms), "record_id", "left_semi")
            .groupBy("arm").agg(F.count(F.lit(1)).alias("records"), *[F.avg(c).alias(f"mean_{c}") for c in MEANS]))

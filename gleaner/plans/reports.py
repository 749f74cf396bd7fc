"""Composite reports: the bench report, question batches and answer batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.prompts import question_request
from gleaner.operators.attempts import attempt_notes, attempt_stats
from gleaner.operators.facets import top_n_per_group
from gleaner.operators.joins import hits_with_collections, keep_cited
from gleaner.operators.matching import (arm_agreement, disagreement_examples, match_facts, scoreboard)
from gleaner.operators.ranking import best_hit_per_record
from gleaner.operators.vectors import nearest
from gleaner.session import cut_lineage


def question_batch(questions: DataFrame, sources: DataFrame, turns: DataFrame, instruction: str, k: int = 8) -> DataFrame:
    """(question_id, request) from questions(question_id, conv_id, question).

    Of sources(question_id, rank, id, title, text) the first k of each question are used, of
    turns(conv_id, turn, role, content) the last six of each conversation.
    """
    last = top_n_per_group(turns, ["conv_id"], [F.desc("turn")], K.HISTORY_TURNS)
    history = last.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("_h"))
    best = top_n_per_group(sources, ["question_id"], ["rank"], k, "_rn").drop("_rn")
    blocks = best.groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "title", "text"))).alias("_s"))
    empty_s = F.array().cast("array<struct<rank:int,id:string,title:string,text:string>>")
    empty_h = F.array().cast("array<struct<turn:bigint,role:string,content:string>>")
    joined = questions.join(blocks, "question_id", "left").join(history, "conv_id", "left")
    return joined.select("question_id", question_request(
        F.coalesce("_s", empty_s), F.coalesce("_h", empty_h), "question", instruction).alias("request"))


def retrieve(queries: DataFrame, index: DataFrame, k: int = 8) -> DataFrame:
    """Best hit per record for every query: (question_id, record_id, rank, score, title, url, text, timestamp).

    queries(id, vec); index(id, record_id, title, url, text, timestamp, vec).
    """
    hits = nearest(queries, index, k).withColumnRenamed("query_id", "question_id")
    shown = hits.join(index.drop("vec").withColumnRenamed("id", "row_id"), "row_id")
    return best_hit_per_record(shown)


def answer_batch(queries: DataFrame, index: DataFrame, membership: DataFrame, answers: DataFrame,
                 k: int = 8) -> DataFrame:
    """(question_id, answer, note, citations) for landed answers(question_id, answer, error).

    Citations are the best rows per record in rank order, with a snippet and their shelves; the ones the
    answer cites, or all when it cites none. Without an answer all are kept with a note.
    """
    best = hits_with_collections(retrieve(queries, index, k), membership)
    cites = best.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.col("record_id").alias("id"), "title", "url", "score",
        F.substring("text", 1, K.SNIPPET_CHARS).alias("snippet"), "timestamp", "collections"))).alias("_c"))
    joined = (queries.select(F.col("id").alias("question_id")).join(cites, "question_id", "left")
              .join(answers, "question_id", "left"))
    cited = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(K.CITATION), F.lit(1))
    none = F.col("_c").isNull()
    return joined.select(
        "question_id", F.when(~none, F.col("answer")).alias("answer"),
        F.when(none, "archive is empty").when(F.col("answer").isNull(), F.concat(
            F.lit("synthesis unavailable: "), F.coalesce("error", F.lit("")))).alias("note"),
        keep_cited(F.col("_c"), F.col("answer"), cited).alias("citations"))


def bench_tables(measures: DataFrame, facts: DataFrame, summaries: DataFrame, attempts: DataFrame,
                 sample: DataFrame, reference: str, examples: int = 40) -> dict[str, DataFrame]:
    """The report's tables, all restricted to the fixed sample(id)."""
    ids = sample.select(F.col("id").alias("record_id"))
    inside = lambda df: df.join(ids, "record_id", "left_semi")
    mine = inside(facts)
    matched = cut_lineage(match_facts(mine, reference))   # read by two tables
    board = scoreboard(measures, sample)
    stats = attempt_stats(attempts)
    return {
        "metrics": board,
        "agreement": arm_agreement(inside(measures.select("record_id", "arm")), matched, reference),
        "attempts": attempt_notes(stats, board.select("arm"), sample.agg(F.count(F.lit(1)).cast("int")).scalar()),
        "examples": disagreement_examples(matched, inside(summaries), reference, examples)}


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def bench_report(tables: dict[str, DataFrame], reference: str) -> DataFrame:
    """(section, position, text): the report as ordered markdown rows."""
    two = lambda c: F.format_number(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 2)
    whole = lambda c: F.col(c).cast("string")
    metrics = tables["metrics"].select(
        F.lit("1 metrics").alias("section"),
        F.concat(F.lpad((F.lit(10 ** 9) - F.floor(F.col("avg_facts") * 100)).cast("string"), 12, "0"), "arm").alias("position"),
        _row(F.col("arm"), whole("records"), two("avg_facts"), two("avg_tags"), two("avg_summary_chars"),
             two("avg_structured_fields"), whole("empty"), whole("salvaged"), two("avg_seconds"),
             F.format_number(F.col("cost_per_record").cast("double"), 4)).alias("text"))
    agree = tables["agreement"].select(
        F.lit(f"2 agreement with {reference}"),
        F.concat(F.lpad((F.lit(10 ** 6) - F.floor(F.coalesce("agreement", F.lit(0.0)) * 10 ** 6)).cast("string"), 8, "0"), "arm"),
        _row(F.col("arm"), whole("records"),
             F.when(F.col("agreement").isNull(), "no overlap").otherwise(
                 F.concat(F.bround(F.col("agreement") * 100).cast("int").cast("string"), F.lit("%"))),
             two("missed_per_record"), two("added_per_record")))
    runs = tables["attempts"].select(
        F.lit("3 attempts"), F.col("arm"),
        _row(F.col("arm"), whole("ok"), whole("failed"), two("avg_seconds"), F.col("note")))
    none = tables["attempts"].agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit("3 attempts"), F.lit(""), F.lit(K.NO_RUN_LOG))
    shown = tables["examples"].select(
        F.lit("4 examples"), F.concat(F.lpad(whole("round"), 6, "0"), "arm"),
        F.concat(F.lit("- "), "arm", F.lit(": missed "), F.array_join("only_reference", "; "),
                 F.lit(" / added "), F.array_join("only_candidate", "; ")))
    return metrics.union(agree).union(runs).union(none).union(shown)

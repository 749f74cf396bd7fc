"""Read lines, spoken segments and dictionary redaction as columns and table jobs."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner import constants as K
from gleaner.functions.text import col, strip
from gleaner.operators.joins import first_occurrence


def filter_ocr_lines(detections: DataFrame, min_confidence: float = K.OCR_MIN_CONFIDENCE) -> DataFrame:
    """detections(record_id, frame, pos, text, confidence): confident, readable, first of its kind."""
    lines = detections.withColumn("text", strip("text"))
    kept = lines.filter((F.col("confidence") >= min_confidence) & (F.length("text") >= 3)
                        & F.col("text").rlike(r"[\p{L}\p{N}]"))
    return first_occurrence(kept.withColumn("_key", F.lower("text")), ["record_id", "_key"], ["frame", "pos"]).drop("_key")


def kept_segments(segments: Column | str) -> Column:
    """Segments with trimmed text, without blanks and without likely non-speech.

    segments: array<struct<start, end, text, no_speech_prob, avg_logprob>>.
    """
    trimmed = F.transform(col(segments), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), strip(F.coalesce(s["text"], F.lit(""))).alias("text"),
        F.coalesce(s["no_speech_prob"], F.lit(0.0)).alias("no_speech_prob"),
        F.coalesce(s["avg_logprob"], F.lit(0.0)).alias("avg_logprob")))
    return F.filter(trimmed, lambda s: (s["text"] != "") & ~(
        (s["no_speech_prob"] > K.NO_SPEECH_MAX) & (s["avg_logprob"] < K.LOGPROB_MIN)))


def filter_segments(records: DataFrame, segments: str = "segments", translate: bool = False) -> DataFrame:
    """Adds transcript (start, end, text), transcript_text and transcript_translated."""
    kept = records.withColumn("_kept", kept_segments(segments))
    language = F.coalesce("transcript_language", F.lit(""))
    return (kept.withColumn("transcript", F.transform("_kept", lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))))
            .withColumn("transcript_text", F.array_join(F.transform("_kept", lambda s: s["text"]), " "))
            .withColumn("transcript_translated", F.lit(translate) & ~language.isin("", "en"))
            .drop("_kept"))


WORD = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]")


@lru_cache(maxsize=1 << 16)
def is_word(char: str) -> bool:
    return WORD.match(char) is not None


class Redactor:
    """Replaces the terms of a dictionary on word boundaries, one after another in its order.

    A trie of all terms is run over the text once to see which stand in it, then once more after each term that was replaced (a
    stand-in may bring in later terms). So a text costs as many passes as it holds terms, however many the dictionary has.
    """

    def __init__(self, terms: dict[str, str]):
        if "" in terms:
            raise ValueError("an empty term")
        self.terms = list(terms.items())
        self.trie = None

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "trie": None}

    def places(self, text: str) -> dict[int, list[int]]:
        """Starts of every term, by its number, where it stands on word boundaries."""
        if self.trie is None:
            import ahocorasick

            self.trie = ahocorasick.Automaton()
            for i, (term, _) in enumerate(self.terms):
                self.trie.add_word(term, i)
            self.trie.make_automaton()
        found: dict[int, list[int]] = {}
        for last, i in self.trie.iter(text) if self.terms else ():
            at, end = last - len(self.terms[i][0]) + 1, last + 1
            if is_word(text[at]) != (at > 0 and is_word(text[at - 1])) and is_word(text[last]) != (end < len(text) and is_word(text[end])):
                found.setdefault(i, []).append(at)
        return found

    def run(self, text: str) -> tuple[str, int]:
        """The edited text, and how many terms stood in it at first."""
        found = self.places(text)
        hits, done = len(found), -1
        while later := [i for i in found if i > done]:
            done = min(later)
            term, stand_in = self.terms[done]
            parts, at = [], 0
            for start in found[done]:
                if start >= at:
                    parts += [text[at:start], stand_in]
                    at = start + len(term)
            text = "".join([*parts, text[at:]])
            found = self.places(text)
        return text, hits


def redact_terms(df: DataFrame, column: str, terms: dict[str, str]) -> DataFrame:
    """Replaces dictionary terms on word boundaries, in dictionary order; `hits` counts terms present.

    The dictionary is a parameter sent to the tasks; filter on hits > 0 for a check without edits. A null text has null hits.
    """
    redactor = Redactor(terms)

    def edit(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else redactor.run(t) for t in texts.to_pylist()]
        return pa.array([r and {"text": r[0], "hits": r[1]} for r in rows], pa.struct([("text", pa.string()), ("hits", pa.int32())]))

    edited = F.arrow_udf(edit, StructType.fromDDL("text string, hits int"))(F.col(column))
    return df.withColumn("_edited", edited).withColumn("hits", F.col("_edited.hits")).withColumn(column, F.col("_edited.text")).drop("_edited")

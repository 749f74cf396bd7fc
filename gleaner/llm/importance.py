"""Resampling towards a target: hashed n-gram features, log-likelihood gains held in an array, and a cutoff found in a bracket.

Every run of one to three words falls into a bucket (crc32 of its bytes); the buckets of all documents and of all target texts are
counted, and a bucket's gain says how much more frequent it is in the target. A document's weight is the sum of the gains of its
runs. Gumbel noise from its id is added, so that the highest scores are a draw without replacement by weight.

The hashes of runs come from the hashes of their words: appending n bytes to a text is a linear map of its crc, kept as a table
per n, so that all runs of a batch are hashed by a few array operations.

The cutoff is not found by a sort of all scores: a quantile sketch proposes nested brackets around its rank, one exact count of the
rows above and within each says which holds it (the widest always does), and only the distinct scores of the narrowest such
bracket are sorted. A bracket of too many rows is bracketed again. The drawn rows alone are then numbered in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.decontamination import words_of
from gleaner.llm.shared import short_batches, small, written
from gleaner.operators.records import with_rank

_SPACE = np.uint32(crc32(b" "))


class Shifts:
    """The crc of a text followed by n more bytes, before those are added: tables per n and byte of the crc."""

    def __init__(self, short: int = 64):
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = (one >> np.uint32(1)) ^ np.where(one & 1, np.uint32(0xEDB88320), np.uint32(0))
        step = [np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)]
        tables = [np.stack(step)]
        for _ in range(short):
            tables.append((tables[-1] >> np.uint32(8)) ^ one[tables[-1] & 0xFF])
        self.short = np.stack(tables)
        self.long = [self.short[short]]                     # of short * 2 ** k bytes
        for _ in range(26):
            last = self.long[-1]
            self.long.append(self._apply(last, last))

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 0xFF] ^ table[1][(crc >> np.uint32(8)) & 0xFF] ^ table[2][(crc >> np.uint32(16)) & 0xFF] ^ table[3][crc >> np.uint32(24)]

    def over(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        size = len(self.short) - 1
        few, many = n % size, n // size
        t = self.short
        out = t[few, 0, crc & 0xFF] ^ t[few, 1, (crc >> np.uint32(8)) & 0xFF] ^ t[few, 2, (crc >> np.uint32(16)) & 0xFF] ^ t[few, 3, crc >> np.uint32(24)]
        for k in range(int(many.max(initial=0)).bit_length()):
            at = np.flatnonzero(many >> k & 1)
            out[at] = self._apply(self.long[k], out[at])
        return out


_SHIFTS: list[Shifts] = []


def run_hashes(texts: list[str | None], longest: int = 3) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words per text, and for runs of 1 to `longest` words the crc of every run and the text it lies in."""
    if not _SHIFTS:
        _SHIFTS.append(Shifts())
    words = [words_of(t) for t in texts]
    n = np.array(list(map(len, words)), np.int64)
    flat = list(chain.from_iterable(words))
    where = np.repeat(np.arange(len(texts)), n)
    crc = np.fromiter(map(crc32, flat), np.uint32, len(flat))
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    tail = _SHIFTS[0].over(np.full(len(flat), _SPACE, np.uint32), size) ^ crc
    runs, places = [crc], [where]
    for k in range(1, longest):
        crc = _SHIFTS[0].over(crc[:-1], size[k:] + 1) ^ tail[k:]
        inside = where[:len(crc)] == where[k:]
        runs.append(crc[inside]), places.append(where[:len(crc)][inside])
    return n, runs, places


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """Runs per bucket over all rows; a task sends one row per bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in small(batches):
            for crc in run_hashes(b.column(0).to_pylist(), longest)[1]:
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    short_batches(texts.sparkSession)
    rows = texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():                                # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def bucket_gains(docs: DataFrame, target: DataFrame, *, text_col: str = "text", target_text_col: str = "text", buckets: int = 10_000,
                 longest: int = 3) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the documents, both with one added to every bucket."""
    s, t = bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest)
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(float(b + 1) * all_s / (float(a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def with_weights(docs: DataFrame, gains: np.ndarray, text_col: str = "text", longest: int = 3) -> DataFrame:
    """`docs` without the text, with n_words, n_features and weight (64-bit)."""
    buckets = np.uint32(len(gains))
    place = docs.columns.index(text_col)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            n, runs, places = run_hashes(b.column(place).to_pylist(), longest)
            features, weight = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for crc, where in zip(runs, places):
                if len(where):
                    # whole numbers far below 2 ** 53: exact in double sums
                    weight += np.bincount(where, gains[crc % buckets], len(n)).astype(np.int64)
                    features += np.bincount(where, minlength=len(n))
            rest = [c for i, c in enumerate(b.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(x, pa.int64()) for x in (n, features, weight))], names)

    short_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != text_col]
    names = [*(f.name for f in kept), "n_words", "n_features", "weight"]
    kinds = [*(f.dataType.simpleString() for f in kept), "long", "long", "long"]
    return docs.mapInArrow(weigh, ", ".join(f"`{c}` {k}" for c, k in zip(names, kinds)))


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 x) of Gumbel noise from the first 32 bits of sha256('seed:key')."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def cutoff(scores: DataFrame, column: str, k: int, *, accuracy: int = 10_000, most: int = 1_000_000) -> int | None:
    """The k-th highest of a whole-number column (1 <= k <= rows): brackets by a quantile sketch, exact counts, a sort of the narrowest."""
    rows, low, high = scores.count(), None, None
    rank = k                                                # counted from the top of what is left
    while True:
        margins = [2.0 / accuracy * 8 ** j for j in range(4)]
        place = 1 - rank / rows
        asked = [min(max(place + m, 0.0), 1.0) for m in (*(-x for x in margins), *margins)]
        sketch = scores.agg(F.percentile_approx(column, [float(p) for p in asked], accuracy).alias("q"), F.min(column).alias("low"),
                            F.max(column).alias("high")).first()
        brackets = [*((min(a, b), max(a, b)) for a, b in zip(sketch.q[:4], sketch.q[4:])), (sketch.low, sketch.high)]
        counts = scores.agg(*[F.count_if(F.col(column) > b).alias(f"above{i}") for i, (_, b) in enumerate(brackets)],
                            *[F.count_if(F.col(column).between(a, b)).alias(f"in{i}") for i, (a, b) in enumerate(brackets)]).first()
        i = next(i for i in range(len(brackets)) if counts[f"above{i}"] < rank <= counts[f"above{i}"] + counts[f"in{i}"])
        low, high = brackets[i]
        narrower = counts[f"in{i}"] < rows
        rank, rows = rank - counts[f"above{i}"], counts[f"in{i}"]
        scores = scores.filter(F.col(column).between(low, high))
        if low == high:
            return low
        if rows <= most or not narrower:
            break
    falling = Window.orderBy(F.col(column).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = scores.groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(column, F.sum("n").over(falling).alias("reached"))
    return values.filter(F.col("reached") >= rank).agg(F.max(column)).first()[0]


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000, longest: int = 3,
             id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Every document with n_words, n_features, weight, score and rank: 1, 2, 3... for the drawn `percent` of those with enough words.

    Null and empty texts have no words, no features and weight 0 and are never drawn. Equal scores go by id (null first), then by
    number of features; rows repeated under one id each take part with the same noise. A null id counts as an empty one. An empty target or empty
    table is no error. Other columns are left out.
    """
    gains = bucket_gains(docs, target, text_col=text_col, target_text_col=target_text_col, buckets=buckets, longest=longest)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = written(with_weights(source, gains, "text", longest).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
                     .withColumn("row", F.monotonically_increasing_id()), "importance-scores")
    able = F.col("n_words") >= least_words
    k = percent * scored.filter(able).count() // 100
    columns = [F.col("id").alias(id_col), "n_words", "n_features", "weight", "score"]
    if k == 0:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    reached = able & (F.col("score") >= cutoff(scored.filter(able).select("score"), "score", k))
    # the row number splits a group of equal rows over the ranges of the sort
    ranked = with_rank(scored.filter(reached), [F.col("score").desc(), F.col("id").asc(), F.col("n_features").asc(), F.col("row").asc()])
    drawn = ranked.select(*columns, F.when(F.col("rank") <= k, F.col("rank")).cast("long").alias("rank"))
    return drawn.unionByName(scored.filter(~reached).select(*columns, F.lit(None).cast("long").alias("rank")))

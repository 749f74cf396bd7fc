"""Benchmark decontamination: a broadcast hash set of the test items' word n-grams, scanned over whole documents.

Words are runs of a-z, 0-9 and characters beyond ASCII, after A-Z is lower-cased. An item's windows are its runs
of `n` words, or all its words if it has fewer. In the scan each word becomes its number in the items' vocabulary
(-1: none), rolling sums of powers give every window's hash at once for a whole batch, and hits in the hash set
are verified word by word.

Test sets are small beside the corpus, but the broadcast is held to `max_broadcast_words` words: a larger set is
cut into slices of items, each broadcast and scanned on its own, and the hits are put together per document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import short_batches, small

_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEPT else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
SPANS = "array<struct<first:bigint,last:bigint>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Windows:
    """The n-gram hash set of some items: by window length, sorted hashes and what they stand for."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        self.numbers: dict[bytes, int] = {}
        grams: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, words in items:
            ids = [self.numbers.setdefault(w, len(self.numbers)) for w in words]
            k = min(n, len(ids))
            for i in range(len(ids) - k + 1 if k else 0):
                grams[k][tuple(ids[i:i + k])].add(item)
        self.by_length = []
        for k, found in grams.items():
            power = _BASE ** np.arange(k - 1, -1, -1, dtype=np.uint64)
            ids = np.array(list(found), dtype=np.int64).reshape(len(found), k)
            hashes = ((ids + 1).astype(np.uint64) * power).sum(axis=1, dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            names = list(found.values())
            self.by_length.append((k, power, hashes[order], ids[order], [names[i] for i in order]))

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """(start, length, items) of every occurrence in a row of word numbers; -1 never matches."""
        for k, power, hashes, grams, names in self.by_length:
            if len(ids) < k:
                continue
            known = np.concatenate([[0], np.cumsum(ids >= 0)])
            starts = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(starts):
                continue
            value = np.zeros(len(starts), np.uint64)
            for j in range(k):
                value += (ids[starts + j] + 1).astype(np.uint64) * power[j]
            lo, hi = np.searchsorted(hashes, value), np.searchsorted(hashes, value, side="right")
            for s, a, b in zip(starts[hi > lo], lo[hi > lo], hi[hi > lo]):
                for g in range(a, b):
                    if np.array_equal(grams[g], ids[s:s + k]):
                        yield int(s), k, names[g]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(items: list, n: int, spark):
    held = spark.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(held.value, n)
        number = windows.numbers.get
        for b in small(batches):
            counts, spans, found = [], [], []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                ids = np.array([number(w, -1) for w in words], dtype=np.int64)
                hit = list(windows.hits(ids))
                counts.append(len(words))
                spans.append([{"first": a, "last": z} for a, z in _merged([(s, s + k - 1) for s, k, _ in hit])])
                found.append(sorted(set().union(*(x for _, _, x in hit))))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                pa.array(found, pa.list_(pa.string()))], ["id", "n_words", "spans", "items"])

    return scan


def item_slices(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> list[list[tuple[str, list[bytes]]]]:
    """The items with their words, cut into slices of about `most` words."""
    tests = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")) \
        .filter(F.col("item").isNotNull() & F.col("text").isNotNull())
    slices: list[list] = [[]]
    held = 0
    # toLocalIterator holds one partition at a time
    for r in tests.toLocalIterator():
        words = words_of(r.text)
        if held and held + len(words) > most:
            slices.append([])
            held = 0
        slices[-1].append((r.item, words))
        held += len(words)
    return slices


def without_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, *, text_col: str = "text", item_col: str = "item_id",
                         item_text_col: str = "text", max_broadcast_words: int = 2_000_000) -> DataFrame:
    """The rows of `docs` in which no window of any item occurs, with all their columns. Texts without words stay."""
    short_batches(docs.sparkSession)
    place = docs.columns.index(text_col)
    for items in item_slices(benchmark, item_col, item_text_col, max_broadcast_words):
        docs = docs.mapInArrow(_keep_clean(items, n, place, docs.sparkSession), docs.schema)
    return docs


def _keep_clean(items: list, n: int, place: int, spark):
    held = spark.sparkContext.broadcast(items)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(held.value, n)
        number = windows.numbers.get
        for b in small(batches):
            clean = [next(windows.hits(np.array([number(w, -1) for w in words_of(t)], dtype=np.int64)), None) is None
                     for t in b.column(place).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return keep


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", max_broadcast_words: int = 2_000_000) -> DataFrame:
    """Per document row: (id, n_words, spans of hit words as (first, last), items found as sorted texts).

    Null and empty texts have no words and no hits; items without words are never found; repeated items and
    equal rows each count; a null item id is left out; other columns are left out; an empty benchmark gives no hits.
    """
    spark = docs.sparkSession
    short_batches(spark)
    slices = item_slices(benchmark, item_col, item_text_col, max_broadcast_words)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if len(slices) == 1:
        return source.mapInArrow(_scan(slices[0], n, spark), f"id {kind}, n_words long, spans {SPANS}, items array<string>") \
            .withColumnRenamed("id", id_col)
    source = source.withColumn("row", F.xxhash64("id", "text"))
    same = Window.partitionBy("id", "row").orderBy(F.lit(1))
    parts = []
    for k, items in enumerate(slices):
        ids = source.select(F.struct("id", "row").alias("id"), "text")
        part = ids.mapInArrow(_scan(items, n, spark), f"id struct<id:{kind},row:bigint>, n_words long, spans {SPANS}, items array<string>")
        parts.append(part.select(F.col("id.id").alias("id"), F.col("id.row").alias("row"), "n_words", "spans", "items")
                     .withColumn("copy", F.row_number().over(same)))
    both = reduce(DataFrame.unionAll, parts).groupBy("id", "row", "copy").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.udf(lambda s: _merged([(x["first"], x["last"]) for x in s]), SPANS)
    return both.select(F.col("id").alias(id_col), "n_words", merged("spans").alias("spans"), "items")


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the hit words and what stands between them; word numbers as in `contamination`."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    flat = raw.translate(_TABLE)
    at, where = 0, []
    for w in flat.split():
        at = flat.index(w, at)
        where.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last:where[a][0]])
        last = where[b][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def items_digest(items: list[str]) -> str:
    return sha256(",".join(sorted(items)).encode()).hexdigest()

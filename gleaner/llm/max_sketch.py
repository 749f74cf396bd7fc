"""Ranked lexical search: hashed max-sketches give upper bounds, and exact scores are worked out in falling order of the bounds.

A first pass counts in how many documents each term stands. In the second, a document's terms are folded into a sketch: the term's
hash names a coordinate, which keeps the largest impact of the terms that fall on it. A query's bound is the sum of its terms'
coordinates, looked up for all documents of a batch at once; no document scores above its bound. A task holds the best k of every
query so far; documents whose bound reaches the k-th score are rescored from their own terms, highest bound first, until the bound
falls below it. The few best of every task are ranked at the end. A coordinate no query looks up is not kept.

Impacts need the weight of each term. Exact weights are sent for the queries' terms and for the most frequent terms, at most
`most_weights` of them by a count in the cluster; any other term counts in the sketch with the weight of a term that stands in one
document. Queries go in blocks of about `most_query_terms` terms, one block in the driver at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.decontamination import words_of
from gleaner.llm.shared import short_batches, small, written


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def term_counts(docs: DataFrame, held: int = 200_000) -> DataFrame:
    """(term, df) over the rows of (id, text); the row with a null term holds the documents with terms and all terms with repeats."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, terms = Counter(), 0, 0
        for b in small(batches):
            for text in b.column(0).to_pylist():
                words = words_of(text)
                documents += bool(words)
                terms += len(words)
                df.update(set(words))
            if len(df) > held:
                yield rows(df)
                df = Counter()
        yield rows(df)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], names)

    def rows(df: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64()), pa.nulls(len(df), pa.int64())], names)

    names = ["term", "df", "terms"]
    found = docs.select("text").mapInArrow(count, "term binary, df long, terms long")
    return written(found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("terms").alias("terms")), "search-terms")


def frequent(counts: DataFrame, most: int) -> pa.Table:
    """(term, df) of all terms that stand in 2^j documents or more, for the smallest j that leaves at most `most` terms."""
    known = counts.filter("term IS NOT NULL")
    sizes = known.groupBy(F.floor(F.log2("df")).cast("int").alias("j")).agg(F.count(F.lit(1)).alias("n")).collect()
    floor, total = 0, 0
    for r in sorted(sizes, key=lambda r: -r.j):
        total += r.n
        if total > most:
            floor = 1 << (r.j + 1)
            break
    return known.filter(F.col("df") >= floor).select("term", "df").toArrow()


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, term, times) of the rows (query, text)."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 50):
            found = [Counter(words_of(t)) for t in b.column(1).to_pylist()]
            rows = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), [len(c) for c in found])))
            yield pa.RecordBatch.from_arrays([rows, pa.array(list(chain.from_iterable(found)), pa.binary()),
                                              pa.array(list(chain.from_iterable(c.values() for c in found)), pa.int64())], ["query", "term", "times"])

    return queries.select("query", "text").mapInArrow(split, "query long, term binary, times long")


class Block:
    """A block of queries as sent to the tasks: the terms whose weight is known, and every query's terms."""

    def __init__(self, rows: pa.Table, often: pa.Table, documents: int, terms: int, width: int):
        self.documents, self.terms, self.width = documents, terms, width
        self.numbers: dict[bytes, int] = {}
        df = dict(zip(often["term"].to_pylist(), often["df"].to_pylist()))
        asked = dict(zip(rows["term"].to_pylist(), rows["df"].to_pylist()))
        for t in chain(asked, df):                          # the queries' terms first
            self.numbers.setdefault(t, len(self.numbers))
        self.asked = len(asked)
        df |= asked
        self.weights = np.array([weight(df[t], documents) for t in self.numbers] + [weight(1, documents)], np.int64)
        places = np.array([crc32(t) % width for t in asked], np.int64)
        self.kept, at = np.unique(places, return_inverse=True)
        self.queries: list[int] = []
        self.of: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        number = np.array([self.numbers[t] for t in rows["term"].to_pylist()], np.int64)
        query, times = rows["query"].to_numpy(), rows["times"].to_numpy()
        order = np.argsort(query, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(query[order])) + 1) if len(order) else []:
            self.queries.append(int(query[part[0]]))
            self.of.append((number[part], at[number[part]], times[part]))


def impacts(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Sketches:
    """The documents of a batch: their terms, and the sketch of each in the coordinates that the block looks up."""

    def __init__(self, texts: list[str | None], block: Block):
        counted = [Counter(words_of(t)) for t in texts]
        n = [sum(c.values()) for c in counted]
        # whole numbers of any size: n * N may pass 64 bits
        self.m = np.array([75 + 25 * k * block.documents // max(block.terms, 1) for k in n], np.int64)
        size = [len(c) for c in counted]
        total = sum(size)
        doc = np.repeat(np.arange(len(texts)), size)
        tf = np.fromiter(chain.from_iterable(c.values() for c in counted), np.int64, total)
        number = np.fromiter(map(block.numbers.get, chain.from_iterable(counted), repeat(-1)), np.int64, total)
        place = np.fromiter(map(crc32, chain.from_iterable(counted)), np.int64, total) % block.width
        at = np.searchsorted(block.kept, place)
        looked = np.flatnonzero(block.kept[np.minimum(at, len(block.kept) - 1)] == place)
        self.sketch = np.zeros((len(block.kept), len(texts)), np.int64)
        np.maximum.at(self.sketch, (at[looked], doc[looked]), impacts(block.weights[number[looked]], tf[looked], self.m[doc[looked]]))
        own = np.flatnonzero((number >= 0) & (number < block.asked))
        keys = doc[own] * block.asked + number[own]
        order = np.argsort(keys)
        self.keys, self.tf = keys[order], tf[own][order]
        self.block = block

    def bounds(self, places: np.ndarray, times: np.ndarray) -> np.ndarray:
        return (self.sketch[places] * times[:, None]).sum(axis=0)

    def exact(self, docs: np.ndarray, numbers: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The scores of some documents for one query, from the documents' own terms."""
        wanted = docs[:, None] * self.block.asked + numbers[None, :]
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        tf = np.where(self.keys[at] == wanted, self.tf[at], 0) if len(self.keys) else np.zeros(wanted.shape, np.int64)
        return (impacts(self.block.weights[numbers], tf, self.m[docs][:, None]) * times).sum(axis=1)


def best_of_batch(found: Sketches, numbers: np.ndarray, places: np.ndarray, times: np.ndarray, ids: list, best: list, k: int, step: int = 32) -> int:
    """Merges a batch into the best k so far, (score, id) in order; returns how many documents were rescored."""
    bounds = found.bounds(places, times)
    least = best[-1][0] if len(best) == k else 1
    reach = np.flatnonzero(bounds >= least)
    reach = reach[np.argsort(-bounds[reach], kind="stable")]
    done = 0
    while done < len(reach) and bounds[reach[done]] >= least:
        some = reach[done:done + step]
        done += len(some)
        scores = found.exact(some, numbers, times)
        ahead = np.flatnonzero(scores >= least)
        if len(ahead):
            best.extend((int(scores[i]), ids[some[i]]) for i in ahead)
            best.sort(key=lambda e: (-e[0], e[1] is not None, e[1]))
            del best[k:]
            least = best[-1][0] if len(best) == k else 1
    return done


def _searched(docs: DataFrame, block: Block, k: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(block)
    kind = docs.schema["id"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        best: list[list] = [[] for _ in block.queries]
        id_type = None
        for b in small(batches):
            id_type = b.schema.field(0).type
            found = Sketches(b.column(1).to_pylist(), block)
            ids = b.column(0).to_pylist()
            for q, mine in zip(block.of, best):
                best_of_batch(found, *q, ids, mine, k)
        if id_type is not None:
            rows = [(q, e) for q, mine in zip(block.queries, best) for e in mine]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.int64()), pa.array([e[1] for _, e in rows], id_type),
                                              pa.array([e[0] for _, e in rows], pa.int64())], ["query", "id", "score"])

    return docs.mapInArrow(search, f"query long, id {kind.dataType.simpleString()}, score long")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 20, *, width: int = 16_384, id_col: str = "doc_id", text_col: str = "text",
                  query_id_col: str = "item_id", query_text_col: str = "text", most_weights: int = 100_000,
                  most_query_terms: int = 200_000) -> DataFrame:
    """(query id, rank, document id, score): the k highest scores above 0 of every query, ties by document id (null first).

    Null and empty texts have no terms: such documents are never found, such queries find nothing. Rows repeated under one document
    id each take a place of their own; equal query rows (id and text) count once, other rows under one id are queries of their own.
    Other columns are left out; empty tables give no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = written(queries.select(F.col(query_id_col).alias("name"), F.col(query_text_col).cast("string").alias("text")).distinct()
                    .withColumn("query", F.monotonically_increasing_id()), "search-queries")
    counts = term_counts(source)
    totals = counts.filter("term IS NULL").agg(F.sum("df").alias("documents"), F.sum("terms").alias("terms")).first()
    terms = written(query_terms(asked).join(counts.select("term", "df"), "term"), "search-query-terms")
    blocks = max(-(-terms.count() // most_query_terms), 1)
    often = frequent(counts, most_weights)
    parts = []
    for i in range(blocks):
        rows = terms.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).toArrow()
        if rows.num_rows:
            part = _searched(source, Block(rows, often, totals.documents, totals.terms, width), k)
            parts.append(written(part, "search-block") if blocks > 1 else part)
    if not parts:
        return asked.select(F.col("name").alias(query_id_col), F.lit(0).alias("rank"), F.lit(None).cast(docs.schema[id_col].dataType).alias(id_col),
                            F.lit(0).cast("long").alias("score")).limit(0)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(asked.select("query", "name"), "query").select(F.col("name").alias(query_id_col), "rank", F.col("id").alias(id_col), "score")

"""Exact nearest neighbours of two large sides over a stored cell index.

Every row of the index belongs to the pivot its vector makes the smallest angle with; pivots are rows of the index, those with the
smallest hash of their id, about the square root of their number. A cell's radius is its largest angle. By the triangle inequality
of angles no row of a cell is nearer to a query than the angle to the pivot less the radius, so a cell whose bound lies beyond a
query's k-th best so far need not be read.

A search has two rounds: the `probes` cells nearest to a query give a k-th best, then the cells that may still hold better rows
are read. The rows are broadcast in blocks of bounded size, which are stretches of the cell order; a task takes some thousand
queries through the blocks and scores each cell with the queries that call it. So a hot cell is met by all tasks, and no query
is copied for the cells it calls, which are nearly all where the data has no clusters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators.vectors import BLOCK_BYTES, PIECE, _dealt, _gathered, _matrix, _objects, _opened, _rank, _sent, _TopK, _types, _unit

SLACK = 1e-6        # angles of float64 cosines near one are this exact
MOST_CELLS = 16_384
ANGLES = 1 << 20    # angles of rows to pivots held at once: 8 MB
CALLS = 4_096       # vectors sent on at once


@dataclass
class Cells:
    """`rows`(cell, id, vec, piece) and, per cell, the pivot's unit vector, the radius and the number of rows."""

    rows: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray


def _slices(batches: Iterator[pa.RecordBatch], pivots: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so few rows that their angles to all pivots take no more than `ANGLES`, however many pivots there are."""
    rows = max(ANGLES // max(pivots, 1), 1)
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles of rows to pivots; a zero vector is at a right angle to all."""
    return np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))


def write_cells(index: DataFrame, path: str, cells: int | None = None) -> Cells:
    """Writes index(id, vec) to `path` as rows in cell order and a table of cells; null vectors are left out."""
    spark = index.sparkSession
    index = index.select("id", "vec").filter("vec IS NOT NULL")
    n = index.count()
    cells = min(cells or max(math.isqrt(n), 1), MOST_CELLS)
    chosen = index.orderBy(F.xxhash64("id"), "id").limit(cells).toArrow()
    shared = spark.sparkContext.broadcast(_matrix(chosen.column("vec")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, len(shared.value)):
            angles = _angles(_matrix(b.column(1)), shared.value)
            near = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *b.columns, pa.array(angles[np.arange(b.num_rows), near])],
                                             ["cell", "id", "vec", "angle"])

    kinds = dict(index.dtypes)
    placed = index.mapInArrow(place, f"cell int, id {kinds['id']}, vec {kinds['vec']}, angle double")
    # a piece is a stretch of cells of about a block; the hash lets the ranges cut a hot cell
    pieces = max(1, -(-n * shared.value.shape[1] * 8 // BLOCK_BYTES))
    dealt = placed.repartitionByRange(pieces, "cell", F.xxhash64("id")).withColumn(PIECE, F.spark_partition_id())
    dealt.sortWithinPartitions(PIECE, "cell").write.partitionBy(*[PIECE] if n else []).parquet(f"{path}/rows")      # without rows a folder would have no file
    found = spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
    pivots = spark.createDataFrame([(i, v) for i, v in enumerate(shared.value.tolist())], "cell int, pivot array<double>")
    pivots.join(found, "cell", "left").coalesce(1).write.parquet(f"{path}/cells")
    return read_cells(spark, path)


def read_cells(spark: SparkSession, path: str) -> Cells:
    table = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()       # at most MOST_CELLS rows
    number = lambda c: np.nan_to_num(table.column(c).to_numpy().astype(np.float64))
    return Cells(spark.read.parquet(f"{path}/rows").select("cell", "id", "vec", PIECE), _matrix(table.column("pivot")), number("radius"), number("n"))


def nearest_exact(queries: DataFrame, cells: Cells, k: int, probes: int = 4, block: int = BLOCK_BYTES) -> DataFrame:
    """queries(id, vec) -> (query_id, row_id, score, rank): exact top k by cosine, ties to the lower id."""
    return _rank(_search(queries, cells, k, probes, block), k)


def two_rounds(queries: DataFrame, cells: Cells, k: int, probes: int = 4, block: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The best k of the first round alone, and the (id, vec, cell) that a second has to read after it."""
    queries = queries.select("id", "vec")
    first = _rank(_search(queries, cells, k, probes, block, rounds=1), k)
    kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("reach"))
    again = queries.join(kth, "id", "left").withColumn("reach", F.coalesce("reach", F.lit(-1.0)))     # fewer than k: all cells
    return first, _calls(again, cells, probes)


def _search(queries: DataFrame, cells: Cells, k: int, probes: int, block: int, rounds: int = 2) -> DataFrame:
    """(query_id, row_id, score): the k best of each query over the cells that may hold them."""
    queries = queries.select("id", "vec").filter("vec IS NOT NULL")
    out, qt, rt = _types(queries, cells.rows)
    sent = _sent(cells.rows, k, block)
    shared = queries.sparkSession.sparkContext.broadcast((cells.pivots, cells.radius, cells.sizes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius, sizes = shared.value
        for t in _gathered(batches):
            q = _matrix(t.column("vec"))
            near = _nearest_cells(q, pivots, sizes, probes)
            top = _TopK(q, k)
            for later in range(rounds):
                for own, b in sent:
                    if later or np.isin(own, near).any():
                        _read(top, near, *_opened(b), pivots, radius, bool(later))
            yield from top.batches(_objects(t.column("id")), qt, rt)

    return _dealt(queries).mapInArrow(search, out)


def _nearest_cells(q: np.ndarray, pivots: np.ndarray, sizes: np.ndarray, probes: int) -> np.ndarray:
    """Of each vector the `probes` cells nearest to it that have rows."""
    held = np.flatnonzero(sizes > 0)
    step = max(ANGLES // max(len(held), 1), 1)
    n = min(probes, len(held))
    parts = [np.argpartition(-(q[i:i + step] @ pivots[held].T), n - 1, axis=1)[:, :n] if 0 < n < len(held) else np.tile(np.arange(n), (len(q[i:i + step]), 1))
             for i in range(0, len(q), step)]
    return held[np.concatenate(parts)]


def _read(top: _TopK, near: np.ndarray, ids: np.ndarray, raw: np.ndarray, cells: np.ndarray, pivots: np.ndarray, radius: np.ndarray, later: bool) -> None:
    """Offers the cells of a block: first to the queries that have them among their nearest, later to the others they may hold a better row for."""
    rows, own = _unit(raw), np.unique(cells)
    ends = np.append(np.searchsorted(cells, own), len(cells))
    step = max(ANGLES // max(len(top.q), 1), 1)
    for s in range(0, len(own) if len(top.q) else 0, step):
        few = own[s:s + step]
        if later:
            top.merge()
            wanted = _angles(top.q, pivots[few]) - radius[few] - SLACK <= np.arccos(np.clip(top.floor, -1, 1))[:, None]
        for j, c in enumerate(few):
            probed = (near == c).any(axis=1)
            at = np.flatnonzero(wanted[:, j] & ~probed if later else probed)
            if len(at):
                i, e = ends[s + j:s + j + 2]
                top.offer(ids[i:e], rows[i:e], at)


def _calls(queries: DataFrame, cells: Cells, probes: int) -> DataFrame:
    """(id, vec, cell): the nearest `probes` cells where `reach` (a cosine) is null, else the others that may hold a score of `reach`."""
    shared = queries.sparkSession.sparkContext.broadcast((cells.pivots, cells.radius, cells.sizes))

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _called(batches, *shared.value, probes)

    kinds = dict(queries.dtypes)
    return queries.filter("vec IS NOT NULL").select("id", "vec", "reach").mapInArrow(call, f"id {kinds['id']}, vec {kinds['vec']}, cell int")


def _called(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, radius: np.ndarray, sizes: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """The calls of batches (id, vec, reach), `CALLS` at a time: a vector goes to each cell it calls, which may be most of them."""
    held = np.flatnonzero(sizes > 0)
    for b in _slices(batches, len(held)) if len(held) else ():
        angles = _angles(_matrix(b.column(1)), pivots[held])
        order = np.argsort(angles, axis=1, kind="stable")[:, :probes]
        wanted = np.zeros(angles.shape, bool)
        np.put_along_axis(wanted, order, True, axis=1)
        reach = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
        later = ~np.isnan(reach)
        wanted[later] = ~wanted[later] & (angles[later] - radius[held] - SLACK <= np.arccos(np.clip(reach[later], -1, 1))[:, None])
        row, cell = np.nonzero(wanted)
        for i in range(0, len(row), CALLS):
            at = pa.array(row[i:i + CALLS])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(held[cell[i:i + CALLS]].astype(np.int32))],
                                             ["id", "vec", "cell"])


def similar_to_all(queries: DataFrame, cells: Cells, owners: DataFrame, k: int = 6, probes: int = 4) -> DataFrame:
    """Neighbours of many records without the record itself: k of the k + 3 nearest rows.

    queries(id, vec); owners(id, record_id) says whose rows the index holds.
    """
    hits = nearest_exact(queries, cells, k + 3, probes)
    others = hits.join(owners.select(F.col("id").alias("row_id"), "record_id"), "row_id").filter(F.col("record_id") != F.col("query_id"))
    w = Window.partitionBy("query_id").orderBy("rank")
    return others.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k) \
        .select("query_id", "row_id", "record_id", "score", F.col("_rn").alias("rank"))

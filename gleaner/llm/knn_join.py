"""Exact top-k by integer inner product as a Voronoi kNN join.

A vector's components become floor(scale * x). Inner product turns into distance by one more coordinate: with M the
largest norm of all candidates, candidate p becomes (p, sqrt(M² - |p|²)) and query q becomes (q, 0); then
|q - p|² = |q|² + M² - 2 q·p, so the k nearest candidates are the k highest scores.

1. A bounded number of candidates, those with the smallest hash of their id, are the pivots: about two for every
   `chunk` queries. Each query belongs to the cell of its nearest pivot, each candidate likewise.
2. Summaries: per cell of queries its radius, per cell of candidates its k + 1 smallest distances to the pivot.
   The triangle inequality gives each query cell i a bound: its k + 1 nearest candidates lie within
   radius(i) + |pivot i - pivot j| + d for the k + 1 smallest such sums over all cells j.
3. Neighbouring query cells are put together into groups of up to `chunk` queries. A candidate is replicated to a group
   only if, for some cell i of it, its distance to pivot i minus radius(i) is within the bound.
4. Groups meet their candidates in blocks of bounded size: the candidates of a group are dealt into blocks by the hash
   of their id; a cell of more than `chunk` queries is a group of its own whose queries are dealt into parts. A block
   keeps k rows per query; the best k of those remain.

Scores are exact: products and sums are integers; floating point is used where every partial sum stays below 2^53.
Bounds are widened by a relative 1e-9 so that rounding never loses a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import written

SLACK = 1e-9
EXACT = float(2 ** 53)


def usable(vec: Column) -> Column:
    """No null, no null or non-finite component."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def integers(vec: Column, scale: int) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as rows of an array; shorter ones end in zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _distances(points: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    p = points.astype(np.float64)
    square = (p * p).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * p @ pivots.T + (extra[:, None] - pivot_extra[None]) ** 2
    return np.sqrt(np.maximum(square, 0))


class _Space:
    """Pivots and the norm bound; what every task needs to place a vector."""

    def __init__(self, pivots: np.ndarray, width: int, norm2: float):
        self.width, self.norm2, self.pivots = width, norm2, pivots.astype(np.float64)
        self.pivot_extra = self.extra(pivots)
        self.between = _distances(pivots, self.pivot_extra, self.pivots, self.pivot_extra)

    def extra(self, points: np.ndarray) -> np.ndarray:
        p = points.astype(np.float64)
        return np.sqrt(np.maximum(self.norm2 - (p * p).sum(1), 0))

    def queries(self, points: np.ndarray) -> np.ndarray:
        return _distances(points, np.zeros(len(points)), self.pivots, self.pivot_extra)

    def candidates(self, points: np.ndarray) -> np.ndarray:
        return _distances(points, self.extra(points), self.pivots, self.pivot_extra)


def _summaries(df: DataFrame, space: _Space, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Per cell: queries, their radius, candidates, the k smallest candidate distances."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = len(space.pivots)
        n, radius, m = np.zeros(cells, np.int64), np.zeros(cells), np.zeros(cells, np.int64)
        near: list[np.ndarray] = [np.zeros(0)] * cells
        for b in batches:
            points = _rows(b.column(1), space.width)
            asks = b.column(2).to_numpy(zero_copy_only=False)
            d = space.queries(points[asks])
            # a query as near to two pivots counts for both: which one it is dealt to may depend on rounding
            row, own = np.nonzero(d <= d.min(1, keepdims=True) * (1 + SLACK) + SLACK) if len(d) else (np.zeros(0, int),) * 2
            n += np.bincount(own, minlength=cells)
            np.maximum.at(radius, own, d[row, own])
            d = space.candidates(points)
            own, least = d.argmin(1), d.min(1)
            m += np.bincount(own, minlength=cells)
            for c in np.unique(own):
                near[c] = np.sort(np.concatenate([near[c], least[own == c]]))[:k]
        yield pa.RecordBatch.from_arrays([pa.array(range(cells), pa.int32()), pa.array(n), pa.array(radius), pa.array(m),
                                          pa.array([x.tolist() for x in near], pa.list_(pa.float64()))], ["cell", "n", "radius", "m", "near"])

    parts = df.select("id", "vec", "asks").mapInArrow(measure, "cell int, n long, radius double, m long, near array<double>")
    few = Window.partitionBy("cell").orderBy("d")
    rows = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("m").alias("m")).collect()
    near = parts.select("cell", F.explode("near").alias("d")).withColumn("r", F.row_number().over(few)).filter(F.col("r") <= k)
    cells = len(space.pivots)
    n, radius, m, least = np.zeros(cells, np.int64), np.zeros(cells), np.zeros(cells, np.int64), [[] for _ in range(cells)]
    for r in rows:
        n[r.cell], radius[r.cell], m[r.cell] = r.n, r.radius, r.m
    for r in near.select("cell", "d").collect():
        least[r.cell].append(r.d)
    return n, radius, m, [np.array(x) for x in least]


def _bounds(space: _Space, n: np.ndarray, radius: np.ndarray, near: list[np.ndarray], k: int) -> np.ndarray:
    """Largest distance to a pivot at which a candidate still matters to the queries of that cell; -1 without queries."""
    reach = np.full(len(n), -1.0)
    for i in np.flatnonzero(n):
        ends = np.sort(np.concatenate([radius[i] + space.between[i, j] + x for j, x in enumerate(near)]))
        bound = ends[k - 1] if len(ends) >= k else np.inf
        reach[i] = (bound + radius[i]) * (1 + SLACK) + SLACK * np.sqrt(space.norm2 + 1)
    return reach


def _groups(space: _Space, n: np.ndarray, chunk: int) -> np.ndarray:
    """Group of each query cell: cells in a chain of nearest pivots, put together while they hold at most `chunk` queries."""
    group, number, held = np.full(len(n), -1), -1, 0
    left = list(np.flatnonzero(n))
    at = left[0] if left else None
    while left:
        at = min(left, key=lambda c: space.between[at, c])
        left.remove(at)
        if number < 0 or held + n[at] > chunk:
            number, held = number + 1, 0
        group[at] = number
        held += n[at]
    return group


def _top(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best: score down, id up; a query's own id does not count."""
    rows, cols = [], []
    for i in range(len(scores)):
        s = scores[i]
        at = np.flatnonzero(ids != own[i])
        if len(at) > k:
            cut = np.partition(s[at], len(at) - k)[len(at) - k]
            at = at[s[at] >= cut]
        at = at[np.lexsort((ids[at], -s[at]))][:k]
        rows.append(np.full(len(at), i))
        cols.append(at)
    return np.concatenate(rows), np.concatenate(cols)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024,
          pivots: tuple[int, int] = (16, 1_024), block: int = 8_192, chunk: int = 1_024) -> DataFrame:
    """(query_id, rank from 1, id, score) of each query's k best candidates: every usable row but the query's own.

    Ties go to the smaller id. Vectors that are null or hold null or non-finite components take no part, nor do null
    ids; vectors of different lengths are compared as if the shorter one ended in zeros. Rows equal in id and vector (in whole
    numbers) count once; rows that share an id alone are candidates of their own, and queries under that id. Queries with no
    other candidate give no rows. Scores and components must fit 64 bits. Other columns are left out. `pivots` are the least and
    the most pivots.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("raw"), F.coalesce(is_query, F.lit(False)).alias("asks")) \
        .filter(F.col("id").isNotNull() & usable(F.col("raw"))).select("id", integers(F.col("raw"), scale).alias("vec"), "asks")
    # ids alone are exchanged to see which stand more than once; only such rows are compared whole
    twice = written(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "knn-repeats")
    rows = rows.join(twice, "id", "left_anti").unionAll(
        rows.join(twice, "id", "left_semi").groupBy("id", "vec").agg(F.bool_or("asks").alias("asks")))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    shape = rows.agg(F.max(F.size("vec")).alias("width"), F.max(norm).alias("norm2"), F.count_if("asks").alias("queries")).first()
    out = "query_id long, id long, score long"
    if shape.width is None:
        return spark.createDataFrame([], out).select("query_id", F.lit(1).alias("rank"), F.col("id").alias(id_col), "score")
    wanted = min(pivots[1], max(pivots[0], 2 * -(-shape.queries // chunk)))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").collect()
    points = np.zeros((len(chosen), shape.width), np.int64)
    for i, r in enumerate(chosen):
        points[i, :len(r.vec)] = r.vec
    space = _Space(np.unique(points, axis=0), shape.width, shape.norm2 * (1 + SLACK))
    n, radius, _, near = _summaries(rows, space, k + 1)
    reach = _bounds(space, n, radius, near, k + 1)
    group = _groups(space, n, chunk)
    parts = np.ones(group.max() + 1, np.int64)
    np.maximum.at(parts, group[group >= 0], -(-n[group >= 0] // chunk))
    exact = shape.norm2 < EXACT

    def wanted_by(points: np.ndarray) -> list[np.ndarray]:
        """Of each group the candidates that may matter to its queries."""
        near_by = space.candidates(points) <= reach[None]
        return [np.flatnonzero(near_by[:, group == g].any(1)) for g in range(len(parts))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(parts), np.int64)
        for b in batches:
            total += [len(at) for at in wanted_by(_rows(b.column(0), space.width))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(total)], ["team", "n"])

    blocks = np.ones(len(parts), np.int64)
    for r in rows.select("vec").mapInArrow(count, "team long, n long").groupBy("team").agg(F.sum("n").alias("n")).collect():
        blocks[r.team] = max(1, -(-r.n // block))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to every block of their group, candidates to one block of every group they matter to, for each part."""
        for b in batches:
            ids = b.column(0).to_numpy()
            points = _rows(b.column(1), space.width)
            packed = np.array([p.tobytes() for p in points], dtype=object)
            asks = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = group[space.queries(points[asks]).argmin(1)]
            part = (mixed[asks] % parts[own].astype(np.uint64)).astype(np.int64)
            for g in np.unique(own):
                at = asks[own == g]
                for z in range(blocks[g]):
                    yield _dealt(g, part[own == g], z, ids[at], packed[at], True)
            for g, at in enumerate(wanted_by(points)):
                for p in range(parts[g] if len(at) else 0):
                    yield _dealt(g, p, (mixed[at] // np.uint64(7) % blocks[g].astype(np.uint64)).astype(np.int64), ids[at], packed[at], False)

    def _dealt(g, p, z, ids, packed, asks) -> pa.RecordBatch:
        full = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int64), len(ids)))
        return pa.RecordBatch.from_arrays([full(g), full(p), full(z), pa.array(ids), pa.array(packed, pa.binary()),
                                           pa.array(np.full(len(ids), asks))], ["team", "part", "block", "id", "vec", "asks"])

    def solve(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        ids = group.column("id").to_numpy()
        vecs = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.int64).reshape(len(ids), space.width)
        q, p, qid, pid = vecs[asks], vecs[~asks], ids[asks], ids[~asks]
        found: list[tuple[np.ndarray, ...]] = []
        if len(p) and len(q):
            right = p.astype(np.float64).T if exact else p.T
            for s in range(0, len(q), 64):
                part = q[s:s + 64]
                scores = (part.astype(np.float64) @ right).astype(np.int64) if exact else part @ right
                r, c = _top(scores, pid, qid[s:s + 64], k)
                found.append((qid[s:s + 64][r], pid[c], scores[r, c]))
        cols = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(cols, ["query_id", "id", "score"])

    best = (rows.mapInArrow(deal, "team long, part long, block long, id long, vec binary, asks boolean")
            .groupBy("team", "part", "block").applyInArrow(solve, out))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))

"""Histogram sort: rows dealt into key ranges of nearly equal bytes with one exchange.

Each row's key is 64 bits: the upper 40 from the hash of its text, so that equal texts lie side by side, the
lower 24 from the hash of its id, so that a large group of equal texts can still be cut. Rounds count the exact
bytes below a few candidate boundaries in every partition; only these counts reach the driver. Each splitter's
interval shrinks to the two probes around its target until it is within the tolerance. A boundary between two
groups is taken when it meets the tolerance; only a group too large for that is cut inside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import written

GROUP_BITS = 24
LOW, HIGH = -2 ** 63, 2 ** 63 - 1


def sort_key(text: Column, row_id: Column) -> Column:
    """Upper bits from the text, lower bits from the id."""
    low = (1 << GROUP_BITS) - 1
    return F.xxhash64(text).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(row_id).bitwiseAND(F.lit(low)))


def count_below(keys: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact (bytes, rows) with `key` < probe, for sorted probes and last for everything."""
    edges = np.array(probes, dtype=np.int64)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(edges, b.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(size, at, b.column(1).to_numpy(zero_copy_only=False))
            rows += np.bincount(at, minlength=len(rows))
        has = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(size[has]), pa.array(rows[has])], ["bin", "size", "n"])

    size, rows = [0] * (len(edges) + 1), [0] * (len(edges) + 1)
    for r in (keys.mapInArrow(histogram, "bin long, size long, n long")
              .groupBy("bin").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()):
        size[r.bin], rows[r.bin] = r.size, r.n
    return np.cumsum(size), np.cumsum(rows)


def _probes(lo: int, hi: int, n: int) -> list[int]:
    """Up to n keys strictly inside (lo, hi); on group boundaries while the interval holds any."""
    unit = 1 << GROUP_BITS
    first, last = -(-(lo + 1) // unit), (hi - 1) // unit
    if first > last:
        unit, first, last = 1, lo + 1, hi - 1
    span = last - first + 1
    return sorted({(first + span * i // n) * unit for i in range(n)}) if span > 0 else []


def find_splitters(keys: DataFrame, shards: int, tolerance: float, probes: int) -> tuple[list[int], list[int], int]:
    """(splitters, rows below each, rows in all); row belongs to shard s when splitter s-1 <= key < splitter s."""
    totals = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("n")).first()
    targets = [totals["size"] * s / shards for s in range(1, shards)]
    near = tolerance * totals["size"] / shards
    low, high = [(LOW, 0, 0)] * len(targets), [(HIGH, totals["size"], totals["n"])] * len(targets)
    while True:
        off = [min(abs(a[1] - t), abs(b[1] - t)) for a, b, t in zip(low, high, targets)]
        tries = [_probes(a[0], b[0], probes) if o > near else [] for a, b, o in zip(low, high, off)]
        points = sorted({p for x in tries for p in x})
        if not points:
            break
        size, rows = count_below(keys, points)
        seen = {p: (p, int(s), int(n)) for p, s, n in zip(points, size, rows)}
        for i, t in enumerate(targets):
            inside = [seen[p] for p in tries[i]]
            low[i] = max([low[i], *(x for x in inside if x[1] <= t)])
            high[i] = min([high[i], *(x for x in inside if x[1] > t)])
    best = [min(a, b, key=lambda x: abs(x[1] - t)) for a, b, t in zip(low, high, targets)]
    return [b[0] for b in best], [b[2] for b in best], totals["n"]


def _cut_fine(keys: DataFrame, edges: list[int], rows: list[int], total: int, most: int, probes: int) -> tuple[list[int], list[int]]:
    """More edges until no range holds over `most` rows (or one key), and the rows below each."""
    at = {LOW: 0, HIGH: total} | dict(zip(edges, rows))
    while True:
        order = sorted(at)
        tries = {p for a, b in zip(order, order[1:]) if at[b] - at[a] > most
                 for p in _probes(a, b, min(probes, 2 * (at[b] - at[a]) // most))}
        if not tries:
            return order[1:-1], [at[p] for p in order[1:-1]]
        points = sorted(tries)
        at |= dict(zip(points, map(int, count_below(keys, points)[1])))


def shard_by_bytes(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text",
                   payload: Column | None = None, tolerance: float = 0.005, probes: int = 64, slot_rows: int = 5_000) -> DataFrame:
    """(id, payload, size, shard, slot) of every row; shards are key ranges whose sizes differ by little.

    payload: what goes through the exchange with each row; the text itself where none is given.
    size: UTF-8 bytes of the text plus 1. tolerance: how far a shard's border may lie from its target, as a part
    of a mean shard; where single rows are larger than that the nearest border counts. slot: gapless from 0 in
    the shard, in key order. slot_rows: rows that one task sorts at most; it rises with the table so that at most
    about 32,768 ranges exist.

    Null texts have size 1 and form one group, empty texts another; null ids are kept; equal rows get different
    slots; other columns are left out; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select(
        "id", (F.col("text") if payload is None else payload).alias("payload"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        sort_key(F.col("text"), F.col("id")).alias("key"))
    keys = written(rows.select("key", "size"), "shard-keys")
    splitters, rows_below, total = find_splitters(keys, shards, tolerance, probes)
    edges, before = _cut_fine(keys, *(list(x) for x in zip(*dict(zip(splitters, rows_below)).items())) if splitters else ([], []),
                              total, max(slot_rows, total // 16_384), probes)
    cuts, fine = np.array(splitters, np.int64), np.array(edges, np.int64)
    base = np.array([0, *before], np.int64)
    first = np.array([0, *rows_below], np.int64)

    @F.pandas_udf("shard int, bin int, skip long")
    def place(key: pd.Series) -> pd.DataFrame:
        shard, at = np.searchsorted(cuts, key, side="right"), np.searchsorted(fine, key, side="right")
        return pd.DataFrame({"shard": shard.astype("int32"), "bin": at.astype("int32"), "skip": base[at] - first[shard]})

    within = Window.partitionBy("at.shard", "at.bin").orderBy("key", "id")
    return (rows.withColumn("at", place("key"))
            .withColumn("slot", (F.row_number().over(within) - 1 + F.col("at.skip")).cast("bigint"))
            .select(F.col("id").alias(id_col), F.col("payload").alias(text_col if payload is None else "payload"), "size", F.col("at.shard").alias("shard"), "slot"))

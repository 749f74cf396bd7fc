"""b-bit MinHash near-duplicates: documents linked by the Jaccard similarity of their word shingles.

1. Every text becomes its set of distinct word-shingle hashes (64 bits). Texts with equal sets form one class, held
   by its smallest id; only class holders go on, so copies cost one row each.
2. A class gets `bands` × `rows` minima. Each band's minima make a bucket key; of each minimum the low two bits are
   kept and packed, 32 to a long.
3. Members of a bucket are candidates. Where the packed signatures' matching fields, corrected for chance matches of
   two bits, say that a pair lies far below the threshold, it goes no further. The rest is confirmed on full sets.
4. Nothing lists all pairs of a bucket. First every bucket compares its members with one of them, the centre: the member
   whose buckets hold the most rows in all, which in a group of near copies is the text they come from. Confirmed links
   make components. Buckets whose other members are all of one component need no more comparing. In the rest the members
   are dealt into tiles; each pair of tiles is one task of bounded size, which compares signatures, counts the common
   shingles of the pairs left and returns only links that join two components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.graph import components
from gleaner.llm.shared import small, written

_MIX = np.uint64(0x9E3779B97F4A7C15)
FIELDS = 32
ODD = 0x5555555555555555


class _Words(dict):
    """Word hashes, remembered; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _blend(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, width: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Hashes of the `width`-word shingles in order, of all or from one to another; a shorter text is one shingle, one without
    words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if last is not None:
        words = words[first:last + width]
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(width, len(ids))
    h = np.full(len(ids) - k + 1, k, np.uint64)
    for j in range(k):
        h = _blend(h * _MIX + ids[j:len(ids) - k + 1 + j])
    return h


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2 ** 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2 ** 32, n, dtype=np.uint32)


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minima (32 bits) of each set; sets must not be empty."""
    a, b = _seeds(n)
    out = np.empty((len(sets), n), np.uint32)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= 1 << 17):
            size += len(sets[last])
            last += 1
        x = np.concatenate(sets[first:last])
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[first:last - 1])])
        h = np.empty_like(x)
        for k in range(n):
            np.multiply(x, a[k], out=h)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h += b[k]
            h ^= h >> np.uint32(13)
            out[first:last, k] = np.minimum.reduceat(h, starts)
        first = last
    return out


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(low), bands), np.uint64)
    for j in range(rows):
        key = _blend(key * _MIX + low[:, j::rows][:, :bands].astype(np.uint64) + np.uint64(1))
    return (key ^ np.arange(bands, dtype=np.uint64) * _MIX).view(np.int64)


def pack(low: np.ndarray) -> np.ndarray:
    """The low two bits of each minimum, 32 to a long."""
    n = -(-low.shape[1] // FIELDS)
    bits = np.zeros((len(low), n * FIELDS), np.uint64)
    bits[:, :low.shape[1]] = low & np.uint32(3)
    shift = np.arange(FIELDS, dtype=np.uint64) * np.uint64(2)
    return np.bitwise_or.reduce(bits.reshape(len(low), n, FIELDS) << shift, axis=2).view(np.int64)


def least_matches(n: int, threshold: float, sigmas: float = 5.0) -> int:
    """Matching fields of n below which a pair lies `sigmas` deviations under the threshold.

    Two equal minima always match, others in one of four cases: J + (1 - J) / 4 of the fields are expected.
    """
    p = threshold + (1 - threshold) / 4
    return math.floor(n * p - sigmas * math.sqrt(n * p * (1 - p)))


def matching_fields(a: Column, b: Column, n: int) -> Column:
    """Equal two-bit fields of two packed signatures of n fields."""
    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(ODD)))

    return F.lit(n) - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)


def estimate(matches: Column, n: int) -> Column:
    """Similarity from matching fields, corrected for chance."""
    return F.greatest((matches / F.lit(n) - 0.25) / 0.75, F.lit(0.0))


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n, digest, keys, sig) of every row of (id, text); digest stands for the whole set, null without words."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sets = [shingle_set(t, width) for t in b.column(1).to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            digest: list = [None] * len(sets)
            keys: list = [None] * len(sets)
            sig: list = [None] * len(sets)
            if some:
                low = minima([sets[i] for i in some], bands * rows)
                for i, k, s in zip(some, band_keys(low, bands, rows), pack(low)):
                    digest[i], keys[i], sig[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), k, s
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int64()))], ["id", "n", "digest", "keys", "sig"])

    return docs.mapInArrow(sign, "id long, n long, digest binary, keys array<long>, sig array<long>")


def _full_sets(texts: DataFrame, wanted: DataFrame, width: int, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(id, set) of the wanted ids, made again from their texts. Up to `broadcast_ids` ids (8 MB) go to the texts, beyond
    that the texts are shuffled by id."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [shingle_set(t, width).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "set"])

    wanted = written(wanted, "near-wanted")
    side = F.broadcast(wanted) if wanted.count() <= broadcast_ids else wanted
    return written(texts.join(side, "id", "left_semi").mapInArrow(sets, "id long, set array<long>").dropDuplicates(["id"]), "near-sets")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 |A ∩ B| >= percent |A ∪ B|."""
    both = (pairs.join(full.select(F.col("id").alias("a"), F.col("set").alias("left")), "a")
            .join(full.select(F.col("id").alias("b"), F.col("set").alias("right")), "b"))
    common = F.size(F.array_intersect("left", "right"))
    return both.withColumn("common", common).filter(
        100 * F.col("common") >= percent * (F.size("left") + F.size("right") - F.col("common"))).select("a", "b")


def _common(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray, columns: int = 4_096) -> np.ndarray:
    """Sizes of the intersections of sets[one] with sets[two], by products of 0/1 matrices over slices of the shingles."""
    used = np.concatenate([one, two])
    value = np.concatenate([sets[i] for i in used])
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    known, at, n = np.unique(value, return_inverse=True, return_counts=True)
    place = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[at]
    keep = place >= 0
    row, place = row[keep], place[keep]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(one), len(two)), np.float32)
    for c in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        lo, hi = np.searchsorted(place, [c, c + columns])
        m = np.zeros((len(used), columns), np.float32)
        m[row[lo:hi], place[lo:hi] - c] = 1
        out += m[:len(one)] @ m[len(one):].T
    return out.astype(np.int64)


def _tile_links(left: DataFrame, full: DataFrame, percent: int, least: int, n: int, tile: int) -> DataFrame:
    """Confirmed links (a, b) between different components in a bucket, from groups of at most 2 · tile rows; of the links of a
    group only as many as join its components."""
    size = written(left.groupBy("key").agg(F.count(F.lit(1)).alias("members")), "near-sizes")
    dealt = left.join(size, "key").withColumn("tiles", F.ceil(F.col("members") / tile).cast("int")) \
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).join(full, "id")
    # tile pair (lo, hi): each row goes to the pairs its own tile is part of
    copies = dealt.select("key", "id", "component", "sig", "set", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")) \
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id", "component", "sig", "set", "own")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, comp, own = (group.column(c).to_numpy() for c in ("id", "component", "own"))
        sig = group.column("sig").combine_chunks()
        sig = sig.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).view(np.uint64)
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        one, two = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        if not len(one) or not len(two):
            return pa.table([np.zeros(0, np.int64)] * 2, ["a", "b"])
        near = np.zeros((len(one), len(two)), bool)
        for r, i in enumerate(one):
            d = sig[i] ^ sig[two]
            equal = n - np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(ODD)).sum(axis=1)
            near[r] = (equal >= least) & (comp[two] != comp[i])
        rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        a, b = [], []
        if len(rows):
            flat = group.column("set").combine_chunks()
            cuts, values = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False)
            sets = [values[cuts[i]:cuts[i + 1]] for i in range(len(ids))]
            length = np.diff(cuts)
            both = _common(sets, one[rows], two[cols])
            union = length[one[rows]][:, None] + length[two[cols]][None] - both
            root = {c: c for c in comp.tolist()}

            def find(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            for r, c in np.argwhere((100 * both >= percent * union) & near[np.ix_(rows, cols)]):
                i, j = one[rows[r]], two[cols[c]]
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(int(ids[i]))
                    b.append(int(ids[j]))
        return pa.table([np.array(a, np.int64), np.array(b, np.int64)], ["a", "b"])

    return copies.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
                    bands: int = 32, rows: int = 5, tile: int = 256) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Documents are linked when 100 · |A ∩ B| >= percent · |A ∪ B| for their shingle sets; component_id is the smallest id
    reachable. A null text, an empty one or one of white space has no shingles and is linked with nothing. Ids must be
    integers; rows that share an id share a component, null ids are their own and kept. Other columns are left out.
    With 32 bands of 5 rows a pair at a similarity of 0.8 shares a bucket with probability 1 - 3e-6.
    """
    n = bands * rows
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = written(signatures(texts, width, bands, rows), "near-signed")
    some = signed.filter("digest is not null and id is not null")
    holder = some.groupBy("digest").agg(F.min("id").alias("holder"), F.min_by(F.struct("keys", "sig"), "id").alias("s"))
    classes = written(holder.select("digest", "holder", "s.keys", "s.sig"), "near-classes")
    members = classes.select(F.col("holder").alias("id"), F.col("holder").alias("component"), "sig", F.explode("keys").alias("key"))
    left = _mixed_buckets(members)
    full = _full_sets(texts.filter("id is not null"), left.select("id").distinct(), width)
    least = least_matches(n, percent / 100)
    centres = written(_centres(left), "near-centres")
    pairs = left.join(centres, "key").filter((F.col("id") != F.col("centre")) & (matching_fields(F.col("sig"), F.col("c_sig"), n) >= least)) \
        .select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
    links = written(_confirmed(written(pairs.distinct(), "near-pairs"), full, percent), "near-links")
    rest = left.join(centres.select("key", "centre"), "key").filter("id <> centre").drop("centre", "component")
    left = _mixed_buckets(rest.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id")))
    links = links.unionAll(written(_tile_links(left, full, percent, least, n, tile), "near-links"))
    roots = classes.select("digest", "holder")
    roots = roots.join(components(links).withColumnRenamed("id", "holder"), "holder", "left")
    roots = written(roots.select("digest", F.coalesce("component", "holder").alias("root")), "near-roots")
    return (signed.select("id", "n", "digest").join(roots, "digest", "left")
            .withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("root", "id")))
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                    F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")))


def _mixed_buckets(members: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    members = written(members.select("key", "id", "component", "sig"), "near-members")
    mixed = written(members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                    .filter("lo <> hi").select("key"), "near-mixed")
    return written(members.join(mixed, "key", "left_semi"), "near-buckets")


def _centres(left: DataFrame) -> DataFrame:
    """(key, centre, c_sig): of each bucket the member whose buckets hold the most rows in all, ties to the smaller id."""
    sizes = written(left.groupBy("key").agg(F.count(F.lit(1)).alias("members")), "near-sizes")
    weight = written(left.select("key", "id").join(sizes, "key").groupBy("id").agg(F.sum("members").alias("weight")), "near-weights")
    best = left.join(weight, "id").groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), "id", "sig")).alias("m"))
    return best.select("key", F.col("m.id").alias("centre"), F.col("m.sig").alias("c_sig"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", broadcast_ids: int = 1_000_000, **how) -> DataFrame:
    """The rows of `docs` without those that `near_duplicates` does not keep: one document of each component stays.

    Up to `broadcast_ids` dropped ids (8 MB) are sent to the rows, beyond that rows and ids are shuffled.
    """
    dropped = written(near_duplicates(docs, id_col=id_col, **how).filter("not kept").select(id_col), "near-dropped")
    side = F.broadcast(dropped) if dropped.count() <= broadcast_ids else dropped
    return docs.join(side, id_col, "left_anti")

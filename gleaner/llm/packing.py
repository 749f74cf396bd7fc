"""Lexical retrieval packing: token windows filled with documents that resemble one another.

Every document becomes token ids and a closing id. Whole windows of it stand alone; what is left, shorter than a window,
is packed with the remainders of other documents. Remainders are dealt into shards of bounded size by the hash of their
id; each shard builds a BM25 inverted index (document frequencies and the mean length come from all documents). The
first unused remainder seeds a window; its neighbours by BM25 over its weightiest terms fill it greedily, best first,
those that fit whole before one that is cut. What is cut off stays in the index. So every window but the last one of a
shard is full.

Token ids come from the byte-level BPE ranks file, which holds the vocabulary of byte_bpe_50k.json and gives the same ids
several times faster; a test compares both.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import small, written

K1, B = 1.2, 0.75


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def public_vocabulary() -> tuple[str, str]:
    """(ranks file, split pattern) of the public 50k byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(text: str | None, vocabulary: tuple[str, str], last: int) -> np.ndarray:
    """Token ids of a text and the closing id; a null text counts as empty."""
    ids = _encoding(*vocabulary).encode_ordinary(text) if text else []
    return np.append(np.array(ids, np.uint32), np.uint32(last))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, vocabulary: tuple[str, str], window: int, last: int, carry: bool) -> DataFrame:
    """(id, n, crcs of whole windows, their ids if `carry`, ids of the remainder) of each row of (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            n, crcs, heads, tails = [], [], [], []
            for text in b.column(1).to_pylist():
                ids = encode(text, vocabulary, last)
                whole = len(ids) // window * window
                n.append(len(ids))
                crcs.append([crc(ids[i:i + window]) for i in range(0, whole, window)])
                heads.append(ids[:whole].astype("<u4").tobytes() if carry else None)
                tails.append(ids[whole:].astype("<u2" if ids.max() < 65_536 else "<u4").tobytes())
            wide = [len(t) > 2 * (k % window) for t, k in zip(tails, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(heads, pa.binary()),
                                              pa.array(tails, pa.binary()), pa.array(wide, pa.bool_())], ["id", "n", "crcs", "head", "tail", "wide"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, crcs array<long>, head binary, tail binary, wide boolean")


def _ids(tail: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(tail, "<u4" if wide else "<u2").astype(np.int64)


def frequencies(rows: DataFrame) -> dict[int, int]:
    """In how many remainders each token stands; at most one entry per token of the vocabulary."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, np.int64)
        for b in small(batches):
            for tail, wide in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.unique(_ids(tail, wide))
                if len(ids) and ids[-1] >= len(seen):
                    seen = np.concatenate([seen, np.zeros(ids[-1] + 1 - len(seen), np.int64)])
                seen[ids] += 1
        has = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(seen[has])], ["token", "n"])

    return {r.token: r.n for r in rows.select("tail", "wide").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}


class Shard:
    """The BM25 index of a shard's remainders."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float, terms: int):
        self.tails, self.terms = tails, terms
        token, owner, weight, first = [], [], [], [0]
        for i, t in enumerate(tails):
            ids, tf = np.unique(t, return_counts=True)
            token.append(ids)
            owner.append(np.full(len(ids), i))
            weight.append(idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean)))
            first.append(first[-1] + len(ids))
        self.token, self.owner, self.weight = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (token, owner, weight))
        self.first = first
        order = np.argsort(self.token, kind="stable")
        self.posting_owner, self.posting_weight = self.owner[order], self.weight[order]
        self.names, self.begin = np.unique(self.token[order], return_index=True)
        self.begin = np.append(self.begin, len(order))

    def scores(self, seed: int) -> np.ndarray:
        lo, hi = self.first[seed], self.first[seed + 1]
        top = lo + np.argsort(-self.weight[lo:hi], kind="stable")[:self.terms]
        out = np.zeros(len(self.tails))
        for at in np.searchsorted(self.names, self.token[top]):
            span = slice(self.begin[at], self.begin[at + 1])
            out[self.posting_owner[span]] += self.posting_weight[span]
        return out


def fill_windows(shard: Shard, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(window, offset, document, start in its remainder, length) of every piece."""
    size = np.array([len(t) for t in shard.tails])
    done = np.zeros(len(size), np.int64)
    left = size.copy()
    number, seed = 0, 0
    while True:
        while seed < len(size) and not left[seed]:
            seed += 1
        if seed == len(size):
            return
        room, offset = window, 0
        take, score = seed, None
        while True:
            k = int(min(left[take], room))
            yield number, offset, take, int(done[take]), k
            done[take] += k
            left[take] -= k
            offset += k
            room -= k
            if not room:
                break
            if score is None:
                score = shard.scores(seed)
                order = np.argsort(-score, kind="stable")
            order = order[left[order] > 0]
            if not len(order):
                return
            whole = np.flatnonzero(left[order] <= room)
            near = whole[score[order[whole]] > 0]
            take = int(order[near[0]] if len(near) else order[0])
        number += 1


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, last: int = 0,
         vocabulary: tuple[str, str] | None = None, shard_docs: int = 1_024, terms: int = 16, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece.

    Each id of each document lies in exactly one piece; offsets in a sequence have no gaps. Null and empty texts have the
    closing id alone. Null ids are packed like others, rows that share an id are documents of their own; other columns are
    left out; an empty table gives no pieces. with_ids adds the token ids themselves.
    """
    vocabulary = vocabulary or public_vocabulary()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = written(tokenized(source, vocabulary, window, last, with_ids), "packing-tokens")
    counts = frequencies(rows)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("n") % window).alias("mean")).first()
    n = totals.n
    idf = np.zeros(max(counts, default=0) + 1)
    for token, df in counts.items():
        idf[token] = np.log(1 + (n - df + 0.5) / (df + 0.5))
    held = docs.sparkSession.sparkContext.broadcast((idf, max(float(totals.mean or 1), 1.0)))
    shards = max(1, -(-n // shard_docs))
    kind = docs.schema[id_col].dataType
    out = [f"id {kind.simpleString()}", "start long", "length long", "ids_crc32 long", "doc_tokens long", "sequence_id long", "offset long"]
    out += ["ids array<long>"] * with_ids

    def solve(group: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(group, sort_keys=[("id", "ascending"), ("n", "ascending"), ("tail", "ascending")])
        group = group.take(order)
        idf, mean = held.value
        sizes, crcs, heads = (group.column(c).to_pylist() for c in ("n", "crcs", "head"))
        tails = [_ids(t, w) for t, w in zip(group.column("tail").to_pylist(), group.column("wide").to_pylist())]
        base = group.column("shard")[0].as_py() << 32
        owner, rest = [], []
        number = 0
        for i, own in enumerate(crcs):
            head = np.frombuffer(heads[i], "<u4") if with_ids else None
            for j, c in enumerate(own):
                owner.append(i)
                rest.append((j * window, window, c, sizes[i], base + number, 0, *([head[j * window:(j + 1) * window].tolist()] if with_ids else [])))
                number += 1
        for w, offset, i, start, k in fill_windows(Shard(tails, idf, mean, terms), window):
            ids = tails[i][start:start + k]
            owner.append(i)
            rest.append((sizes[i] - len(tails[i]) + start, k, crc(ids), sizes[i], base + number + w, offset, *([ids.tolist()] if with_ids else [])))
        cols = [group.column("id").combine_chunks().take(pa.array(owner, pa.int64()))]
        cols += [pa.array(c, pa.list_(pa.int64()) if i == 6 else pa.int64()) for i, c in enumerate(zip(*rest))]
        return pa.table(cols, [x.split()[0] for x in out])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(solve, ", ".join(out)).withColumnRenamed("id", id_col)

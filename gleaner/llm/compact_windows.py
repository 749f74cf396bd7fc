"""Near-duplicate passages by compact windows.

Tokens are hashed word shingles. For one hash function all subsequences of at least t tokens whose minimum is the same
token form a compact window, the span of that token's node in the Cartesian tree of the hash values. Here the minima of
all length-t windows are taken first (runs of equal minima); the tree over these runs, far fewer than tokens, gives each
run's window: it ends before the next smaller minimum on either side.

A row is a run; its key is its minimum. Two windows of min_words words at the similarity share an unbroken repeat of `longest_run`
words (25 of 50 at 0.8), unless they hold two words in a row twice. So the keys of one function are minima over wide shingles (13
words) in all stretches of that length: whatever repeats one shares a key, and few texts share 13 words by chance. Where a window
does hold two words in a row twice, its minima under `bands` functions are keys as well: passages whose windows of t tokens
have a similarity S agree in one with probability S; these come from shingles two words wider than those of the similarity.

Documents that share a passage are linked, and links make classes; the passage of a third of a corpus needs a link a
document, not all pairs. Nothing that could join two classes is left out:

1. Rows of one key whose stretches of windows are equal are linked by that alone and stand for each other: one goes on.
   Each task does so with the documents it holds before the one exchange by key, and after it sorted runs are read as a stream.
2. Where the rest of a key is of several classes, all are compared with one of them, on the texts.
3. Where it still is, all are compared with all of other classes, in tiles of bounded size. In large groups, rows of which no
   stretch is long enough in tokens that any other row of the group holds are left out first: they repeat nobody.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.graph import components
from gleaner.llm.minhash import _MIX, _blend, _common, shingle_hashes
from gleaner.llm.shared import small, written

ROW = "key long, stretch long, doc long, a int, b int, other long"
NAMES = ["key", "stretch", "doc", "a", "b", "other"]
WIDER = 2


def cartesian_bounds(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the next smaller value before and after each one (-1, len): the spans of the Cartesian tree's nodes."""
    n = len(values)
    before, after = np.full(n, -1), np.full(n, n)
    stack: list[int] = []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            after[stack.pop()] = i
        if stack:
            top = stack[-1]
            before[i] = before[top] if values[top] == v else top
        stack.append(i)
    return before, after


def sliding_minimum(x: np.ndarray, t: int) -> np.ndarray:
    """Minimum of every t consecutive values."""
    rows = -(-len(x) // t)
    full = np.full(rows * t, np.iinfo(np.uint64).max, np.uint64)
    full[:len(x)] = x
    block = full.reshape(rows, t)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - t + 1
    return np.minimum(behind[:m], ahead[t - 1:t - 1 + m])


def minimum_runs(x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first length-t window, minimum, end) of each run of equal minima: its windows cover x[start:end], the part of the compact
    window that subsequences of t tokens can lie in."""
    m = sliding_minimum(x, t)
    start = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    return start, m[start], np.append(start[1:], len(m)) + t - 1


def compact_windows(x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first length-t window of each run of equal minima, minimum, a, b): its compact window is x[a..b].

    A value of 0 separates texts: no window crosses it, and runs with minimum 0 mean nothing.
    """
    start, low, _ = minimum_runs(x, t)
    before, after = cartesian_bounds(low.tolist())
    bound = np.append(start, len(x) - t + 1)
    return start, low, bound[before + 1], bound[after] + t - 2


class _Joined:
    """Texts, as arrays of word hashes, behind each other."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(x) for x in texts])
        self.words = np.concatenate(texts)
        self.begins = np.cumsum(sizes) - sizes
        self.text = np.repeat(np.arange(len(texts)), sizes)
        # of every word, where its text begins and ends
        self.begin, self.end = np.repeat(self.begins, sizes), np.repeat(self.begins + sizes, sizes)
        n = len(self.words)
        power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _MIX)]))
        self.back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(pow(int(_MIX), -1, 1 << 64)))]))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * power[:-1])])

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words a to b, end exclusive."""
        return _blend((self.total[b] - self.total[a]) * self.back[a] + (b - a).astype(np.uint64))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles that begin at each word, and whether they stay in its text."""
        a = np.arange(len(self.words) - width + 1)
        return self.stretch(a, a + width), a + width <= self.end[:len(a)]


def longest_run(width: int, min_words: int, percent: int) -> int:
    """Words of the longest unbroken repeat that two windows of min_words words at the similarity have at least, if neither holds
    two words in a row twice.

    All t shingles of a window differ then; c of them are common, t - c at most are not. Common ones that follow each other in
    one window do so in the other; between two unbroken repeats at least width - 2 shingles are not common.
    """
    t = min_words - width + 1
    common = -(-2 * t * percent // (100 + percent))
    runs = 1 + (t - common) // max(width - 2, 1)
    return -(-common // runs) + width - 1


def repeating_parts(held: _Joined, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches covered by windows of min_words words that hold two words in a row twice."""
    pair, inside = held.shingles(2)
    at = np.flatnonzero(inside)
    at = at[np.argsort(pair[at], kind="stable")]
    same = pair[at[1:]] == pair[at[:-1]]
    before, after = at[:-1][same], at[1:][same]
    low = np.maximum(after - min_words + 2, held.begin[after])
    high = np.minimum(before, held.end[before] - min_words)
    low, high = low[low <= high], high[low <= high]
    edge = np.bincount(low, minlength=len(held.words) + 1) - np.bincount(high + 1, minlength=len(held.words) + 1)
    runs = np.array(_runs(np.cumsum(edge) > 0, 1), np.int64).reshape(-1, 2)
    return runs[:, 0], runs[:, 1] + min_words - 1


def window_keys(texts: list[np.ndarray], width: int, min_words: int, percent: int, bands: int) -> tuple[np.ndarray, ...]:
    """(key, stretch, index of text, a, b) of runs of equal minima: the windows of min_words words that meet by the key lie in the
    words a to b of the text, end exclusive, `stretch` is a hash of these. Texts have min_words words at least."""
    held = _Joined(texts)
    run = longest_run(width, min_words, percent)
    wide = (run + 1) // 2
    h, inside = held.shingles(wide)
    start, low, end = minimum_runs(np.where(inside, h | np.uint64(1), np.uint64(0)), run - wide + 1)
    use = low > 0
    start, low, end = start[use], low[use], end[use] + wide - 1
    a, b = np.maximum(start - (min_words - run), held.begin[start]), np.minimum(end + min_words - run, held.end[start])
    text = held.text[start]
    out = [(_blend(low * _MIX).view(np.int64), held.stretch(a, b).view(np.int64), text, a - held.begins[text], b - held.begins[text])]
    begins, ends = repeating_parts(held, min_words)
    if len(begins):
        parts = _Joined([held.words[s:e] for s, e in zip(begins, ends)])
        wide = min(width + WIDER, min_words)
        shingles, inside = parts.shingles(wide)
        for band in range(bands):
            h = np.where(inside, _blend(shingles * _MIX + np.uint64(band + 1)) | np.uint64(1), np.uint64(0))
            start, low, end = minimum_runs(h, min_words - wide + 1)
            use = low > 0
            start, low, end = start[use], low[use], end[use] + wide - 1
            part = parts.text[start]
            text = held.text[begins[part]]
            shift = begins[part] - parts.begins[part] - held.begins[text]
            out.append((_blend(low * _MIX + np.uint64(band + 1)).view(np.int64), parts.stretch(start, end).view(np.int64), text, start + shift, end + shift))
    return tuple(np.concatenate(c) for c in zip(*out))


def _equal_stretches(key, stretch, doc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by key and stretch: indexes of the first row of each pair of them, and links (doc, doc of the first) of the others."""
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (stretch[1:] != stretch[:-1])])
    at = np.flatnonzero(first)
    centre = doc[at[np.cumsum(first) - 1]]
    use = doc != centre
    links = np.unique(np.stack([doc[use], centre[use]], 1), axis=0)
    return at, links[:, 0], links[:, 1]


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    kinds = {"a": pa.int32(), "b": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for c, n in zip(columns, names)], names)


def _link_rows(doc: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    none = [None] * len(doc)
    return _batch([_blend(doc.astype(np.uint64) * _MIX).view(np.int64), none, doc, none, none, other], NAMES)


def window_rows(texts: DataFrame, width: int, min_words: int, percent: int, bands: int, words_at_once: int = 500_000) -> DataFrame:
    """Window rows (other null) of each text, and links already found among the texts a task holds at once."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0
        for batch in small(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = shingle_hashes(text, 1)
                if len(x) >= min_words:
                    ids.append(i)
                    held.append(x)
                    size += len(x)
                if size >= words_at_once:
                    yield from emit(ids, held)
                    ids, held, size = [], [], 0
        if held:
            yield from emit(ids, held)

    def emit(ids: list, held: list) -> Iterator[pa.RecordBatch]:
        key, stretch, text, a, b = window_keys(held, width, min_words, percent, bands)
        doc = np.array(ids, np.int64)[text]
        order = np.lexsort((a, doc, stretch, key))
        key, stretch, doc, a, b = key[order], stretch[order], doc[order], a[order], b[order]
        at, *links = _equal_stretches(key, stretch, doc)
        yield _batch([key[at], stretch[at], doc[at], a[at], b[at], [None] * len(at)], NAMES)
        if len(links[0]):
            yield _link_rows(*links)

    return texts.mapInArrow(make, ROW)


def shared_rows(rows: DataFrame) -> DataFrame:
    """Links (other not null), and of each key with several different stretches one row a stretch."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, went = None, False
        for batch in batches:
            ready = batch.filter(batch.column(5).is_valid())
            if ready.num_rows:
                yield ready
            single = batch.filter(batch.column(5).is_null())
            if not single.num_rows:
                continue
            cols = [single.column(i).to_numpy() for i in range(5)]
            if last is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(last, cols)]
            at, *links = _equal_stretches(*cols[:3])
            cols = [c[at] for c in cols]
            same = cols[0][1:] == cols[0][:-1]
            near = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            last, went, gone = [c[-1:] for c in cols], went if len(at) == 1 and last is not None else bool(near[-1]), went
            if gone:
                near[0] = False
            if near.any():
                yield _batch([*(c[near] for c in cols), [None] * int(near.sum())], NAMES)
            if len(links[0]):
                yield _link_rows(*links)

    return rows.repartition("key").sortWithinPartitions("key", "stretch", "doc", "a").mapInArrow(stream, ROW)


def _segments(hit: np.ndarray, t: int, share: int) -> list[tuple[int, int]]:
    """The longest stretch [s, e) of at least t in which `share` percent of the tokens hit, then the same on either side of it."""
    out, todo = [], [(0, len(hit))]
    gain = np.where(hit, 100 - share, -share)
    while todo:
        s, e = todo.pop()
        if e - s < t:
            continue
        total = np.concatenate([[0], np.cumsum(gain[s:e])])
        # for every end the earliest begin from which the sum is not negative
        begin = np.searchsorted(-np.minimum.accumulate(total), -total, side="left")
        end = int(np.argmax(np.arange(len(total)) - begin))
        at = np.flatnonzero(hit[s + begin[end]:s + end])
        if not len(at):
            continue
        u, v = s + int(begin[end]) + int(at[0]), s + int(begin[end]) + int(at[-1]) + 1
        if v - u < t:
            continue
        out.append((u, v))
        todo += [(s, u), (v, e)]
    return sorted(out)


def shared_passages(x: np.ndarray, y: np.ndarray, t: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start in y, end in y, similarity) of stretches of x that y repeats; of tokens, ends exclusive.

    Two sets at a similarity J have at least a share J of either in the other, and sets of one size a share 2 J / (1 + J), so
    stretches with these shares of common tokens come first, then unbroken repeats. One whose similarity is too small is cut by
    what of it the stretch of y holds. What these leave of x is compared with y by all windows of t tokens: where two of them have
    the similarity, something is found.
    """
    found = []
    hit = np.isin(x, y)
    # the last is taken first
    todo = [(0, len(x), 0, len(y), share) for share in (100, -(-200 * percent // (100 + percent)), percent)]
    while todo:
        begin, end, low, high, share = todo.pop()
        near = np.isin(x[begin:end], y[low:high])
        if near.sum() < t * share // 100:
            continue
        for s, e in _segments(near, t, share) if share < 100 else _runs(near, t):
            s, e = s + begin, e + begin
            if any(f[0] <= s and e <= f[1] for f in found):
                continue
            part = np.unique(x[s:e])
            same = np.isin(y[low:high], part)
            for u, v in _segments(same, t, share) if share < 100 else _runs(same, t):
                u, v = u + low, v + low
                both, union = _sizes(part, y[u:v])
                if 100 * both >= percent * union:
                    found.append((s, e, u, v, both / union))
                elif (s, e, u, v) != (begin, end, low, high):
                    todo.append((s, e, u, v, share))
    todo, begin = [], 0
    for s, e in [*sorted(f[:2] for f in found), (len(x), len(x))]:
        todo.append((begin, s))
        begin = max(begin, e)
    while todo:
        begin, end = todo.pop()
        if end - begin >= t and (best := _equal_windows(x[begin:end], y, hit[begin:end], t, percent)):
            s, u, similarity = best
            found.append((begin + s, begin + s + t, u, u + t, similarity))
            todo += [(begin, begin + s), (begin + s + t, end)]
    return sorted(found)


def _sizes(part: np.ndarray, other: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of the distinct values of `part`, distinct already, and of `other`."""
    other = np.unique(other)
    both = len(np.intersect1d(part, other, assume_unique=True))
    return both, len(part) + len(other) - both


def _distinct(x: np.ndarray, t: int, hit: np.ndarray | None = None) -> np.ndarray:
    """Number of distinct tokens, or of those that hit, in every window of t."""
    order = np.argsort(x, kind="stable")
    before = np.full(len(x), -1)
    same = x[order[1:]] == x[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    # a token is new in the windows that begin behind the last one equal to it
    at = np.arange(len(x))
    low, high = np.maximum(before + 1, at - t + 1), np.minimum(at, len(x) - t)
    use = low <= high if hit is None else (low <= high) & hit
    edge = np.bincount(low[use], minlength=len(x) + 1) - np.bincount(high[use] + 1, minlength=len(x) + 1)
    return np.cumsum(edge)[:len(x) - t + 1]


def _holding(x: np.ndarray, common: np.ndarray, t: int) -> np.ndarray:
    """1 where a window of t of x holds a token of `common` (sorted), a row a window."""
    at = np.flatnonzero(np.isin(x, common))
    column = np.searchsorted(common, x[at])
    edge = np.zeros((len(x) + 1, len(common)), np.int32)
    np.add.at(edge, (np.maximum(at - t + 1, 0), column), 1)
    np.add.at(edge, (at + 1, column), -1)
    return (edge.cumsum(0)[:len(x) - t + 1] > 0).astype(np.float32)


def _equal_windows(x: np.ndarray, y: np.ndarray, hit: np.ndarray, t: int, percent: int, side: int = 1_024) -> tuple[int, int, float] | None:
    """(start in x, start in y, similarity) of length-t windows whose similarity is at least percent, if there are any.

    Common tokens are counted for all pairs of windows, in squares: equal positions, or where windows hold a token several times
    the distinct ones.
    """
    if min(len(x), len(y)) < t:
        return None

    def enough(z: np.ndarray, hits: np.ndarray, kinds: np.ndarray) -> list[tuple[int, int]]:
        runs = _runs(100 * _distinct(z, t, hits) >= percent * kinds, 1)
        return [(i, min(i + side, e)) for s, e in runs for i in range(s, e, side)]

    mine = enough(x, hit, kinds_x := _distinct(x, t)) if hit.any() else []
    theirs = enough(y, np.isin(y, x), kinds_y := _distinct(y, t)) if mine else []
    for i, i_end in mine:
        for j, j_end in theirs:
            one, two = x[i:i_end + t - 1], y[j:j_end + t - 1]
            if min(kinds_x[i:i_end].min(), kinds_y[j:j_end].min()) < t:
                common = np.intersect1d(one, two)
                count = (_holding(one, common, t) @ _holding(two, common, t).T).astype(np.int64)
            else:
                equal = one[:, None] == two[None]
                if equal.any(1).sum() < t * percent // 100:
                    continue
                total = np.zeros((equal.shape[0] + 1, equal.shape[1] + 1), np.int32)
                total[1:, 1:] = equal.cumsum(0, dtype=np.int32).cumsum(1, dtype=np.int32)
                count = total[t:, t:] - total[:-t, t:] - total[t:, :-t] + total[:-t, :-t]
            # c common ones of m + n make a similarity of c / (m + n - c)
            kinds = kinds_x[i:i_end, None] + kinds_y[None, j:j_end]
            best = np.argwhere((100 + percent) * count >= percent * kinds)
            if len(best):
                s, u = (int(v) for v in best[0])
                both = int(count[s, u])
                return i + s, j + u, both / (int(kinds[s, u]) - both)
    return None


def _runs(hit: np.ndarray, t: int) -> list[tuple[int, int]]:
    """Unbroken stretches of at least t hits."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(int(s), int(e)) for s, e in zip(edge[::2], edge[1::2]) if e - s >= t]


def _passages(links: DataFrame, held: DataFrame, width: int, t: int, percent: int) -> DataFrame:
    """(id, other, s, e, u, v, sim): passages that linked documents share; of tokens, ends exclusive."""
    both = (links.join(held.select(F.col("id").alias("doc"), F.col("text").alias("left")), "doc")
            .join(held.select(F.col("id").alias("other"), F.col("text").alias("right")), "other"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[] for _ in range(7)]
            doc, other = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            last, y = None, None
            for i in range(batch.num_rows):
                # rows often arrive by other: its hashes serve until the next one
                if other[i] != last:
                    last, y = other[i], shingle_hashes(batch.column(3)[i].as_py(), width)
                for found in shared_passages(shingle_hashes(batch.column(2)[i].as_py(), width), y, t, percent):
                    for c, value in zip(out, (doc[i], other[i], *found)):
                        c.append(value)
            kinds = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             ["id", "other", "s", "e", "u", "v", "sim"])

    return both.select("doc", "other", "left", "right").mapInArrow(find, "id long, other long, s long, e long, u long, v long, sim double")


def shares_passage(x: np.ndarray, y: np.ndarray, t: int, percent: int) -> bool:
    """Whether two windows of t tokens of x and y have the similarity."""
    return min(len(x), len(y)) >= t and all(_enough(z, np.isin(z, other), t, percent) for z, other in ((x, y), (y, x))) and bool(
        shared_passages(x, y, t, percent))


def _enough(x: np.ndarray, hit: np.ndarray, t: int, percent: int) -> bool:
    """Whether in some window of t `percent` of the distinct tokens hit, without which no other window has the similarity."""
    return bool((100 * _distinct(x, t, hit) >= percent * _distinct(x, t)).any())


def _in_others(sets: list[np.ndarray], comp: np.ndarray) -> np.ndarray:
    """Of each set the number of values that a set of another component holds."""
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    known, at = np.unique(np.concatenate(sets), return_inverse=True)
    low, high = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
    np.minimum.at(low, at, comp[row])
    np.maximum.at(high, at, comp[row])
    return np.bincount(row[(low < high)[at]], minlength=len(sets))


def _joined_classes(found: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) of the documents of earlier classes and of the links (doc, other) found between them. Only what the links
    join is looked at again."""
    label = found.withColumnRenamed("component", "label")
    ends = links.join(label.withColumnRenamed("id", "doc"), "doc", "left").select(F.coalesce("label", "doc").alias("a"), "other").join(
        label.withColumnRenamed("id", "other"), "other", "left").select("a", F.coalesce("label", "other").alias("b"))
    joined = components(ends)
    older = label.join(joined.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("component", "label").alias("component"))
    return written(older.unionAll(joined.join(found.select("id"), "id", "left_anti")), "passage-classes")


def _mixed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, doc, a, b, component): the rows of keys that hold documents of several classes."""
    members = rows.select("key", "doc", "a", "b").join(found.withColumnRenamed("id", "doc"), "doc", "left").withColumn(
        "component", F.coalesce("component", "doc"))
    members = written(members.select("key", "doc", "a", "b", "component"), "passage-members")
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    return written(members.join(mixed, "key", "left_semi"), "passage-mixed")


def _centre_pairs(mixed: DataFrame) -> DataFrame:
    """(doc, a, b, cdoc, ca, cb): each row with the centre of its key, if that is of another component; one row a pair of documents,
    with the smallest regions that hold all its windows. The centre is of the document whose keys hold the most rows in all."""
    sizes = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    weight = mixed.select("key", "doc").join(sizes, "key").groupBy("doc").agg(F.sum("n").alias("weight"))
    centres = mixed.join(weight, "doc").groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), "doc", "a", "b", "component")).alias("c"))
    both = mixed.join(centres, "key").filter("component <> c.component")
    later = F.col("doc") > F.col("c.doc")
    mine, other = F.struct("doc", "a", "b"), F.struct("c.doc", "c.a", "c.b")
    pairs = both.select(F.when(later, mine).otherwise(other).alias("x"), F.when(later, other).otherwise(mine).alias("y"))
    return pairs.groupBy(F.col("x.doc").alias("doc"), F.col("y.doc").alias("cdoc")).agg(
        F.min("x.a").alias("a"), F.max("x.b").alias("b"), F.min("y.a").alias("ca"), F.max("y.b").alias("cb"))


def _wanted(texts: DataFrame, ids: DataFrame, broadcast_ids: int) -> DataFrame:
    """(id, text) of the ids asked for, one row an id; texts are not shuffled for that where no id comes twice."""
    ids = written(ids.distinct(), "passage-ids")
    side = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    held = texts.join(side, "id", "left_semi")
    twice = held.select("id").groupBy("id").count().filter("count > 1")
    return held if twice.isEmpty() else held.dropDuplicates(["id"])


def _centre_links(pairs: DataFrame, texts: DataFrame, width: int, t: int, percent: int, broadcast_ids: int) -> DataFrame:
    """The links (doc, other) among the pairs: their regions share a passage."""
    held = _wanted(texts, pairs.select(F.explode(F.array("doc", "cdoc")).alias("id")), broadcast_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            parts = [x.encode("utf-8", "surrogatepass").lower().split()[i:j] for x, i, j in zip(*(b.column(c).to_pylist() for c in range(3)))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3, 7)), pa.array([b" ".join(p) for p in parts], pa.binary())],
                                             ["doc", "cdoc", "ca", "cb", "left"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            doc, cdoc, left, right, ca, cb = (b.column(i).to_pylist() for i in range(6))
            out: list[list] = [[], []]
            last, y = None, None
            for i in range(b.num_rows):
                # rows often arrive by cdoc: its hashes serve until the next one
                if cdoc[i] != last:
                    last, y = cdoc[i], shingle_hashes(right[i], width)
                x = shingle_hashes(left[i].decode("utf-8", "surrogatepass"), width)
                if shares_passage(x, y[ca[i]:max(cb[i] - width + 1, 0)], t, percent):
                    out[0].append(doc[i])
                    out[1].append(cdoc[i])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc", "other"])

    left = pairs.join(held.withColumnRenamed("id", "doc"), "doc").select("text", "a", "b", "doc", "cdoc", "ca", "cb").mapInArrow(
        cut, "doc long, cdoc long, ca int, cb int, left binary")
    return left.join(held.withColumnRenamed("id", "cdoc"), "cdoc").select("doc", "cdoc", "left", "text", "ca", "cb").mapInArrow(
        compare, "doc long, other long")


def _tile_links(mixed: DataFrame, texts: DataFrame, width: int, t: int, percent: int, tile: int, broadcast_ids: int) -> DataFrame:
    """Links (doc, other) between rows of one key and different components, from groups of at most 2 · tile rows; of the links of a
    group only as many as join its components."""
    # a document's windows are as many as its length allows
    lists = mixed.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("key", "a", "b", "component")).alias("w"))
    held = _wanted(texts, mixed.select(F.col("doc").alias("id")), broadcast_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 100):
            for doc, text, windows in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = shingle_hashes(text, width).view(np.int64)
                for i in range(0, len(windows), 1_000):
                    part = windows[i:i + 1_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w["key"] for w in part], pa.int64()), pa.array([doc] * len(part), pa.int64()),
                         pa.array([w["a"] for w in part], pa.int32()), pa.array([w["component"] for w in part], pa.int64()),
                         pa.array([x[w["a"]:w["b"] - width + 1] for w in part], pa.list_(pa.int64()))], ["key", "doc", "a", "component", "tokens"])

    rows = written(held.join(lists, "id").select("id", "text", "w").mapInArrow(
        cut, "key long, doc long, a int, component long, tokens array<long>"), "passage-windows")
    sizes = written(rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), "passage-sizes")
    large = rows.join(sizes.filter("tiles > 1"), "key").withColumn("own", F.pmod(F.xxhash64("doc", "a"), F.col("tiles")).cast("int"))
    # tokens that two documents of a key hold, for each tile that holds them
    seen = large.select("key", "own", "doc", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("key", "own", "token").agg(
        F.min("doc").alias("lo"), F.max("doc").alias("hi")).groupBy("key", "token").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list("own").alias("tiles")).filter("lo < hi").select(
        F.col("key").alias("of_key"), F.explode("tiles").alias("of_tile"), "token")
    kept = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("a", pa.int32()), ("component", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def repeating(part: pa.Table, known: pa.Table) -> pa.Table:
        # a tile may have no rows, a group no tokens that two documents hold
        if not part.num_rows or not known.num_rows:
            return kept.empty_table()
        tokens = [np.array(x, np.int64) for x in part.column("tokens").to_pylist()]
        hit = np.split(np.isin(np.concatenate(tokens), known.column("token").to_numpy()), np.cumsum([len(x) for x in tokens])[:-1])
        use = [len(x) >= t and _enough(x, h, t, percent) for x, h in zip(tokens, hit)]
        return part.filter(pa.array(use, pa.bool_())).select(kept.names)

    some = written(large.drop("tiles").groupBy("key", "own").cogroup(seen.groupBy("of_key", "of_tile")).applyInArrow(repeating, rows.schema), "passage-repeating")
    few = some.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"), F.min("component").alias("lo"),
                                  F.max("component").alias("hi")).filter("lo <> hi").select("key", "tiles")
    dealt = rows.join(sizes.filter("tiles = 1"), "key").unionAll(some.join(few, "key")).withColumn(
        "own", F.pmod(F.xxhash64("doc", "a"), F.col("tiles")).cast("int"))
    # tile pair (lo, hi): each row goes to the pairs its own tile is part of
    copies = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "doc", "component", "tokens")

    def compare(group: pa.Table) -> pa.Table:
        doc, comp, own = (group.column(c).to_numpy() for c in ("doc", "component", "own"))
        mixed = group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
        tokens = [np.array(x, np.int64).view(np.uint64) for x in group.column("tokens").to_pylist()]
        out: list[list] = [[], []]
        if comp.min() != comp.max() and min(own.tolist()) == group.column("lo")[0].as_py() and max(own.tolist()) == group.column("hi")[0].as_py():
            # any passage has at least as many distinct tokens as the window of t with the fewest
            least = np.array([_distinct(x, t).min() if len(x) >= t else 1 << 40 for x in tokens])
            sets = [np.unique(x) for x in tokens]
            use = np.flatnonzero(100 * _in_others(sets, comp) >= percent * least)
            if len(use) < 2:
                return pa.table([pa.array(c, pa.int64()) for c in out], ["doc", "other"])
            doc, comp, own, tokens, least = doc[use], comp[use], own[use], [tokens[i] for i in use], least[use]
            both = _common([sets[i] for i in use], np.arange(len(use)), np.arange(len(use)))
            # c common ones of m + n make a similarity of c / (m + n - c)
            near = ((100 + percent) * both >= percent * (least[:, None] + least[None])) & (comp[:, None] != comp[None])
            if mixed:
                near &= own[:, None] != own[None]
            root = {c: c for c in comp.tolist()}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            for i, j in np.argwhere(np.triu(near, 1)):
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y and shares_passage(tokens[i], tokens[j], t, percent):
                    root[max(x, y)] = min(x, y)
                    out[0].append(max(int(doc[i]), int(doc[j])))
                    out[1].append(min(int(doc[i]), int(doc[j])))
        return pa.table([pa.array(c, pa.int64()) for c in out], ["doc", "other"])

    # groups cost by their squares, not by their bytes: a set number of tasks
    tasks = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(tasks, "key", "lo", "hi").groupBy("key", "lo", "hi").applyInArrow(compare, "doc long, other long")


def passage_links(docs: DataFrame, **how) -> DataFrame:
    """(doc, other): the links of `links_and_classes`."""
    return links_and_classes(docs, **how)[0]


def links_and_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, min_words: int = 50,
                  percent: int = 80, bands: int = 7, broadcast_ids: int = 1_000_000, tile: int = 256) -> tuple[DataFrame, DataFrame]:
    """Links (doc, other) between documents, doc > other, that share a passage of at least min_words words at a Jaccard similarity
    of percent / 100 or more of their `width`-word shingles, and the classes (id, component) they make. Any two documents that share
    a passage are joined by links, directly or by others.

    Rows of a key that stay of different classes after the comparison with its centre are compared with each other: n such rows
    that are made of tokens they have in common cost n² comparisons of windows, spread over (n / tile)² tasks.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter(
        "id is not null and text is not null")
    shared = written(shared_rows(window_rows(texts, width, min_words, percent, bands)), "passage-rows")
    links = shared.filter("other is not null").select(F.greatest("doc", "other").alias("doc"), F.least("doc", "other").alias("other")).distinct()
    links = written(links, "passage-links")
    rows = shared.filter("other is null")
    t = min_words - width + 1
    found = components(links, "doc", "other")
    pairs = written(_centre_pairs(_mixed(rows, found)), "passage-pairs")
    near = written(_centre_links(pairs, texts, width, t, percent, broadcast_ids), "passage-links")
    found = _joined_classes(found, near)
    rest = _mixed(rows, found)
    last = written(_tile_links(rest, texts, width, t, percent, tile, broadcast_ids), "passage-links")
    return links.unionAll(near).unionAll(last).distinct(), _joined_classes(found, last)


def passage_classes(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """(id, component_id, n_documents) of every row: the smallest id reachable through shared passages, its own if it shares none,
    and the number of documents of that class. Parameters and null texts as in `duplicate_passages`; null ids stay alone."""
    ids = docs.select(F.col(id_col).cast("bigint").alias("id"))
    _, found = links_and_classes(docs, id_col=id_col, **how)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return ids.join(found.join(sizes, "component"), "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("component", "id").alias("component_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("n_documents"))


def duplicate_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, min_words: int = 50,
                       percent: int = 80, bands: int = 7, broadcast_ids: int = 1_000_000, tile: int = 256) -> DataFrame:
    """(id, other_id, start_word, end_word, other_start, other_end, similarity): passages of at least min_words words that
    another document repeats at a Jaccard similarity of percent / 100 or more of their `width`-word shingles.

    Of the documents that share a passage each is paired with those that `passage_links` links it to, not all with all; ends are exclusive.
    Null, empty and shorter texts share nothing; null ids are left out; rows that share an id are one document that
    is not compared with itself; other columns are left out.
    """
    how = {"width": width, "min_words": min_words, "percent": percent, "bands": bands, "broadcast_ids": broadcast_ids, "tile": tile}
    links = written(passage_links(docs, id_col=id_col, text_col=text_col, **how), "passage-links")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter(
        "id is not null and text is not null")
    held = _wanted(texts, links.select(F.explode(F.array("doc", "other")).alias("id")), broadcast_ids)
    found = _passages(links, held, width, min_words - width + 1, percent)
    words = width - 1
    return found.select(F.col("id").alias(id_col), F.col("other").alias("other_id"), F.col("s").alias("start_word"), (F.col("e") + words).alias(
        "end_word"), F.col("u").alias("other_start"), (F.col("v") + words).alias("other_end"), F.col("sim").alias("similarity"))

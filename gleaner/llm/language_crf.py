"""Language identification by a linear-chain conditional random field over words.

Each word gets a score per language from its character n-grams (with word ends, so affixes are among them) and from a
lexicon of frequent training words; transitions between the languages of neighbouring words are learned too.
Forward-backward gives every word's marginal distribution, so a text that switches language is labelled word by word;
a text's language is the one with the largest sum of marginals.

The model is fitted on the driver from a bounded sample; prediction is a map over whole texts. Texts are labelled in
stretches of `STRETCH` words, many at a time. A word's scores are worked out once per task while they stay in a cache
of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import of_each_label, short_batches, small

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
STRETCH = 64
BITS = 17
ORDERS = (1, 2, 3, 4)
WORDS_AT_ONCE = 300_000


def words_of(text: str | None) -> list[str]:
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def ngram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, index of its word) of all n-grams of ^word$, hashed."""
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    own = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))
    h, feats, at = np.zeros(len(code), np.uint64), [], []
    for n in ORDERS:
        shifted = np.zeros_like(code)
        shifted[:len(code) - n + 1] = code[n - 1:]
        h = (h + shifted + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        whole = left >= n
        feats.append((h[whole] >> np.uint64(64 - BITS)).astype(np.int64))
        at.append(own[whole])
    return np.concatenate(feats), np.concatenate(at)


def forward_backward(emit: np.ndarray, move: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (sequence, word, label) and expected transitions; emit: positive factors, move: positive matrix, size: words
    of each sequence. Both passes are scaled to sums of 1."""
    n, length, k = emit.shape
    live = np.arange(length)[None] < size[:, None]
    ahead, back = np.empty_like(emit), np.ones_like(emit)
    for t in range(length):
        a = emit[:, t] if t == 0 else (ahead[:, t - 1] @ move) * emit[:, t]
        ahead[:, t] = np.where(live[:, t, None], a / a.sum(1, keepdims=True), ahead[:, t - 1] if t else a)
    pairs = np.zeros((k, k))
    for t in range(length - 2, -1, -1):
        ahead_of = emit[:, t + 1] * back[:, t + 1]
        b = ahead_of @ move.T
        back[:, t] = np.where(live[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
        both = ahead[:, t, :, None] * move[None] * ahead_of[:, None]
        pairs += (both / both.sum((1, 2), keepdims=True) * live[:, t + 1, None, None]).sum(0)
    both = ahead * back
    return both / both.sum(2, keepdims=True) * live[..., None], pairs


@dataclass
class CrfModel:
    labels: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    lexicon_weights: np.ndarray
    moves: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        feats, own = ngram_features(words)
        out = np.empty((len(words), len(self.labels)))
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(own, self.weights[feats, k], minlength=len(words))
        known = np.fromiter((self.lexicon.get(w, 0) for w in words), np.int64, len(words))
        return out + self.lexicon_weights[known]


def _factors(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(scores - scores.max(-1, keepdims=True), -50, 0))


def fit(samples: list[tuple[str, str]], *, epochs: int = 3, stretch: int = 24, lexicon_size: int = 20_000, switched: float = 0.3,
        rate: float = 0.3, decay: float = 1e-6, seed: int = 7) -> CrfModel | None:
    """Maximum likelihood by AdaGrad on (text, label) samples. A share of `switched` stretches is joined from two samples of any
    label at a random word, so that the chain sees changes of language. None without a usable sample."""
    rng = np.random.default_rng(seed)
    labels = sorted({label for _, label in samples})
    number = {label: i for i, label in enumerate(labels)}
    parts = [(number[label], w[i:i + stretch]) for text, label in samples for w in [words_of(text)] for i in range(0, len(w), stretch)]
    if not parts:
        return None
    k = len(labels)
    seen = Counter(w for _, p in parts for w in p)
    types = {w: i for i, w in enumerate(seen)}
    lexicon = {w: i + 1 for i, (w, n) in enumerate(seen.most_common(lexicon_size)) if n > 2}
    feats, own = ngram_features(list(types))
    order = np.argsort(own, kind="stable")
    feats, first = feats[order], np.searchsorted(own[order], np.arange(len(types) + 1))
    known = np.fromiter((lexicon.get(w, 0) for w in types), np.int64, len(types))
    model = CrfModel(labels, np.zeros((1 << BITS, k)), lexicon, np.zeros((len(lexicon) + 1, k)), np.zeros((k, k)))
    squares = [np.full_like(x, 1e-2) for x in (model.weights, model.lexicon_weights, model.moves)]
    tokens = [np.fromiter((types[w] for w in p), np.int64, len(p)) for _, p in parts]
    truth = [np.full(len(p), label) for label, p in parts]
    for _ in range(epochs):
        mate, mixed = rng.permutation(len(parts)), rng.random(len(parts)) < switched
        for batch in np.array_split(rng.permutation(len(parts)), max(1, len(parts) // 128)):
            seqs, tags = [], []
            for i in batch:
                x, y = tokens[i], truth[i]
                if mixed[i]:
                    cut = rng.integers(0, len(x) + 1)
                    x, y = np.concatenate([x[:cut], tokens[mate[i]][cut:]]), np.concatenate([y[:cut], truth[mate[i]][cut:]])
                if len(x):
                    seqs.append(x)
                    tags.append(y)
            if not seqs:
                continue
            size = np.array([len(x) for x in seqs])
            used, at = np.unique(np.concatenate(seqs), return_inverse=True)
            spans = first[used + 1] - first[used]
            f = feats[np.repeat(first[used] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())]
            of = np.repeat(np.arange(len(used)), spans)
            scores = np.stack([np.bincount(of, model.weights[f, j], minlength=len(used)) for j in range(k)], 1) + model.lexicon_weights[known[used]]
            live = np.arange(size.max())[None] < size[:, None]
            emit = np.ones((len(seqs), size.max(), k))
            emit[live] = _factors(scores)[at]
            marginal, pairs = forward_backward(emit, np.exp(model.moves), size)
            y = np.concatenate(tags)
            error = -marginal[live]
            error[np.arange(len(y)), y] += 1
            by_type = np.stack([np.bincount(at, error[:, j], minlength=len(used)) for j in range(k)], 1)
            moved = np.zeros((k, k))
            for t in tags:
                np.add.at(moved, (t[:-1], t[1:]), 1)
            own_f, at_f = np.unique(f, return_inverse=True)
            grad_f = np.stack([np.bincount(at_f, by_type[of, j], minlength=len(own_f)) for j in range(k)], 1)
            lex, at_l = np.unique(known[used], return_inverse=True)
            grad_l = np.stack([np.bincount(at_l, by_type[:, j], minlength=len(lex)) for j in range(k)], 1)
            for w, sq, rows, g in ((model.weights, squares[0], own_f, grad_f), (model.lexicon_weights, squares[1], lex, grad_l),
                                   (model.moves, squares[2], slice(None), moved - pairs)):
                g = g / len(seqs) - decay * w[rows]
                sq[rows] += g * g
                w[rows] += rate * g / np.sqrt(sq[rows])
    return model


def sample(labelled: DataFrame, *, key_col: str = "doc_id", per_label: int = 300, chars: int = 2_000) -> list[tuple[str, str]]:
    """A bounded sample of (text, lang): of each label the `per_label` texts whose key has the smallest hashes among all of that
    label, of each text a stretch of at most `chars` characters from a place the hash names. It grows with the number of labels."""
    rows = labelled.filter("text is not null and lang is not null").select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col(key_col).alias("key"))
    place = F.pmod(F.xxhash64("key"), F.greatest(F.length("text") - chars, F.lit(1))).cast("int")
    short = rows.select("lang", "key", F.substring(F.col("text"), place + 1, F.lit(chars)).alias("text"))
    picked = of_each_label(short, "lang", F.col("key"), per_label, ["text"]).select("text", "lang").collect()
    return sorted((r.text, r.lang) for r in picked)


class _Cache(dict):
    """Numbers of words met so far; new ones wait in `fresh`."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Labeller:
    """Word marginals of texts under a model, with a bounded cache of word scores."""

    def __init__(self, model: CrfModel, held: int = 100_000):
        self.model, self.held, self.move = model, held, np.exp(model.moves)
        self._reset()

    def _reset(self) -> None:
        self.cache, self.factors = _Cache(), np.empty((0, len(self.model.labels)))

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Per text an array (word, label)."""
        sizes = [len(w) for w in texts]
        if len(self.cache) > self.held:
            self._reset()
        ids = np.fromiter((i for w in texts for i in map(self.cache.__getitem__, w)), np.int64, sum(sizes))
        if self.cache.fresh:
            new = [self.factors]
            for i in range(0, len(self.cache.fresh), 20_000):
                new.append(_factors(self.model.word_scores(self.cache.fresh[i:i + 20_000])))
            self.factors, self.cache.fresh = np.concatenate(new), []
        cuts = [min(STRETCH, n - i) for n in sizes for i in range(0, n, STRETCH)]
        size = np.array(cuts, np.int64)
        out = np.zeros((len(ids), len(self.model.labels)))
        begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        order = np.argsort(size, kind="stable")
        for group in np.array_split(order, max(1, -(-len(order) // 2_048))):
            if not len(group):
                continue
            s = size[group]
            live = np.arange(s.max())[None] < s[:, None]
            at = (begin[group][:, None] + np.arange(s.max())[None])[live]
            emit = np.ones((len(group), s.max(), len(self.model.labels)))
            emit[live] = self.factors[ids[at]]
            out[at] = _marginals_only(emit, self.move, live)[live]
        return np.split(out, np.cumsum(sizes)[:-1]) if texts else []


def _marginals_only(emit: np.ndarray, move: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Marginals as in `forward_backward`, labels outermost so that every step works on long rows."""
    e = np.ascontiguousarray(emit.transpose(1, 2, 0))
    alive = live.T
    length, k, n = e.shape
    ahead, back = np.empty_like(e), np.ones_like(e)
    ahead[0] = e[0] / e[0].sum(0)
    for t in range(1, length):
        a = (move.T @ ahead[t - 1]) * e[t]
        ahead[t] = a / a.sum(0)
    for t in range(length - 2, -1, -1):
        b = move @ (e[t + 1] * back[t + 1])
        back[t] = np.where(alive[t + 1], b / b.sum(0), 1.0)
    both = ahead * back
    return (both / both.sum(1, keepdims=True)).transpose(2, 0, 1)


RUN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())])


def identify(docs: DataFrame, model: CrfModel | None, *, text_col: str = "text", keep: list[str] | None = None, runs: bool = False) -> DataFrame:
    """The `keep` columns (default: all) of every row with lang_pred, score (mean marginal of that label), n_words and evidence (mean
    over the words of their largest marginal: high for a text whose words are each in some known language, whichever it is).
    With `runs` also the stretches of words of one label, as (first word, last word, lang): the languages of a code-switched text.

    A null text, one without a letter, or no model: `und` with score and evidence 0 and no runs. Ties go to the first label in
    sorted order. Columns of the result's names are replaced.
    """
    added = ("lang_pred", "score", "n_words", "evidence") + (("runs",) if runs else ())
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    short_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    carried = text_col in names and docs.schema[text_col].dataType.simpleString() == "string"
    place = names.index(text_col) if carried else len(names)
    more = [] if carried else [F.col(text_col).cast("string").alias("_text")]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(held.value) if held.value else None
        for batch in small(batches):
            texts = batch.column(place).to_pylist()
            label, score, count = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
            sure, found = [0.0] * len(texts), [[] for _ in texts] if runs else None
            waiting: list[tuple[int, list[str]]] = []
            size = 0
            for i, text in enumerate(texts):
                words = words_of(text)
                count[i] = len(words)
                if words and labeller:
                    waiting.append((i, words))
                    size += len(words)
                if waiting and (size >= WORDS_AT_ONCE or i == len(texts) - 1):
                    _settle(labeller, waiting, label, score, sure, found)
                    waiting, size = [], 0
            if waiting:
                _settle(labeller, waiting, label, score, sure, found)
            cols = [batch.column(i) for i in range(len(names))] + [pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(count, pa.int64()),
                                                                          pa.array(sure, pa.float64())]
            if runs:
                cols.append(pa.array(found, pa.list_(RUN)))
            yield pa.RecordBatch.from_arrays(cols, [f"c{i}" for i in range(len(cols))])

    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], *more)
    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)] + [
        f"c{len(names) + i} {kind}" for i, kind in enumerate(("string", "double", "long", "double", "array<struct<first:bigint,last:bigint,lang:string>>")[:len(added)])]
    return source.mapInArrow(predict, ", ".join(kinds)).toDF(*names, *added)


def _settle(labeller: Labeller, waiting: list, label: list, score: list, sure: list, runs: list | None) -> None:
    for (i, words), m in zip(waiting, labeller.marginals([w for _, w in waiting])):
        total = m.sum(0)
        best = int(total.argmax())
        label[i], score[i] = labeller.model.labels[best], min(1.0, float(total[best] / len(words)))
        sure[i] = min(1.0, float(m.max(1).mean()))
        if runs is not None:
            own = m.argmax(1)
            edge = np.flatnonzero(np.diff(own)) + 1
            runs[i] = [{"first": int(a), "last": int(b) - 1, "lang": labeller.model.labels[own[a]]}
                       for a, b in zip([0, *edge], [*edge, len(own)])]


def held_out(doc_id: Column) -> Column:
    """Rows no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2

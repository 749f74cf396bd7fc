"""Facts as column expressions: hygiene, claim words, similarity, in-row matching."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner import constants as K
from gleaner.functions.text import alnum_key, col, let, strip, words


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_fragment(text: Column | str) -> Column:
    """A sentence caught half way: too short, dangling at the end, or opening on a function word."""

    def judged(t: Column) -> Column:
        lowered = F.lower(t)
        dangling = lowered.rlike("(?:" + "|".join(map(re.escape, K.FRAGMENT_TAILS)) + r")\z")
        first = F.regexp_extract(lowered, r"(?U)^\S+", 0)
        opens_low = t.rlike(r"^\p{Ll}") & first.isin(K.FRAGMENT_HEADS)
        return (F.size(words(t)) < K.FRAGMENT_MIN_WORDS) | opens_low | dangling

    return let(F.rtrim(strip(col(text)), F.lit(".")), judged)


def fact_words(text: Column | str) -> Column:
    """Distinct ASCII words of three or more characters: the key near-copies compare on."""
    found = F.regexp_extract_all(F.lower(col(text)), F.lit(K.CLAIM_WORD), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: F.length(w) > 2))


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats."""
    return let(_overlap(a, b), lambda n: F.try_divide(n, F.size(a) + F.size(b) - n))


def dedupe_facts(facts: Column | str, kind: str = "array<struct<text:string>>", text_field: str = "text") -> Column:
    """Keep-first near-copy removal over an array of fact structs (of type `kind`) held in one row.

    Facts without words are never copies. The facts of a batch of rows go to Python (`first_of_near_copies`), where a fact is
    compared only with kept ones it shares rare words with.
    """
    def kept_facts(rows: pa.Array) -> pa.Array:
        facts = rows.flatten()
        words = [[w for w in CLAIM_WORDS.findall((t or "").lower()) if len(w) > 2] for t in facts.field(text_field).to_pylist()]
        kept: list[bool] = []
        ends = pa.compute.fill_null(pa.compute.list_value_length(rows), 0).to_numpy().cumsum()
        for end in ends.tolist():
            kept += first_of_near_copies(words[len(kept):end])
        counts = np.concatenate([[0], np.cumsum(np.array(kept, np.int64))])
        offsets = pa.array(np.concatenate([[0], counts[ends]]).astype(np.int32), mask=np.append(rows.is_null().to_numpy(False), False))
        return pa.ListArray.from_arrays(offsets, facts.filter(pa.array(kept, pa.bool_())))

    # a type given as text needs a session, which a column may be built without
    return F.arrow_udf(kept_facts, StructType.fromDDL(f"k {kind}")["k"].dataType)(col(facts))


CLAIM_WORDS = re.compile(K.CLAIM_WORD)
PAIRED = 40


def first_of_near_copies(facts: list[list[str]], over: float = K.DUPLICATE_FACT_JACCARD) -> list[bool]:
    """For word sets in order, whether each is kept: not more similar (Jaccard) than `over` to one kept before it.

    A set more similar than that shares at least floor(over * size) + 1 words with the other, of either size. So, with the words of
    a row in one order (rarest first), both have k of them among their first size - floor(over * size) - 1 + k words. Kept sets are
    listed under those, k = 2 for sets of up to PAIRED words and what can be similar to them (a pair is rarer than a word), 1 for
    longer ones (they have many pairs), and a fact is compared with what it finds there alone. Sets of one word have only equals.
    """
    often = Counter(chain.from_iterable(facts))
    listed: dict[object, list[frozenset]] = defaultdict(list)
    exact: set[frozenset] = set()
    kept = []
    for words in facts:
        mine = frozenset(words)
        n = len(mine)
        if not n or mine in exact:
            kept.append(not n)
            continue
        rare = sorted(mine, key=lambda w: (often[w], w))
        few = n - int(over * n + 1e-9)
        pairs = list(combinations(rare[:few + 1], 2)) if over * n <= PAIRED else []
        kept.append(not any((shared := len(mine & other)) / (n + len(other) - shared) > over
                            for key in (pairs if n <= PAIRED else rare[:few]) for other in listed.get(key, ())))
        if kept[-1]:
            exact.add(mine)
            for key in (*pairs, *(rare[:few] if n > over * PAIRED else ())):
                listed[key].append(mine)
    return kept


# --- claims ------------------------------------------------------------------
def claim_words(text: Column | str) -> Column:
    bare = F.regexp_replace(strip(col(text)), K.CLAIM_FRAME_PREFIX, "")
    found = F.regexp_extract_all(F.lower(bare), F.lit(K.CLAIM_WORD), F.lit(0))
    return F.array_except(F.filter(found, lambda w: F.length(w) > 2), _literals(K.CLAIM_STOP_WORDS))


def claim_phrases(text: Column | str) -> Column:
    """Quoted or shouted labels of two or more words, normalised."""
    t = col(text)
    labels = F.concat(F.regexp_extract_all(t, F.lit(K.CLAIM_QUOTED), F.lit(1)),
                      F.regexp_extract_all(t, F.lit(K.CLAIM_SHOUTED), F.lit(1)))
    keys = F.transform(labels, lambda m: F.array_join(
        F.filter(F.regexp_extract_all(F.lower(m), F.lit(K.CLAIM_WORD), F.lit(0)),
                 lambda w: F.length(w) > 2), " "))
    return F.array_distinct(F.filter(keys, lambda k: F.contains(k, F.lit(" "))))


def claim_score(wa: Column, pa: Column, wb: Column, pb: Column) -> Column:
    """Similarity of two claims from their word sets and phrase sets."""
    na, nb = F.size(wa), F.size(wb)
    shorter = F.least(na, nb)

    def by_words(shared: Column) -> Column:
        jac, contained = shared / (na + nb - shared), shared / shorter
        return F.when((shorter >= 2) & (contained >= K.CLAIM_CONTAINMENT), F.greatest(jac, contained)).otherwise(jac)

    return (F.when((na == 0) & (nb == 0), F.lit(1.0))
            .when((na == 0) | (nb == 0), F.lit(0.0))
            .when(F.arrays_overlap(pa, pb), F.lit(K.CLAIM_PHRASE_SCORE))
            .otherwise(let(_overlap(wa, wb), by_words)))


def claim_similarity(a: Column | str, b: Column | str) -> Column:
    keys = F.struct(claim_words(a).alias("wa"), claim_phrases(a).alias("pa"),
                    claim_words(b).alias("wb"), claim_phrases(b).alias("pb"))
    return let(keys, lambda k: claim_score(k["wa"], k["pa"], k["wb"], k["pb"]))


# --- overlay lines and markers -----------------------------------------------
def spoken_key(text: Column | str) -> Column:
    """Lower case, every run of other characters a single blank."""
    return F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9]+", " ")


def strip_subtitles(lines: Column | str, transcript: Column | str) -> Column:
    """Drop overlay lines of two or more words that the transcript says verbatim."""
    def said(key: Column, spoken: Column) -> Column:
        return F.contains(key, F.lit(" ")) & F.contains(spoken, key)

    kept = let(spoken_key(transcript), lambda spoken: F.filter(
        col(lines), lambda x: ~let(F.trim(spoken_key(x)), lambda key: said(key, spoken))))
    return F.when(F.coalesce(col(transcript), F.lit("")) == "", col(lines)).otherwise(kept)


def exclusive_markers(markers: Column | str, elsewhere: Column | str, min_chars: int,
                      limit: int | None = None) -> Column:
    """Markers whose key is long enough, absent from `elsewhere` (a key) and not a repeat.

    Repeats fall out before the search through `elsewhere`, so each distinct marker is looked for once.
    """
    keyed = F.filter(F.transform(col(markers), lambda m: F.struct(m.alias("m"), alnum_key(m).alias("k"))),
                     lambda x: F.length(x["k"]) >= min_chars)
    once = let(keyed, lambda items: let(F.transform(items, lambda x: x["k"]), lambda keys: F.filter(
        items, lambda x, i: F.array_position(keys, x["k"]) == i + 1)))
    first = let(col(elsewhere), lambda e: F.transform(
        F.filter(once, lambda x: ~F.contains(e, x["k"])), lambda x: x["m"]))
    return first if limit is None else F.slice(first, 1, limit)

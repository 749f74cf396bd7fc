"""Near-duplicates, passages, sharding and packing against brute force."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gleaner.llm import compact_windows, graph, minhash, packing, sharding
from tests.llm.fixtures import prose


def near_copies(rng, n=160):
    """A text and edits of it at all similarities, copies, unrelated texts and short ones."""
    first = prose(rng, 90).split()
    docs = [" ".join(first)]
    for _ in range(n):
        w = list(first)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = prose(rng, 1) + str(rng.randrange(99))
        docs.append(" ".join(w))
    docs += [docs[0].upper(), docs[3].replace(" ", "\n"), docs[3] + "\u00a0x"] + [prose(rng, rng.randrange(1, 80)) for _ in range(60)] + ["a b", "A  B", "c"] * 2
    return [*enumerate(docs), (900, None), (901, ""), (902, "\t")]


def components_brute(docs, width):
    sets = {}
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("tile", [256, 16])
def test_near_duplicates_equal_brute_force(spark, tile):
    docs = near_copies(random.Random(11))
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), width=4, tile=tile).collect()
    want = components_brute(docs, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_estimate_from_packed_bits(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2 ** 63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2 ** 63, 100, dtype=np.uint64)])
    sig = minhash.pack(minhash.minima([np.sort(a), np.sort(b)], 160))
    df = spark.createDataFrame([(sig[0].tolist(), sig[1].tolist())], "a array<long>, b array<long>")
    n = minhash.matching_fields(df.a, df.b, 160)
    m, e = df.select(n, minhash.estimate(n, 160)).first()
    fields = [[(int(w) >> (2 * i)) & 3 for w in s.view(np.uint64) for i in range(32)][:160] for s in sig]
    assert m == sum(x == y for x, y in zip(*fields)) and abs(e - 0.8) < 0.15 and m >= minhash.least_matches(160, 0.8)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 5), (7, 6), (7, 6)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 160)}


def test_compact_windows_equal_their_definition():
    x = np.random.default_rng(2).integers(1, 60, 200).astype(np.uint64)
    x[[0, 80, 199]] = 0
    start, low, a, b = compact_windows.compact_windows(x, 7)
    for s, v, lo, hi in zip(start, low, a, b):
        if v:
            assert x[s:s + 7].min() == v == x[lo:hi + 1].min() and x[lo - 1] < v and x[hi + 1] < v and lo <= s and s + 6 <= hi


def test_window_keys_meet_and_are_few():
    rng = np.random.default_rng(7)
    line = rng.integers(1, 1 << 60, 12).astype(np.uint64)
    texts = []
    for i in range(400):
        passage = rng.integers(1, 1 << 60, 50).astype(np.uint64)
        for _ in range(2):
            own = [rng.integers(1, 1 << 60, int(n)).astype(np.uint64) for n in rng.integers(1, 90, 3)]
            texts.append(np.concatenate([own[0], line, own[1], passage, own[2]]))
            passage[i % 50] += np.uint64(1)
    key, _, text, a, b = compact_windows.window_keys(texts, 5, 50, 80, 7)
    held = defaultdict(set)
    for k, i in zip(key.tolist(), text.tolist()):
        held[k].add(i)
    # a passage meets its copy with any one word changed, a line of 12 words alone meets nobody
    assert {frozenset(v) for v in held.values() if len(v) > 1} == {frozenset((2 * i, 2 * i + 1)) for i in range(400)}
    assert len(key) < 0.2 * sum(map(len, texts)) and (b - a >= 50).all()


def test_passages(spark):
    rng = random.Random(5)
    passage, common = prose(rng, 60), prose(rng, 55)
    docs = [(i, prose(rng, 150)) for i in range(40)]
    docs += [(100 + i, prose(rng, 40 + i) + " " + passage.upper() + " " + prose(rng, 30)) for i in range(3)]
    docs += [(200 + i, common + " " + prose(rng, 70)) for i in range(100)]
    words = passage.split()
    words[30] = "changed"
    docs += [(300, prose(rng, 20) + " " + " ".join(words)), (301, prose(rng, 30) + " " + " ".join(words[:40]))]
    got = compact_windows.duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    held = {d: re.sub("[A-Z]", lambda m: m[0].lower(), t).split() for d, t in docs}
    assert {i for r in got for i in (r.doc_id, r.other_id)} == {100, 101, 102, 300, *range(200, 300)}
    assert len(got) < 4 * len(docs)
    for r in got:
        x, y = held[r.doc_id][r.start_word:r.end_word], held[r.other_id][r.other_start:r.other_end]
        sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (x, y)]
        assert min(len(x), len(y)) >= 50 and abs(len(sets[0] & sets[1]) / len(sets[0] | sets[1]) - r.similarity) < 1e-9 and r.similarity >= 0.8


@pytest.mark.parametrize("tile", [256, 8])
def test_passages_behind_a_common_one(spark, tile):
    rng = random.Random(8)
    common = prose(rng, 40)
    docs = [(i, f"{prose(rng, 60)} {common} {prose(rng, 60)}") for i in [*range(60), *range(300, 330)]]
    for i in range(40):
        own = prose(rng, 10)
        docs += [(100 + 100 * j + i, f"{prose(rng, 30)} {common} {own} {prose(rng, 30)}") for j in range(2)]
    got = compact_windows.duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bands=3, tile=tile).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(200 + i, 100 + i) for i in range(40)}
    assert len(got) == len({(r.doc_id, r.other_id, r.start_word) for r in got})


def test_shared_passages_find_what_any_two_windows_share():
    rng = np.random.default_rng(1)
    t, met = 20, 0
    for n in range(120):
        words = 200_000 if n % 2 else 60
        p = rng.integers(0, words, 28).astype(np.uint64)
        q = p.tolist()
        for _ in range(n % 5):
            i = int(rng.integers(0, len(q)))
            q[i:i + int(rng.integers(0, 2))] = rng.integers(0, words, int(rng.integers(0, 2))).tolist()
        x, y = (np.concatenate([rng.integers(0, words, a), v, rng.integers(0, words, b)]).astype(np.uint64) for v, a, b in ((p, 15, 9), (q, 7, 20)))
        sets = [[set(z[i:i + t].tolist()) for i in range(len(z) - t + 1)] for z in (x, y)]
        assert compact_windows._distinct(x, t).tolist() == [len(w) for w in sets[0]]
        shared = any(100 * len(v & w) >= 80 * len(v | w) for v in sets[0] for w in sets[1])
        got = compact_windows.shared_passages(x, y, t, 80)
        met += shared
        assert got or not shared
        for s, e, u, v, _ in got:
            one, two = set(x[s:e].tolist()), set(y[u:v].tolist())
            assert min(e - s, v - u) >= t and 100 * len(one & two) >= 80 * len(one | two)
    assert met > 60


def test_passages_with_one_edit(spark):
    rng = random.Random(6)
    docs = []
    for i in range(300):
        words = [f"w{rng.randrange(10 ** 9)}" for _ in range(50)]
        for j in range(2):
            docs.append((2 * i + j, " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(40)) + " " + " ".join(words)))
            words[25] = "changed"
    got = compact_windows.duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(2 * i + 1, 2 * i) for i in range(300)}


def test_passage_classes_equal_brute_force(spark):
    rng = random.Random(4)
    first, common = prose(rng, 50).split(), prose(rng, 40)
    texts = [" ".join(first)]
    for i in range(20):
        # two copies with a word changed each are far from each other, both are near the first
        w = list(first)
        w[10 + i] = f"changed{i}"
        texts.append(f"{prose(rng, 5)} {' '.join(w)} {prose(rng, 5)}")
    texts += [f"{prose(rng, 20)} {common} {prose(rng, 20)}" for _ in range(20)]
    for i in range(5):
        own = prose(rng, 12)
        texts += [f"{prose(rng, 15)} {common} {own} {prose(rng, 15)}" for _ in range(2)]
    texts += [prose(rng, 100) for _ in range(5)] + ["again and again " * 30, "x again and again " * 20, texts[3].upper(), texts[30], None, "few words"]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    words = [(t or "").lower().split() for t in texts]
    sets = [[{tuple(w[p + k:p + k + 5]) for k in range(46)} for p in range(len(w) - 49)] for w in words]
    kinds = [set().union(*s) for s in sets]
    component = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(kinds[i] & kinds[j]) >= 1 and any(100 * len(x & y) >= 80 * len(x | y) for x in sets[i] for y in sets[j]):
                lo, hi = sorted((component[i], component[j]))
                component = [lo if c == hi else c for c in component]
    got = compact_windows.passage_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bands=12, tile=8).collect()
    assert [(r.doc_id, r.component_id) for r in sorted(got)] == list(enumerate(component))
    assert all(r.n_documents == component.count(r.component_id) for r in got)
    assert max(map(component.count, component)) >= 21


@pytest.mark.parametrize("hot", [0, 400])
def test_shards(spark, hot):
    rng = random.Random(9)
    docs = [(i, prose(rng, rng.randrange(1, 60))) for i in range(600)] + [(1000 + i, "the same text " * 6) for i in range(hot)]
    rows = sharding.shard_by_bytes(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), 8, slot_rows=20).collect()
    assert sorted(r.doc_id for r in rows) == [d for d, _ in docs]
    total, shards, texts = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 1
        total[r.shard] += r.size
        shards[r.shard].append(r.slot)
        texts[r.text].add(r.shard)
    assert set(shards) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    mean = sum(total.values()) / 8
    assert max(abs(t - mean) for t in total.values()) <= max(r.size for r in rows) + 0.01 * mean
    assert all(max(s) - min(s) == len(s) - 1 for s in texts.values())


def test_packing_round_trip(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = random.Random(12)
    odd = ["it's  we'll\n\n\n x", "   ", "\t\r\n", "ééé 漢字かな 🙂🙂", "x" * 3000, "1234567 3.14", "a\u00a0b\u2028c", "\ud7ff\ue000", "<|endoftext|> a", "ﬁ ǅ"]
    texts = [*odd, None, "", *(prose(rng, rng.randrange(1, 1500)) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokens = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokens.encode_special_tokens = True
    ids = [[*tokens.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    rows = packing.pack(docs, shard_docs=20, with_ids=True).collect()
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r.doc_id][r.start] = r.ids
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert [[x for s in sorted(pieces[d]) for x in pieces[d][s]] for d in range(len(texts))] == ids
    short = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
        short += end < 1024
    assert short <= 4


def test_neighbours_share_a_window():
    rng = np.random.default_rng(4)
    topics = [rng.integers(1000 * t, 1000 * t + 60, 300) for t in range(6)]
    tails = [rng.permutation(topics[i % 6])[:250] for i in range(24)]
    idf = np.ones(7000)
    windows = defaultdict(list)
    for w, _, doc, _, length in packing.fill_windows(packing.Shard(tails, idf, 250.0, 16), 1000):
        windows[w].append(doc % 6)
    assert sum(len(set(v)) == 1 for v in windows.values()) >= len(windows) - 1

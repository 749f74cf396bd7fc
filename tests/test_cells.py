"""Exact search over cells against comparing all with all."""

import numpy as np
import pyarrow as pa
import pytest

from gleaner.operators import cells as C
from gleaner.operators import vectors as E


def vectors(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vec array<double>")


def found(df):
    return sorted((r.query_id, r["rank"], r.row_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    m = np.concatenate([centres[rng.integers(0, 30, 1200)] + 0.05 * rng.normal(size=(1200, 16)), np.repeat(centres[:1], 600, axis=0), np.zeros((3, 16))])
    return vectors(spark, m).repartition(5).cache()


@pytest.mark.parametrize("cells, probes, block", [(None, 4, 1 << 25), (20, 1, 8_000), (1, 1, 1 << 25), (64, 64, 1 << 25)])
def test_equals_all_pairs(spark, clustered, tmp_path, cells, probes, block):
    index = C.write_cells(clustered, str(tmp_path / "c"), cells)
    queries = clustered.filter("id % 7 = 0")
    assert found(C.nearest_exact(queries, index, 5, probes, block)) == found(E.nearest(queries, clustered, 5))


def test_reads_a_share_of_the_cells(spark, clustered, tmp_path):
    index = C.write_cells(clustered.filter("id < 1200"), str(tmp_path / "c"), 40)
    queries = clustered.filter("id < 1200")
    _, later = C.two_rounds(queries, index, 3, probes=2)
    share = (later.count() + 2 * 1200) / (1200 * int((index.sizes > 0).sum()))
    assert share < 0.5


def test_the_stored_index_is_read_again(spark, clustered, tmp_path):
    C.write_cells(clustered, str(tmp_path / "c"))
    again = C.read_cells(spark, str(tmp_path / "c"))
    queries = clustered.filter("id % 50 = 0")
    assert found(C.nearest_exact(queries, again, 4)) == found(E.nearest(queries, clustered, 4))


def test_few_rows_null_vectors_and_empty_sides(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, vec array<double>")
    index = C.write_cells(rows, str(tmp_path / "c"))
    assert [(r.query_id, r.row_id) for r in C.nearest_exact(rows.filter("id < 2"), index, 9).orderBy("rank").collect()] == [(1, 1), (1, 2)]
    assert C.nearest_exact(rows.limit(0), index, 9).collect() == []
    none = C.write_cells(rows.limit(0), str(tmp_path / "n"))
    assert C.nearest_exact(rows, none, 9).collect() == []


def test_calls_are_sent_on_in_small_batches():
    """Vectors that call every cell: 300 x 400 copies never stand in one batch."""
    rng = np.random.default_rng(4)
    pivots = rng.normal(size=(400, 8))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(rng.normal(size=(300, 8)).tolist()), pa.array([-1.0] * 300)], ["id", "vec", "reach"])
    out = list(C._called(iter([batch]), pivots, np.full(400, 4.0), np.ones(400), 4))
    assert max(b.num_rows for b in out) <= C.CALLS and sum(b.num_rows for b in out) == 300 * 396
    assert len({x for b in out for x in zip(b.column(0).to_pylist(), b.column(2).to_pylist())}) == 300 * 396
    assert [b.num_rows for b in C._slices(iter([batch]), C.ANGLES // 128)] == [128, 128, 44]


def test_best_rows_are_given_out_in_small_batches():
    top = E._TopK(np.eye(5), 2)
    top.offer(np.array([7, 8], object), np.array([[1.0, 0, 0, 0, 0], [1.0, 0, 0, 0, 0]]))
    top.offer(np.array([6], object), np.array([[1.0, 0, 0, 0, 1.0]]))
    out = list(top.batches(np.array([10, 11, 12, 13, 14], object), pa.int64(), pa.int64(), most=2))
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert [b.num_rows for b in out] == [4, 4, 2] and rows[:2] == [(10, 6, 1.0), (10, 7, 1.0)] and rows[-2:] == [(14, 6, 1.0), (14, 7, 0.0)]


def plan(df):
    return df._jdf.queryExecution().toString()


def loose(spark, n=3000, dim=24):
    """Vectors without clusters: every cell may hold a better row."""
    return vectors(spark, np.random.default_rng(8).normal(size=(n, dim))).repartition(4)


def test_no_vector_is_copied_for_the_cells_it_calls(spark, tmp_path):
    """Without clusters a vector calls nearly every cell; copies of it for each one are what filled the disk."""
    rows = loose(spark)
    index = C.write_cells(rows, str(tmp_path / "c"))
    hits = C.nearest_exact(rows, index, 4)
    assert "FlatMapCoGroups" not in plan(hits) and "Generate" not in plan(hits)
    near = hits.filter("query_id % 100 = 0")
    assert found(near) == found(E.nearest(rows.filter("id % 100 = 0"), rows, 4))


def brute(q, rows, ids, k):
    scores = np.round(q @ rows.T, E.RANK_DECIMALS) + 0.0
    return [sorted(zip(-s, ids))[:k] for s in scores]


def best(top, n):
    out = {i: [] for i in range(n)}
    for b in top.batches(np.arange(n), pa.int64(), pa.int64(), most=3):
        for q, i, s in zip(*b.to_pydict().values()):
            out[q].append((-s, i))
    return [sorted(out[i]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.0, 1e-8, 1e-3, 1.0])
def test_scores_that_single_precision_cannot_tell_apart(spread):
    """Near and exact copies of one vector: the best are chosen by the scores in double precision, then by id."""
    rng = np.random.default_rng(5)
    rows = E._unit(rng.normal(size=16) + spread * rng.normal(size=(5000, 16)))
    rows[::7] = 0.0
    ids = rng.permutation(5000)
    q = E._unit(np.concatenate([rows[:20], rng.normal(size=(20, 16)), -rows[1:6]]))
    top = E._TopK(q, 6)
    for i in range(0, 5000, 1234):
        top.offer(ids[i:i + 1234], rows[i:i + 1234])
    assert best(top, 45) == brute(q, rows, ids.tolist(), 6)


def test_a_row_with_nan_hides_no_other():
    rows = np.eye(3)
    rows[1] = np.nan
    top = E._TopK(np.eye(3), 2)
    top.offer(np.arange(3), rows)
    assert best(top, 3)[0] == [(-1.0, 0), (0.0, 2)] and best(top, 3)[2] == [(-1.0, 2), (0.0, 0)]


def test_of_copies_the_lowest_ids_are_sent():
    raw = np.repeat(np.array([[1, 2], [3, 4], [5, 6]], np.float32), [5, 2, 1], axis=0)
    ids = np.array([9, 8, 7, 6, 5, 4, 3, 2])
    assert ids[E._without_copies(ids, raw, 3)].tolist() == [7, 6, 5, 4, 3, 2]
    assert E._without_copies(ids, raw, 5).tolist() == list(range(8)) and E._without_copies(ids[:0], raw[:0], 3).tolist() == []


def test_a_worker_holds_one_block_at_a_time():
    class Sent:
        def __init__(self):
            self._path, self._value, self.value = "there", 1, (2,)

    block = Sent()
    assert E._opened(block) == (2,) and not hasattr(block, "_value")


def test_a_large_index_is_not_copied_for_each_block_of_queries(spark):
    rows = loose(spark, 700, 6)
    out = "query_id bigint, row_id bigint, score double"
    met = E._nearest_in_blocks(rows, rows, 5, out, pa.int64(), pa.int64(), block=50 * 6 * 8)
    assert "FlatMapCoGroups" not in plan(met) and "Generate" not in plan(met)
    # a task has seen all blocks: k rows a query come out, not k for each block
    assert met.count() == 5 * 700
    assert found(E._rank(met, 5)) == found(E.nearest(rows, rows, 5))


def test_words_as_ids_and_ids_that_repeat(spark):
    rows = loose(spark, 300, 6).selectExpr("concat('r', id % 150) AS id", "vec")
    out = "query_id string, row_id string, score double"
    met = E._rank(E._nearest_in_blocks(rows, rows, 5, out, pa.string(), pa.string(), block=40 * 6 * 8), 5)
    assert found(met) == found(E.nearest(rows, rows, 5))

"""Nearest rows in pruned blocks against all distances."""

import numpy as np
import pytest

from fringeframe.operators.neighbours import nearest_rows, search

SCHEMA = "sample_id bigint, class_index bigint, features array<double>"


def _frame(spark, x, first=0, classes=3):
    return spark.createDataFrame([(first + i, i % classes, row.tolist()) for i, row in enumerate(x)], SCHEMA)


def _plain(rows, queries, k, per_class, exclude_self):
    out = []
    for qid, _, q in queries:
        groups = {}
        for tid, c, t in rows:
            if not (exclude_self and tid == qid):
                d = np.asarray(t) - np.asarray(q)
                groups.setdefault(c if per_class else 0, []).append((float(np.sqrt(np.einsum("i,i->", d, d))), tid, c))
        for own in groups.values():
            out += [(qid, tid, c, rank + 1, d) for rank, (d, tid, c) in enumerate(sorted(own)[:k])]
    return sorted(out)


def _held(rows, queries, k, **options):
    plain = [[(r["sample_id"], r["class_index"], r["features"]) for r in df.collect()] for df in (rows, queries)]
    want = _plain(*plain, k, options.get("per_class", False), options.get("exclude_self", False))
    got = sorted((r["query_id"], r["row_id"], r["class_index"], r["rank"], r["distance"]) for r in nearest_rows(rows, queries, k, **options).collect())
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-12, atol=0)


@pytest.mark.parametrize("per_class", [False, True])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_against_all_distances(spark, per_class, exclude_self):
    """Scattered rows, lattice rows with ties, and copies, in blocks of a few rows."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(150, 4)), rng.integers(0, 3, (120, 4)).astype(float), np.ones((40, 4))])
    rows = _frame(spark, x)
    _held(rows, rows.filter("sample_id % 5 = 0"), 4, per_class=per_class, exclude_self=exclude_self, block=16)


def test_few_rows_and_none(spark):
    rows = _frame(spark, np.random.default_rng(1).normal(size=(5, 2)), classes=2)
    _held(rows, rows, 9, per_class=True, exclude_self=True, block=2)
    assert nearest_rows(rows.limit(0), rows, 3).count() == 0 == nearest_rows(rows, rows.limit(0), 3).count()


def test_far_blocks_are_not_visited(spark):
    """Clustered rows: most pairs of blocks are left out, and the neighbours are the same."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(40, 8)) * 20
    rows = _frame(spark, np.concatenate([m + rng.normal(size=(50, 8)) * 0.3 for m in middles]))
    queries = rows.filter("sample_id % 7 = 0")
    best, visited, pairs = search(rows, queries, 5, exclude_self=True, block=64, pivots=40)
    assert visited.count() < 0.25 * pairs.count()
    _held(rows, queries, 5, exclude_self=True, block=64)


def test_a_meeting_of_full_blocks_and_of_copies_stays_small():
    import tracemalloc

    import pyarrow as pa

    from fringeframe.operators import neighbours as N

    entry = pa.list_(pa.struct([("query_id", pa.int64()), ("kth", pa.float64())]))
    many = pa.list_(pa.int64())
    schema = pa.schema([("qblock", pa.int64()), ("kind", pa.int64()), ("qids", many), ("qx", pa.binary()), ("ids", many), ("classes", many), ("x", pa.binary()), ("known", entry)])
    n, rng = N.BLOCK, np.random.default_rng(4)
    for queries, x in ((n, rng.normal(size=(n, 16))), (n // 4, np.ones((n, 16)))):
        row = dict(qblock=1, kind=0, qids=list(range(queries)), qx=x[:queries].tobytes(), ids=list(range(n)), classes=[2] * n, x=x.tobytes(), known=None)
        batch = pa.RecordBatch.from_pylist([row], schema)
        tracemalloc.start()
        (got,) = N._met(3, True)(iter([batch]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6, peak
        square = ((x[:queries] ** 2).sum(1)[:, None] - 2 * x[:queries] @ x.T + (x**2).sum(1)).round(9)
        square[np.arange(queries), np.arange(queries)] = np.inf
        want = np.argsort(square, axis=1, kind="stable")[:, :3]
        assert np.array_equal(got.column("row_id").to_numpy().reshape(-1, 3), want)
        assert got.column("limit")[0].as_py() == pytest.approx(np.sqrt(np.maximum(np.take_along_axis(square, want, 1), 0)).max())

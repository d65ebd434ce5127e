"""Assignment by merged tiles against the dense solver and its optimality conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeframe.operators import detect as H
from fringeframe.operators.assignment import Tile, assigned


def _distances(rows, cols):
    return np.hypot(rows[0][:, None] - cols[0], rows[1][:, None] - cols[1])


def _solved(rows, cols, strips, free=np.inf, reach=np.inf):
    """Strips of the plane apart, then all at once from their prices and pairs."""
    n, m = rows.shape[1], cols.shape[1]
    u, v, mate = np.full(n, np.inf), np.zeros(m), np.full(n, -1)
    for k in range(strips if strips > 1 else 0):
        r, c = (np.flatnonzero((side[0] * strips // 100).astype(int) == k) for side in (rows, cols))
        tile = Tile(rows[:, r], cols[:, c], u[r], v[c], mate[r], free, reach)
        tile.solve()
        u[r], v[c] = tile.u, tile.v
        paired = np.flatnonzero(tile.mate >= 0)
        mate[r[paired]] = c[tile.mate[paired]]
    tile = Tile(rows, cols, u, v, mate, free, reach)
    tile.solve()
    return tile


def _proved(tile, d):
    """Prices are feasible, tight on pairs, and zero where a column is left over: no assignment costs less."""
    slack = d - tile.u[:, None] - tile.v
    paired = np.flatnonzero(tile.mate >= 0)
    assert slack.min(initial=0) > -1e-7 and np.abs(slack[paired, tile.mate[paired]]).max(initial=0) < 1e-7
    assert len(set(tile.mate[paired])) == len(paired) and (tile.v[tile.holder < 0] == 0).all()
    return paired


@pytest.mark.parametrize("strips", [1, 2, 5])
@pytest.mark.parametrize("step", [0.0, 12.5])
def test_tiles_reach_the_dense_optimum(strips, step):
    """Scattered centers, and centers on a coarse grid with copies and ties."""
    rng = np.random.default_rng(strips)
    for n, m in ((0, 5), (1, 1), (7, 7), (30, 31), (40, 90), (60, 60)):
        rows, cols = (rng.random((2, k)) * 100 for k in (n, m))
        if step:
            rows, cols = np.floor(rows / step) * step, np.floor(cols / step) * step
        d = _distances(rows, cols)
        tile = _solved(rows, cols, strips)
        paired = _proved(tile, d)
        i, j = H.assign(d)
        assert len(paired) == n and d[paired, tile.mate[paired]].sum() == pytest.approx(d[i, j].sum(), abs=1e-6)
        for a, b in ((rows, cols), (cols, rows)):
            reach = 15.0
            free, d = 2 * (reach + 1), _distances(a, b)
            tile = _solved(a, b, strips, free, reach)
            paired = _proved(tile, np.where(d <= reach, d, np.inf))
            assert np.allclose(tile.u[tile.mate < 0], free) and (d[paired, tile.mate[paired]] <= reach).all()
            saving = np.concatenate([np.where(d <= reach, free - d, 0), np.zeros((len(d), len(d)))], axis=1)
            i, j = H.assign(-saving)
            assert (free - d[paired, tile.mate[paired]]).sum() == pytest.approx(saving[i, j].sum(), abs=1e-6)


def _points(spark, x, y, fields=None):
    rows = [(int(f), i, float(a), float(b)) for i, (f, a, b) in enumerate(zip(fields if fields is not None else np.ones(len(x)), x, y))]
    return spark.createDataFrame(rows, "field_id bigint, id bigint, x double, y double")


def test_fields_of_all_sizes(spark):
    """Small fields stay whole, large ones go through three rounds of merging; either side may be the larger."""
    rng = np.random.default_rng(5)
    sizes = {1: (700, 900), 2: (500, 400), 3: (3, 9), 4: (6, 0), 5: (0, 4)}
    sides = [_points(spark, *rng.random((2, sum(s[k] for s in sizes.values()))) * 500, fields=np.repeat(list(sizes), [s[k] for s in sizes.values()])) for k in (0, 1)]
    got = assigned(*sides, ["field_id"], tile=60).toPandas()
    assert sorted(got.columns) == ["col_id", "distance", "field_id", "row_id"]
    a, b = (s.toPandas() for s in sides)
    for field, (n, m) in sizes.items():
        own, left, right = got[got.field_id == field], a[a.field_id == field], b[b.field_id == field]
        assert len(own) == min(n, m) == own.row_id.nunique() == own.col_id.nunique()
        if len(own):
            d = _distances(left[["x", "y"]].to_numpy().T, right[["x", "y"]].to_numpy().T)
            i, j = H.assign(d)
            assert own.distance.sum() == pytest.approx(d[i, j].sum(), abs=1e-6)
            at = left.set_index("id").loc[own.row_id], right.set_index("id").loc[own.col_id]
            assert np.allclose(np.hypot(at[0].x.values - at[1].x.values, at[0].y.values - at[1].y.values), own.distance)


def test_result_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    a, b = (_points(spark, *np.floor(rng.random((2, n)) * 20)) for n in (300, 350))
    first = assigned(a.repartition(3), b.repartition(5), ["field_id"], tile=50)
    again = assigned(a.orderBy("x"), b.repartition(1), ["field_id"], tile=50)
    assert first.exceptAll(again).isEmpty() and first.count() == 300


def test_unusable_centers_and_repeated_ids(spark):
    schema = "field_id bigint, ref_id bigint, x double, y double, place string"
    refs = spark.createDataFrame([(1, 1, 0.0, 0.0, "p"), (1, 1, 5.0, 0.0, "p"), (1, 2, None, 0.0, "p"), (1, 3, float("nan"), 1.0, "p"), (1, None, 9.0, 0.0, "p")], schema)
    dets = spark.createDataFrame([(1, 7, 0.0, 1.0), (1, 7, 5.0, 2.0), (1, 8, 9.0, 3.0), (1, 9, float("inf"), 0.0)], "field_id bigint, det_id bigint, x double, y double")
    rows = [(r["ref_id"], r["det_id"], r["distance"]) for r in H.match_hungarian(refs, dets).collect()]
    assert sorted(rows, key=str) == sorted([(1, 7, 1.0), (1, 7, 2.0), (None, 8, 3.0)], key=str)
    assert H.match_hungarian(refs.limit(0), dets).isEmpty()


def test_dense_component_is_spread_over_tiles(spark):
    """One linked group of tens of thousands of pairs: tiles give the cost of the whole solved at once."""
    rng = np.random.default_rng(7)
    refs = _points(spark, *rng.random((2, 900)) * 300).withColumnRenamed("id", "ref_id")
    dets = _points(spark, *rng.random((2, 800)) * 300).withColumnRenamed("id", "det_id")
    assert H.candidate_pairs(refs, dets, 40.0, ["field_id"]).count() > 30_000
    tiled, whole = H.match_penalised(refs, dets, 40.0, tile=100), H.match_penalised(refs, dets, 40.0)
    gain = lambda df: df.agg(F.sum(82.0 - F.col("distance"))).first()[0]
    assert gain(tiled) == pytest.approx(gain(whole), abs=1e-6)
    assert tiled.select("ref_id").distinct().count() == tiled.count() == tiled.select("det_id").distinct().count()

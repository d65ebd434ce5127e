"""Near-duplicate embeddings by small-world graphs against all products."""

import numpy as np
import pytest

from fringeframe.llm import smallworld
from fringeframe.llm.queries import ORACLES, QUERIES
from tests.oracle import DATA, differences, duck

SCHEMA = "vec_id bigint, embedding array<double>, label string"


def _plain(rows, threshold=0.93):
    """{(key, vector): (links, component)}; rows are vectors, rows of one key share a component."""
    usable = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])]
    width = max([len(r[1]) for r in usable], default=1)
    x = np.array([[*r[1], *[0.0] * (width - len(r[1]))] for r in usable])
    x /= np.linalg.norm(x, axis=1)[:, None]
    labels, keys = np.array([r[2] for r in usable]), np.array([r[0] for r in usable])
    links = (x @ x.T >= threshold) & (labels[:, None] == labels)
    np.fill_diagonal(links, False)
    joined = links | (keys[:, None] == keys)
    low = keys.copy()
    while True:
        new = np.where(joined, low[None, :], low[:, None]).min(axis=1)
        if (new == low).all():
            break
        low = new
    found = [(r[0], int(k), int(c)) for r, k, c in zip(usable, links.sum(axis=1), low)]
    return sorted(found, key=str), x, links


def _found(df, **options):
    out = smallworld.link_near(df, **options)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = out.collect()
    for r in rows:
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=str)


def _clustered(seed: int, n: int, d: int, sizes: list[int], spread: float):
    """Scattered vectors and groups whose pairs have cosines on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=d) for _ in range(n)]
    for size in sizes:
        middle = rng.normal(size=d)
        rows += [middle + spread * rng.normal(size=d) for _ in range(size)]
    order = rng.permutation(len(rows))
    return [(int(i), rows[i].tolist(), "a") for i in order]


@pytest.mark.parametrize("shard_rows", [None, 150])
def test_links_against_all_products(spark, shard_rows):
    rows = _clustered(1, 600, 24, [2, 3, 5, 40, 200], 0.22)
    want, _, links = _plain(rows)
    found = _found(spark.createDataFrame(rows, SCHEMA), shard_rows=shard_rows)
    total, exact = sum(k for _, k, _ in found), int(links.sum())
    assert 0.99 * exact <= total <= exact
    assert sum(a == b for a, b in zip(found, want)) >= 0.97 * len(want)
    by_key = {i: k for i, k, _ in want}
    assert all(k <= by_key[i] for i, k, _ in found)


def test_tight_groups_are_whole(spark):
    """Groups far larger than the beam, within and over shards, keep every link."""
    rows = _clustered(2, 300, 32, [2, 2, 17, 500], 0.05)
    want, _, _ = _plain(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert _found(df, shard_rows=200) == want
    assert _found(df) == want


def test_labels_and_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 8))
    rows = [(i, (base[i % 4] * (1 + i)).tolist(), "ab"[i % 2]) for i in range(20)]
    rows += [(100 + i, base[0].tolist(), "a") for i in range(30)] + [(200, base[0].tolist(), "b"), (201, [*base[0].tolist(), 0.0], "b")]
    want, _, _ = _plain(rows)
    assert _found(spark.createDataFrame(rows, SCHEMA)) == want


def test_awkward_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, "a"), (2, one, None), (3, None, "a"), (4, [0.0, 0.0, 0.0], "a"), (5, [1.0, None, 3.0], "a"), (6, [1.0, float("nan"), 3.0], "a")]
    rows += [(7, [float("inf"), 2.0, 3.0], "a"), (8, [], "a"), (9, [2.0, 4.0, 6.0], "a"), (9, [2.0, 4.0, 6.0], "a"), (10, [1e-200, 2e-200, 3e-200], "a")]
    rows += [(11, [1e200, 2e200, 3e200], "a"), (12, [1.0, 2.0], "b"), (13, [1.0, 2.0, 0.0, -0.0], "b"), (14, [-1.0, -2.0], "b"), (None, one, "a"), (None, one, "a")]
    df = spark.createDataFrame([(*r, 1, 2, "p", 3) for r in rows], SCHEMA + ", id int, component int, place string, links int")
    alone = [(i, 0, i) for i in (2, 3, 4, 5, 6, 7, 8, None, None)]
    linked = [(1, 4, 1), (9, 4, 1), (9, 4, 1), (10, 4, 1), (11, 4, 1), (12, 1, 12), (13, 1, 12), (14, 0, 14)]
    out = smallworld.link_near(df)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()), key=str) == sorted(alone + linked, key=str)
    assert out.filter("vec_id IS NULL").select("kept").distinct().collect() == [(True,)]
    assert smallworld.link_near(df.limit(0)).count() == 0
    assert smallworld.link_near(df.filter("vec_id = 3")).count() == 1


def test_graph_finds_its_neighbours():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph, order = smallworld.Graph.build(x)
    x = x[order]
    assert sorted(order) == list(range(1500)) and [len(v.links) for v in graph.levels] == sorted(len(v.links) for v in graph.levels)
    q = x[:200]
    ids, sims = graph.levels[-1].search(x, q, smallworld.Graph(graph.levels[:-1]).entry(x, q), 64)
    truth = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, truth)]) >= 0.95
    assert (np.diff(sims, axis=1) <= 0).all()
    again = smallworld.Graph.load(graph.dump())
    assert all((a.links == b.links).all() for a, b in zip(graph.levels, again.levels))


def test_graph_of_levels_longer_than_a_batch():
    """Level 1 has more nodes than a batch: the entry of the next batch must not be a node that is not inserted yet."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph, order = smallworld.Graph.build(x)
    x = x[order]
    assert len(graph.levels[-2].links) > 2 * smallworld.BATCH
    for level in graph.levels:
        n = len(level.links)
        assert level.links.max() < n and (level.links != np.arange(n)[:, None]).all()
    q = x[:300]
    ids, _ = graph.levels[-1].search(x, q, smallworld.Graph(graph.levels[:-1]).entry(x, q), 64)
    truth = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, truth)]) >= 0.95


def test_large_shards(spark):
    """Shards of more vectors than any of the small tables has."""
    rows = _clustered(7, 6500, 24, [2, 3, 5, 40, 400], 0.05)
    want, _, _ = _plain(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert _found(df, shard_rows=7000) == want
    assert _found(df.repartition(5)) == want


@pytest.mark.parametrize("labels, tasks", [(1, 8), (300, 4)])
def test_tasks_of_shards(spark, monkeypatch, labels, tasks):
    """Two large shards get tasks of their own; many short ones don't make a task each."""
    asked = []
    monkeypatch.setattr(smallworld, "dealt", lambda df, keys, rows, per_task: asked.append(-(-rows // per_task)) or df.repartition(tasks, *keys))
    rows = [(i, v, str(i % labels)) for i, v, _ in _clustered(8, 5000 if labels == 1 else 500, 8, [3, 30], 0.02)]
    want, _, _ = _plain(rows)
    total, exact = (sum(k for _, k, _ in found) for found in (_found(spark.createDataFrame(rows, SCHEMA)), want))
    assert asked == [tasks] * 3 and 0.99 * exact <= total <= exact


def test_audit_widens_the_beam():
    """A graph without most of its edges fails the audit until the beam, at last all nodes, makes up for it."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph, order = smallworld.Graph.build(x)
    assert smallworld.audited_beam(graph, x[order], 0.93, 0.995) < 1000
    graph.levels[-1].links[:, 2:] = -1
    assert smallworld.audited_beam(graph, x[order], 0.93, 0.995) > smallworld.BEAM


def test_query_matches_sql(spark):
    df = QUERIES["op13_embedding_near_dedup"](spark, str(DATA / "sf0.001"))
    assert differences(df, duck(DATA / "sf0.001"), ORACLES["op13_embedding_near_dedup"]) == []

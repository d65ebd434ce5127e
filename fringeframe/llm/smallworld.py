"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

The vectors of a label are dealt into shards, each with a graph of its own: nodes on falling levels, every level a graph of near
neighbours over the nodes that reach it. Every pair of shards of a label meets once, one as queries, the other as graph (and a
shard meets itself): queries walk down the levels, search the lowest with a beam, and then spread along all neighbours that are
near enough, so that a group larger than the beam is found whole. Pairs found are verified by their cosine in double precision.

The beam of a shard is audited when the graph is built: probes turned away from its own vectors to just above the threshold, and its
own vectors, are searched for and compared with all products; while too few of their links are found, the beam doubles.

Searches run for a block of queries at a time, as array operations. A task hands on numbers of links and the smallest
vector that its links join, never the pairs.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeframe.llm.graph import compact, components, small_batches
from fringeframe.operators.settle import dealt, settled

# A shard has SPREAD * sqrt(vectors of its label) vectors, within these bounds.
SPREAD, LEAST, MOST = 64, 4_096, 1 << 18
# Tasks a shard, or a LEAST vectors if shards are many and short, so that few tasks get two large ones: hashes of few keys fall unevenly.
_ROOM = 4
DEGREE = 16
BUILD_BEAM = 64
BATCH = 256
BEAM = 32
PROBES = 256
# Vectors looked at together in one step of a search, for all queries of a block.
_EXPAND = 4
# Marks of a block of queries, a byte a vector.
_MARKS = 1 << 24


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors; each is first scaled by its largest component, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Level:
    """Graph over the first len(links) nodes; -1 pads the lists."""

    def __init__(self, links: np.ndarray):
        self.links = links

    def search(self, x: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, near: float | None = None):
        """(ids, similarities) of the best `beam` nodes per query, best first; with `near`, marks of all nodes at least as similar."""
        rows, n = len(q), len(self.links)
        beam = min(beam, n)
        seen = np.zeros((rows, n), bool)
        hits = np.zeros((rows, n), bool) if near is not None else None
        done = np.zeros((rows, n), bool) if near is not None else None
        ids = np.full((rows, beam), -1)
        sims = np.full((rows, beam), -np.inf, np.float32)
        grown = np.zeros((rows, beam), bool)
        every = np.arange(rows)
        ids[:, 0], sims[:, 0] = entry, np.einsum("ij,ij->i", x[entry], q)
        seen[every, entry] = True
        if hits is not None:
            hits[every, entry] = sims[:, 0] >= near
        active = every
        while len(active):
            open_ = np.where(grown[active] | (ids[active] < 0), -np.inf, sims[active])
            take = min(_EXPAND, beam)
            at = np.argpartition(-open_, take - 1, axis=1)[:, :take] if take < beam else np.tile(np.arange(beam), (len(active), 1))
            good = np.take_along_axis(open_, at, 1) > -np.inf
            some = good.any(axis=1)
            active, at, good = active[some], at[some], good[some]
            if not len(active):
                break
            from_ = np.where(good, ids[active[:, None], at], -1)
            grown[active[:, None], at] |= good
            if done is not None:
                r, c = np.nonzero(good)
                done[active[r], from_[r, c]] = True
            to = np.where(from_[:, :, None] >= 0, self.links[from_], -1).reshape(len(active), -1)
            # Each node once per query: sorted, the first of a run, and none seen before.
            to.sort(axis=1)
            fresh = to >= 0
            fresh[:, 1:] &= to[:, 1:] != to[:, :-1]
            fresh &= ~seen[active[:, None], to]
            r, c = np.nonzero(fresh)
            node = to[r, c]
            seen[active[r], node] = True
            s = np.einsum("ij,ij->i", x[node], q[active[r]])
            if hits is not None:
                hits[active[r], node] = s >= near
            # Packed to the left, so that few columns are merged.
            width = int(fresh.sum(axis=1).max(initial=0))
            if not width:
                continue
            place = np.cumsum(fresh, axis=1)[r, c] - 1
            new_ids = np.full((len(active), width), -1)
            new_sims = np.full((len(active), width), -np.inf, np.float32)
            new_ids[r, place], new_sims[r, place] = node, s
            both_ids = np.concatenate([ids[active], new_ids], axis=1)
            both_sims = np.concatenate([sims[active], new_sims], axis=1)
            both_grown = np.concatenate([grown[active], np.zeros((len(active), width), bool)], axis=1)
            best = np.argpartition(-both_sims, beam - 1, axis=1)[:, :beam]
            ids[active], sims[active] = np.take_along_axis(both_ids, best, 1), np.take_along_axis(both_sims, best, 1)
            grown[active] = np.take_along_axis(both_grown, best, 1)
        if hits is not None:
            return self._spread(x, q, hits, seen, done, near)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _spread(self, x, q, hits, seen, done, near):
        """On from every hit whose neighbours were not looked at, until none is left."""
        while True:
            r, c = np.nonzero(hits & ~done)
            if not len(r):
                return hits
            done[r, c] = True
            for lo in range(0, len(r), 1 << 14):
                rr, to = np.repeat(r[lo : lo + (1 << 14)], self.links.shape[1]), self.links[c[lo : lo + (1 << 14)]].ravel()
                keep = to >= 0
                rr, to = rr[keep], to[keep]
                new = ~seen[rr, to]
                flat = np.unique(rr[new] * seen.shape[1] + to[new])
                rr, to = np.divmod(flat, seen.shape[1])
                seen[rr, to] = True
                hits[rr, to] = np.einsum("ij,ij->i", x[to], q[rr]) >= near


def _chosen(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Up to `degree` of each row's candidates (best first, -1 pads): those nearer to the node than to one chosen before, then the best others."""
    rows, width = ids.shape
    around = x[np.maximum(ids, 0)]
    between = around @ around.transpose(0, 2, 1)
    taken = np.zeros((rows, width), bool)
    closest = np.full((rows, width), -np.inf, np.float32)
    for c in range(width):
        take = (ids[:, c] >= 0) & (sims[:, c] > closest[:, c]) & (taken.sum(axis=1) < degree)
        taken[:, c] = take
        closest[take] = np.maximum(closest[take], between[take, c])
    rank = np.where(ids < 0, 3 * width, np.where(taken, 0, width) + np.arange(width))
    at = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(ids, at, 1)
    return np.pad(out, [(0, 0), (0, max(0, degree - out.shape[1]))], constant_values=-1)


def _level(x: np.ndarray, upper: Graph, size: int, degree: int) -> Level:
    """Graph over the first `size` nodes, inserted in batches; the levels above whose nodes are all inserted give each its entry."""
    links = np.full((size, degree), -1)
    for lo in range(0, size, BATCH):
        hi = min(lo + BATCH, size)
        q = x[lo:hi]
        inside = q @ q.T
        np.fill_diagonal(inside, -np.inf)
        most = min(BUILD_BEAM // 2, hi - lo)
        near = np.argpartition(-inside, most - 1, axis=1)[:, :most]
        ids, sims = near + lo, np.take_along_axis(inside, near, 1)
        ids = np.where(np.isfinite(sims), ids, -1)
        if lo:
            above = Graph([level for level in upper.levels if len(level.links) <= lo])
            old_ids, old_sims = Level(links[:lo]).search(x, q, above.entry(x, q), BUILD_BEAM)
            ids, sims = np.concatenate([ids, old_ids], axis=1), np.concatenate([sims, old_sims], axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        links[lo:hi] = _chosen(x, ids, sims, degree)
        _link_back(x, links, lo, hi)
    return Level(links)


def _link_back(x: np.ndarray, links: np.ndarray, lo: int, hi: int) -> None:
    """The new nodes lo to hi enter the lists of those they chose; lists that overflow are chosen anew."""
    degree = links.shape[1]
    r, c = np.nonzero(links[lo:hi] >= 0)
    target, source = links[lo:hi][r, c], r + lo
    sims = np.einsum("ij,ij->i", x[target], x[source])
    order = np.lexsort((-sims, target))
    target, source = target[order], source[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    first = place < 2 * degree
    nodes, row = np.unique(target[first], return_inverse=True)
    fresh = np.full((len(nodes), 2 * degree), -1)
    fresh[row, place[first]] = source[first]
    fresh[(fresh[:, :, None] == links[nodes][:, None, :]).any(axis=2)] = -1
    for at in range(0, len(nodes), BATCH):
        own = nodes[at : at + BATCH]
        ids = np.concatenate([links[own], fresh[at : at + BATCH]], axis=1)
        s = np.where(ids >= 0, np.einsum("ijk,ik->ij", x[np.maximum(ids, 0)], x[own]), -np.inf)
        order = np.argsort(-s, axis=1, kind="stable")
        width = int((ids >= 0).sum(axis=1).max(initial=1))
        ids, s = np.take_along_axis(ids, order, 1)[:, :width], np.take_along_axis(s, order, 1)[:, :width]
        links[own] = _chosen(x, ids, s, degree)


class Graph:
    """Levels from the top down; nodes are ordered by falling level, so each level is over a prefix of them."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, x: np.ndarray, degree: int = DEGREE, seed: int = 7) -> tuple[Graph, np.ndarray]:
        """(graph, order): the graph is over x[order]."""
        draw = np.random.default_rng(seed).random(len(x))
        height = np.floor(-np.log(1 - draw) / math.log(degree)).astype(int)
        order = np.lexsort((draw, -height))
        x = x[order]
        graph = cls([])
        for h in range(height.max(initial=0), -1, -1):
            size = int((height >= h).sum())
            graph.levels.append(_level(x, graph, size, degree if h else 2 * degree))
        return graph, order

    def entry(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The node next to each query that the levels so far lead to."""
        at = np.zeros(len(q), np.int64)
        for level in self.levels:
            at = level.search(x, q, at, 4)[0][:, 0]
        return at

    def within(self, x: np.ndarray, q: np.ndarray, beam: int, near: float) -> np.ndarray:
        """(queries, nodes) marks of the nodes found at least `near` to each query."""
        above = Graph(self.levels[:-1]).entry(x, q)
        return self.levels[-1].search(x, q, above, beam, near)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *[level.links.astype(np.int32) for level in self.levels])
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Graph:
        with np.load(io.BytesIO(raw)) as f:
            return cls([Level(f[name].astype(np.int64)) for name in f.files])


def audited_beam(graph: Graph, x: np.ndarray, near: float, recall: float, probes: int = PROBES, seed: int = 11) -> int:
    """The smallest beam of BEAM, 2 * BEAM, ... that finds the share `recall` of the links of the probes; at the latest, all nodes."""
    rng = np.random.default_rng(seed)
    own = x[rng.permutation(len(x))[:probes]]
    aside = rng.standard_normal(own.shape).astype(np.float32)
    aside -= np.einsum("ij,ij->i", aside, own)[:, None] * own
    length = np.sqrt(np.einsum("ij,ij->i", aside, aside))[:, None]
    edge = near + (1 - near) / 20
    turned = edge * own + math.sqrt(max(0.0, 1 - edge**2)) * aside / np.where(length > 0, length, 1)
    asked = np.concatenate([turned, own]).astype(np.float32)
    truth = asked @ x.T >= near
    beam = BEAM
    while beam < len(x):
        found = np.concatenate([graph.within(x, asked[lo : lo + 64], beam, near) for lo in range(0, len(asked), 64)])
        if (found & truth).sum() >= recall * truth.sum():
            return beam
        beam *= 2
    return max(len(x), 1)


def _pack(x: np.ndarray) -> bytes:
    """float32 where that is exact."""
    small = x.astype(np.float32)
    return (small if (small.astype(float) == x).all() else x).tobytes()


def _unpack(raw: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * rows * width else float).reshape(rows, width).astype(float)


class _Groups:
    """Joined sets of vectors, each known by its smallest."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        out = self.low[at]
        while True:
            up = self.low[out]
            if (up == out).all():
                self.low[at] = out
                return out
            out = up

    def join(self, at: np.ndarray) -> None:
        roots = np.unique(self.roots(at))
        self.low[roots] = roots[0]


def _searched(width: int, threshold: float):
    """Rows (ids, times, x of the queries; ids, times, x, graph, beam of the other shard; same) to (id, mark, links, low)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qid, qmark, qtimes = (np.array(row[c], np.int64) for c in ("qids", "qmarks", "qtimes"))
                xid, xmark, xtimes = (np.array(row[c], np.int64) for c in ("ids", "marks", "times"))
                q, x = _units(_unpack(row["qx"], len(qid), width)), _units(_unpack(row["x"], len(xid), width))
                q32, x32, graph = q.astype(np.float32), x.astype(np.float32), Graph.load(row["graph"])
                ids = np.concatenate([xid, qid])
                rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
                groups, back = _Groups(len(ids)), np.argsort(ids, kind="stable")
                qlinks, xlinks = np.zeros(len(qid), np.int64), np.zeros(len(xid), np.int64)
                step = max(32, min(BATCH, _MARKS // max(len(xid), 1)))
                for lo in range(0, len(qid), step):
                    part = slice(lo, lo + step)
                    r, c = np.nonzero(graph.within(x32, q32[part], row["beam"], threshold - 1e-4))
                    for at in range(0, len(r), 1 << 18):
                        rr, cc = r[at : at + (1 << 18)] + lo, c[at : at + (1 << 18)]
                        sure = np.einsum("ij,ij->i", q[rr], x[cc]) >= threshold
                        if row["same"]:
                            sure &= rr != cc
                        rr, cc = rr[sure], cc[sure]
                        np.add.at(qlinks, rr, xtimes[cc])
                        if not row["same"]:
                            np.add.at(xlinks, cc, qtimes[rr])
                        cuts = np.flatnonzero(np.diff(rr)) + 1
                        for own, others in zip(rr[np.concatenate([[0], cuts])] if len(rr) else [], np.split(cc, cuts)):
                            groups.join(rank[np.append(others, own if row["same"] else len(xid) + own)])
                links = np.concatenate([xlinks, qlinks]) if not row["same"] else np.concatenate([qlinks, np.zeros_like(qlinks)])
                some = np.flatnonzero(links)
                low = ids[back[groups.roots(rank[some])]] if len(some) else some
                marks = np.concatenate([xmark, qmark])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (ids[some], marks[some], links[some], low)], ["id", "mark", "links", "low"]
                )

    return run


def _built(width: int, threshold: float, degree: int, recall: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("mark", "ascending")])
        x = np.zeros((len(group), width))
        lists = group.column("v").combine_chunks()
        sizes = pa.compute.list_value_length(lists).to_numpy()
        row = np.repeat(np.arange(len(group)), sizes)
        x[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        units = _units(x).astype(np.float32)
        graph, order = Graph.build(units, degree)
        beam = audited_beam(graph, units[order], threshold, recall)
        column = lambda name: pa.array([group.column(name).to_numpy()[order].tolist()], pa.list_(pa.int64()))
        return pa.table(
            {
                "place": group.column("place").slice(0, 1),
                "shard": group.column("shard").slice(0, 1),
                "shards": group.column("shards").slice(0, 1),
                "ids": column("id"),
                "marks": column("mark"),
                "times": column("times"),
                "x": pa.array([_pack(x[order])], pa.binary()),
                "graph": pa.array([graph.dump()], pa.binary()),
                "beam": pa.array([beam], pa.int32()),
            }
        )

    return run


BUILT = "place bigint, shard int, shards int, ids array<bigint>, marks array<bigint>, times array<bigint>, x binary, graph binary, beam int"


def link_near(
    df: DataFrame,
    threshold: float = 0.93,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    recall: float = 0.995,
    degree: int = DEGREE,
    shard_rows: int | None = None,
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row: the other vectors of its label with a cosine of at least `threshold`, and the
    smallest key that such links reach.

    Rows without a key or a label, and vectors that are null, zero or hold a null or non-finite component, link with nothing: no
    links, component_id is their own key, kept is true. Shorter vectors count as padded with zeros. Equal vectors of a label are searched
    as one; each still counts its copies as links. Rows that repeat a key are vectors of their own that share a component. An
    empty table gives no row; other columns are not read. Links are verified, so none is below the threshold; the search
    may miss some: the beam of each shard is widened until the audit finds the share `recall` of the links of its probes.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != math.inf)) & F.exists(x, lambda c: c != 0)
    usable = F.coalesce(sound & F.col(key).isNotNull() & F.col(label).isNotNull(), F.lit(False))
    # A zero at the end changes no cosine, so equal vectors of any length look the same without it.
    whole = F.size(x) - F.coalesce(F.array_position(F.reverse(F.transform(x, lambda c: c != 0)), F.lit(True)), F.lit(1)).cast("int") + 1
    trimmed = F.transform(F.slice(x, 1, whole), lambda c: c + F.lit(0.0))
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.when(usable, F.xxhash64(label)).alias("place"), F.when(usable, trimmed).alias("v"))
    rows = settled(rows.withColumn("mark", F.xxhash64("place", "v")))
    classes = rows.filter("place IS NOT NULL").groupBy("place", "v").agg(
        F.min("id").alias("id"), F.first("mark").alias("mark"), F.count(F.lit(1)).alias("times")
    )
    classes = settled(classes)
    size = F.lit(shard_rows) if shard_rows else F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.lit(SPREAD) * F.sqrt("all")))
    places = classes.groupBy("place").agg(F.count(F.lit(1)).alias("all"), F.max(F.size("v")).alias("width"))
    places = places.select("place", "width", "all", F.ceil(F.col("all") / size).cast("int").alias("shards"))
    shape = places.agg(F.max("width"), F.sum("shards"), F.sum("all")).first()
    width, count, vectors = shape if shape[0] else (1, 0, 0)
    keys, tasks = ["place", "shard"], _ROOM * min(count, vectors // LEAST + 1)
    parts = classes.join(places.select("place", "shards"), "place").withColumn("shard", F.pmod(F.xxhash64("id", "mark"), F.col("shards")).cast("int"))
    index = settled(dealt(parts, keys, tasks, 1).groupBy(*keys).applyInArrow(_built(width, threshold, degree, recall), BUILT))
    # Of two shards, the one that is asked alternates, so that all are asked about equally often.
    asked = F.filter(
        F.sequence(F.lit(0), F.col("shards") - 1),
        lambda j: (j == F.col("shard")) | F.when(j < F.col("shard"), (j + F.col("shard")) % 2 == 1).otherwise((j + F.col("shard")) % 2 == 0),
    )
    queries = index.select(
        "place", F.col("shard").alias("own"), F.col("ids").alias("qids"), F.col("marks").alias("qmarks"), F.col("times").alias("qtimes"), F.col("x").alias("qx"),
        F.explode(asked).alias("shard"),
    )
    queries, graphs = (dealt(side, keys, tasks, 1) for side in (queries, index.drop("shards")))
    met = queries.join(graphs, keys).withColumn("same", F.col("own") == F.col("shard")).drop("place", "shard", "own")
    with small_batches(spark, 1):
        found = compact(met.mapInArrow(_searched(width, threshold), "id bigint, mark bigint, links bigint, low bigint"))
    own = found.groupBy("id", "mark").agg(F.sum("links").alias("links"))
    # A copied class is known to its members by the smallest of them.
    copied = classes.filter("times > 1").select("place", "v", F.col("id").alias("first"), "times")
    members = rows.join(copied, ["place", "v"], "left").select(
        "id", "mark", F.coalesce("first", "id").alias("first"), F.coalesce("times", F.lit(1).cast("bigint")).alias("times"), F.col("place").isNotNull().alias("usable")
    )
    edges = found.select(F.col("id").alias("a"), F.col("low").alias("b")).unionByName(
        members.filter("first <> id").select(F.col("id").alias("a"), F.col("first").alias("b"))
    )
    reached = components(edges).withColumnRenamed("node", "id")
    joined = members.join(own.withColumnRenamed("id", "first").withColumn("usable", F.lit(True)), ["first", "mark", "usable"], "left").join(reached, "id", "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").cast(kind).alias(key),
        (F.coalesce("links", F.lit(0).cast("bigint")) + F.col("times") - 1).alias("n_links"),
        component.cast(kind).alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )

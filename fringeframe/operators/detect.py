"""Detection tables: filters, suppression, matching and detection scores.

Greedy and assignment steps run per field in a vectorised kernel while the field is small. A field above
`FIELD_LIMIT` rows takes an exact distributed way instead (rounds over a grid, or connected components; assignments go by
merged tiles), so no task ever holds an unbounded field. Candidate pairs come from a grid join, never from all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeframe.functions import arrays as A
from fringeframe.operators.assignment import TILE, Tile, assigned
from fringeframe.operators.nearest import nearest
from fringeframe.operators.quantiles import quantiles
from fringeframe.operators.settle import dealt, settled
from fringeframe.operators.skew import group_rank

FIELD_LIMIT = 20_000
# Greedy matching: fields of up to this many possible pairs per row of the limit are paired in one task.
PAIRS_PER_ROW = 100
# Centers of a task that solves fields one after the other.
FIELDS_PER_TASK = 100_000
# Points that look for their nearest center together.
POINTS_AT_ONCE = 32
COPY_LIMIT = 16


# ---- filters ---------------------------------------------------------------------------------------


def judge_detections(df: DataFrame, threshold: float, crop: int, width: int, height: int) -> DataFrame:
    """Add `verdict` (accepted, confidence, edge), joint score and half-even rounded xi, yi.

    The score test comes before the edge test; a missing point score counts as 1.
    """
    kp = F.coalesce("kp_conf", F.lit(1.0))
    low = ~(A.finite(F.col("x")) & A.finite(F.col("y")) & A.finite(F.col("box_conf")) & A.finite(kp)) | (
        F.col("box_conf") < threshold
    ) | (kp < threshold)
    m = crop / 2.0
    edge = (F.col("x") < m) | (F.col("y") < m) | (F.col("x") > width - m) | (F.col("y") > height - m)
    return (
        df.withColumn("verdict", F.when(low, "confidence").when(edge, "edge").otherwise("accepted"))
        .withColumn("joint", F.least(F.col("box_conf"), kp))
        .withColumn("xi", F.bround("x", 0))
        .withColumn("yi", F.bround("y", 0))
    )


def accepted(judged: DataFrame) -> DataFrame:
    """Accepted rows with rounded centers in x and y."""
    return judged.filter(F.col("verdict") == "accepted").drop("x", "y", "verdict").withColumnsRenamed({"xi": "x", "yi": "y"})


def rejection_counts(judged: DataFrame, kept: DataFrame, field: str = "field_id") -> DataFrame:
    """Per field: raw predictions, confidence, edge and duplicate rejections, and kept detections."""
    counts = judged.groupBy(field).agg(
        F.count(F.lit(1)).alias("raw_predictions"),
        F.count_if(F.col("verdict") == "confidence").alias("confidence_rejected"),
        F.count_if(F.col("verdict") == "edge").alias("edge_rejected"),
        F.count_if(F.col("verdict") == "accepted").alias("_ok"),
    )
    final = kept.groupBy(field).agg(F.count(F.lit(1)).alias("_k"))
    return counts.join(final, field, "left").select(
        field,
        "raw_predictions",
        "confidence_rejected",
        "edge_rejected",
        (F.col("_ok") - F.coalesce("_k", F.lit(0))).alias("duplicate_rejected"),
        F.coalesce("_k", F.lit(0)).alias("accepted_detections"),
    )


# ---- greedy suppression ----------------------------------------------------------------------------


def _split_by_size(df: DataFrame, keys: list[str], limit: int, small: Callable, large: Callable, stored: bool = False) -> DataFrame:
    """Kernel for small groups, distributed way for large ones; the input is computed once (before, if `stored`)."""
    df = df if stored else settled(df)
    sizes = settled(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    facts = sizes.agg(F.max("_n").alias("most"), F.sum("_n").alias("all")).first()
    spread = lambda part: dealt(part, keys, facts["all"] or 0, FIELDS_PER_TASK)
    if (facts["most"] or 0) <= limit:
        return small(spread(df))
    big = sizes.filter(F.col("_n") > limit).select(*keys)
    rest = small(spread(df.join(big, keys, "left_anti")))
    return rest.unionByName(large(df.join(big, keys, "left_semi")))


def _greedy_rounds(
    df: DataFrame, keys: list[str], rank: Column, cell_x: Column, cell_y: Column, reach: int, conflict: Callable
) -> DataFrame:
    """Greedy keep-best-first selection without an ordered pass.

    In each round the best undecided row of every grid cell is kept if no undecided conflicting row
    outranks it; rows in conflict with a kept one drop out. `rank` is a struct, larger is better and
    unique. Rows in conflict lie at most `reach` cells apart. A row meets at most (2*reach+1)^2
    candidates, so dense cells do not multiply.
    """
    columns = df.columns
    left = settled(df.withColumn("_rank", rank).withColumn("_cx", cell_x.cast("bigint")).withColumn("_cy", cell_y.cast("bigint")))
    kept_parts = []
    around = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    cell = [*keys, "_cx", "_cy"]
    while not left.isEmpty():
        best = left.groupBy(*cell).agg(F.max(F.struct(F.col("_rank"), F.struct(*columns).alias("row"))).alias("_c"))
        candidates = best.select(*cell, F.col("_c._rank").alias("_crank"), F.col("_c.row").alias("_crow"))
        spread = candidates.withColumn("_dx", around).withColumn("_dy", around)
        spread = spread.withColumn("_cx", F.col("_cx") + F.col("_dx")).withColumn("_cy", F.col("_cy") + F.col("_dy"))
        near = left.join(spread.drop("_dx", "_dy"), cell).filter(
            (F.col("_rank") != F.col("_crank")) & conflict(lambda c: F.col(c), lambda c: F.col(f"_crow.{c}"))
        )
        near = settled(near.select(*keys, "_rank", "_crank"))
        blocked = near.filter(F.col("_rank") > F.col("_crank")).select(*keys, "_crank").distinct()
        winners = settled(candidates.join(blocked, [*keys, "_crank"], "left_anti"))
        lost = near.join(winners.select(*keys, "_crank"), [*keys, "_crank"], "left_semi").select(*keys, "_rank").distinct()
        done = lost.union(winners.select(*keys, F.col("_crank").alias("_rank")))
        kept_parts.append(winners.select("_crow.*").select(*columns))
        left = settled(left.join(done, [*keys, "_rank"], "left_anti"))
    out = df.limit(0)
    for part in kept_parts:
        out = out.unionByName(part)
    return out


def _best_first(table: pa.Table, score: str) -> np.ndarray:
    return np.lexsort((table.column("det_id").to_numpy(), -table.column(score).to_numpy()))


def _center_kernel(distance: float):
    def run(table: pa.Table) -> pa.Table:
        order = _best_first(table, "joint")
        x, y = (table.column(c).to_numpy()[order] for c in ("x", "y"))
        by_x = np.argsort(x, kind="stable")
        # The distance decides; the window is a little wider, as sums round.
        wide = distance + 1e-9 * (1.0 + np.abs(x))
        lo, hi = (np.searchsorted(x[by_x], x + s * wide, side).tolist() for s, side in ((-1, "left"), (1, "right")))
        alive, keep = np.ones(len(x), bool), []
        for i in range(len(x)):
            if alive[i]:
                keep.append(i)
                near = by_x[lo[i] : hi[i]]
                dx, dy = x[near] - x[i], y[near] - y[i]
                alive[near[dx * dx + dy * dy < distance * distance]] = False
        return table.take(pa.array(order[keep]))

    return run


def _top(df: DataFrame, keys: list[str], order: list[Column], limit: int | None) -> DataFrame:
    if limit is None:
        return df
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")


def suppress_centers(
    df: DataFrame, distance: float, keys: list[str] | None = None, limit: int | None = None, field_limit: int = FIELD_LIMIT
) -> DataFrame:
    """Keep centers by joint score (ties by det_id) when at least `distance` from every kept one.

    Needs det_id, x, y, joint. `limit` keeps the best per field after suppression.
    """
    keys = keys or ["field_id"]
    rank = F.struct(F.col("joint").alias("j"), (-F.col("det_id")).alias("d"))

    def large(part: DataFrame) -> DataFrame:
        half = distance / 2.0
        clash = lambda a, b: (a("x") - b("x")) * (a("x") - b("x")) + (a("y") - b("y")) * (a("y") - b("y")) < distance**2
        return _greedy_rounds(part, keys, rank, F.floor(F.col("x") / half), F.floor(F.col("y") / half), 2, clash)

    small = lambda part: part.groupBy(*keys).applyInArrow(_center_kernel(distance), part.schema)
    kept = _split_by_size(df, keys, field_limit, small, large)
    return _top(kept, keys, [F.desc("joint"), F.col("det_id")], limit)


def _box_kernel(iou: float):
    def run(table: pa.Table) -> pa.Table:
        order = _best_first(table, "score")
        box = [np.asarray(table.column(c).to_numpy()[order], float) for c in ("bx", "by", "bw", "bh")]
        left, right = box[0] - box[2] / 2.0, box[0] + box[2] / 2.0
        top, bottom = box[1] - box[3] / 2.0, box[1] + box[3] / 2.0
        area = np.maximum(0.0, right - left) * np.maximum(0.0, bottom - top)
        # Only boxes that begin within the widest one's reach can overlap.
        by_x = np.argsort(left, kind="stable")
        widest = float((right - left).max(initial=0.0)) if iou >= 0 else np.inf
        lo = np.searchsorted(left[by_x], left - widest - 1e-9 * (1.0 + np.abs(left))).tolist()
        hi = np.searchsorted(left[by_x], right if iou >= 0 else np.full(len(left), np.inf), side="right").tolist()
        alive, keep = np.ones(len(left), bool), []
        for i in range(len(left)):
            if alive[i]:
                keep.append(i)
                near = by_x[lo[i] : hi[i]]
                width = np.minimum(right[i], right[near]) - np.maximum(left[i], left[near])
                height = np.minimum(bottom[i], bottom[near]) - np.maximum(top[i], top[near])
                shared = np.maximum(0.0, width) * np.maximum(0.0, height)
                union = area[i] + area[near] - shared
                ratio = np.divide(shared, union, out=np.zeros(len(near)), where=union > 0)
                alive[near[ratio > iou]] = False
                alive[i] = False
        return table.take(pa.array(order[keep]))

    return run


def overlap(a: Callable, b: Callable) -> Column:
    """Intersection over union of two center/size boxes, 0 for an empty union."""

    def side(c: str, s: str) -> Column:
        hi = F.least(a(c) + a(s) / 2.0, b(c) + b(s) / 2.0)
        lo = F.greatest(a(c) - a(s) / 2.0, b(c) - b(s) / 2.0)
        return F.greatest(F.lit(0.0), hi - lo)

    shared = side("bx", "bw") * side("by", "bh")
    area = lambda f: F.greatest(F.lit(0.0), f("bw")) * F.greatest(F.lit(0.0), f("bh"))
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def nms_boxes(
    df: DataFrame, iou: float, limit: int | None = None, keys: list[str] | None = None, field_limit: int = FIELD_LIMIT, stored: bool = False
) -> DataFrame:
    """Keep boxes by score (ties by det_id) unless they overlap a kept box by more than `iou`.

    Needs det_id, bx, by, bw, bh, score. A `stored` input is read again instead of being materialised.
    """
    keys = keys or ["field_id"]
    rank = F.struct(F.col("score").alias("j"), (-F.col("det_id")).alias("d"))

    def large(part: DataFrame) -> DataFrame:
        sizes = part.groupBy(*keys).agg(
            F.greatest(F.max("bw"), F.lit(1e-9)).alias("_mw"), F.greatest(F.max("bh"), F.lit(1e-9)).alias("_mh")
        )
        sized = part.join(sizes, keys)
        cells = (F.floor(F.col("bx") / F.col("_mw")), F.floor(F.col("by") / F.col("_mh")))
        return _greedy_rounds(sized, keys, rank, *cells, 1, lambda a, b: overlap(a, b) > iou).drop("_mw", "_mh")

    small = lambda part: part.groupBy(*keys).applyInArrow(_box_kernel(iou), part.schema)
    kept = _split_by_size(df, keys, field_limit, small, large, stored)
    return _top(kept, keys, [F.desc("score"), F.col("det_id")], limit)


def letterbox(width: int, height: int, size: int) -> tuple[float, int, int]:
    """(scale, left pad, top pad) that fit an image centred into a square input."""
    factor = min(size / width, size / height)
    left, top = (size - round(width * factor)) / 2, (size - round(height * factor)) / 2
    return factor, round(left - 0.1), round(top - 0.1)


def postprocess(
    decoded: DataFrame, threshold: float, iou: float, limit: int | None, crop: int, distance: float, width: int, height: int
) -> tuple[DataFrame, DataFrame]:
    """Decoded rows to (detections, per-field counts).

    Rows: field_id, det_id, bx, by, bw, bh, score, kx, ky, kp_conf, scale, pad_left, pad_top in network
    input pixels. The count of confidence rejections starts with everything the box step dropped.
    """
    numbers = ["bx", "by", "bw", "bh", "score", "kx", "ky", "kp_conf"]
    usable = F.col("score") >= min(threshold, 0.05)
    for c in numbers:
        usable = usable & A.finite(F.col(c))
    # Original pixels take the place of what they come from, so that one narrow table is stored for counts and boxes.
    original = [((F.col(f"k{c}") - F.col(pad)) / F.col("scale")).alias(c) for c, pad in (("x", "pad_left"), ("y", "pad_top"))]
    rows = settled(
        decoded.select("field_id", "det_id", "bx", "by", "bw", "bh", "score", *original, "kp_conf", F.coalesce(usable, F.lit(False)).alias("_usable"))
    )
    boxes = nms_boxes(rows.filter("_usable").drop("_usable"), iou, limit, stored=True)
    boxes = settled(boxes.select("field_id", "det_id", "x", "y", F.col("score").alias("box_conf"), "kp_conf"))
    judged = judge_detections(boxes, threshold, crop, width, height)
    kept = suppress_centers(accepted(judged), distance)
    every = rows.groupBy("field_id").agg(F.count(F.lit(1)).alias("_all"))
    counts = every.join(rejection_counts(judged, kept), "field_id", "left").fillna(0)
    return kept, counts.withColumn(
        "confidence_rejected", F.col("confidence_rejected") + F.col("_all") - F.col("raw_predictions")
    ).drop("_all")


# ---- matching --------------------------------------------------------------------------------------


def candidate_pairs(refs: DataFrame, dets: DataFrame, radius: float, keys: list[str] | None = None) -> DataFrame:
    """(keys..., ref_id, det_id, distance) with distance <= radius, by an equi-join on radius-sized cells."""
    keys = keys or ["field_id"]
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius))).cast("bigint")
    left = refs.select(*keys, "ref_id", F.col("x").alias("_rx"), F.col("y").alias("_ry"))
    left = left.withColumn("_i", step).withColumn("_j", step).select(
        *keys, "ref_id", "_rx", "_ry", (cell("_rx") + F.col("_i")).alias("_cx"), (cell("_ry") + F.col("_j")).alias("_cy")
    )
    right = dets.select(*keys, "det_id", "x", "y", cell("x").alias("_cx"), cell("y").alias("_cy"))
    dx, dy = F.col("_rx") - F.col("x"), F.col("_ry") - F.col("y")
    return (
        left.join(right, [*keys, "_cx", "_cy"])
        .withColumn("distance", F.sqrt(dx * dx + dy * dy))
        .filter(F.col("distance") <= radius)
        .select(*keys, "ref_id", "det_id", "distance")
    )


def _thinned(side: DataFrame, other: DataFrame, row_id: str, radius: float, keys: list[str]) -> DataFrame:
    """Drop surplus copies at one spot: no more of them can be matched than there are partners around.

    Rows at one spot are interchangeable and matched in id order, so keeping the lowest ids, as many as
    centers of the other side lie in the cells around, changes no result.
    """
    crowded = side.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > COPY_LIMIT)
    if crowded.isEmpty():
        return side
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius))).cast("bigint")
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    partners = other.groupBy(*keys, cell("x").alias("_cx"), cell("y").alias("_cy")).agg(F.count(F.lit(1)).alias("_n"))
    around = (
        partners.withColumn("_i", step)
        .withColumn("_j", step)
        .groupBy(*keys, (F.col("_cx") + F.col("_i")).alias("_cx"), (F.col("_cy") + F.col("_j")).alias("_cy"))
        .agg(F.sum("_n").alias("_most"))
    )
    spots = [*keys, "x", "y"]
    copies = side.join(crowded.select(*spots), spots, "left_semi")
    ranked = group_rank(copies, spots, [F.col(row_id)], F.col(row_id), "_rank")
    kept = (
        ranked.withColumn("_cx", cell("x"))
        .withColumn("_cy", cell("y"))
        .join(around, [*keys, "_cx", "_cy"])
        .filter(F.col("_rank") <= F.col("_most"))
    )
    return side.join(crowded.select(*spots), spots, "left_anti").unionByName(kept.select(*side.columns))


def reduced_pairs(refs: DataFrame, dets: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Candidate pairs that can matter for one-to-one matching."""
    a = refs.select(*keys, "ref_id", "x", "y")
    b = dets.select(*keys, "det_id", "x", "y")
    b = _thinned(b, a, "det_id", radius, keys)
    return candidate_pairs(_thinned(a, b, "ref_id", radius, keys), b, radius, keys)


def _greedy_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    ordered = pdf.sort_values(["distance", "ref_id", "det_id"], kind="stable")
    refs: set = set()
    dets: set = set()
    keep = []
    for position, (r, d) in enumerate(zip(ordered["ref_id"], ordered["det_id"])):
        if r not in refs and d not in dets:
            refs.add(r)
            dets.add(d)
            keep.append(position)
    return ordered.iloc[keep]


def _greedy_pair_rounds(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """A pair that is the smallest at both of its ends is in the greedy result; repeat on what is left."""
    order = lambda: F.struct("distance", "ref_id", "det_id")
    left = settled(pairs)
    out = pairs.limit(0)
    while not left.isEmpty():
        by_ref = left.groupBy(*keys, "ref_id").agg(F.min(order()).alias("_p")).select(*keys, "_p")
        by_det = left.groupBy(*keys, "det_id").agg(F.min(order()).alias("_p")).select(*keys, "_p")
        won = settled(by_ref.join(by_det, [*keys, "_p"]).select(*keys, "_p.ref_id", "_p.det_id", "_p.distance"))
        out = out.unionByName(won)
        left = settled(
            left.join(won.select(*keys, "ref_id"), [*keys, "ref_id"], "left_anti").join(
                won.select(*keys, "det_id"), [*keys, "det_id"], "left_anti"
            )
        )
    return out


def _greedy_field(keys: list[str], radius: float):
    """References and detections of one field to its pairs: near ones by a sorted axis, taken in order."""

    def run(refs: pa.Table, dets: pa.Table) -> pa.Table:
        rx, ry, dx, dy = (t.column(c).cast(pa.float64()).to_numpy() for t in (refs, dets) for c in ("x", "y"))
        by_x = np.argsort(dx, kind="stable")
        sorted_x = dx[by_x]
        # The distance decides; the window is a little wider, as sums round.
        wide = radius * (1.0 + 1e-9) + 1e-9 * np.abs(rx)
        lo = np.searchsorted(sorted_x, rx - wide)
        own = np.maximum(np.searchsorted(sorted_x, rx + wide, side="right") - lo, 0)
        row = np.repeat(np.arange(len(rx)), own)
        col = by_x[np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(lo, own)]
        ax, ay = rx[row] - dx[col], ry[row] - dy[col]
        distance = np.sqrt(ax * ax + ay * ay)
        near = distance <= radius
        row, col, distance = row[near], col[near], distance[near]
        # Copies of an id are one center, as in `_greedy_pairs`.
        ref_id, det_id = refs.column("ref_id").to_numpy()[row], dets.column("det_id").to_numpy()[col]
        seen_refs, seen_dets, keep = set(), set(), []
        order = np.lexsort((det_id, ref_id, distance))
        for place, r, d in zip(order.tolist(), ref_id[order].tolist(), det_id[order].tolist()):
            if r not in seen_refs and d not in seen_dets:
                seen_refs.add(r)
                seen_dets.add(d)
                keep.append(place)
        kept = {k: pa.array([refs.column(k)[0].as_py()] * len(keep) if keep else [], refs.schema.field(k).type) for k in keys}
        kept["ref_id"] = refs.column("ref_id").take(pa.array(row[keep], pa.int64())).combine_chunks()
        kept["det_id"] = dets.column("det_id").take(pa.array(col[keep], pa.int64())).combine_chunks()
        return pa.table({**kept, "distance": pa.array(distance[keep], pa.float64())})

    return run


def match_greedy(
    refs: DataFrame, dets: DataFrame, radius: float, keys: list[str] | None = None, field_limit: int = FIELD_LIMIT
) -> DataFrame:
    """One-to-one pairs taken in order of (distance, ref_id, det_id).

    Both sides of a field meet in one task, which lists the pairs within the radius itself, while its possible pairs are at most
    `PAIRS_PER_ROW` x `field_limit`. Other fields list their pairs by a grid join and go on apart.
    """
    keys = keys or ["field_id"]
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    a = settled(refs.filter(known).select(*keys, "ref_id", "x", "y"))
    b = settled(dets.filter(known).select(*keys, "det_id", "x", "y"))
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    many = F.col("_a").cast("double") * F.col("_b") > PAIRS_PER_ROW * field_limit
    big = settled(count(a, "_a").join(count(b, "_b"), keys).filter(many).select(*keys))
    kinds = dict(a.dtypes) | dict(b.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "ref_id", "det_id"]) + ", distance double"

    def paired(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(_greedy_field(keys, radius), schema)

    if big.isEmpty():
        return paired(a, b)
    pairs = reduced_pairs(a.join(big, keys, "left_semi"), b.join(big, keys, "left_semi"), radius, keys)
    small = lambda part: part.groupBy(*keys).applyInPandas(_greedy_pairs, part.schema)
    crowded = _split_by_size(pairs, keys, field_limit, small, lambda part: _greedy_pair_rounds(part, keys))
    return paired(a.join(big, keys, "left_anti"), b.join(big, keys, "left_anti")).unionByName(crowded)


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum-cost assignment of the smaller side by shortest augmenting paths with dual prices."""
    cost = np.asarray(cost, dtype=float)
    if cost.shape[0] > cost.shape[1]:
        cols, rows = assign(cost.T)
        order = np.argsort(rows)
        return rows[order], cols[order]
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    col_of = np.full(n, -1)
    for start in range(n):
        reach = np.full(m, np.inf)
        parent = np.full(m, -1)
        closed = np.zeros(m, dtype=bool)
        visited, row, base = [start], start, 0.0
        while True:
            open_cols = np.flatnonzero(~closed)
            through = base + cost[row, open_cols] - row_price[row] - col_price[open_cols]
            better = through < reach[open_cols]
            reach[open_cols[better]] = through[better]
            parent[open_cols[better]] = row
            sink = open_cols[np.argmin(reach[open_cols])]
            base = reach[sink]
            closed[sink] = True
            if row_of[sink] < 0:
                break
            row = row_of[sink]
            visited.append(row)
        for r in visited:
            row_price[r] += base - (0.0 if r == start else reach[col_of[r]])
        col_price[closed] += reach[closed] - base
        while True:
            r = parent[sink]
            row_of[sink] = r
            sink, col_of[r] = col_of[r], sink
            if r == start:
                break
    return np.arange(n), col_of


def match_hungarian(refs: DataFrame, dets: DataFrame, keys: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """Pairs of least total distance, no radius. Every reference or every detection of a field is used.

    Fields above `tile` centers are solved in tiles that are merged and mended (operators/assignment.py), so no field is too large.
    Centers without finite coordinates are not paired.
    """
    keys = keys or ["field_id"]
    pairs = assigned(refs.withColumnRenamed("ref_id", "id"), dets.withColumnRenamed("det_id", "id"), keys, tile=tile)
    return pairs.withColumnsRenamed({"row_id": "ref_id", "col_id": "det_id"})


def match_penalised(refs: DataFrame, dets: DataFrame, radius: float, keys: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """Pairs within the radius of least total cost, each unmatched center costing radius + 1.

    Leaving both ends unmatched costs twice the penalty: that is what a reference pays for staying free. Fields above `tile`
    centers are solved in tiles that are merged and mended; no pairs are listed.
    """
    keys = keys or ["field_id"]
    sides = refs.withColumnRenamed("ref_id", "id"), dets.withColumnRenamed("det_id", "id")
    return assigned(*sides, keys, 2.0 * (radius + 1.0), radius, tile).withColumnsRenamed({"row_id": "ref_id", "col_id": "det_id"})


def nearest_centers(
    points: DataFrame, centers: DataFrame, radii: list[float], point_id: str = "ref_id", keys: list[str] | None = None,
    field_limit: int = FIELD_LIMIT,
) -> DataFrame:
    """(keys..., point_id, det_id, distance): nearest center per point, ties by det_id.

    The largest radius bounds the search: points with nothing inside it are left out. A small field is searched in one task; in large
    ones radii grow from step to step, only points without a center so far go on, and centers at one spot are merged first.
    """
    keys = keys or ["field_id"]
    left = points.select(*keys, F.col(point_id).alias("ref_id"), "x", "y")

    def large(left: DataFrame, centers: DataFrame) -> DataFrame:
        spots = centers.groupBy(*keys, "x", "y").agg(F.min("det_id").alias("det_id"))
        out = None
        for radius in radii:
            best = F.min(F.struct("distance", "det_id"))
            found = candidate_pairs(left, spots, radius, keys).groupBy(*keys, "ref_id").agg(best.alias("_b")).select(
                *keys, "ref_id", "_b.det_id", "_b.distance"
            )
            out = found if out is None else out.unionByName(found)
            left = left.join(found, [*keys, "ref_id"], "left_anti")
        return out

    return _nearest_by_field(left, centers, keys, "ref_id", max(radii), field_limit, large).withColumnRenamed("ref_id", point_id)


def _nearest_by_field(points: DataFrame, centers: DataFrame, keys: list[str], point_id: str, reach: float, field_limit: int, large: Callable) -> DataFrame:
    """(keys..., point_id, det_id, distance) of the nearest center within `reach`, ties by det_id.

    Both sides of a field meet in one task, a few points at a time; fields of more than `PAIRS_PER_ROW` x `field_limit`
    possible pairs take the way given.
    """
    sound = A.finite(F.col("x")) & A.finite(F.col("y"))
    for k in keys:
        sound = sound & F.col(k).isNotNull()
    a = settled(points.filter(sound).select(*keys, point_id, "x", "y"))
    b = settled(centers.filter(sound).select(*keys, "det_id", "x", "y"))
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    pairs = F.col("_a").cast("double") * F.col("_b")
    sizes = settled(count(a, "_a").join(count(b, "_b"), keys).select(*keys, (F.col("_a") + F.col("_b")).alias("_n"), pairs.alias("_pairs")))
    facts = sizes.agg(F.max("_pairs").alias("most"), F.sum("_n").alias("all")).first()
    kinds = dict(a.dtypes) | dict(b.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, point_id, "det_id"]) + ", distance double"

    def run(points: pa.Table, centers: pa.Table) -> pa.Table:
        # In the order of det_id, the first of equal distances is the one to take.
        centers = centers.sort_by("det_id")
        px, py, cx, cy = (t.column(c).cast(pa.float64()).to_numpy() for t in (points, centers) for c in ("x", "y"))
        best, least = np.zeros(len(px), np.int64), np.full(len(px), np.inf)
        by_x, left = np.argsort(cx, kind="stable"), np.argsort(px, kind="stable")
        # First within a few times the usual spacing, which settles most points; then the rest as far as it takes.
        span = max(np.ptp(cx), np.ptp(cy)) if len(cx) else 0.0
        for within in (min(reach, 4.0 * span / np.sqrt(max(len(cx), 1))), reach):
            wide = within * (1.0 + 1e-9) + 1e-9 * np.abs(px[left])
            lo = np.searchsorted(cx[by_x], px[left] - wide)
            hi = np.searchsorted(cx[by_x], px[left] + wide, side="right")
            for start in range(0, len(left), POINTS_AT_ONCE):
                part = left[start : start + POINTS_AT_ONCE]
                near = np.sort(by_x[lo[start : start + POINTS_AT_ONCE].min() : hi[start : start + POINTS_AT_ONCE].max()])
                if len(near):
                    dx, dy = px[part, None] - cx[near], py[part, None] - cy[near]
                    distance = np.sqrt(dx * dx + dy * dy)
                    place = distance.argmin(axis=1)
                    best[part], least[part] = near[place], distance[np.arange(len(part)), place]
            left = left[least[left] > within]
        at = np.flatnonzero((least <= reach) & np.isfinite(least))
        found = pa.table({
            **{k: points.column(k).take(pa.array(at)) for k in [*keys, point_id]},
            "det_id": centers.column("det_id").take(pa.array(best[at])),
            "distance": pa.array(least[at], pa.float64()),
        })
        # Points that repeat an id count as one.
        found = found.sort_by([(c, "ascending") for c in (point_id, "distance", "det_id")])
        ids = found.column(point_id).to_numpy()
        return found.take(pa.array(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])))) if len(ids) else found

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        sides = [dealt(df, keys, facts["all"] or 0).groupBy(*keys) for df in (a, b)]
        return sides[0].cogroup(sides[1]).applyInArrow(run, schema)

    if (facts["most"] or 0) <= PAIRS_PER_ROW * field_limit:
        return met(a, b)
    big = sizes.filter(F.col("_pairs") > PAIRS_PER_ROW * field_limit).select(*keys)
    rest = met(*[df.join(big, keys, "left_anti") for df in (a, b)])
    return rest.unionByName(large(*[df.join(big, keys, "left_semi") for df in (a, b)]).select(*rest.columns))


def center_agreement(refs: DataFrame, dets: DataFrame, keys: list[str] | None = None, field_limit: int = FIELD_LIMIT) -> DataFrame:
    """Per field: references, those with a center within 2 and 5 px, mean and largest distance to the nearest, however far it is."""
    keys = keys or ["field_id"]
    large = lambda a, b: nearest(a, b, keys)
    near = _nearest_by_field(refs.withColumnRenamed("ref_id", "id"), dets, keys, "id", float("inf"), field_limit, large)
    counts = refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("references"))
    stats = near.groupBy(*keys).agg(
        F.count_if(F.col("distance") <= 2).alias("within_2px"),
        F.count_if(F.col("distance") <= 5).alias("within_5px"),
        F.avg("distance").alias("mean_distance"),
        F.max("distance").alias("max_distance"),
    )
    return counts.join(stats, keys, "left").fillna(0, ["within_2px", "within_5px"])


# ---- scores ----------------------------------------------------------------------------------------

RADII = (5, 10, 20)


def _rate(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _prf(tp: Column, predicted: Column, truth: Column, suffix: str) -> list[Column]:
    p, r = _rate(tp, predicted), _rate(tp, truth)
    f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(2.0 * p * r / (p + r))
    return [p.alias(f"precision_{suffix}"), r.alias(f"recall_{suffix}"), f1.alias(f"f1_{suffix}")]


def field_metrics(
    matches: DataFrame, refs: DataFrame, dets: DataFrame, radii=RADII, keys: list[str] | None = None
) -> DataFrame:
    """Per field counts, count error, and true positives, precision, recall, F1 at each radius.

    Fields without detections or without labels are kept.
    """
    keys = keys or ["field_id"]
    truth = refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("ground_truth_count"))
    found = dets.groupBy(*keys).agg(F.count(F.lit(1)).alias("predicted_count"))
    return _field_scores(matches, truth, found, radii, keys)


def _field_scores(matches: DataFrame, truth: DataFrame, found: DataFrame, radii, keys: list[str]) -> DataFrame:
    """`field_metrics` of counted labels and detections."""
    hits = matches.groupBy(*keys).agg(*[F.count_if(F.col("distance") <= r).alias(f"tp_{r}px") for r in radii])
    both = truth.join(found, keys, "full_outer").join(hits, keys, "left").fillna(0)
    gap = F.col("predicted_count") - F.col("ground_truth_count")
    scores = []
    for r in radii:
        scores += _prf(F.col(f"tp_{r}px"), F.col("predicted_count"), F.col("ground_truth_count"), f"{r}px")
    return both.select("*", gap.alias("count_error"), F.abs(gap).alias("absolute_count_error"), *scores)


def pooled_metrics(fields: DataFrame, matches: DataFrame, radii=RADII, by: list[str] | None = None) -> DataFrame:
    """Micro precision, recall and F1 per radius, count MAE and RMSE, and center-error statistics."""
    by = by or []
    one = by or ["_all"]
    fields = fields if by else fields.withColumn("_all", F.lit(0))
    matches = matches if by else matches.withColumn("_all", F.lit(0))
    gap = F.col("count_error").cast("double")
    sums = fields.groupBy(*one).agg(
        F.count(F.lit(1)).alias("images"),
        F.sum("ground_truth_count").alias("ground_truth_centers"),
        F.sum("predicted_count").alias("predicted_centers"),
        F.avg("absolute_count_error").alias("count_mae"),
        F.sqrt(F.avg(gap * gap)).alias("count_rmse"),
        *[F.sum(f"tp_{r}px").alias(f"tp_{r}px") for r in radii],
    )
    inside = matches.filter(F.col("distance") <= max(radii))
    errors = inside.groupBy(*one).agg(
        F.avg("distance").alias("center_error_mean"), F.max("distance").alias("center_error_max")
    )
    marks = quantiles(inside, one, "distance", {"center_error_median": 0.5, "center_error_p95": 0.95})
    scores = []
    for r in radii:
        scores += _prf(F.col(f"tp_{r}px"), F.col("predicted_centers"), F.col("ground_truth_centers"), f"{r}px")
    out = sums.join(errors, one, "left").join(marks, one, "left")
    return out.select("*", *scores).drop("_all") if not by else out.select("*", *scores)


def threshold_sweep(
    dets: DataFrame, refs: DataFrame, thresholds: list[float], crop: int, distance: float, width: int, height: int, tile: int = TILE
) -> DataFrame:
    """Pooled detection scores at each threshold: filter, suppress, least-total-distance matching."""
    marks = sorted({float(t) for t in thresholds}, reverse=True)
    listed = F.array(*[F.lit(t) for t in marks])
    judged = judge_detections(dets.filter(F.col("box_conf") >= marks[-1]), 0.0, crop, width, height)
    strong = accepted(judged).filter(F.col("joint") >= marks[-1]).select("field_id", "det_id", "x", "y", "joint")
    # Weaker detections never drop stronger ones, so what a threshold keeps is what it leaves of the lowest one's.
    kept = settled(suppress_centers(strong, distance))
    keys = ["threshold", "field_id"]
    passed = F.explode(F.filter(listed, lambda t: t <= F.col("joint")))
    found = kept.select("field_id", passed.alias("threshold")).groupBy(*keys).agg(F.count(F.lit(1)).alias("predicted_count"))
    truth = refs.groupBy("field_id").agg(F.count(F.lit(1)).alias("ground_truth_count")).withColumn("threshold", F.explode(listed))
    # Pairs beyond the largest radius enter no score.
    matches = settled(match_nested(refs, kept, marks, tile).filter(F.col("distance") <= max(RADII)).select(*keys, "distance"))
    return pooled_metrics(_field_scores(matches, truth, found, RADII, keys), matches, by=["threshold"])


def match_nested(refs: DataFrame, dets: DataFrame, thresholds: list[float], tile: int = TILE) -> DataFrame:
    """(threshold, field_id, ref_id, det_id, distance): `match_hungarian` of the detections of at least each threshold's joint score.

    A field of up to `tile` centers is one task's for all thresholds: as long as detections are the smaller side, those of a lower
    threshold are added to the solved ones. Larger fields go threshold by threshold through merged tiles.
    """
    marks = sorted(thresholds, reverse=True)
    sound = F.col("field_id").isNotNull() & A.finite(F.col("x")) & A.finite(F.col("y"))
    point = [F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")]
    a = refs.filter(sound).select("field_id", F.col("ref_id").cast("bigint").alias("ref_id"), *point)
    b = dets.filter(sound & (F.col("joint") >= marks[-1])).select("field_id", F.col("det_id").cast("bigint").alias("det_id"), *point, "joint")
    sizes = [df.groupBy("field_id").agg(F.count(F.lit(1)).alias(name)) for df, name in ((a, "_a"), (b, "_b"))]
    sizes = settled(sizes[0].join(sizes[1], "field_id").select("field_id", (F.col("_a") + F.col("_b")).alias("_n")))
    facts = sizes.agg(F.max("_n").alias("most"), F.sum("_n").alias("all")).first()

    def run(refs: pa.Table, dets: pa.Table) -> pa.Table:
        refs = refs.sort_by([(c, "ascending") for c in ("ref_id", "x", "y")])
        dets = dets.sort_by([("joint", "descending"), *[(c, "ascending") for c in ("det_id", "x", "y")]])
        (rx, ry), (dx, dy) = (np.stack([t.column(c).to_numpy() for c in ("x", "y")]) for t in (refs, dets))
        joint, parts, done, tile = dets.column("joint").to_numpy(), [], 0, None
        for t in marks if len(rx) else []:
            n = int(np.searchsorted(-joint, -t, side="right"))
            if n <= len(rx):
                if tile is None:
                    most = int(min(len(dx), len(rx)))
                    tile = Tile(np.stack([dx, dy])[:, :most], np.stack([rx, ry]), np.full(most, np.inf), np.zeros(len(rx)), np.full(most, -1))
                tile.place(np.arange(done, n))
                done, det = n, np.arange(n)
                ref = tile.mate[:n].copy()
            else:
                whole = Tile(np.stack([rx, ry]), np.stack([dx, dy])[:, :n], np.full(len(rx), np.inf), np.zeros(n), np.full(len(rx), -1))
                whole.solve()
                ref, det = np.arange(len(rx)), whole.mate
            parts.append((np.full(n if n <= len(rx) else len(rx), t), ref, det))
        t, r, d = (np.concatenate([p[i] for p in parts] or [np.zeros(0)]) for i in range(3))
        r, d = r.astype(np.int64), d.astype(np.int64)
        field = pa.array([dets.column("field_id")[0].as_py()] * len(r) if len(r) else [], dets.schema.field("field_id").type)
        ids = refs.column("ref_id").take(pa.array(r)).combine_chunks(), dets.column("det_id").take(pa.array(d)).combine_chunks()
        return pa.table({"threshold": pa.array(t, pa.float64()), "field_id": field, "ref_id": ids[0], "det_id": ids[1], "distance": pa.array(np.hypot(rx[r] - dx[d], ry[r] - dy[d]), pa.float64())})

    def nested(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = (dealt(df, ["field_id"], facts["all"] or 0, FIELDS_PER_TASK) for df in (a, b))
        schema = f"threshold double, field_id {dict(a.dtypes)['field_id']}, ref_id bigint, det_id bigint, distance double"
        return a.groupBy("field_id").cogroup(b.groupBy("field_id")).applyInArrow(run, schema)

    if (facts["most"] or 0) <= tile:
        return nested(a, b)
    big = sizes.filter(F.col("_n") > tile).select("field_id")
    listed = F.array(*[F.lit(float(t)) for t in marks])
    each = b.join(big, "field_id", "left_semi").withColumn("threshold", F.explode(F.filter(listed, lambda t: t <= F.col("joint"))))
    truth = a.join(big, "field_id", "left_semi").withColumn("threshold", F.explode(listed))
    large = match_hungarian(truth, each, ["threshold", "field_id"], tile)
    return nested(*[df.join(big, "field_id", "left_anti") for df in (a, b)]).unionByName(large.select("threshold", "field_id", "ref_id", "det_id", "distance"))


def match_audit(matches: DataFrame, refs: DataFrame, dets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., kind, id): unmatched references and detections."""
    keys = keys or ["field_id"]
    lost = refs.join(matches, [*keys, "ref_id"], "left_anti").select(
        *keys, F.lit("unmatched_reference").alias("kind"), F.col("ref_id").alias("id")
    )
    extra = dets.join(matches, [*keys, "det_id"], "left_anti").select(
        *keys, F.lit("unmatched_detection").alias("kind"), F.col("det_id").alias("id")
    )
    return lost.unionByName(extra)


def matched_class_accuracy(matches: DataFrame, labels: DataFrame, expected: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per field: matched pairs, those with the field's expected label, accuracy (NULL without pairs)."""
    keys = keys or ["field_id"]
    rows = matches.join(labels.select(*keys, "det_id", "label"), [*keys, "det_id"]).join(
        expected.select(*keys, F.col("label").alias("_want")), keys
    )
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matched"), F.count_if(F.col("label") == F.col("_want")).alias("correct")
    )
    return (
        expected.select(*keys)
        .join(sums, keys, "left")
        .fillna(0, ["matched", "correct"])
        .withColumn("accuracy", F.when(F.col("matched") > 0, F.col("correct") / F.col("matched")))
    )


def latency_stats(df: DataFrame, seconds: str, by: list[str]) -> DataFrame:
    """n, mean, sample SD, min, max of milliseconds, and frames per second of the mean."""
    ms = F.col(seconds) * 1000.0
    return df.groupBy(*by).agg(
        F.count(ms).alias("n"),
        F.avg(ms).alias("mean_ms"),
        F.stddev_samp(ms).alias("sd_ms"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
        F.try_divide(F.lit(1000.0), F.avg(ms)).alias("fps"),
    )


def numeric_agreement(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Correlation, MAE, RMSE and largest difference of two tables joined on keys."""
    e = F.col("_a") - F.col("_b")
    rows = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.corr("_a", "_b").alias("correlation"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.max(F.abs(e)).alias("max_abs"),
    )


def detection_report(dets: DataFrame, scores: DataFrame, field: str = "field_id") -> DataFrame:
    """Detections with roi_id (1.. by y, x within the field) joined to their class scores."""
    ranked = group_rank(dets, [field], [F.col("y"), F.col("x"), F.col("det_id")], F.col("y"), "roi_id")
    return ranked.join(scores, [field, "det_id"], "left")


def local_maxima(
    images: DataFrame, window: int, percentile: float, border: int, support: Column, min_support: float, keys: list[str]
) -> DataFrame:
    """(keys..., det_id, x, y, joint): pixels at least the percentile and the window maximum of their image.

    The neighbourhood is a square of side `window`, found by a row pass and a column pass;
    joint = response * (0.25 + min(support, 3)). det_id is the row-major position.
    """
    half = window // 2

    def passed(a: Column, stride: Column, position: Callable, count: Column) -> Column:
        def best(i: Column) -> Column:
            shifted = [
                F.when((position(i) + k >= 0) & (position(i) + k < count), A.at(a, i + stride * k))
                for k in range(-half, half + 1)
            ]
            return F.greatest(*shifted)

        return F.transform(a, lambda _v, i: best(i))

    shape = F.struct(F.col("pixels").alias("p"), F.col("width").alias("w"), F.col("height").alias("h"))
    highest = A.let(
        shape,
        lambda s: A.let(
            passed(s["p"], F.lit(1), lambda i: i % s["w"], s["w"]),
            lambda rowwise: passed(rowwise, s["w"], lambda i: F.floor(i / s["w"]), s["h"]),
        ),
    )
    marked = images.select(
        *keys, "height", "width", A.percentile(F.col("pixels"), percentile / 100.0).alias("_t"), support.alias("_sup"),
        F.posexplode(F.arrays_zip(F.col("pixels").alias("v"), highest.alias("m"))).alias("_i", "_z"),
    )
    y, x, v = F.floor(F.col("_i") / F.col("width")), F.col("_i") % F.col("width"), F.col("_z.v")
    inside = (y >= border) & (y < F.col("height") - border) & (x >= border) & (x < F.col("width") - border)
    hit = (v >= F.col("_t")) & (v >= F.col("_z.m") - 1e-6) & inside & (F.col("_sup") >= min_support)
    return marked.filter(hit).select(
        *keys,
        F.col("_i").cast("bigint").alias("det_id"),
        x.cast("double").alias("x"),
        y.cast("double").alias("y"),
        (v * (0.25 + F.least(F.col("_sup"), F.lit(3.0)))).alias("joint"),
    )

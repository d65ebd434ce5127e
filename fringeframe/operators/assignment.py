"""Assignment of least total distance for fields of any size: tiles are solved apart, then merged and mended.

A field is cut into tiles of about `TILE` centers along a space-filling curve. Every tile is solved on its own, in one task, with prices:
u of a row and v of a column, so that u + v is nowhere above the distance and equal to it on chosen pairs, and v is 0 where a column is
left over. Then four neighbouring tiles become one, until one is left. A merge keeps pairs and prices and looks for rows that a column
of another tile now suits better; only what these break is mended, by shortest alternating paths from rows without a column and from
columns left over at a price. At the top the prices prove the optimum over all pairs, though hardly any were looked at.

Number of rounds: the logarithm of the tiles. Memory of a task: the centers of its tile, never pairs.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeframe.functions import arrays as A
from fringeframe.operators.settle import dealt, settled
from fringeframe.operators.skew import group_rank

TILE = 2_000
# Tiles of up to this many possible pairs are solved on the table of their distances.
DENSE = 1 << 21
# Prices further apart than this are a violation; rounding alone stays far below.
_TOLERANCE = 1e-9
_CHUNK = 1 << 20
CURVE_BITS = 16


class Tile:
    """Rows and columns with prices and mates (-1: none). `free` is what a row without a column costs, `reach` the largest distance of a pair."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, u: np.ndarray, v: np.ndarray, mate: np.ndarray, free: float = math.inf, reach: float = math.inf):
        self.rx, self.ry = rows
        self.cx, self.cy = cols
        self.u, self.v, self.mate = u, v, mate
        self.holder = np.full(len(v), -1)
        self.holder[mate[mate >= 0]] = np.flatnonzero(mate >= 0)
        self.free, self.reach = free, reach
        self.by_x, self.rows_by_x = np.argsort(self.cx, kind="stable"), np.argsort(self.rx, kind="stable")
        self.sorted_x, self.sorted_rx = self.cx[self.by_x], self.rx[self.rows_by_x]
        self.apart = None

    def solve(self) -> None:
        if math.isinf(self.reach) and len(self.mate) * len(self.v) <= DENSE and (self.mate < 0).all() and not self.v.any():
            self.place(np.arange(len(self.mate)))
            return
        best = self._lower()
        mended = self._release()
        self._take(best)
        for row in np.flatnonzero((self.mate < 0) & (self.u < self.free - _TOLERANCE)):
            # Without a column left over there is no path, unless a row may stay free.
            if math.isinf(self.free) and (self.holder >= 0).all():
                break
            self._place_row(row)
        for col in mended:
            if self.holder[col] < 0 and self.v[col] < 0:
                self._settle_col(col)

    def place(self, rows: np.ndarray) -> None:
        """Pair further rows of a tile that starts without prices; rows placed before keep a column each, unless they may stay free."""
        if self.apart is None:
            x, y = self.rx[:, None] - self.cx, self.ry[:, None] - self.cy
            self.apart = np.sqrt(x * x + y * y)
            self.u = np.full(len(self.rx), min(self.free, np.finfo(float).max))
        if not len(self.cx) or not len(rows):
            return
        worth = self.apart[rows] - self.v
        best, left = worth.argmin(axis=1), []
        for row, col, least in zip(rows.tolist(), best.tolist(), worth[np.arange(len(rows)), best].tolist()):
            if least < self.free and self.holder[col] < 0:
                self.u[row], self.mate[row], self.holder[col] = least, col, row
            else:
                left.append(row)
        for row in self._reduced(left):
            self._place_dense(row)

    def _reduced(self, rows: list[int]) -> list[int]:
        """Every row takes its best column at the price of its second best and sends the holder away; rows that are left without one."""
        apart, u, v, mate, holder, free = self.apart, self.u, self.v, self.mate, self.holder, self.free
        todo, later, tries = rows[::-1], [], 3 * len(rows)
        while todo:
            row = todo.pop()
            if tries <= 0:
                later.append(row)
                continue
            tries -= 1
            worth = apart[row] - v
            col = int(worth.argmin())
            least = float(worth[col])
            if least >= free or least == math.inf:
                continue
            worth[col] = math.inf
            second = min(float(worth.min()), free)
            if second == math.inf:
                # A single column: its price is open, a path decides.
                u[row] = least
                later.append(row)
                continue
            other = int(holder[col])
            if other >= 0 and second <= least:
                u[row] = least
                later.append(row)
                continue
            u[row] = second
            v[col] -= second - least
            mate[row], holder[col] = col, row
            if other >= 0:
                mate[other] = -1
                todo.append(other)
        return later

    def _place_dense(self, start: int) -> None:
        """`_place_row` on the table of distances."""
        apart, u, v, holder, free = self.apart, self.u, self.v, self.holder, self.free
        u[start] = min(float((apart[start] - v).min()), free)
        if u[start] >= free or u[start] == math.inf:
            u[start] = min(free, np.finfo(float).max)
            return
        reach, came = np.full(len(v), np.inf), np.full(len(v), -1)
        open_, rows, cols, ways = reach.copy(), [start], [], [0.0]
        row, base, top, end = start, 0.0, math.inf, None
        while True:
            if base + free - u[row] < top:
                top, end = max(base, base + free - u[row]), (row, -1)
            way = apart[row] - v
            way += base - u[row]
            np.maximum(way, base, out=way)
            better = way < reach
            np.copyto(reach, way, where=better)
            np.copyto(open_, way, where=better)
            came[better] = row
            col = int(open_.argmin())
            near = float(open_[col])
            if near >= top:
                break
            row = int(holder[col])
            if row < 0:
                top, end = near, (-1, col)
                break
            open_[col], base = np.inf, near
            cols.append(col)
            rows.append(row)
            ways.append(base)
        if end is None:
            return
        u[rows] += top - np.array(ways)
        v[cols] -= top - np.array(ways[1:])
        row, col = end
        if row >= 0:
            if row == start:
                return
            col, self.mate[row] = self.mate[row], -1
        while True:
            row = came[col]
            self.mate[row], holder[col], col = col, row, self.mate[row]
            if row == start:
                return

    def _lower(self) -> np.ndarray:
        """Lower u where a column is nearer than the prices allow (new rows start above all); the column that sets it, or -1."""
        n, best = len(self.rx), np.full(len(self.rx), -1)
        if not len(self.cx):
            self.u = np.where(np.isinf(self.u) & (self.u > 0), np.minimum(self.free, np.finfo(float).max), self.u)
            return best
        # v is never above 0, so only columns within u matter.
        half = np.minimum(self.u, self.reach)
        lo = np.searchsorted(self.sorted_x, self.rx - half - _TOLERANCE)
        hi = np.searchsorted(self.sorted_x, self.rx + half + _TOLERANCE, side="right")
        sizes = hi - lo
        start = 0
        while start < n:
            stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), _CHUNK)))
            own = sizes[start:stop]
            row = np.repeat(np.arange(start, min(stop, n)), own)
            col = self.by_x[np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(lo[start:stop], own)]
            d = np.hypot(self.rx[row] - self.cx[col], self.ry[row] - self.cy[col])
            worth = np.where(d <= self.reach, d - self.v[col], np.inf)
            some = np.flatnonzero(own)
            if len(some):
                low = np.minimum.reduceat(worth, (np.cumsum(own) - own)[some])
                at = start + some
                less = low < self.u[at] - _TOLERANCE
                hit = worth == np.repeat(low, own[some])
                first = np.full(len(own), -1)
                place = np.flatnonzero(hit)
                first[row[place[::-1]] - start] = col[place[::-1]]
                self.u[at[less]] = low[less]
                best[at[less]] = first[some][less]
            start = stop
        none = np.isinf(self.u) & (self.u > 0)
        self.u[none] = min(self.free, np.finfo(float).max)
        over = self.u > self.free
        self.u[over], best[over] = self.free, -1
        return best

    def _release(self) -> np.ndarray:
        """Pairs whose distance is above the lowered prices come apart; the columns they leave at a price."""
        rows = np.flatnonzero(self.mate >= 0)
        cols = self.mate[rows]
        apart = np.hypot(self.rx[rows] - self.cx[cols], self.ry[rows] - self.cy[cols]) - self.u[rows] - self.v[cols] > _TOLERANCE
        self.mate[rows[apart]], self.holder[cols[apart]] = -1, -1
        return cols[apart][self.v[cols[apart]] < 0]

    def _take(self, best: np.ndarray) -> None:
        """Rows whose best column is left over take it at once."""
        for row in np.flatnonzero((best >= 0) & (self.mate < 0)):
            if self.holder[best[row]] < 0:
                self.mate[row], self.holder[best[row]] = best[row], row

    def _place_row(self, start: int) -> None:
        """Shortest alternating path from a row to a column left over, or to a row that may as well stay free."""
        reach, came = np.full(len(self.cx), np.inf), np.full(len(self.cx), -1)
        heap: list[tuple[float, int]] = []
        rows, cols, at = [(start, 0.0)], [], set()
        row, base, top, end = start, 0.0, math.inf, None
        while True:
            if base + self.free - self.u[row] < top:
                top, end = max(base, base + self.free - self.u[row]), (row, -1)
            half = min(top - base + self.u[row], self.reach)
            near = self.by_x
            if half < math.inf:
                near = near[np.searchsorted(self.sorted_x, self.rx[row] - half) : np.searchsorted(self.sorted_x, self.rx[row] + half, side="right")]
            d = np.hypot(self.cx[near] - self.rx[row], self.cy[near] - self.ry[row])
            way = base + np.maximum(d - self.u[row] - self.v[near], 0.0)
            better = (way < reach[near]) & (way < top) & (d <= self.reach)
            near, way = near[better], way[better]
            reach[near], came[near] = way, row
            open_ = self.holder[near] < 0
            if open_.any():
                least = np.flatnonzero(open_)[np.argmin(way[open_])]
                top, end = way[least], (-1, near[least])
            for c, w in zip(near[~open_ & (way < top)].tolist(), way[~open_ & (way < top)].tolist()):
                heapq.heappush(heap, (w, c))
            while heap and (heap[0][1] in at or heap[0][0] > reach[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= top:
                break
            base, col = heapq.heappop(heap)
            at.add(col)
            cols.append((col, base))
            row = self.holder[col]
            rows.append((row, base))
        if end is None:
            return
        for r, way in rows:
            self.u[r] += top - way
        for c, way in cols:
            self.v[c] -= top - way
        row, col = end
        if row >= 0:
            if row == start:
                return
            col, self.mate[row] = self.mate[row], -1
        while True:
            row = came[col]
            self.mate[row], self.holder[col], col = col, row, self.mate[row]
            if row == start:
                return

    def _settle_col(self, start: int) -> None:
        """Shortest alternating path from a column left over at a price to a row without one, or to a column that loses its price instead."""
        reach, came = np.full(len(self.rx), np.inf), np.full(len(self.rx), -1)
        heap: list[tuple[float, int]] = []
        rows, cols, at = [], [(start, 0.0)], set()
        col, base, top, end = start, 0.0, math.inf, None
        highest = self.u.max(initial=0.0)
        while True:
            if base - self.v[col] < top:
                top, end = base - self.v[col], (-1, col)
            half = max(min(top - base + highest + self.v[col], self.reach), 0.0)
            near = self.rows_by_x[np.searchsorted(self.sorted_rx, self.cx[col] - half) : np.searchsorted(self.sorted_rx, self.cx[col] + half, side="right")]
            d = np.hypot(self.rx[near] - self.cx[col], self.ry[near] - self.cy[col])
            way = base + np.maximum(d - self.u[near] - self.v[col], 0.0)
            better = (way < reach[near]) & (way < top) & (d <= self.reach)
            near, way = near[better], way[better]
            reach[near], came[near] = way, col
            lone = self.mate[near] < 0
            if lone.any():
                least = np.flatnonzero(lone)[np.argmin(way[lone])]
                top, end = way[least], (near[least], -1)
            for r, w in zip(near[~lone & (way < top)].tolist(), way[~lone & (way < top)].tolist()):
                heapq.heappush(heap, (w, r))
            while heap and (heap[0][1] in at or heap[0][0] > reach[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= top:
                break
            base, row = heapq.heappop(heap)
            at.add(row)
            rows.append((row, base))
            col = self.mate[row]
            cols.append((col, base))
        for c, way in cols:
            self.v[c] = min(self.v[c] + top - way, 0.0)
        for r, way in rows:
            self.u[r] -= top - way
        row, col = end
        if col >= 0:
            self.v[col] = 0.0
            if col == start:
                return
            row, self.holder[col] = self.holder[col], -1
        while True:
            col = came[row]
            before = self.holder[col]
            self.mate[row], self.holder[col] = col, row
            if col == start:
                return
            row = before


_STATE = "side int, uid bigint, id bigint, x double, y double, place bigint, tiles bigint, price double, mate bigint, mate_id bigint, gap double"


def _tile_kernel(names: list[str], free: float, reach: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Order by place in the field makes the result the same under every partitioning.
        pdf = pdf.sort_values(["side", "uid", "id", "x", "y"], kind="stable", ignore_index=True)
        side = pdf["side"].to_numpy()
        r, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        x, y, uid, ids = (pdf[k].to_numpy() for k in ("x", "y", "uid", "id"))
        price = pdf["price"].to_numpy(dtype=float, na_value=np.nan)
        u, v = np.where(np.isnan(price[r]), np.inf, price[r]), np.where(np.isnan(price[c]), 0.0, price[c])
        known = pdf["mate"].to_numpy(dtype=float, na_value=np.nan)[r]
        mate = np.full(len(r), -1)
        has = ~np.isnan(known)
        mate[has] = np.searchsorted(uid[c], known[has].astype(np.int64))
        tile = Tile(np.stack([x[r], y[r]]), np.stack([x[c], y[c]]), u, v, mate, free, reach)
        tile.solve()
        price[r], price[c] = tile.u, tile.v
        paired = np.flatnonzero(tile.mate >= 0)
        rows, cols = r[paired], c[tile.mate[paired]]
        partner, partner_id, gap = pd.array([pd.NA] * len(pdf), "Int64"), pd.array([pd.NA] * len(pdf), "Int64"), np.full(len(pdf), np.nan)
        partner[rows], partner_id[rows], gap[rows] = uid[cols], ids[cols], np.hypot(x[rows] - x[cols], y[rows] - y[cols])
        return pdf.assign(price=price, mate=partner, mate_id=partner_id, gap=gap)[names]

    return run


def _curve(at: Column, low: Column, high: Column) -> Column:
    """The bits of a coordinate's place between low and high, spread to every second bit."""
    place = F.when(high > low, F.floor((at - low) / (high - low) * (2**CURVE_BITS - 1))).otherwise(0).cast("bigint")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        place = place.bitwiseOR(F.shiftleft(place, shift)).bitwiseAND(F.lit(mask))
    return place


def assigned(
    rows: DataFrame, cols: DataFrame, keys: list[str], free: float = math.inf, reach: float = math.inf, tile: int = TILE
) -> DataFrame:
    """(keys..., row_id, col_id, distance): pairs of (id, x, y) of least total cost within each key.

    Without `free`, every center of the side with fewer is paired. With it, a row without a column costs `free` and pairs are at most
    `reach` apart. Centers with a null or non-finite coordinate are left out; among optima of equal cost the choice is
    fixed by order, not by partitioning.
    """
    sound = A.finite(F.col("x")) & A.finite(F.col("y"))
    for k in keys:
        sound = sound & F.col(k).isNotNull()
    sides = [df.select(*keys, F.col("id").cast("bigint").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(sound) for df in (rows, cols)]
    counts = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)) for df, name in zip(sides, ("_a", "_b"))]
    sizes = settled(counts[0].join(counts[1], keys).select(*keys, (F.col("_a") + F.col("_b")).alias("_n")))
    facts = sizes.agg(F.max("_n").alias("most"), F.sum("_n").alias("all")).first()
    most = facts["most"] or 0
    if most <= tile:
        return _paired(*sides, keys, facts["all"] or 0, free, reach)
    big = sizes.filter(F.col("_n") > tile).select(*keys)
    apart = _paired(*[df.join(big, keys, "left_anti") for df in sides], keys, facts["all"], free, reach)
    return apart.unionByName(_merged(*[df.join(big, keys, "left_semi") for df in sides], keys, most, free, reach, tile))


def _paired(rows: DataFrame, cols: DataFrame, keys: list[str], centers: int, free: float, reach: float) -> DataFrame:
    """Fields of one tile: both sides meet in one task and only pairs are handed on."""

    def run(rows: pa.Table, cols: pa.Table) -> pa.Table:
        flipped = math.isinf(free) and len(rows) > len(cols)
        # A fixed order makes the result the same under every partitioning.
        a, b = (t.sort_by([(c, "ascending") for c in ("id", "x", "y")]) for t in ((cols, rows) if flipped else (rows, cols)))
        places = [np.stack([t.column(c).to_numpy() for c in ("x", "y")]) for t in (a, b)]
        tile = Tile(*places, np.full(len(a), np.inf), np.zeros(len(b)), np.full(len(a), -1), free, reach)
        if len(a) and len(b):
            tile.solve()
        r = np.flatnonzero(tile.mate >= 0)
        c = tile.mate[r]
        gap = np.hypot(places[0][0][r] - places[1][0][c], places[0][1][r] - places[1][1][c])
        ids = a.column("id").take(pa.array(r)).combine_chunks(), b.column("id").take(pa.array(c)).combine_chunks()
        out = {k: pa.array([rows.column(k)[0].as_py()] * len(r) if len(r) else [], rows.schema.field(k).type) for k in keys}
        return pa.table({**out, "row_id": ids[flipped], "col_id": ids[not flipped], "distance": pa.array(gap, pa.float64())})

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "row_id bigint, col_id bigint, distance double"])
    a, b = (dealt(df, keys, centers).groupBy(*keys) for df in (rows, cols))
    return a.cogroup(b).applyInArrow(run, schema)


def _merged(rows: DataFrame, cols: DataFrame, keys: list[str], most: int, free: float, reach: float, tile: int) -> DataFrame:
    """Fields of several tiles of at most `most` centers."""
    points = rows.select(*keys, F.lit(0).alias("side"), "id", "x", "y").unionByName(cols.select(*keys, F.lit(1).alias("side"), "id", "x", "y"))
    box = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        (F.count_if(F.col("side") == 0) > F.count_if(F.col("side") == 1)).alias("_flip"),
        *[f(c).alias(f"_{name}_{c}") for c in ("x", "y") for name, f in (("low", F.min), ("high", F.max))],
    )
    flip = F.col("_flip") if math.isinf(free) else F.lit(False)
    placed = points.join(box, keys).withColumn("flipped", flip).withColumn("side", F.when(F.col("flipped"), 1 - F.col("side")).otherwise(F.col("side")))
    code = F.shiftleft(_curve(F.col("y"), F.col("_low_y"), F.col("_high_y")), 1).bitwiseOR(_curve(F.col("x"), F.col("_low_x"), F.col("_high_x")))
    state = group_rank(placed.withColumn("_code", code), keys, [F.col("_code"), F.col("side"), F.col("id"), F.col("x"), F.col("y")], F.col("_code"), "uid")
    state = state.withColumn("place", F.floor((F.col("uid") - 1) / tile)).withColumn("tiles", F.ceil(F.col("_n") / tile))
    kinds = dict(points.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "flipped boolean", _STATE])
    state = state.selectExpr(*[f"`{k}`" for k in keys], "flipped", "side", "cast(uid as bigint) uid", "id", "cast(x as double) x", "cast(y as double) y",
        "cast(place as bigint) place", "cast(tiles as bigint) tiles", "cast(null as double) price", "cast(null as bigint) mate", "cast(null as bigint) mate_id", "cast(null as double) gap")
    kernel = _tile_kernel(state.columns, free, reach)
    state = state.groupBy(*keys, "place").applyInPandas(kernel, schema)
    done, merged = [], 1
    while most > tile * merged:
        state = settled(state)
        done.append(state.filter(F.col("tiles") <= merged))
        merged *= 4
        left = state.filter(F.col("tiles") > merged // 4).withColumn("place", F.floor(F.col("place") / 4))
        state = left.groupBy(*keys, "place").applyInPandas(kernel, schema)
    for part in done:
        state = state.unionByName(part)
    ends = lambda a, b: F.when(F.col("flipped"), F.col(a)).otherwise(F.col(b))
    return state.filter("side = 0 AND mate_id IS NOT NULL").select(
        *keys, ends("mate_id", "id").alias("row_id"), ends("id", "mate_id").alias("col_id"), F.col("gap").alias("distance")
    )

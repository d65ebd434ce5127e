"""Nearest center of every point, at whatever distance, by a pyramid of cells.

Cells double in size from level to level; each knows one of its centers. A point looks around itself, level after level, until a cell
next to it holds a center: that center's distance is its bound. From the level that fits the bound it goes down again: of every
cell within the bound the quarters are looked at, whose centers tighten it, and quarters beyond it are left. Only the centers of
the smallest cells that remain are compared. Points in dense places never leave the lowest level; no point is paired with all
centers, however far away they are or how dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringeframe.functions import arrays as A
from fringeframe.operators.settle import settled

# Spots of a smallest cell; cells are halved up to FINER times below the mean spacing to get there.
LEAF = 64
FINER = 8
_SLACK = 1.0 + 1e-9


def _halved(number: Column | str, times: Column | int) -> Column:
    """Whole number halved `times` times, rounded down."""
    number = F.col(number) if isinstance(number, str) else number
    return F.call_function("shiftright", number, times.cast("int") if isinstance(times, Column) else F.lit(times))


def _doubled(times: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), times.cast("int"))


def _apart(x: Column, y: Column, u: Column, v: Column) -> Column:
    return F.sqrt((x - u) * (x - u) + (y - v) * (y - v))


def _grids(spots: DataFrame, keys: list[str], leaf: int) -> DataFrame:
    """(keys..., low_x, low_y, size, top): corner and smallest cells of each field, and the level whose one cell holds the field."""
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    box = spots.groupBy(*keys).agg(F.min("x").alias("low_x"), F.min("y").alias("low_y"), span.alias("_span"), F.count(F.lit(1)).alias("_n"))
    box = box.withColumn("_first", F.when(F.col("_span") > 0, F.col("_span") / F.ceil(F.sqrt("_n"))).otherwise(1.0))
    placed = spots.join(box, keys).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(FINER))))
    step = F.col("_first") / F.pow(F.lit(2.0), F.col("_s"))
    full = placed.groupBy(*keys, "_s", F.floor((F.col("x") - F.col("low_x")) / step).alias("_i"), F.floor((F.col("y") - F.col("low_y")) / step).alias("_j"))
    most = full.agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys, "_s").agg(F.max("_c").alias("_c"))
    finer = most.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_c") <= leaf, F.col("_s"))), F.lit(FINER)).alias("_s"))
    size = F.col("_first") / F.pow(F.lit(2.0), F.col("_s"))
    top = F.when(F.col("_span") > 0, F.ceil(F.log2(F.col("_span") / size + 1.0))).otherwise(0).cast("int")
    return box.join(finer, keys).select(*keys, "low_x", "low_y", size.alias("size"), top.alias("top"))


def _cell(at: Column, low: Column, level: Column) -> Column:
    """Number of the cell that holds a coordinate; every level halves the numbers of the one below, so the levels nest exactly."""
    return _halved(F.floor((at - low) / F.col("size")).cast("bigint"), level)


def _cell_gap(at: Column, low: Column, number: Column, size: Column) -> Column:
    start = low + number * size
    return F.greatest(start - at, at - (start + size), F.lit(0.0))


def nearest(points: DataFrame, centers: DataFrame, keys: list[str], leaf: int = LEAF) -> DataFrame:
    """(keys..., id, det_id, distance) of every point (keys, id, x, y): its nearest center (keys, det_id, x, y), ties to the smaller det_id.

    Centers at one spot are merged first. Points and centers with a null or non-finite coordinate take no part; points of a field
    without centers are left out. Points that repeat an id count as one, with the nearest center of any of them.
    """
    sound = A.finite(F.col("x")) & A.finite(F.col("y"))
    spots = settled(centers.filter(sound).groupBy(*keys, "x", "y").agg(F.min("det_id").alias("det_id")))
    grid = settled(_grids(spots, keys, leaf))
    top = grid.agg(F.max("top")).first()[0] or 0
    zero = F.lit(0)
    low = settled(spots.join(grid, keys).withColumn("i", _cell(F.col("x"), F.col("low_x"), zero)).withColumn("j", _cell(F.col("y"), F.col("low_y"), zero)))
    each = low.withColumn("level", F.explode(F.sequence(zero, F.col("top"))))
    cells = settled(
        each.groupBy(*keys, "level", _halved("i", F.col("level")).alias("i"), _halved("j", F.col("level")).alias("j")).agg(
            F.min(F.struct("det_id", "x", "y")).alias("one")
        )
    )
    left = settled(points.filter(sound).select(*keys, "id", "x", "y").join(grid, keys))
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    bounded = None
    for level in range(top + 1):
        if level and left.isEmpty():
            break
        at = F.lit(level)
        # Far outside the field, the cell at its edge is next.
        last = _halved(_doubled(F.col("top")) - 1, level)
        place = lambda c, lo: F.greatest(F.lit(0).cast("bigint"), F.least(last, _cell(F.col(c), F.col(lo), at)))
        probes = left.select("*", (place("x", "low_x")).alias("_i"), (place("y", "low_y")).alias("_j"))
        probes = probes.withColumn("_di", F.explode(around)).withColumn("_dj", F.explode(around))
        probes = probes.select(*left.columns, (F.col("_i") + F.col("_di")).alias("i"), (F.col("_j") + F.col("_dj")).alias("j"))
        seen = probes.join(cells.filter(F.col("level") == level).drop("level"), [*keys, "i", "j"])
        found = seen.groupBy(*left.columns).agg(F.min(_apart(F.col("x"), F.col("y"), F.col("one.x"), F.col("one.y"))).alias("bound"))
        found = settled(found)
        bounded = found if bounded is None else bounded.unionByName(found)
        left = settled(left.join(found.select(*keys, "id"), [*keys, "id"], "left_anti"))
    # The level whose cells are about as large as the bound: at most three a side.
    start = F.greatest(F.lit(0), F.least(F.col("top"), F.when(F.col("bound") > 0, F.ceil(F.log2(F.col("bound") / F.col("size")))).otherwise(0).cast("int")))
    reach = F.col("bound") * _SLACK
    end = _doubled(F.col("top")) - 1

    def numbers(c: str, lo: str) -> Column:
        number = lambda at: _halved(F.greatest(F.lit(0).cast("bigint"), F.least(end, F.floor((at - F.col(lo)) / F.col("size")).cast("bigint"))), F.col("level"))
        return F.explode(F.sequence(number(F.col(c) - reach), number(F.col(c) + reach)))

    asked = bounded.withColumn("level", start).withColumn("i", numbers("x", "low_x")).withColumn("j", numbers("y", "low_y"))
    asked = settled(asked.join(cells.drop("one"), [*keys, "level", "i", "j"], "left_semi"))
    own = Window.partitionBy(*keys, "id")
    for level in range(top, 0, -1):
        here = asked.filter(F.col("level") == level)
        quarters = cells.filter(F.col("level") == level - 1).select(
            *keys, _halved("i", 1).alias("i"), _halved("j", 1).alias("j"), F.col("i").alias("_i"), F.col("j").alias("_j"), "one"
        )
        size = F.col("size") * float(2 ** (level - 1))
        gap_x, gap_y = _cell_gap(F.col("x"), F.col("low_x"), F.col("_i"), size), _cell_gap(F.col("y"), F.col("low_y"), F.col("_j"), size)
        down = here.join(quarters, [*keys, "i", "j"])
        down = down.withColumn("bound", F.least("bound", F.min(_apart(F.col("x"), F.col("y"), F.col("one.x"), F.col("one.y"))).over(own)))
        # Sizes are no powers of two, so a gap may be off by rounding of the corner.
        down = down.filter(F.sqrt(gap_x * gap_x + gap_y * gap_y) <= reach + size * 1e-9)
        down = down.withColumn("level", F.lit(level - 1)).drop("i", "j", "one").withColumnsRenamed({"_i": "i", "_j": "j"})
        asked = asked.filter(F.col("level") != level).unionByName(down.select(*asked.columns))
        if level % 4 == 0 or level == 1:
            asked = settled(asked)
    candidates = low.select(*keys, "i", "j", F.col("x").alias("_x"), F.col("y").alias("_y"), "det_id")
    best = F.min(F.struct(_apart(F.col("x"), F.col("y"), F.col("_x"), F.col("_y")).alias("distance"), "det_id"))
    return asked.join(candidates, [*keys, "i", "j"]).groupBy(*keys, "id").agg(best.alias("b")).select(*keys, "id", "b.det_id", "b.distance")

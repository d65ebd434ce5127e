"""Exact percentiles without moving the values.

The order of doubles is the order of their bit patterns (signs turned). A pass over the table counts, map-side, the values by the
next 16 bits; only the bins that hold a wanted rank go on to the next pass. As soon as these hold few values, one last pass
counts their distinct values. A table of few values takes that pass alone; else two or three scans are usual, five the most. No exchange carries more than 2^16 rows a key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringeframe.operators.settle import settled

DIGIT = 16
# Values of a bin that are counted one by one.
FEW = 1 << DIGIT
_SIGN = np.uint64(1 << 63)


def _ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; NaN is above all, the zeros are equal."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _doubles(ordered: np.ndarray) -> np.ndarray:
    bits = ordered.astype(np.int64).view(np.uint64)
    return np.where(bits & _SIGN, bits & ~_SIGN, ~bits).view(np.float64)


def _flat(column: pa.Array, by_place: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of all values that are not null; place is 0 unless `by_place`."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy().astype(np.int64)
        row, values = np.repeat(np.arange(len(column)), sizes), column.flatten()
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) if by_place else np.zeros(len(row), np.int64)
    else:
        row, values, place = np.arange(len(column)), column, np.zeros(len(column), np.int64)
    known = pa.compute.is_valid(values).to_numpy(zero_copy_only=False)
    return row[known], place[known], np.ascontiguousarray(values.to_numpy(zero_copy_only=False)[known], float)


def _codes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """A number per row, equal for equal keys."""
    out = np.zeros(len(batch), np.int64)
    for k in keys:
        code = pa.compute.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy()
        _, out = np.unique(out * (int(code.max(initial=0)) + 1) + code, return_inverse=True)
    return out


def _counted(keys: list[str], by_place: bool, prefix_bits: int, last: bool):
    """Rows (keys..., _v, _want) to (keys..., _place, _prefix, _digit, _n): how often each next digit (or, at last, value) follows a wanted prefix."""
    shift = np.uint64(64 - prefix_bits - DIGIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, values = _flat(batch.column("_v"), by_place)
            bits, code = _ordered(values), _codes(batch, keys)
            lone = np.unique(code, return_index=True)[1]
            width = int(place.max(initial=0)) + 1
            group = code[row] * width + place
            prefix = np.zeros(len(bits), np.uint64)
            if prefix_bits:
                prefix = bits >> np.uint64(64 - prefix_bits)
                wanted = [(code[i] * width + w["p"], w["b"]) for i in lone for w in batch.column("_want")[int(i)].as_py() or () if w["p"] < width]
                groups, marks = (np.array([w[k] for w in wanted], np.int64) for k in (0, 1))
                every = np.unique(marks.view(np.uint64))
                at = np.minimum(np.searchsorted(every, prefix), max(len(every) - 1, 0))
                own = np.zeros(len(bits), bool)
                if len(every):
                    pairs = groups * len(every) + np.searchsorted(every, marks.view(np.uint64))
                    own = (every[at] == prefix) & np.isin(group * len(every) + at, pairs)
                row, group, prefix, bits = row[own], group[own], prefix[own], bits[own]
            digit = bits if last else (bits >> shift) & np.uint64(2**DIGIT - 1)
            order = np.lexsort((digit, prefix, group))
            g, p, d = group[order], prefix[order], digit[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (p[1:] != p[:-1]) | (d[1:] != d[:-1])
            starts = np.flatnonzero(new)
            counts = np.diff(np.append(starts, len(g)))
            example = pa.array(row[order][starts])
            columns = [batch.column(k).take(example) for k in keys]
            columns += [pa.array(c[starts].astype(np.uint64).view(np.int64)) for c in (g % width, p, d)] + [pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "_place", "_prefix", "_digit", "_n"])

    return run


def quantiles(
    df: DataFrame, keys: list[str], value: str | Column, wanted: dict[str, float], by_place: bool = False, place: str = "place", few: int = FEW
) -> DataFrame:
    """(keys..., [place], one column per wanted): exact linear-interpolation percentiles of a double, or of all elements of an array.

    With `by_place` every position of the array is a group of its own, named `place`. Nulls are ignored, NaN is the
    largest value, groups without a value give no row. `df` is read once per pass.
    """
    value = F.col(value) if isinstance(value, str) else value
    kind = df.select(value.alias("v")).schema["v"].dataType.simpleString()
    source = df.select(*keys, value.cast("array<double>" if kind.startswith("array") else "double").alias("_v"))
    kinds = dict(source.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "_place bigint, _prefix bigint, _digit bigint, _n bigint"])
    group = [*keys, "_place"]
    same = lambda a, b, names: [a[k].eqNullSafe(b[k]) for k in names]
    many = F.sum(F.coalesce(F.size("_v"), F.lit(0))) if kind.startswith("array") and not by_place else F.count("_v")
    inside = source.groupBy(*keys).agg(many.alias("n")).agg(F.max("n")).first()[0] or 0
    state = None
    bits = 0
    while True:
        last = bits == 64 - DIGIT or inside <= few
        if state is None:
            rows = source
        else:
            want = state.groupBy(*keys).agg(F.collect_set(F.struct(F.col("_place").alias("p"), F.col("_prefix").alias("b"))).alias("_want"))
            rows = source.join(want.withColumnsRenamed({k: f"_{k}_" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys] or F.lit(True)).select(*source.columns, "_want")
        found = rows.mapInArrow(_counted(keys, by_place, bits, last), schema)
        # The sign bit of the ordered pattern makes a BIGINT negative: turning it gives the right order.
        turned = F.col("_digit").bitwiseXOR(F.lit(-(2**63))) if last else F.col("_digit")
        found = found.groupBy(*group, "_prefix", "_digit").agg(F.sum("_n").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*group, "_prefix").orderBy(turned).rowsBetween(Window.unboundedPreceding, 0))
        found = found.withColumn("_upto", upto)
        if state is None:
            sizes = found.groupBy(*group).agg(F.sum("_n").alias("_size"))
            ends = F.array(*[F.struct(F.lit(name).alias("q"), (F.lit(float(p)) * (F.col("_size") - 1)).alias("at")) for name, p in wanted.items()])
            ranks = sizes.withColumn("_e", F.explode(ends)).select(*group, F.col("_e.q").alias("_q"), F.col("_e.at").alias("_at"))
            ranks = ranks.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))).withColumn("_left", F.col("_rank"))
            ranks = ranks.withColumn("_prefix", F.lit(0).cast("bigint"))
        else:
            ranks = state.drop("_inside")
        a, b = ranks.alias("a"), found.alias("b")
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*group, "_prefix"]]
        hit = (F.col("b._upto") - F.col("b._n") <= F.col("a._left")) & (F.col("a._left") < F.col("b._upto"))
        joined = a.join(b, on).filter(hit)
        nxt = F.col("b._digit") if last else F.shiftleft(F.col("a._prefix"), DIGIT).bitwiseOR(F.col("b._digit"))
        state = settled(
            joined.select(
                *[F.col(f"a.{k}").alias(k) for k in [*group, "_q", "_at", "_rank"]],
                (F.col("a._left") - (F.col("b._upto") - F.col("b._n"))).alias("_left"),
                nxt.alias("_prefix"),
                F.col("b._n").alias("_inside"),
            )
        )
        if last:
            break
        bits += DIGIT
        inside = state.agg(F.max("_inside")).first()[0] or 0

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_prefix")
            yield batch.set_column(at, "_value", pa.array(_doubles(batch.column("_prefix").to_numpy())))

    picked = state.select(*group, "_q", "_at", "_rank", "_prefix")
    values = picked.mapInArrow(back, ", ".join(f"`{n}` {'double' if n == '_prefix' else k}".replace("`_prefix`", "`_value`") for n, k in picked.dtypes))
    lo, hi = F.min_by("_value", "_rank"), F.max_by("_value", "_rank")
    mixed = values.groupBy(*group, "_q", "_at").agg(F.when(F.count(F.lit(1)) == 1, lo).otherwise(lo + (F.col("_at") - F.floor("_at")) * (hi - lo)).alias("_value"))
    out = mixed.groupBy(*group).agg(*[F.max(F.when(F.col("_q") == name, F.col("_value"))).alias(name) for name in wanted])
    return out.withColumnRenamed("_place", place) if by_place else out.drop("_place")

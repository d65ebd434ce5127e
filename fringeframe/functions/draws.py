"""Deterministic draws from hashes: independent of partitioning, repeatable after executor loss."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX32_MAX = 4294967295.0


def _column(part) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def hash32(*parts) -> Column:
    """First eight hex digits of sha1('a|b|...') as BIGINT."""
    text = F.concat_ws("|", *[_column(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform in (0, 1)."""
    return (hash32(*parts) + F.lit(0.5)) / F.lit(HEX32_MAX + 1.0)


def normal(*parts) -> Column:
    """Standard normal by Box-Muller from two hash uniforms."""
    return F.sqrt(F.lit(-2.0) * F.log(uniform(*parts, "r"))) * F.cos(
        F.lit(2.0 * math.pi) * uniform(*parts, "a")
    )


def draw_index(n: Column, *parts) -> Column:
    """Index 0..n-1; modulo bias is at most n / 2**32."""
    return F.pmod(hash32(*parts), n)

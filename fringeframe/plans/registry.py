"""Registration of named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeframe.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `build(views) -> DataFrame` under `name`, with the SQL that must agree."""

    def wrap(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return wrap


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0, as the SQL twins do."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits) + F.lit(0.0)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers as BIGINT: the shape compared with the SQL twin."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        c = F.col(f"`{field.name}`")
        if kind in ("double", "float"):
            c = rounded(c.cast("double"), digits)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)

"""Missing data. NULL and NaN are missing; compat=True also takes 0 of whole-number columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidOption, check_columns
from .ordered import drop_helpers, neighbours
from .select import col

WHOLE = ("tinyint", "smallint", "int", "bigint")


def is_missing(df: DataFrame, column: str, compat: bool = False) -> Column:
    check_columns(df, column)
    kind, c = dict(df.dtypes)[column], col(column)
    gone = c.isNull()
    if kind in ("double", "float"):
        gone = gone | F.isnan(c)
    if compat and kind in WHOLE:
        gone = gone | (c == 0)
    return F.coalesce(gone, F.lit(True))


def isna(df: DataFrame, column: str, compat: bool = False, name=None) -> DataFrame:
    return df.withColumn(name or f"{column}_isna", is_missing(df, column, compat))


def notna(df: DataFrame, column: str, compat: bool = False, name=None) -> DataFrame:
    return df.withColumn(name or f"{column}_notna", ~is_missing(df, column, compat))


def dropna(df: DataFrame, subset=None, how: str = "any", compat: bool = False) -> DataFrame:
    """Unknown names of subset are skipped."""
    if how not in ("any", "all"):
        raise InvalidOption("how is 'any' or 'all'")
    names = [c for c in (subset or df.columns) if c in df.columns]
    if not names:
        return df
    test = None
    for c in names:
        g = is_missing(df, c, compat)
        test = g if test is None else (test | g if how == "any" else test & g)
    return df.where(~test)


def fill_constant(df: DataFrame, column: str, value, compat: bool = False) -> DataFrame:
    return df.withColumn(column, F.when(is_missing(df, column, compat), F.lit(value)).otherwise(col(column)))


def _default(df, column):
    kind = dict(df.dtypes)[column]
    return F.lit("" if kind == "string" else False if kind == "boolean" else 0).cast(kind)


def fill_forward(df: DataFrame, column: str, order_by, partition_by=None) -> DataFrame:
    """A gap at the start gets the type's zero."""
    n = neighbours(df, column, order_by, partition_by)
    return drop_helpers(n.withColumn(column, F.coalesce("__pv", _default(df, column))))


def fill_backward(df: DataFrame, column: str, order_by, partition_by=None) -> DataFrame:
    """A gap at the end gets the type's zero."""
    n = neighbours(df, column, order_by, partition_by)
    return drop_helpers(n.withColumn(column, F.coalesce("__nv", _default(df, column))))


def interpolate(df: DataFrame, column: str, order_by, partition_by=None) -> DataFrame:
    """Linear by row position; the nearest value at the ends, 0.0 where there is none."""
    n = neighbours(df, column, order_by, partition_by)
    pv, nv = F.col("__pv").cast("double"), F.col("__nv").cast("double")
    step = F.try_divide((nv - pv) * (F.col("__i") - F.col("__pi")), F.col("__ni") - F.col("__pi"))
    return drop_helpers(n.withColumn(column, F.coalesce(F.when(F.col("__pi") == F.col("__i"), pv), pv + step, pv, nv, F.lit(0.0))))


def fillna(df: DataFrame, column: str, method: str = "constant", value=None, order_by=None, partition_by=None, compat: bool = False) -> DataFrame:
    if method == "constant":
        return fill_constant(df, column, value, compat)
    ways = {"ffill": fill_forward, "bfill": fill_backward, "interpolate": interpolate}
    if method not in ways:
        raise InvalidOption(f"{method!r} is none of constant, {', '.join(ways)}")
    return ways[method](df, column, order_by, partition_by)

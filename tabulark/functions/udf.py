"""User functions in Arrow batches. A Column expression is always faster; these are for what it can't say."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..errors import InvalidOption, check_columns

TYPES = ("double", "bigint", "boolean", "string")


def _typed(values, result_type: str):
    s = pd.Series(values, dtype=object)
    gone = s.isna()
    if result_type == "boolean":
        return s.map(lambda x: None if x is None or x != x else bool(x))
    if result_type == "bigint":
        return s.map(lambda x: None if x is None or x != x else int(x)).astype("Int64")
    return s.where(~gone, None).astype("float64") if result_type == "double" else s.where(~gone, None)


def map_column(df: DataFrame, column: str, fn: Callable, result_type: str = "double", to: str = "map_result") -> DataFrame:
    """fn on each value that isn't missing; missing stays missing."""
    check_columns(df, column)
    if result_type not in TYPES:
        raise InvalidOption(f"{result_type!r} is none of {', '.join(TYPES)}")

    @F.pandas_udf(result_type)
    def run(s: pd.Series) -> pd.Series:
        return _typed([None if x is None or x != x else fn(x) for x in s], result_type)

    return df.withColumn(to, run(F.col(f"`{column}`")))


def apply_rows(df: DataFrame, fn: Callable, result_type: str = "double", to: str = "apply_result") -> DataFrame:
    """fn on each row as a dict. Numbers are cast to result_type: fractions are cut, non-zero is true."""
    if result_type not in TYPES:
        raise InvalidOption(f"{result_type!r} is none of {', '.join(TYPES)}")

    @F.pandas_udf(result_type)
    def run(rows: pd.DataFrame) -> pd.Series:
        return _typed([fn(r) for r in rows.to_dict("records")], result_type)

    return df.withColumn(to, run(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def apply_columns(df: DataFrame, fn: Callable) -> DataFrame:
    """fn(Column) -> aggregate Column, on every column, in one pass."""
    return df.agg(*[fn(F.col(f"`{c}`")).alias(c) for c in df.columns])


def filter_rows(df: DataFrame, fn: Callable) -> DataFrame:
    """Rows (as dicts) for which fn is true."""
    return apply_rows(df, fn, "boolean", "__keep").where("__keep").drop("__keep")


def group_apply(df: DataFrame, key: str, column: str, fn: Callable, to: str) -> DataFrame:
    """fn(pandas Series) -> number, for each group."""
    check_columns(df, key, column)

    @F.pandas_udf(DoubleType())
    def run(s: pd.Series) -> float:
        return float(fn(s))

    return df.groupBy(key).agg(run(F.col(f"`{column}`")).alias(to))




"""Pivot, melt, stack, unstack, transpose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidOption, check_columns
from .aggregate import AGG_NAMES, AGGS, is_number
from .ordered import with_position
from .select import col

MOST_COLUMNS = 10_000


def pivot(df: DataFrame, index: str, columns: str, values: str, agg: str = "sum", names: list | None = None) -> DataFrame:
    """Cells are doubles. Without `names` the distinct values of `columns` are read first (at most
    MOST_COLUMNS: a table can't be wider), in sorted order."""
    check_columns(df, index, columns, values)
    if agg not in AGG_NAMES:
        raise InvalidOption(f"{agg!r} is none of {', '.join(AGG_NAMES)}")
    if names is None:
        rows = df.select(col(columns)).distinct().orderBy(col(columns)).limit(MOST_COLUMNS + 1).collect()
        if len(rows) > MOST_COLUMNS:
            raise InvalidOption(f"more than {MOST_COLUMNS} columns")
        names = [r[0] for r in rows if r[0] is not None]
    v = col(values).cast("double")
    v = F.nanvl(v, F.lit(None).cast("double"))
    made = F.count(v) if agg == "count" else AGGS[agg](v)
    return df.groupBy(col(index)).pivot(columns, names).agg(made.cast("double"))


def unstack(df: DataFrame, index: str, columns: str, values: str, names: list | None = None) -> DataFrame:
    return pivot(df, index, columns, values, "sum", names)


def melt(df: DataFrame, ids: list[str], values: list[str] | None = None, variable: str = "variable", value: str = "value") -> DataFrame:
    """Values as doubles, or as text if any of them holds no numbers; ids of any type."""
    check_columns(df, *ids, *(values or []))
    values = list(values or [c for c in df.columns if c not in ids])
    if not values:
        raise InvalidOption("melt needs a value column")
    kinds = dict(df.dtypes)
    kind = "double" if all(is_number(kinds[c]) or kinds[c] == "boolean" for c in values) else "string"
    cast = lambda c: col(c).cast("int").cast("double") if kind == "double" and kinds[c] == "boolean" else col(c).cast(kind)
    return df.select(*[col(c) for c in ids], *[cast(c).alias(c) for c in values]).unpivot([col(c) for c in ids], [col(c) for c in values], variable, value)


def stack(df: DataFrame, id_column: str, variable: str = "variable", value: str = "value") -> DataFrame:
    return melt(df, [id_column], None, variable, value)


def transpose(df: DataFrame, order_by, columns: list[str] | None = None, names: bool = True) -> DataFrame:
    """One row for each (numeric) column, columns row_0..row_{n-1}; at most MOST_COLUMNS rows. names: keep
    the old column names in `column`."""
    columns = list(columns or [c for c, k in df.dtypes if is_number(k) or k == "boolean"])
    placed = with_position(df, order_by, "__row")
    n = placed.agg(F.max("__row")).first()[0] or 0
    if n > MOST_COLUMNS:
        raise InvalidOption(f"{n} rows can't become columns")
    long = melt(placed.select("__row", *[col(c) for c in columns]), ["__row"], columns, "column", "__value")
    out = long.groupBy("column").pivot("__row", list(range(1, n + 1))).agg(F.first("__value"))
    out = out.select("column", *[col(str(i)).alias(f"row_{i - 1}") for i in range(1, n + 1)])
    place = F.array_position(F.lit(columns), F.col("column"))
    out = out.orderBy(place)
    return out if names else out.drop("column")

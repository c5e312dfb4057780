"""Projection, filters, sorting and row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FrameError, InvalidOption, OrderRequired, check_batch, check_columns

COMPARE = {"==": "eqNull", "!=": "ne", ">": "gt", "<": "lt", ">=": "ge", "<=": "le"}


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def orders(df: DataFrame, order_by, op: str, tie_break=()) -> list[Column]:
    """Sort columns from names, "-name" for descending, or Columns."""
    if not order_by:
        raise OrderRequired(op)
    listed = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    out = []
    for o in [*listed, *tie_break]:
        if isinstance(o, str):
            name = o[1:] if o.startswith("-") and o not in df.columns else o
            check_columns(df, name)
            out.append(col(name).desc_nulls_first() if name != o else col(name).asc_nulls_last())
        else:
            out.append(o)
    return out


def select(df: DataFrame, *columns: str) -> DataFrame:
    if not columns:
        raise InvalidOption("select needs a column")
    check_columns(df, *columns)
    return df.select(*[col(c) for c in columns])


def drop(df: DataFrame, *columns: str) -> DataFrame:
    """Unknown names are ignored; dropping every column is an error."""
    if set(df.columns) <= set(columns):
        raise InvalidOption("drop would leave no column")
    return df.drop(*columns)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    check_columns(df, name)
    return df.withColumn(name, value)


def where(df: DataFrame, condition, op: str | None = None, value=None) -> DataFrame:
    """where(df, Column) or where(df, "col", ">", 5). A missing number satisfies no comparison."""
    if op is None:
        return df.where(condition)
    if op not in COMPARE:
        raise InvalidOption(f"{op!r} is none of {', '.join(COMPARE)}")
    check_columns(df, condition)
    c, v = col(condition), F.lit(value)
    test = {"==": c == v, "!=": c != v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[op]
    if dict(df.dtypes)[condition] in ("double", "float"):
        test = test & ~F.isnan(c)
    return df.where(test)


def sort(df: DataFrame, *keys, tie_break=()) -> DataFrame:
    """Missing values last when ascending, first when descending; give tie_break for a total order."""
    return df.orderBy(*orders(df, list(keys), "sort", tie_break))


def head(df: DataFrame, n: int, order_by) -> DataFrame:
    return df.orderBy(*orders(df, order_by, "head")).limit(max(0, n))


def _reverse(df: DataFrame, order_by):
    out = []
    for o in [order_by] if isinstance(order_by, str) else order_by:
        if not isinstance(o, str):
            raise InvalidOption("tail takes column names")
        down = o.startswith("-") and o not in df.columns
        name = o[1:] if down else o
        check_columns(df, name)
        out.append(col(name).asc_nulls_last() if down else col(name).desc_nulls_first())
    return out


def tail(df: DataFrame, n: int, order_by) -> DataFrame:
    """The last n rows, in order: a top-n of the reverse order, never a collect."""
    orders(df, order_by, "tail")
    return df.orderBy(*_reverse(df, order_by)).limit(max(0, n)).orderBy(*orders(df, order_by, "tail"))


def slice_rows(df: DataFrame, start: int, end: int, order_by) -> DataFrame:
    return df.orderBy(*orders(df, order_by, "slice")).offset(start).limit(max(0, end - start))


def row(df: DataFrame, i: int, order_by) -> DataFrame:
    return slice_rows(df, i, i + 1, order_by)


def top_k(df: DataFrame, k: int, *keys, tie_break=()) -> DataFrame:
    return sort(df, *keys, tie_break=tie_break).limit(k)


def sample(df: DataFrame, n: int, key, seed: int = 0, replace: bool = False) -> DataFrame:
    """n rows by the MD5 of the seed and `key` (columns that make rows unique): the same rows on any
    partitioning. With replacement, n uniform draws over positions of that order."""
    check_batch(df, "sample")
    keys = [key] if isinstance(key, str) else list(key)
    check_columns(df, *keys)
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]).cast("binary"))
    if not replace:
        return df.orderBy(h, *[col(k) for k in keys]).limit(n)
    from .ordered import with_position

    total = df.count()
    placed = with_position(df.withColumn("__h", h), ["__h", *keys], "__at").drop("__h")
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|draw|"), F.col("id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    draws = df.sparkSession.range(n if total else 0).select((drawn % F.lit(max(1, total))).alias("__draw"))
    return placed.join(draws, F.col("__at") - 1 == F.col("__draw")).drop("__at", "__draw")


def unique(df: DataFrame, column: str) -> DataFrame:
    """Distinct values as text."""
    check_columns(df, column)
    return df.select(col(column).cast("string").alias("value")).distinct()


def drop_duplicates(df: DataFrame, subset=None, order_by=None) -> DataFrame:
    """The first row of each key in the given order; all columns: one of equal rows."""
    check_batch(df, "drop_duplicates with an order")
    if not subset or set(subset) == set(df.columns):
        return df.distinct()
    check_columns(df, *subset)
    w = Window.partitionBy(*[col(c) for c in subset]).orderBy(*orders(df, order_by, "drop_duplicates"))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def column_index(df: DataFrame, name: str) -> int:
    check_columns(df, name)
    return df.columns.index(name)


def column_at(df: DataFrame, i: int) -> str:
    if not 0 <= i < len(df.columns):
        raise FrameError(f"column {i} of {len(df.columns)}")
    return df.columns[i]


def info(df: DataFrame) -> DataFrame:
    """(column, type, present, missing) in one pass."""
    kinds = dict(df.dtypes)
    gone = {c: col(c).isNull() | F.isnan(col(c)) if kinds[c] in ("double", "float") else col(c).isNull() for c in df.columns}
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(g).alias(f"__m{i}") for i, g in enumerate(gone.values())])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), (F.col("__n") - F.col(f"__m{i}")).alias("present"), F.col(f"__m{i}").alias("missing")) for i, c in enumerate(df.columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")

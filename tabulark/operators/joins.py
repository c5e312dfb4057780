"""Two families: join (same key names, all columns of both sides, clashes get _right) and merge (keys may
differ, the right keys go, clashes get the right suffix). Keys compare as typed values; missing keys join
nothing. Spark picks the strategy: no side is broadcast by hand, its size decides at run time (`salted_join` is
always shuffled)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidOption, check_columns
from .select import col

MOST_CROSSED = 10_000_000
HOW = {"inner": "inner", "left": "left", "right": "left", "outer": "full", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def _zero(kind: str):
    if kind == "string":
        return F.lit("")
    if kind == "boolean":
        return F.lit(False)
    return F.lit(0).cast(kind) if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else None


def _filled(df: DataFrame, names) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.coalesce(col(c), _zero(kinds[c])).alias(c) if c in names and _zero(kinds[c]) is not None else col(c) for c in df.columns])


def _suffixed(right: DataFrame, taken, suffix: str) -> DataFrame:
    taken, out = set(taken), []
    for c in right.columns:
        name = c
        while name in taken:
            name += suffix
        taken.add(name)
        out.append(name)
    return right.toDF(*out)


def _equal(left, right, pairs):
    return reduce(lambda a, b: a & b, [left[f"`{l}`"] == right[f"`{r}`"] for l, r in pairs])


def join(left: DataFrame, right: DataFrame, on, how: str = "inner", fill: bool = False) -> DataFrame:
    """how: inner, left, right, outer, cross, semi or anti. "right" swaps the sides: the right's columns come
    first. fill: cells without a match get their type's zero."""
    if how == "cross":
        return cross_join(left, right)
    keys = [on] if isinstance(on, str) else list(on)
    if how not in HOW or not keys:
        raise InvalidOption(f"how is one of {', '.join(HOW)}, cross, and on names a key")
    if how == "right":
        left, right = right, left
    check_columns(left, *keys)
    check_columns(right, *keys)
    if how in ("semi", "anti"):
        return left.join(right.select(*keys), keys, HOW[how])
    renamed = _suffixed(right, left.columns, "_right")
    names = dict(zip(right.columns, renamed.columns))
    out = left.join(renamed, _equal(left, renamed, [(k, names[k]) for k in keys]), HOW[how])
    if fill and how != "inner":
        out = _filled(out, set(renamed.columns) | (set(left.columns) if how in ("outer", "full") else set()))
    return out


def inner_join(left: DataFrame, right: DataFrame, on, fill: bool = False) -> DataFrame:
    return join(left, right, on, "inner", fill)


def left_join(left: DataFrame, right: DataFrame, on, fill: bool = False) -> DataFrame:
    return join(left, right, on, "left", fill)


def right_join(left: DataFrame, right: DataFrame, on, fill: bool = False) -> DataFrame:
    return join(left, right, on, "right", fill)


def outer_join(left: DataFrame, right: DataFrame, on, fill: bool = False) -> DataFrame:
    return join(left, right, on, "outer", fill)


def cross_join(left: DataFrame, right: DataFrame, most: int | None = MOST_CROSSED) -> DataFrame:
    """Every pair of rows. More than `most` of them are refused; None: no bound."""
    if most is not None and not (left.isStreaming or right.isStreaming):
        rows = left.count() * right.count()
        if rows > most:
            raise InvalidOption(f"the cross join has {rows} rows, more than {most}")
    return left.crossJoin(_suffixed(right, left.columns, "_right"))


def merge(left: DataFrame, right: DataFrame, how: str = "inner", left_on=None, right_on=None, suffix: str = "_y", fill: bool = False) -> DataFrame:
    """outer keeps the key of rows that only the right has."""
    if how == "cross":
        return cross_join(left, right)
    lk = [left_on] if isinstance(left_on, str) else list(left_on or [])
    rk = [right_on] if isinstance(right_on, str) else list(right_on or lk)
    if how not in ("inner", "left", "right", "outer") or not lk or len(lk) != len(rk):
        raise InvalidOption("how is inner, left, right, outer or cross, with as many left as right keys")
    if how == "right":
        left, right, lk, rk = right, left, rk, lk
    check_columns(left, *lk)
    check_columns(right, *rk)
    keys = [f"__key{i}" for i in range(len(rk))]
    rest = _suffixed(right.drop(*rk), left.columns, suffix)
    renamed = right.select(*[col(r).alias(k) for r, k in zip(rk, keys)], *[col(c).alias(n) for c, n in zip(right.drop(*rk).columns, rest.columns)])
    out = left.join(renamed, _equal(left, renamed, list(zip(lk, keys))), HOW[how])
    if how == "outer":
        out = out.withColumns({l: F.coalesce(col(l), F.col(k)) for l, k in zip(lk, keys)})
    out = out.drop(*keys)
    if fill and how != "inner":
        out = _filled(out, set(rest.columns) | (set(left.columns) if how == "outer" else set()))
    return out


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int = 16) -> DataFrame:
    """Inner join for a left side with a few very frequent keys: each key's rows go to `salts` tasks, and
    the right side is copied as often. For plans where adaptive skew handling can't act. Both sides are shuffled: Spark
    takes the copies for no larger than the right side itself, so it would broadcast what the driver can't hold."""
    check_columns(left, on)
    check_columns(right, on)
    spread = left.withColumn("__salt", F.pmod(F.xxhash64(*[col(c) for c in left.columns]), F.lit(salts)).cast("int"))
    copies = _suffixed(right, left.columns, "_right").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies.hint("merge"), (spread[on] == copies[f"{on}_right"]) & (spread["__salt"] == copies["__salt"])).drop("__salt")

"""Concatenation, append, keyed update and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidOption, SchemaMismatch, check_columns
from .aggregate import is_number
from .joins import _filled
from .ordered import with_position
from .select import col, orders


def _promoted(kinds: set[str]) -> str:
    if len(kinds) == 1:
        return next(iter(kinds))
    if "string" in kinds or not all(is_number(k) or k == "boolean" for k in kinds):
        return "string"
    return "double" if kinds & {"double", "float"} or any(k.startswith("decimal") for k in kinds) else "bigint"


def concat(frames: list[DataFrame], fill: bool = False) -> DataFrame:
    """All rows of all frames; columns by name, in alphabetical order, of the widest type; absent cells
    are missing, or their type's zero with fill."""
    if not frames:
        raise InvalidOption("concat needs a frame")
    kinds: dict[str, set] = {}
    for f in frames:
        for c, k in f.dtypes:
            kinds.setdefault(c, set()).add(k)
    cast = [f.select(*[col(c).cast(_promoted(kinds[c])).alias(c) for c in f.columns]) for f in frames]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast).select(*[col(c) for c in sorted(kinds)])
    return _filled(out, set(kinds)) if fill else out


def concat_columns(left: DataFrame, right: DataFrame, left_order, right_order) -> DataFrame:
    """Rows side by side by position; unequal lengths are an error, clashing names get _right."""
    n, m = left.count(), right.count()
    if n != m:
        raise SchemaMismatch(f"{n} rows beside {m}")
    a, b = with_position(left, left_order, "__at"), with_position(right, right_order, "__at")
    renamed = b.select("__at", *[col(c).alias(c + "_right" if c in left.columns else c) for c in right.columns])
    return a.join(renamed, "__at").drop("__at")


def append(base: DataFrame, other: DataFrame, verify_schema: bool = True) -> DataFrame:
    if verify_schema and base.dtypes != other.dtypes:
        raise SchemaMismatch(f"{base.dtypes} and {other.dtypes}")
    return concat([base, other])


def update(base: DataFrame, other: DataFrame, on, order_by=None, overwrite: bool = True) -> DataFrame:
    """Rows of base; where a key matches, shared columns take the value of other's first matching row
    (overwrite=False: only where base has none). Repeated keys of other need order_by."""
    keys = [on] if isinstance(on, str) else list(on)
    check_columns(base, *keys)
    check_columns(other, *keys)
    shared = [c for c in base.columns if c in other.columns and c not in keys]
    by = orders(other, order_by, "update") if order_by else [col(k) for k in keys]
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*by)
    first = other.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[col(c).alias(f"__v{i}") for i, c in enumerate(shared)], F.lit(True).alias("__hit"))
    out = base.join(first, reduce(lambda a, b: a & b, [base[f"`{k}`"] == first[f"__k{i}"] for i, k in enumerate(keys)]), "left")
    new = {c: F.when(F.col("__hit"), F.col(f"__v{i}")).otherwise(col(c)) if overwrite else F.coalesce(col(c), F.col(f"__v{i}")) for i, c in enumerate(shared)}
    return out.select(*[new[c].cast(dict(base.dtypes)[c]).alias(c) if c in new else col(c) for c in base.columns])


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)

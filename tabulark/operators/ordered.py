"""Operators over one global row order, without a single-partition window.

Rows get their global position from a range partitioning: positions inside each range, plus the sizes
of the ranges before it. Positions are cut into blocks of BLOCK rows. A trailing window or a lag needs
the last rows of the block before only, which are copied into the next block (halo); running totals and
carried values need one small row per block. With partition_by each group is ordered on its own and a
plain window serves, as groups are the unit of work then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidOption, check_batch, check_columns
from ..storage import materialize
from .select import col, orders

BLOCK = 250_000
ROLLING = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop, "count": F.count}
RANKS = ("average", "min", "max", "dense", "first")


def with_position(df: DataFrame, order_by, name: str = "pos") -> DataFrame:
    """df with the 1-based global position of every row, from one range shuffle."""
    check_batch(df, "a global order")
    sort = orders(df, order_by, "position")
    # written first: the ranges come from a sample, so their numbers hold for one run of the plan only
    placed = materialize(df.repartitionByRange(*sort).withColumn("__range", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*sort))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    # one row per range: as many as shuffle partitions, whatever the rows
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return placed.withColumn(name, inside.cast("long")).join(F.broadcast(before), "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def _parts(partition_by):
    return [partition_by] if isinstance(partition_by, str) else list(partition_by or [])


def _halo(df: DataFrame, order_by, reach: int, make, name: str, forward: bool = False, block: int = BLOCK) -> DataFrame:
    """make(window) over global position, for frames that reach back (or forward) at most `reach` rows."""
    size = max(block, reach, 1)
    placed = with_position(df, order_by, "__pos")
    own = F.floor((F.col("__pos") - 1) / size)
    other = own + (-1 if forward else 1)
    edge = (F.col("__pos") - 1) % size < reach if forward else (F.col("__pos") - 1) % size >= size - reach
    copies = F.when(edge & F.lit(reach > 0), F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.struct(other.alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(own.alias("b"), F.lit(True).alias("own"))))
    spread = placed.withColumn("__c", F.explode(copies)).select("*", F.col("__c.b").alias("__b"), F.col("__c.own").alias("__own")).drop("__c")
    w = Window.partitionBy("__b").orderBy("__pos")
    return spread.withColumn(name, make(w)).where("__own").drop("__b", "__own", "__pos")


def _named(df, column, name, default):
    check_columns(df, column)
    return name or f"{column}_{default}"


def rolling(df: DataFrame, column: str, n: int, agg: str, order_by, partition_by=None, name=None) -> DataFrame:
    """Trailing window of n rows, partial at the start."""
    if n < 1:
        raise InvalidOption("the window needs a row")
    if agg not in ROLLING:
        raise InvalidOption(f"{agg!r} is none of {', '.join(ROLLING)}")
    name = _named(df, column, name, f"rolling_{agg}")
    value = lambda w: ROLLING[agg](col(column).cast("double")).over(w.rowsBetween(-(n - 1), 0)).cast("double")
    if partition_by:
        check_batch(df, "rolling")
        return df.withColumn(name, value(Window.partitionBy(*_parts(partition_by)).orderBy(*orders(df, order_by, "rolling"))))
    return _halo(df, order_by, n - 1, value, name)


def expanding(df: DataFrame, column: str, agg: str, order_by, partition_by=None, name=None, block: int = BLOCK) -> DataFrame:
    """Running sum, mean, min, max or count."""
    if agg not in ("sum", "mean", "min", "max", "count"):
        raise InvalidOption(f"expanding has no {agg!r}")
    name = _named(df, column, name, f"expanding_{agg}")
    c = col(column).cast("double")
    if partition_by:
        w = Window.partitionBy(*_parts(partition_by)).orderBy(*orders(df, order_by, "expanding")).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, ROLLING[agg](c).over(w).cast("double"))
    placed = with_position(df, order_by, "__pos").withColumn("__b", F.floor((F.col("__pos") - 1) / block)).withColumn("__v", c)
    w = Window.partitionBy("__b").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    fold = {"min": F.min, "max": F.max}.get(agg, F.sum)
    sums = placed.groupBy("__b").agg(fold("__v").alias("s"), F.count("__v").alias("k")).select("__b", fold("s").over(back).alias("__s"), F.sum("k").over(back).alias("__k"))
    both = placed.withColumn("__own", fold("__v").over(w)).withColumn("__n", F.count("__v").over(w)).join(sums, "__b")
    n = F.col("__n") + F.coalesce(F.col("__k"), F.lit(0))
    if agg in ("min", "max"):
        value = (F.least if agg == "min" else F.greatest)("__own", "__s")
    else:
        total = F.when(n > 0, F.coalesce(F.col("__own"), F.lit(0.0)) + F.coalesce(F.col("__s"), F.lit(0.0)))
        value = {"sum": total, "count": n.cast("double"), "mean": F.try_divide(total, n)}[agg]
    return both.withColumn(name, value).drop("__pos", "__b", "__v", "__own", "__n", "__s", "__k")


def _lagged(df, column, k, order_by, partition_by, name, formula):
    c = col(column).cast("double")
    value = lambda w: formula(c, F.lag(c, k).over(w) if k >= 0 else F.lead(c, -k).over(w))
    if partition_by:
        check_batch(df, "shift")
        return df.withColumn(name, value(Window.partitionBy(*_parts(partition_by)).orderBy(*orders(df, order_by, "shift"))))
    return _halo(df, order_by, abs(k), value, name, forward=k < 0)


def shift(df: DataFrame, column: str, k: int, order_by, partition_by=None, name=None) -> DataFrame:
    return _lagged(df, column, k, order_by, partition_by, _named(df, column, name, "shift"), lambda c, p: p)


def diff(df: DataFrame, column: str, k: int, order_by, partition_by=None, name=None) -> DataFrame:
    return _lagged(df, column, k, order_by, partition_by, _named(df, column, name, "diff"), lambda c, p: c - p)


def pct_change(df: DataFrame, column: str, k: int, order_by, partition_by=None, name=None) -> DataFrame:
    """(x - p) / p; missing where p is 0."""
    return _lagged(df, column, k, order_by, partition_by, _named(df, column, name, "pct_change"), lambda c, p: F.try_divide(c - p, p))


def _value_ranks(df: DataFrame, column: str) -> DataFrame:
    """For each distinct value: rows below, rows equal, distinct values below and all rows."""
    counts = df.groupBy(col(column).alias("__value")).agg(F.count("*").alias("__peers"))
    lined = expanding(counts.withColumn("__one", F.lit(1.0)), "__peers", "sum", "__value", name="__upto")
    lined = expanding(lined, "__one", "sum", "__value", name="__dense").drop("__one")
    return lined.select("__value", (F.col("__upto") - F.col("__peers")).alias("__below"), "__peers", "__dense")


def rank(df: DataFrame, column: str, method: str = "average", partition_by=None, order_by=None, name=None) -> DataFrame:
    """1-based rank, ascending, missing last. Without partition_by the ranks come from the counts of the
    distinct values, so no window sees all rows. "first" breaks ties by order_by."""
    check_batch(df, "rank")
    if method not in RANKS:
        raise InvalidOption(f"{method!r} is none of {', '.join(RANKS)}")
    name = _named(df, column, name, "rank")
    if method == "first":
        ties = orders(df, order_by, "rank by first")
        if partition_by:
            return df.withColumn(name, F.row_number().over(Window.partitionBy(*_parts(partition_by)).orderBy(col(column).asc_nulls_last(), *ties)).cast("double"))
        return with_position(df, [col(column).asc_nulls_last(), *ties], name).withColumn(name, F.col(name).cast("double"))
    if partition_by:
        w = Window.partitionBy(*_parts(partition_by)).orderBy(col(column).asc_nulls_last())
        peers = F.count("*").over(Window.partitionBy(*_parts(partition_by), col(column)))
        low, dense = F.rank().over(w), F.dense_rank().over(w)
        ranked = df
    else:
        ranked = df.join(_value_ranks(df, column), F.col("__value").eqNullSafe(col(column)))
        low, peers, dense = F.col("__below") + 1, F.col("__peers"), F.col("__dense")
    value = {"min": low, "max": low + peers - 1, "average": low + (peers - 1) / 2, "dense": dense}[method]
    return ranked.withColumn(name, value.cast("double")).drop("__value", "__below", "__peers", "__dense")


def percentile_rank(df: DataFrame, column: str, method: str = "average", partition_by=None, order_by=None, name=None) -> DataFrame:
    """(rank - 1) / (n - 1); one row: 0.5."""
    name = _named(df, column, name, "percentile_rank")
    ranked = rank(df, column, method, partition_by, order_by, "__rank")
    if partition_by:
        n = F.count("*").over(Window.partitionBy(*_parts(partition_by)))
        return ranked.withColumn("__n", n).withColumn(name, F.coalesce(F.try_divide(F.col("__rank") - 1, F.col("__n") - 1), F.lit(0.5))).drop("__rank", "__n")
    total = F.broadcast(df.agg(F.count("*").alias("__n")))  # one row
    return ranked.crossJoin(total).withColumn(name, F.coalesce(F.try_divide(F.col("__rank") - 1, F.col("__n") - 1), F.lit(0.5))).drop("__rank", "__n")


def neighbours(df: DataFrame, column: str, order_by, partition_by=None, block: int = BLOCK) -> DataFrame:
    """df with __i (position), and the last (__pv, __pi) and next (__nv, __ni) present value and its position.
    The next value is the last one in descending order: a frame that ends at the end of its partition would be
    evaluated anew for every row."""
    check_columns(df, column)
    kind = dict(df.dtypes)[column]
    v = F.nanvl(col(column), F.lit(None).cast(kind)) if kind in ("double", "float") else col(column)
    here = lambda pos: F.when(v.isNotNull(), F.struct(v.alias("v"), pos.alias("i")))
    if partition_by:
        w = Window.partitionBy(*_parts(partition_by)).orderBy(*orders(df, order_by, "fill"))
        placed = df.withColumn("__i", F.row_number().over(w).cast("long")).withColumn("__x", here(F.col("__i")))
        p, n = (F.last("__x", True).over(Window.partitionBy(*_parts(partition_by)).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)) for o in (F.asc("__i"), F.desc("__i")))
        out = placed.withColumn("__p", p).withColumn("__q", n)
    else:
        placed = with_position(df, order_by, "__i").withColumn("__x", here(F.col("__i"))).withColumn("__b", F.floor((F.col("__i") - 1) / block))
        sums = placed.groupBy("__b").agg(F.max_by("__x", F.when(F.col("__x").isNotNull(), F.col("__i"))).alias("l"), F.min_by("__x", F.when(F.col("__x").isNotNull(), F.col("__i"))).alias("f"))
        lined = Window.orderBy("__b")  # one row per block
        sums = sums.select("__b", F.last("l", True).over(lined.rowsBetween(Window.unboundedPreceding, -1)).alias("__lp"), F.last("f", True).over(Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)).alias("__fn"))
        p, n = (F.last("__x", True).over(Window.partitionBy("__b").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)) for o in (F.asc("__i"), F.desc("__i")))
        out = placed.withColumn("__p", p).withColumn("__q", n).join(sums, "__b").withColumn("__p", F.coalesce("__p", "__lp")).withColumn("__q", F.coalesce("__q", "__fn")).drop("__b", "__lp", "__fn")
    return out.select(*[col(c) for c in df.columns], "__i", F.col("__p.v").alias("__pv"), F.col("__p.i").alias("__pi"), F.col("__q.v").alias("__nv"), F.col("__q.i").alias("__ni"))


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop("__i", "__pv", "__pi", "__nv", "__ni")


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)

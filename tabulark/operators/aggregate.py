"""Group-by, statistics, value counts, correlation, describe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidOption, check_columns
from .select import col

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
AGGS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
AGG_NAMES = ("sum", "mean", "count", "min", "max")
MOST_VALUES = 500_000  # distinct values up to which one aggregate buffer counts them for an exact quantile


def is_number(kind: str) -> bool:
    return kind in NUMBERS or kind.startswith("decimal")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if is_number(k)]


def _number(df, *names):
    check_columns(df, *names)
    for n in names:
        if not is_number(dict(df.dtypes)[n]):
            raise InvalidOption(f"{n!r} holds no numbers")


def _agg(df, column, fn):
    if fn not in AGG_NAMES:
        raise InvalidOption(f"{fn!r} is none of {', '.join(AGG_NAMES)}")
    check_columns(df, column)
    value = F.count("*") if fn == "count" else AGGS[fn](col(column).cast("double"))
    return value.cast("double").alias(f"{column}_{fn.capitalize()}")


def group_by(df: DataFrame, keys, specs: list[tuple[str, str]], having=None) -> DataFrame:
    """specs: (column, function); results are doubles named column_Function. having: a Column over the result."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    check_columns(df, *keys)
    out = df.groupBy(*[col(k) for k in keys]).agg(*[_agg(df, c, f) for c, f in specs])
    return out.where(having) if having is not None else out


def rollup(df: DataFrame, keys: list[str], specs) -> DataFrame:
    return df.rollup(*keys).agg(*[_agg(df, c, f) for c, f in specs])


def cube(df: DataFrame, keys: list[str], specs) -> DataFrame:
    return df.cube(*keys).agg(*[_agg(df, c, f) for c, f in specs])


def statistic(df: DataFrame, column: str, fn: str, q: float | None = None):
    """A Column with one number. variance and std are those of a sample, 0.0 for one row; an empty column
    gives NULL; quantile is exact, with linear interpolation."""
    if fn in ("count", "nunique"):
        check_columns(df, column)
        return (F.count(col(column)) if fn == "count" else F.count_distinct(col(column))).cast("double")
    _number(df, column)
    c = col(column).cast("double")
    if fn in AGGS:
        return AGGS[fn](c)
    if fn in ("variance", "std"):
        return F.when(F.count(c) == 1, 0.0).otherwise((F.var_samp if fn == "variance" else F.stddev_samp)(c))
    if fn == "median":
        return F.percentile(c, 0.5)
    if fn == "quantile":
        if q is None or not 0 <= q <= 1:
            raise InvalidOption("quantile needs q from 0 to 1")
        return F.percentile(c, q)
    if fn == "approx_quantile":
        return F.percentile_approx(c, q, 10_000)
    if fn == "approx_nunique":
        return F.approx_count_distinct(c).cast("double")
    raise InvalidOption(f"no statistic {fn!r}")


def exact_quantiles(df: DataFrame, column: str, qs: list[float], most: int | None = None) -> list:
    """A Column for each quantile, with linear interpolation. Up to `most` distinct values one aggregate counts them.
    Beyond, a mergeable sketch brackets the two ranks each quantile lies between, a second pass counts the
    values below and inside, and the ranks are read from the bracket alone: counted there if its values are few, else
    by their global positions."""
    most = MOST_VALUES if most is None else most
    values = df.select(col(column).cast("double").alias("v")).where("v is not null")
    size = values.agg(F.count("*").alias("n"), F.approx_count_distinct("v").alias("d")).first()
    if size["d"] <= most:
        return [F.percentile(col(column).cast("double"), q) for q in qs]
    n, wide = size["n"], 4e-4
    asked = [x for q in qs for x in (max(0.0, q - wide), min(1.0, q + wide))]
    ends = values.agg(F.percentile_approx("v", asked, 10_000).alias("e"), F.min("v").alias("a"), F.max("v").alias("z")).first()
    pairs = [(ends["a"] if lo <= 0 else ends["e"][2 * i], ends["z"] if hi >= 1 else ends["e"][2 * i + 1]) for i, (lo, hi) in enumerate(zip(asked[::2], asked[1::2]))]
    inside = [F.col("v").between(F.lit(a), F.lit(z)) for a, z in pairs]
    many = values.agg(*[x for i, (a, _) in enumerate(pairs) for x in (F.count_if(F.col("v") < F.lit(a)).alias(f"below{i}"), F.count_if(inside[i]).alias(f"in{i}"), F.approx_count_distinct(F.when(inside[i], F.col("v"))).alias(f"d{i}"))]).first()
    out = []
    for i, (q, (a, z)) in enumerate(zip(qs, pairs)):
        rank = q * (n - 1)
        low, high = int(rank) - many[f"below{i}"], min(int(rank) + 1, n - 1) - many[f"below{i}"]
        part, held = values.where(inside[i]), many[f"in{i}"]
        if low < 0 or high >= held:  # the sketch missed: no bracket
            part, held, low, high, a, z = values, n, int(rank), min(int(rank) + 1, n - 1), None, 0.0
        if a == z:
            out.append(F.lit(a))
            continue
        if a is not None and many[f"d{i}"] <= most:
            at = low + rank - int(rank)
            out.append(F.lit(part.agg(F.percentile("v", at / (held - 1))).first()[0]))
        else:
            from .ordered import with_position

            two = {r["p"]: r["v"] for r in with_position(part, "v", "p").where(F.col("p").isin(low + 1, high + 1)).collect()}
            out.append(F.lit(two[low + 1] + (two[high + 1] - two[low + 1]) * (rank - int(rank))))
    return out


def statistics(df: DataFrame, column: str, *names: str) -> DataFrame:
    """One row with a column for each statistic; "quantile:0.9" asks for a quantile."""
    made = []
    exact = {n: 0.5 if n == "median" else float(n[9:]) for n in names if n == "median" or n.startswith("quantile:")}
    if exact:
        _number(df, column)
        if any(not 0 <= q <= 1 for q in exact.values()):
            raise InvalidOption("quantile needs q from 0 to 1")
        exact = dict(zip(exact, exact_quantiles(df, column, list(exact.values()))))
    for n in names:
        fn, _, q = n.partition(":")
        if n in exact:
            made.append(exact[n].alias(n.replace(":", "_").replace(".", "_")))
            continue
        made.append(statistic(df, column, fn, float(q) if q else None).alias(n.replace(":", "_").replace(".", "_")))
    return df.agg(*made)


def corr_matrix(df: DataFrame, columns=None) -> DataFrame:
    """(col_a, col_b, corr) of every pair, from one pass; no variance gives 0.0, the diagonal is 1.0."""
    names = list(columns or numeric_columns(df))
    if not 1 <= len(names) <= 100:
        raise InvalidOption("1 to 100 numeric columns")
    _number(df, *names)
    d = {n: col(n).cast("double") for n in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    made = [F.coalesce(F.try_divide(F.covar_pop(d[a], d[b]), F.stddev_pop(F.when(d[b].isNotNull(), d[a])) * F.stddev_pop(F.when(d[a].isNotNull(), d[b]))), F.lit(0.0)).alias(f"__c{i}") for i, (a, b) in enumerate(pairs)]
    one = df.agg(F.count("*").alias("__n"), *made)
    at = {p: i for i, p in enumerate(pairs)}
    cell = lambda a, b: F.lit(1.0) if a == b else F.col(f"__c{at[(a, b) if (a, b) in at else (b, a)]}")
    rows = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), cell(a, b).alias("corr")) for a in names for b in names])
    return one.where("__n >= 2").select(F.explode(rows).alias("r")).select("r.*")


def value_counts(df: DataFrame, column: str, normalize: bool = False) -> DataFrame:
    """(value, count), most frequent first, ties by value."""
    check_columns(df, column)
    counts = df.groupBy(col(column).alias("value")).agg(F.count("*").cast("double").alias("count"))
    if normalize:
        total = F.broadcast(df.agg(F.count("*").alias("__n")))  # one row
        counts = counts.crossJoin(total).select("value", F.try_divide("count", "__n").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("value"))


def describe(df: DataFrame) -> DataFrame:
    """(column, count, mean, std, min, max): std of the population; other columns have a count only."""
    kinds = dict(df.dtypes)
    made = []
    for i, c in enumerate(df.columns):
        made.append(F.count(col(c)).cast("double").alias(f"__count{i}"))
        v = col(c).cast("double") if is_number(kinds[c]) else F.lit(None).cast("double")
        made += [f(v).alias(f"__{n}{i}") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"__{n}{i}").alias(n) for n in ("count", "mean", "std", "min", "max")]) for i, c in enumerate(df.columns)])
    return df.agg(*made).select(F.explode(rows).alias("r")).select("r.*")


def summary(df: DataFrame, columns=None) -> DataFrame:
    """(column, count, mean, std, min, max, median, q25, q75): std of a sample; numeric columns."""
    names = list(columns or numeric_columns(df))
    _number(df, *names)
    made = []
    for i, c in enumerate(names):
        v, quantiles = col(c).cast("double"), exact_quantiles(df, c, [0.25, 0.5, 0.75])
        made += [F.count(v).cast("double").alias(f"__count{i}"), F.avg(v).alias(f"__mean{i}"), statistic(df, c, "std").alias(f"__std{i}"), F.min(v).alias(f"__min{i}"), F.max(v).alias(f"__max{i}"), *[x.alias(f"__q{i}_{k}") for k, x in enumerate(quantiles)]]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"__{n}{i}").alias(n) for n in ("count", "mean", "std", "min", "max")], F.col(f"__q{i}_1").alias("median"), F.col(f"__q{i}_0").alias("q25"), F.col(f"__q{i}_2").alias("q75")) for i, c in enumerate(names)])
    return df.agg(*made).select(F.explode(rows).alias("r")).select("r.*")


def share_of_group(df: DataFrame, key: str, column: str, name: str = "share") -> DataFrame:
    """Each row's part of its group's sum. The sums are joined back, so a group may have any number of rows."""
    check_columns(df, key, column)
    total = df.groupBy(col(key).alias("__key")).agg(F.sum(col(column).cast("double")).alias("__total"))
    both = df.join(total, col(key).eqNullSafe(F.col("__key")), "left")
    return both.withColumn(name, F.try_divide(col(column).cast("double"), F.col("__total"))).drop("__key", "__total")

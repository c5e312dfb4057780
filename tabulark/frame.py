"""Frame: the fluent surface over a DataFrame. Each method hands the frame to the operator of that name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from .errors import check_columns
from .functions import strings, udf
from .operators import aggregate, combine, joins, missing, ordered, reshape, select
from .sources import writers

_METHODS = {
    **{n: getattr(select, n) for n in ("select", "drop", "rename", "with_column", "replace_column", "where", "sort", "head", "tail", "slice_rows", "row", "top_k", "sample", "unique", "drop_duplicates", "info")},
    **{n: getattr(aggregate, n) for n in ("group_by", "rollup", "cube", "statistics", "corr_matrix", "value_counts", "describe", "summary", "share_of_group")},
    **{n: getattr(ordered, n) for n in ("with_position", "rolling", "expanding", "shift", "diff", "pct_change", "rank", "percentile_rank")},
    **{n: getattr(missing, n) for n in ("isna", "notna", "dropna", "fillna")},
    **{n: getattr(joins, n) for n in ("join", "inner_join", "left_join", "right_join", "outer_join", "cross_join", "merge", "salted_join")},
    **{n: getattr(combine, n) for n in ("append", "update", "union_distinct", "intersect", "difference", "concat_columns")},
    **{n: getattr(reshape, n) for n in ("pivot", "unstack", "melt", "stack", "transpose")},
    **{n: getattr(udf, n) for n in ("map_column", "apply_rows", "apply_columns", "filter_rows", "group_apply")},
    "split_columns": strings.split_columns,
}


class Frame:
    def __init__(self, df: DataFrame):
        self.df = df

    def __getattr__(self, name):
        if name.startswith("_") or name not in _METHODS:
            raise AttributeError(name)
        run = _METHODS[name]

        def call(*args, **kw):
            args = [a.df if isinstance(a, Frame) else a for a in args]
            kw = {k: v.df if isinstance(v, Frame) else v for k, v in kw.items()}
            return Frame(run(self.df, *args, **kw))

        return call

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def shape(self) -> tuple[int, int]:
        return select.shape(self.df)

    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def has_column(self, name: str) -> bool:
        return name in self.df.columns

    def column_index(self, name: str) -> int:
        return select.column_index(self.df, name)

    def column_at(self, i: int) -> str:
        return select.column_at(self.df, i)

    def column(self, name: str):
        """The values of one column, on the driver."""
        check_columns(self.df, name)
        return self.df.select(f"`{name}`").toArrow().column(0)

    def clone(self) -> Frame:
        return Frame(self.df)

    lazy = clone

    def limit(self, n: int) -> Frame:
        return Frame(self.df.limit(n))

    def collect(self):
        return self.df.collect()

    def str(self, column: str) -> strings.Strings:
        check_columns(self.df, column)
        return strings.Strings(self, column)

    def stat(self, column: str, fn: str, q: float | None = None):
        """One statistic as a number."""
        value: Column = aggregate.statistic(self.df, column, fn, q)
        return self.df.agg(value).first()[0]

    def sum(self, c):
        return self.stat(c, "sum")

    def mean(self, c):
        return self.stat(c, "mean")

    def min(self, c):
        return self.stat(c, "min")

    def max(self, c):
        return self.stat(c, "max")

    def variance(self, c):
        return self.stat(c, "variance")

    def std(self, c):
        return self.stat(c, "std")

    def median(self, c):
        return self.quantile(c, 0.5)

    def quantile(self, c, q):
        return self.statistics(c, f"quantile:{q}").df.first()[0]

    def print(self, n: int = 20) -> None:
        self.df.show(n, truncate=False)

    def nunique(self, c):
        return int(self.stat(c, "nunique"))

    def to_csv(self, **kw) -> str:
        return writers.to_csv(self.df, **kw)

    def to_json(self, **kw) -> str:
        return writers.to_json(self.df, **kw)

    def to_arrow(self):
        return writers.to_arrow(self.df)

    def write_csv(self, path, **kw):
        writers.write_csv(self.df, path, **kw)

    def write_json(self, path):
        writers.write_json(self.df, path)

    def write_parquet(self, path, **kw):
        writers.write_parquet(self.df, path, **kw)


def concat(*frames: Frame, fill: bool = False) -> Frame:
    return Frame(combine.concat([f.df for f in frames], fill))

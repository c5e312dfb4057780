"""CSV, JSON, Parquet and Arrow out. Files are written by all tasks; only the to_... functions bring a
result to the driver, for results that fit there."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidOption


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", one_file: bool = False) -> None:
    """Blanks at a text's ends are kept. A missing cell has no character, an empty text is ""."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").option("header", header).option("sep", sep).option("quote", '"').option("escape", '"').option("emptyValue", '""').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("lineSep", "\n").csv(path)


def csv_lines(df: DataFrame, sep: str = ",") -> DataFrame:
    """One column `line`: quoted where the delimiter, a quote or a line end is inside."""

    def cell(c, kind):
        v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        if kind != "string":
            return v
        quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(v.rlike(f'[{"".join(chr(92) + x for x in sep)}"\r\n]'), quoted).otherwise(v)

    return df.select(F.concat_ws(sep, *[cell(c, k) for c, k in df.dtypes]).alias("line"))


def to_csv(df: DataFrame, order_by=None, header: bool = True, sep: str = ",") -> str:
    lines = [r[0] for r in csv_lines(df.orderBy(*order_by) if order_by else df, sep).collect()]
    return "".join(x + "\n" for x in ([sep.join(df.columns)] if header else []) + lines)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def to_json(df: DataFrame, layout: str = "lines", order_by=None) -> str:
    """One text in layout lines, array or columns."""
    df = df.orderBy(*order_by) if order_by else df
    lines = [r[0] for r in json_lines(df).collect()]
    if layout == "lines":
        return "".join(x + "\n" for x in lines)
    if layout == "array":
        return "[" + ",".join(lines) + "]"
    if layout == "columns":
        import json

        rows = [json.loads(x) for x in lines]
        return json.dumps({c: [r[c] for r in rows] for c in df.columns}, ensure_ascii=False)
    raise InvalidOption("layout is lines, array or columns")


def write_parquet(df: DataFrame, path: str, partition_by=()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)

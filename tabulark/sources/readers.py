"""CSV, JSON, Parquet and Arrow in; types are inferred in one distributed pass over text columns."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FrameError, InvalidOption, ParseFailure
from ..storage import put_text

BOOLS = ("true", "false", "yes", "no", "1", "0", "t", "f", "y", "n")
TRUE = ("true", "yes", "1", "t", "y")
TESTS = {"boolean": None, "bigint": r"^[+-]?[0-9]+$", "double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(nan|NaN|inf|Infinity)$"}
MODES = {"strict": "FAILFAST", "lenient": "PERMISSIVE", "collect": "PERMISSIVE"}


def _is(kind, c):
    if kind == "boolean":
        return F.lower(c).isin(*BOOLS)
    return c.rlike(TESTS[kind]) & c.try_cast("bigint").isNotNull() if kind == "bigint" else c.rlike(TESTS[kind])


def infer_types(df: DataFrame, infer_bool_from_01: bool = True) -> dict[str, str]:
    """Type of each text column from all its cells: boolean, bigint, double, else string. Empty: string."""
    made = []
    for i, c in enumerate(df.columns):
        v = F.col(f"`{c}`")
        full = v.isNotNull() & (v != "")
        made.append(F.count_if(full).alias(f"n{i}"))
        made += [F.count_if(full & ~_is(k, v)).alias(f"{k}{i}") for k in TESTS]
        made.append(F.count_if(full & ~v.isin("0", "1")).alias(f"bit{i}"))
    row = df.agg(*made).first()
    out = {}
    for i, c in enumerate(df.columns):
        kind = next((k for k in TESTS if row[f"{k}{i}"] == 0 and not (k == "boolean" and not infer_bool_from_01 and row[f"bit{i}"] == 0)), "string")
        out[c] = kind if row[f"n{i}"] else "string"
    return out


def categorical(df: DataFrame, columns=None) -> list[str]:
    """Text columns with fewer distinct values than a twentieth of those present."""
    names = [c for c, k in df.dtypes if k == "string" and (not columns or c in columns)]
    if not names:
        return []
    row = df.agg(*[x for i, c in enumerate(names) for x in (F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}"), F.count(F.col(f"`{c}`")).alias(f"n{i}"))]).first()
    return [c for i, c in enumerate(names) if row[f"n{i}"] >= 10 and row[f"d{i}"] < 0.05 * row[f"n{i}"]]


def cast_types(df: DataFrame, types: dict[str, str], mode: str = "strict", empty: str = "null") -> DataFrame:
    """Cells that don't fit are an error (strict) or missing. empty="compat": empty cells get the type's zero."""
    zero = {"boolean": F.lit(False), "bigint": F.lit(0).cast("bigint"), "int": F.lit(0), "double": F.lit(0.0), "string": F.lit("")}
    made, bad = [], []
    for c in df.columns:
        v, kind = F.col(f"`{c}`"), types.get(c, "string")
        if kind == "boolean":
            cast = F.when(F.lower(v).isin(*TRUE), True).when(F.lower(v).isin(*[b for b in BOOLS if b not in TRUE]), False)
        else:
            cast = v if kind == "string" else v.try_cast(kind)
        if kind != "string":
            bad.append((c, kind, v.isNotNull() & (v != "") & cast.isNull()))
        if empty == "compat" and kind in zero:
            cast = F.when(v.isNull() | (v == ""), zero[kind]).otherwise(cast)
        made.append(cast.alias(c))
    if mode == "strict" and bad:
        row = df.agg(*[x for i, (c, _, b) in enumerate(bad) for x in (F.count_if(b).alias(f"n{i}"), F.max(F.when(b, F.col(f"`{c}`"))).alias(f"x{i}"))]).first()
        for i, (c, kind, _) in enumerate(bad):
            if row[f"n{i}"]:
                raise ParseFailure(c, kind, row[f"n{i}"], row[f"x{i}"])
    return df.select(*made)


def read_csv(spark: SparkSession, path, header: bool = True, sep: str = ",", mode: str = "lenient", schema: dict | None = None, trim: bool = False, multiline: bool = False, infer_bool_from_01: bool = True, empty: str = "null", corrupt_column: str | None = None) -> DataFrame:
    """Typed frame of CSV files. Headerless columns are col0, col1 and so on. multiline: quoted line ends; without
    it big files are split. mode "collect" puts rows that don't parse into corrupt_column. Text cells without any
    character are missing, "" is an empty text."""
    if mode not in MODES or len(sep) != 1:
        raise InvalidOption(f"mode is one of {', '.join(MODES)}, sep one character")
    reader = spark.read.option("header", header).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", multiline).option("mode", MODES[mode]).option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim)
    # Spark takes "" for missing where nullValue is "", so it gets what no cell has; the parser drops each NUL of a
    # quoted cell where the escape's escape isn't set.
    reader = reader.option("nullValue", f"\ufdd0{uuid.uuid4().hex}").option("charToEscapeQuoteEscaping", '"')
    text = reader.csv(path)
    if mode == "collect":
        name = corrupt_column or "_corrupt"
        from pyspark.sql.types import StringType

        text = reader.option("columnNameOfCorruptRecord", name).schema(text.schema.add(name, StringType())).csv(path)
    if header:
        text = text.toDF(*[c.lstrip("﻿") for c in text.columns])
    else:
        text = text.toDF(*[f"col{c[2:]}" if c.startswith("_c") else c for c in text.columns])
    given = {k: v for k, v in (schema or {}).items() if k in text.columns}
    rest = [c for c in text.columns if c not in given]
    types = (infer_types(text.select(*[F.col(f"`{c}`") for c in rest]), infer_bool_from_01) if rest else {}) | given
    return cast_types(text, types, "strict" if mode == "strict" else "lenient", empty)


def read_json(spark: SparkSession, path, layout: str = "lines") -> DataFrame:
    """layout: lines, array (of objects) or columns (an object of arrays of one length)."""
    if layout == "lines":
        df = spark.read.option("mode", "FAILFAST").json(path)
    elif layout == "array":
        df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    elif layout == "columns":
        wide = spark.read.option("multiLine", True).json(path)
        sizes = F.array_distinct(F.array(*[F.size(F.col(f"`{c}`")) for c in wide.columns]))
        if wide.where(F.size(sizes) > 1).limit(1).count():
            raise FrameError("the arrays have different lengths")
        df = wide.select(F.inline(F.arrays_zip(*[F.col(f"`{c}`") for c in wide.columns])))
    else:
        raise InvalidOption("layout is lines, array or columns")
    if not df.columns:
        raise FrameError("no data")
    return df


def csv_from_text(spark: SparkSession, text: str, multiline: bool = True, **options) -> DataFrame:
    """As read_csv, of a text in the driver's memory: it is put in the shared folder as a file."""
    return read_csv(spark, put_text(spark, text, "text.csv"), multiline=multiline, **options)


def json_from_text(spark: SparkSession, text: str, layout: str = "lines") -> DataFrame:
    """As read_json, of a text in the driver's memory."""
    return read_json(spark, put_text(spark, text, "text.json"), layout)


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def from_rows(spark: SparkSession, rows, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def stream_csv(spark: SparkSession, folder: str, schema, header: bool = True) -> DataFrame:
    return spark.readStream.option("header", header).schema(schema).csv(folder)

"""String functions as Columns. Case maps ASCII only and length counts bytes, as the semantics require."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidOption

BLANKS = " \t\n\r\x0b\x0c"


def lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def upper(c: Column) -> Column:
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def contains(c: Column, text: str) -> Column:
    return F.contains(c, F.lit(text))


def replace(c: Column, old: str, new: str) -> Column:
    if not old:
        raise InvalidOption("nothing to replace")
    return F.replace(c, F.lit(old), F.lit(new))


def slice_text(c: Column, start: int, end: int, unit: str = "char") -> Column:
    """[start, end), clamped; unit="byte" gives binary, which may cut a character."""
    if start > end or start < 0:
        raise InvalidOption("0 <= start <= end")
    return F.substring(c if unit == "char" else F.encode(c, "UTF-8"), start + 1, end - start)


def byte_length(c: Column) -> Column:
    return F.octet_length(c).cast("bigint")


def starts_with(c: Column, text: str) -> Column:
    return F.startswith(c, F.lit(text))


def ends_with(c: Column, text: str) -> Column:
    return F.endswith(c, F.lit(text))


def split_columns(df: DataFrame, column: str, delimiter: str, prefix: str = "part", parts: int | None = None) -> DataFrame:
    """Columns prefix_0.. of the literal split, short rows padded with ""; `parts` saves the pass that finds
    the widest row."""
    if not delimiter:
        raise InvalidOption("the delimiter is empty")
    cut = F.split(F.col(f"`{column}`"), re.escape(delimiter), -1)
    if parts is None:
        parts = df.agg(F.max(F.size(cut))).first()[0] or 0
    return df.select("*", *[F.coalesce(F.try_element_at(cut, F.lit(i + 1)), F.lit("")).alias(f"{prefix}_{i}") for i in range(max(0, parts))])


class Strings:
    """frame.str("name").lower() and so on: the frame with the column replaced, or a new one with `to`."""

    def __init__(self, frame, column: str):
        self.frame, self.column = frame, column

    def _put(self, made: Column, to: str | None):
        return self.frame.with_column(to or self.column, made)

    def __getattr__(self, name):
        made = {"lower": lower, "upper": upper, "trim": trim, "strip": trim, "contains": contains, "replace": replace, "slice": slice_text, "len": byte_length, "starts_with": starts_with, "ends_with": ends_with}.get(name)
        if made is None:
            raise AttributeError(name)
        return lambda *args, to=None: self._put(made(F.col(f"`{self.column}`"), *args), to)

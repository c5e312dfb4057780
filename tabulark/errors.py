"""Errors with the facts a caller needs to act on them."""

from __future__ import annotations

import difflib


class FrameError(ValueError):
    pass


class ColumnNotFound(FrameError):
    def __init__(self, name: str, columns: list[str]):
        near = difflib.get_close_matches(name, columns, 1, 0.5)
        super().__init__(f"no column {name!r}" + (f"; did you mean {near[0]!r}?" if near else f"; there are {', '.join(columns[:20])}"))
        self.name, self.suggestion = name, near[0] if near else None


class OrderRequired(FrameError):
    def __init__(self, op: str):
        super().__init__(f"{op} depends on row order: pass order_by with columns that make rows unique")


class SchemaMismatch(FrameError):
    pass


class InvalidOption(FrameError):
    pass


class ParseFailure(FrameError):
    def __init__(self, column: str, kind: str, bad: int, example: str):
        super().__init__(f"column {column!r}: {bad} cells are not {kind}, such as {example!r}; give a schema or mode='lenient'")
        self.column, self.bad = column, bad


def check_columns(df, *names: str) -> None:
    for n in names:
        if n not in df.columns:
            raise ColumnNotFound(n, df.columns)


def check_batch(df, op: str) -> None:
    if df.isStreaming:
        raise FrameError(f"{op} needs the whole table: it can't run on a stream")

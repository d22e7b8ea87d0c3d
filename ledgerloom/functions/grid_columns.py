"""Expressions over grids held as array<array<string>>: what functions.grid judges and renders, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import grid as G


def _matches(cell: Column, pattern) -> Column:
    return F.rlike(cell, F.lit(f"(?i){pattern.pattern}"))


def is_numeric(cell: Column) -> Column:
    cell = F.replace(cell, F.lit(" "), F.lit(""))
    return _matches(cell, G.NUMBER) | _matches(cell, G.NIL)


def _body(row: Column) -> Column:
    return F.filter(F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0))), lambda c: c != "")


def kind_of(grid: Column) -> Column:
    lines = F.transform(grid, lambda r: F.lower(F.array_join(F.filter(r, lambda c: c != ""), " ")))
    listed = F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(G.CONTENTS.pattern))))
    numbers = F.size(F.filter(F.flatten(F.transform(grid, _body)), is_numeric))
    labels = F.filter(F.transform(grid, lambda r: F.lower(F.get(r, 0))), lambda x: x.isNotNull() & (x != ""))
    narrow = (F.size(F.get(grid, 0)) <= 2) & (numbers == 0)
    single = (F.size(grid) == 1) & (numbers <= 1)
    bullets = (F.size(labels) > 0) & F.forall(labels, lambda x: F.rlike(x, F.lit(G.BULLET.pattern)))
    toc = (listed >= 3) & (listed >= 0.3 * F.size(grid))
    return F.when(F.size(grid) == 0, "empty").when(toc, "toc").when(narrow | single | bullets, "layout").otherwise("data")


def has_header(grid: Column) -> Column:
    return F.exists(_body(F.get(grid, 0)), lambda c: ~is_numeric(c))


def all_percentages(grid: Column) -> Column:
    rows = F.filter(grid, lambda r: F.get(r, 0) != "")
    values = F.filter(F.flatten(F.transform(rows, _body)), is_numeric)
    return (F.size(values) > 0) & F.forall(values, lambda c: F.rlike(c, F.lit(r"%\)?$")))


def to_text(grid: Column) -> Column:
    return F.array_join(F.transform(grid, lambda r: F.array_join(F.filter(r, lambda c: c != ""), " ")), "\n")


def to_markdown(grid: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.get(grid, 0))))
    rest = F.transform(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), line)
    return F.when(F.size(grid) == 0, "").otherwise(F.array_join(F.concat(F.array(line(F.get(grid, 0)), rule), rest), "\n"))


def pad(row: Column, width: Column) -> Column:
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0)).cast("int")))


def cells(grid: Column) -> Column:
    """array<struct<row, col, label, text>> of the filled cells but for labels: the unpivoted grid."""
    one = lambda r, i: F.filter(F.transform(r, lambda c, j: F.struct(i.alias("row"), j.alias("col"), F.get(r, 0).alias("label"), c.alias("text"))), lambda x: (x["col"] > 0) & (x["text"] != ""))
    return F.flatten(F.transform(grid, one))

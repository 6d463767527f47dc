"""Tolerant parsing, recoding, rounding and row-reject expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Spellings of a missing cell.
MISSING_TOKENS = ("", "NA", "N/A", "NULL", "NaN", "nan", "null")


def number(column: Column, kind: str = "double") -> Column:
    """Parse text to a number; blanks and garbage become NULL."""
    return F.nullif(F.trim(column), F.lit("")).try_cast(kind)


def strict_date(column: Column, context: str) -> Column:
    """Parse an ISO date and fail the job, naming the context, on anything else."""
    parsed = F.when(column.rlike(r"^\d{4}-\d{2}-\d{2}$"), column.try_cast("date"))
    message = F.concat(F.lit(f"invalid ISO date for {context}: "), F.coalesce(column, F.lit("NULL")))
    return F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(message).cast("date"))


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or NULL when the three parts do not form one."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat_ws("-", pad(year, 4), pad(month, 2), pad(day, 2)).try_cast("date")


def missing_to_null(column: Column, tokens: tuple[str, ...] = MISSING_TOKENS) -> Column:
    return F.when(~column.isin(*tokens), column)


def matches(column: Column, pattern: str) -> Column:
    """1 when the pattern occurs, else 0."""
    return F.coalesce(column.rlike(pattern), F.lit(False)).cast("int")


def letters(column: Column) -> Column:
    return F.regexp_replace(column, r"[^\p{L}]", "")


def station_key(agency: Column, international: Column, longitude: Column, latitude: Column) -> Column:
    """Composite text key with five-decimal coordinates."""
    coordinate = lambda c: F.format_string("%.5f", c)
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return F.to_json(F.array(text(agency), text(international), coordinate(longitude), coordinate(latitude)))


def banded(column: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the right-open band [edges[i], edges[i+1]) holding the value; NULL outside."""
    chain = F.when(column.isNull() | (column < edges[0]) | (column >= edges[-1]), None)
    for upper, label in zip(edges[1:], labels):
        chain = chain.when(column < upper, label)
    return chain


def recode(column: Column, mapping: dict, default) -> Column:
    """Small fixed code table as an expression, with a default."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column), F.lit(default))


def half_even(column: Column, digits: int = 6) -> Column:
    return F.bround(column, digits)


def half_up(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits)


def first_failing(rules: list[tuple[str, Column]], kept: str = "included") -> Column:
    """Name of the first rule that rejects the row (rules are reject predicates, in order)."""
    chain = reduce(lambda c, rule: c.when(F.coalesce(rule[1], F.lit(True)), rule[0]), rules[1:], F.when(F.coalesce(rules[0][1], F.lit(True)), rules[0][0]))
    return chain.otherwise(kept)


def in_season(day: Column, start: tuple[int, int] = (5, 1), end: tuple[int, int] = (10, 31)) -> Column:
    code = F.month(day) * 100 + F.dayofmonth(day)
    return code.between(start[0] * 100 + start[1], end[0] * 100 + end[1])


def strip_byte_order_mark(df: DataFrame) -> DataFrame:
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else df

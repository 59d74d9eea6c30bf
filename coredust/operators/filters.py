"""Row filters: the command line's ``[+-]column,pattern[!]`` and the result viewer's column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered(c: str) -> Column:
    """A cell as the text renderers show it; an absent cell is ``-``."""
    return F.coalesce(F.col(c).cast("string"), F.lit("-"))


def cli_filter(df: DataFrame, filters: Sequence[str]) -> DataFrame:
    """Rows that at least one filter accepts.

    A filter names columns by a case-insensitive part of their name (none or an unknown one: any column); its pattern is
    a substring of the rendered cell, or a regular expression with a final ``!``; a leading ``-`` negates the filter.
    """
    tests = []
    for text in filters:
        body, negate = (text[1:], text[0] == "-") if text[:1] in ("+", "-") else (text, False)
        name, _, pattern = body.partition(",") if "," in body else ("", "", body)
        is_regex = pattern.endswith("!")
        pattern = pattern.removesuffix("!")
        columns = [c for c in df.columns if name and name.lower() in c.lower()] or df.columns
        hit = reduce(Column.__or__, (rendered(c).rlike(pattern) if is_regex else rendered(c).contains(pattern) for c in columns))
        tests.append(~hit if negate else hit)
    return df.filter(reduce(Column.__or__, tests)) if tests else df


def view_predicate(column: str, expression: str) -> Column:
    """``=exact``, ``!not``, ``<`` ``<=`` ``>`` ``>=``, ``/regex/``, ``-`` (absent), ``!-`` (present), else contains; case-insensitive."""
    c = F.col(column)
    text = F.lower(c.cast("string"))
    if expression == "-":
        return c.isNull()
    if expression == "!-":
        return c.isNotNull()
    if len(expression) > 1 and expression[0] == "/" == expression[-1]:
        return c.cast("string").rlike("(?i)" + expression[1:-1])
    for op, f in (("<=", Column.__le__), (">=", Column.__ge__), ("<", Column.__lt__), (">", Column.__gt__)):
        if expression.startswith(op):
            value = expression[len(op) :].strip()
            try:
                return f(c.cast("double"), F.lit(float(value)))
            except ValueError:
                return f(text, F.lit(value.lower()))
    if expression.startswith("="):
        return text == expression[1:].lower()
    if expression.startswith("!"):
        return ~F.coalesce(text.contains(expression[1:].lower()), F.lit(False))
    return text.contains(expression.lower())


def view_filter(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Rows that meet the expression of every column."""
    return reduce(DataFrame.filter, (view_predicate(c, e) for c, e in columns.items()), df)


def text_search(df: DataFrame, q: str, columns: Sequence[str]) -> DataFrame:
    """Rows with ``q`` in any of the columns, whatever the case."""
    return df.filter(reduce(Column.__or__, (F.coalesce(F.lower(F.col(c).cast("string")).contains(q.lower()), F.lit(False)) for c in columns)))


def time_range(df: DataFrame, columns: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows with any of the time columns between the two instants, both included."""
    return df.filter(reduce(Column.__or__, (F.coalesce(F.col(c).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")), F.lit(False)) for c in columns)))


def view_sort(df: DataFrame, keys: Sequence[tuple[str, bool]], tie: str) -> list[Column]:
    """Order of a view: numbers by value, text whatever its case, absent cells last in both directions, then ``tie``."""
    kinds = dict(df.dtypes)
    out = []
    for c, descending in keys:
        value = F.lower(F.col(c)) if kinds[c] == "string" else F.col(c)
        out.append(value.desc_nulls_last() if descending else value.asc_nulls_last())
    return [*out, F.col(tie).asc()]


def top_rows(df: DataFrame, keys: Sequence[tuple[str, bool]], tie: str, start: int, count: int) -> DataFrame:
    """A page of a sorted view with each row's place ``row_no`` from 1.

    The page is cut with a distributed top-k before its few rows are numbered, so no task sorts the whole view.
    """
    order = view_sort(df, keys, tie)
    page = df.orderBy(*order).limit(start + count)
    from pyspark.sql import Window

    return page.withColumn("row_no", F.row_number().over(Window.orderBy(*order)).cast("long")).filter(F.col("row_no") > start)

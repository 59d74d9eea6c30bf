"""Timelines: events of many sources merged, pivoted by kind of time, and binned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("Created", "Modified", "Accessed", "Changed")


def merge(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows (plugin, description, kind, time) of all parts, without those that have no time."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("time").isNotNull())


def pivoted(events: DataFrame) -> DataFrame:
    """One row a (plugin, description), a column a kind of time: the earliest of it."""
    return events.groupBy("plugin", "description").agg(*(F.min(F.when(F.col("kind") == k, F.col("time"))).alias(f"{k.lower()}_date") for k in KINDS))


def body_line(row: DataFrame) -> Column:
    """A mactime body line; times are whole Unix seconds, 0 where absent."""
    sec = lambda c: F.coalesce(F.unix_seconds(F.col(c).cast("timestamp")), F.lit(0)).cast("string")
    return F.concat_ws("|", F.lit("0"), F.concat_ws(" - ", "plugin", "description"), F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"), sec("accessed_date"), sec("modified_date"), sec("changed_date"), sec("created_date"))


def histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of ``value`` in ``bins`` equal bins of [lo, hi]; the last bin includes ``hi``. ``by`` stacks the counts."""
    b = F.least(F.floor((value - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("long")
    return df.filter((value >= lo) & (value <= hi)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


def top_and_other(counts: DataFrame, by: str, n: str, keep: int) -> DataFrame:
    """The ``keep`` largest groups by name, all others as ``other``; ties by name."""
    order = Window.orderBy(F.desc(n), by)
    ranked = counts.withColumn("_r", F.row_number().over(order))
    return ranked.groupBy(F.when(F.col("_r") <= keep, F.col(by)).otherwise("other").alias(by)).agg(F.sum(n).alias(n))


def _real(df: DataFrame, value: str) -> DataFrame:
    """Rows with a value: neither null nor, in columns that can hold it, not a number."""
    d = df.filter(F.col(value).isNotNull())
    return d.filter(~F.isnan(value)) if dict(df.dtypes)[value] in ("double", "float") else d


def nth_value(df: DataFrame, value: str, k: int, bins: int = 2048) -> float | None:
    """The exact value at index ``k`` of the sorted column, null for an empty one; infinities sort as such.

    Each round counts the values of a range in ``bins`` bins and goes on in the bin that holds the index, so the driver
    gets at most ``bins`` rows a round and no task sorts the column.
    """
    d = _real(df, value)
    kind = dict(df.dtypes)[value]
    if kind in ("double", "float"):
        inf = float("inf")
        below, all_finite = d.agg(F.count_if(F.col(value) == -inf), F.count_if(F.abs(value) < inf)).first()
        if k < below:
            return -inf
        k -= below
        if k >= all_finite:
            return inf if k < all_finite + d.filter(F.col(value) == inf).count() else None
        d = d.filter(F.abs(value) < inf)

        def place(lo: float, hi: float) -> Column:
            by = 1.0 if hi - lo < inf else 4.0  # the span of two finite values need not be finite
            return (F.col(value) / by - lo / by) / (hi / by - lo / by) * bins
    else:
        place = lambda lo, hi: (F.col(value) - F.lit(lo)) * bins / (F.lit(hi) - F.lit(lo))
    lo, hi = d.agg(F.min(value), F.max(value)).first()
    while lo is not None and lo != hi:
        b = F.least(F.floor(place(lo, hi)), F.lit(bins - 1))
        rows = d.filter(F.col(value).between(lo, hi)).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: r["b"]):
            if k < r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
        else:
            return None
    return lo


def focus(df: DataFrame, value: str, low: float = 0.005, high: float = 0.995, share: float = 0.2) -> DataFrame:
    """(lo, hi, focused): the span between two exact quantiles if it is under ``share`` of the full span, else the full one.

    A quantile q is the value at index int((n - 1) * q).
    """
    n, a, z = _real(df, value).agg(F.count(value), F.min(value), F.max(value)).first()
    ends = [nth_value(df, value, int((n - 1) * q)) for q in (low, high)] if n else [None, None]
    narrow = n > 0 and ends[1] - ends[0] < (z - a) * share
    lo, hi = ends if narrow else (a, z)
    kind = df.schema[value].dataType
    return df.sparkSession.range(1).select(F.lit(lo).cast(kind).alias("lo"), F.lit(hi).cast(kind).alias("hi"), F.lit(bool(narrow)).alias("focused"))

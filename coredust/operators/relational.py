"""Shapes that forensic checks share: cross-views, differences, address lookups, groups, runs, trees and chains.

Every helper takes generic column names, so it works on extracted kernel objects and on any other table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ship import ship
from ..functions.tables import written

#: Rows of equal keys that travel as one.
BUNDLE = 1000
#: Rows of neighbouring keys that are joined as one.
BLOCK = 256
#: Blocks of ranges that meet the points of their bucket in one task.
SEGMENT = 32
#: Parts that places are cut into at most, a power of two, and the points and range ends that are worth a part of their own.
PARTS, PART_ROWS = 256, 8192


def crossview(sources: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Every key that any source reports, with a flag per source that reports it."""
    tagged = [df.select(F.col(key), *(F.lit(n == name).alias(n) for n in sources)) for name, df in sources.items()]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    return both.groupBy(key).agg(*(F.bool_or(n).alias(n) for n in sources))


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str], mode: str) -> DataFrame:
    """Rows of ``left`` against another run: ``only`` here, in ``common``, or all with a ``is_new`` ``mark``."""
    other = right.select(*keys).distinct()
    if mode == "only":
        return left.join(other, list(keys), "left_anti")
    if mode == "common":
        return left.join(other, list(keys), "left_semi")
    return left.join(other.withColumn("_seen", F.lit(True)), list(keys), "left").withColumn("is_new", F.col("_seen").isNull()).drop("_seen")


def listed_not_found(listed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Objects that one enumeration lists and another does not find."""
    return listed.join(found.select(key).distinct(), key, "left_anti")


def _blocks(df: DataFrame, keys: Sequence[str], rows: str, first: str, last: str) -> DataFrame:
    """Neighbours of equal ``keys``, about ``BLOCK`` of their ``rows`` at a time, as an array ``_all``; ``_c`` counts them, all lie from ``_first`` to ``_last``."""
    before = Window.partitionBy(*keys).orderBy(first, last).rowsBetween(Window.unboundedPreceding, 0)
    d = df.select(*keys, first, last, F.struct(*(c for c in df.columns if c not in keys)).alias("_all"), F.floor((F.sum(F.size(rows)).over(before) - 1) / BLOCK).alias("_c"))
    return d.groupBy(*keys, "_c").agg(F.min(first).alias("_first"), F.max(last).alias("_last"), F.collect_list("_all").alias("_all"))


def _held(points: DataFrame, at: str, ranges: DataFrame, lo: str, hi: str, width: float, inclusive: bool) -> DataFrame:
    """Pairs of a bundle of points and a bundle of ranges that holds it, each once, as an equality join on (level, bucket).

    Buckets are a fourth of ``width`` wide at level 0 and twice as wide at each next level. A range is looked up at the
    level whose buckets are about a fourth of its length, so it touches at most six of them however long it is, and a
    point at each level that any range has: at most 64, and one where all ranges are of the usual length.

    What is joined are blocks of neighbours. They leave as each point with all ranges of the block, then the next point
    with the same ranges: runs and repeats, of which a file by columns keeps little. A bucket with many ranges is dealt
    out in segments, each with all points of the bucket, so that its pairs are made in several tasks.
    """
    whole = dict(ranges.dtypes)[lo] == dict(ranges.dtypes)[hi] == dict(points.dtypes)[at] == "bigint" and float(width).is_integer() and int(width) & (int(width) - 1) == 0
    width = max(1, int(width) >> 2) if whole else width / 4
    bits = width.bit_length() - 1 if whole else 0

    def bucket(c: str, level: Column) -> Column:
        if whole:  # addresses may be too large for the arithmetic of doubles
            return F.call_function("shiftright", F.col(c), F.least(level + bits, F.lit(62)).cast("int"))
        return F.floor(F.col(c) / (width * F.pow(F.lit(2.0), level))).cast("long")

    length = F.greatest(F.col(hi).cast("double") - F.col(lo).cast("double"), F.lit(float(width))) / width
    r = ranges.filter(F.col(lo) <= F.col(hi)).withColumn("_l", F.least(F.greatest(F.ceil(F.log2(length)).cast("int") - 2, F.lit(0)), F.lit(62 - bits)))
    levels = r.agg(F.collect_set("_l").alias("_ls"))  # one row, at most 64 levels
    r = r.withColumn("_b", F.explode(F.sequence(bucket(lo, F.col("_l")), bucket(hi, F.col("_l")))))
    q = points.filter(F.col(at).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("_l", F.explode("_ls")).drop("_ls")
    q = q.withColumn("_b", bucket(at, F.col("_l")))
    r = _blocks(r, ["_l", "_b"], "_ranges", lo, hi).withColumn("_s", F.floor(F.col("_c") / SEGMENT))
    q = q.join(r.groupBy("_l", "_b").agg(F.max("_s").alias("_n")), ["_l", "_b"]).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), "_n"))).drop("_n")
    keys = ["_l", "_b", "_s"]
    # A fixed number of partitions, as the pairs made in one are far more than its bytes tell.
    dealt = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    p, r = _blocks(dealt(q), keys, "_points", at, at).alias("p"), dealt(r).alias("r")
    near = (F.col("p._last") >= F.col("r._first")) & (F.col("p._first") <= F.col("r._last"))
    for k in keys:
        near = (F.col(f"p.{k}") == F.col(f"r.{k}")) & near
    inside = (F.col(at) >= F.col(lo)) & ((F.col(at) <= F.col(hi)) if inclusive else (F.col(at) < F.col(hi)))
    both = p.join(r, near).select(F.col("p._all").alias("_p"), F.col("r._all").alias("_r"), F.col("r._first").alias("_first"), F.col("r._last").alias("_last"))
    # The lambda also keeps this step out of generated code, which would hold all rows made of a pair of blocks at once.
    some = F.filter("_p", lambda x: (x[at] >= F.col("_first")) & (x[at] <= F.col("_last")))
    return both.select(F.inline(some), "_r").select(*points.columns, F.inline("_r")).filter(inside)


def _bundled(df: DataFrame, keys: Mapping[str, str], rows: str) -> DataFrame:
    """A row for at most ``BUNDLE`` rows of equal ``keys`` (new name -> column), the rows themselves as an array ``rows``."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    d = df.select(*(F.col(c).alias(k) for k, c in keys.items()), F.struct(*df.columns).alias(rows))
    return d.withColumn("_n", F.floor((nth - 1) / BUNDLE)).groupBy(*keys, "_n").agg(F.collect_list(rows).alias(rows)).drop("_n")


def lookup_all(points: DataFrame, at: str, ranges: DataFrame, lo: str, hi: str, width: float) -> DataFrame:
    """Every inclusive range that holds a point: a table entry against the modules that may own it.

    The result has a row a pair, which may be far more than both inputs together. So equal places and equal ranges are
    looked up once, bundle by bundle, and pairs are first made where they leave: they are never shuffled or compared.
    """
    p = _bundled(points.filter(F.col(at).isNotNull()), {"_at": at}, "_points")
    r = _bundled(ranges.filter(F.col(lo) <= F.col(hi)), {"_lo": lo, "_hi": hi}, "_ranges")
    both = _held(p, "_at", r, "_lo", "_hi", width, True).select(F.inline("_points"), "_ranges")
    return both.select(*points.columns, F.inline("_ranges"))


def _edges(points: DataFrame, at: str, ranges: DataFrame, lo: str, hi: str, by: Sequence[str]) -> DataFrame:
    """(by, ``_edges``): places, in order, that cut the points and range ends of each owner into parts of about equal size.

    At most ``PARTS`` parts, and fewer where there is less than ``PART_ROWS`` for each. Where they lie changes no result.
    """
    ends = [points.select(*by, F.col(at).alias("_e")), ranges.select(*by, F.col(lo).alias("_e")), ranges.select(*by, F.col(hi).alias("_e"))]
    cuts = F.percentile_approx("_e", [i / PARTS for i in range(1, PARTS)], 10 * PARTS)
    per = ends[0].unionByName(ends[1]).unionByName(ends[2]).groupBy(*by).agg(cuts.alias("_c"), F.count("_e").alias("_n"))
    step = F.greatest(F.lit(1), F.ceil(F.lit(float(PARTS * PART_ROWS)) / F.col("_n"))).cast("int")
    return per.select(*by, F.coalesce(F.array_sort(F.array_distinct(F.filter("_c", lambda _, i: (i + 1) % step == 0))), F.array().cast(per.schema["_c"].dataType)).alias("_edges"))


def _part(x: Column) -> Column:
    """The number of ``_edges`` at or before ``x``, by bisection: it grows with ``x``, so parts are in order."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(PARTS.bit_length() - 1))))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get("_edges", n + s - 1) <= x, n + s).otherwise(n))


def _in_parts(points: DataFrame, at: str, ranges: DataFrame, lo: str, hi: str, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Points with their part ``_p``; ranges with the parts ``_pa`` and ``_pb`` of their ends, and ``_edges``."""
    cut = _edges(points, at, ranges, lo, hi, by)
    joined = lambda df: df.join(cut, list(by)) if by else df.crossJoin(F.broadcast(cut))
    p = joined(points).withColumn("_p", _part(F.col(at))).drop("_edges")
    return p, joined(ranges).withColumns({"_pa": _part(F.col(lo)), "_pb": _part(F.col(hi))})


def _painter(inclusive: bool):
    """The first range of each point of one part: (by, part, at, place) of points and ranges in, hits out."""

    def paint(points: pa.Table, ranges: pa.Table) -> pa.Table:
        if not len(points) or not len(ranges):
            return points.append_column("_name", pa.nulls(len(points), ranges.schema.field("_name").type)).slice(0, 0)
        ranges = ranges.take(pc.sort_indices(ranges, [("_order", "ascending")]))
        lo, hi, at = (t.column(c).to_numpy(zero_copy_only=False) for t, c in ((ranges, "_lo"), (ranges, "_hi"), (points, "_at")))
        ends = np.unique(np.concatenate([lo, hi]))
        # Cell 2i is the place ends[i], cell 2i + 1 what lies between it and the next end.
        first, last = 2 * np.searchsorted(ends, lo), 2 * np.searchsorted(ends, hi) + (1 if inclusive else 0)
        owner, free = [-1] * (2 * len(ends) + 1), list(range(2 * len(ends) + 2))
        for i, (cell, stop) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            while True:
                root = cell
                while free[root] != root:
                    root = free[root]
                while free[cell] != root:
                    free[cell], cell = root, free[cell]
                if root >= stop:
                    break
                owner[root], free[root] = i, root + 1
                cell = root + 1
        place = np.searchsorted(ends, at, side="right") - 1
        end = ends[np.maximum(place, 0)]
        cells = np.where((end == at) | ((end != end) & (at != at)), 2 * place, 2 * place + 1)
        own = np.where(place < 0, -1, np.array(owner)[np.maximum(cells, 0)])
        hit = np.flatnonzero(own >= 0)
        return points.take(hit).append_column("_name", ranges.column("_name").take(own[hit]))

    return paint


def lookup_first(points: DataFrame, at: str, ranges: DataFrame, lo: str, hi: str, order: str, name: str, width: float, by: Sequence[str] = (), inclusive: bool = False) -> DataFrame:
    """The first range (by ``order``) that holds each point, as ``name``; null if none does. Half-open unless inclusive.

    Places are cut into parts of about equal content. A range goes to the parts in which it ends; of those that cover
    a part from end to end the first one does. In a part the ranges, first ones first, take the cells between their ends
    that are still free, so no range is paired with the points that it holds. ``width`` is not needed for that.
    """
    keys = [*by, at]
    own = [f"_by{i}" for i in range(len(by))]
    q = points.select(*(F.col(c).alias(k) for c, k in zip(by, own, strict=True)), F.col(at).alias("_at")).distinct().filter("_at IS NOT NULL")
    best = [F.min("_order").alias("_order"), F.min_by("_name", "_order").alias("_name")]
    r = ranges.select(*(F.col(c).alias(k) for c, k in zip(by, own, strict=True)), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.col(name).alias("_name"), F.col(order).alias("_order"))
    r = r.filter((F.col("_lo") <= F.col("_hi")) & F.col("_order").isNotNull()).groupBy(*own, "_lo", "_hi").agg(*best)
    q, r = _in_parts(q, "_at", r, "_lo", "_hi", own)
    ends = r.select(*own, F.explode(F.array_distinct(F.array("_pa", "_pb"))).alias("_p"), "_lo", "_hi", "_order", "_name")
    whole = r.filter("_pb - _pa > 1").groupBy(*own, "_pa", "_pb").agg(F.first("_edges").alias("_edges"), *best)
    whole = whole.select(*own, "_edges", F.explode(F.sequence(F.col("_pa") + 1, F.col("_pb") - 1)).alias("_p"), "_order", "_name")
    whole = whole.groupBy(*own, "_p").agg(F.first(F.get("_edges", F.col("_p") - 1)).alias("_lo"), F.first(F.get("_edges", F.col("_p"))).alias("_hi"), *best)
    out = StructType([*q.schema.fields, r.schema["_name"]])
    ship(points.sparkSession)
    hit = q.groupBy(*own, "_p").cogroup(ends.unionByName(whole).groupBy(*own, "_p")).applyInArrow(_painter(inclusive), out)
    hit = hit.select(*(F.col(k).alias(c) for c, k in zip(by, own, strict=True)), F.col("_at").alias(at), F.col("_name").alias(name))
    return points.join(hit, keys, "left")


def outside_ranges(points: DataFrame, at: str, ranges: DataFrame, lo: str, hi: str, width: float) -> DataFrame:
    """Points that no half-open range holds: code that belongs to no module.

    A point is held if the greatest end of the ranges that start at or before it lies beyond it: one sort in parts of about
    equal content, into each of which the greatest end of the parts before is carried. ``width`` is not needed for that.
    """
    q = points.select(F.col(at).alias("_at")).filter("_at IS NOT NULL").distinct()
    r = ranges.select(F.col(lo).alias("_lo"), F.col(hi).alias("_hi")).filter("_lo < _hi").groupBy("_lo").agg(F.max("_hi").alias("_hi"))
    q, r = _in_parts(q, "_at", r, "_lo", "_hi", [])
    both = q.select("_p", "_at", F.lit(None).cast(r.schema["_hi"].dataType).alias("_hi"), F.lit(1).alias("_k"))
    both = both.unionByName(r.select(F.col("_pa").alias("_p"), F.col("_lo").alias("_at"), "_hi", F.lit(0).alias("_k")))
    # At most a row a part.
    carried = r.groupBy(F.col("_pa").alias("_c")).agg(F.max("_hi").alias("_m")).agg(F.collect_list(F.struct("_c", "_m")).alias("_carried"))
    before = F.array_max(F.transform(F.filter("_carried", lambda x: x["_c"] < F.col("_p")), lambda x: x["_m"]))
    parts = both.select("_p").distinct().crossJoin(F.broadcast(carried)).select("_p", before.alias("_before"))
    reach = F.max("_hi").over(Window.partitionBy("_p").orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0))
    hit = both.withColumn("_reach", reach).filter("_k = 1").join(F.broadcast(parts), "_p").filter("_at < greatest(_reach, _before)")
    return points.join(hit.select(F.col("_at").alias(at)), at, "left_anti")


def last_before(points: DataFrame, marks: DataFrame, by: str, at: str, carry: str) -> DataFrame:
    """As-of join: for each point the ``carry`` of the last mark at or before it, per ``by``.

    One sort of the union by (by, at); marks come before points at the same place.
    """
    m = marks.select(by, at, F.col(carry).alias("_m"), F.lit(0).alias("_k"))
    p = points.withColumns({"_m": F.lit(None).cast(m.schema["_m"].dataType), "_k": F.lit(1)})
    order = Window.partitionBy(by).orderBy(at, "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(m, allowMissingColumns=True)
    return both.withColumn(f"last_{carry}", F.last("_m", ignorenulls=True).over(order)).filter("_k = 1").drop("_m", "_k")


def shared_groups(df: DataFrame, keys: Sequence[str], member: str, least: int = 2) -> DataFrame:
    """Groups of at least ``least`` members that share a value they should not share, with the sorted members."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_members"), F.sort_array(F.collect_list(member)).alias("_m"))
    return per.filter(F.col("n_members") >= least).withColumn("members", F.array_join(F.transform("_m", lambda x: x.cast("string")), ",")).drop("_m")


def minority(df: DataFrame, group: str, variant: str) -> DataFrame:
    """(group, variant) pairs seen less often than the group's most frequent variant: patched copies of shared code."""
    n = df.groupBy(group, variant).agg(F.count(F.lit(1)).alias("n_rows"))
    return n.withColumn("top_rows", F.max("n_rows").over(Window.partitionBy(group))).filter("n_rows < top_rows")


def runs(df: DataFrame, by: Sequence[str], at: str, length: Column | None = None) -> DataFrame:
    """Coalesce neighbouring positions: (by, run_start, run_end, n_parts), the end being exclusive."""
    size = F.lit(1) if length is None else length
    order = Window.partitionBy(*by).orderBy(at)
    d = df.select(*by, F.col(at).alias("_a"), (F.col(at) + size).alias("_e"))
    order = Window.partitionBy(*by).orderBy("_a")
    d = d.withColumn("_new", F.when(F.col("_a") > F.coalesce(F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_a") - 1), 1).otherwise(0))
    d = d.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "_run").agg(F.min("_a").alias("run_start"), F.max("_e").alias("run_end"), F.count(F.lit(1)).alias("n_parts")).drop("_run")


def running_offset(df: DataFrame, by: Sequence[str], order: Sequence[str], size: str) -> DataFrame:
    """Where each part starts in the file that its group is dumped to: the sum of the sizes before it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("file_offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def first_seen(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row a key, the first by ``order``: what a walk in both directions keeps."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def chain_positions(links: DataFrame, node: str, after: str) -> DataFrame:
    """(node, head, place) of every node on singly linked lists, all lists at once, by pointer jumping.

    ``links`` has a row a node and the node after it (null at the end). Each round doubles the distance looked back, so
    a list of n nodes takes log2(n) joins. Nodes on cycles have no head and fall away.
    """
    back = links.select(F.col(after).alias("n"), F.col(node).alias("_prev")).filter("n IS NOT NULL")
    state = links.select(F.col(node).alias("n")).join(back, "n", "left")
    state = state.select("n", F.coalesce("_prev", "n").alias("head"), F.when(F.col("_prev").isNull(), 0).otherwise(1).cast("long").alias("place"))
    state = heads = written(state, "chain")
    heads = heads.filter("n = head").select("head")
    for _ in range(max(1, state.count()).bit_length() + 1):
        far = state.select(F.col("n").alias("head"), F.col("head").alias("_h"), F.col("place").alias("_p"))
        step = written(state.join(far, "head"), "chain")
        state = step.select("n", F.col("_h").alias("head"), (F.col("place") + F.col("_p")).alias("place"))
        if step.filter("_h <> head").isEmpty():
            break
    return state.join(heads, "head", "left_semi").select(F.col("n").alias(node), "head", "place")


def _key(c: str) -> Column:
    """An id as text that sorts like the unsigned 64-bit value."""
    return F.lpad(F.hex(F.col(c).cast("long")), 16, "0")


def tree_paths(nodes: DataFrame, node: str, parent: str, by: Sequence[str] = (), label: str | None = None, sep: str = "/") -> DataFrame:
    """(by, node, depth, path) of every node below a root; a root has no parent, itself, or one that is not there.

    Ids are unique within ``by`` (an image, say); of rows that repeat one, that with the least parent counts. ``path``
    holds the ancestors' ids in 16 hex digits, so sorting by it lists each tree depth first. With ``label`` a column
    ``names`` holds the labels along the path, joined by ``sep``.

    Each round doubles the distance that every node has looked up, so depth d takes log2(d) joins. Nodes on cycles, or
    below one, never see a root: a round in which no node does is the last, and they fall away.
    """
    by = list(by)
    names = [F.col(label).cast("string").alias("names")] if label else []
    ids = nodes.select(*by, F.col(node).alias("n"), F.struct(F.col(parent).alias("up"), *names).alias("x")).filter("n IS NOT NULL")
    ids = ids.groupBy(*by, "n").agg(F.min("x").alias("x")).select(*by, "n", "x.*")
    known = ids.select(*by, F.col("n").alias("up")).withColumn("_k", F.lit(True))
    there = F.col("_k") & (F.col("up") != F.col("n"))
    text = ["names"] if label else []
    state = ids.join(known, [*by, "up"], "left").select(*by, "n", F.when(there, F.col("up")).alias("up"), F.when(there, 1).otherwise(0).cast("long").alias("depth"), _key("n").alias("path"), *text)
    state = written(state, "tree")
    done, open_ = state.filter("up IS NULL"), state.filter("up IS NOT NULL")
    while True:
        far = done.unionByName(open_).select(*by, F.col("n").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("path").alias("_p"), *(F.col(c).alias("_n") for c in text))
        step = open_.join(far, [*by, "up"]).select(*by, "n", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), F.concat_ws("/", "_p", "path").alias("path"), *(F.concat_ws(sep, "_n", "names").alias("names") for _ in text))
        step = written(step, "tree")
        found = step.filter("up IS NULL")
        if found.isEmpty():
            return done.drop("up").withColumnRenamed("n", node)
        done, open_ = done.unionByName(found), step.filter("up IS NOT NULL")


def with_ancestors(paths: DataFrame, node: str, hits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nodes to show when ``hits`` match: the hits and, as context, all their ancestors; ``is_context`` tells which."""
    keys = [*by, node]
    up = paths.join(hits.select(*keys), keys, "left_semi").select(*by, F.explode(F.split("path", "/")).alias("_s")).select(*by, F.conv("_s", 16, -10).cast("long").alias(node)).distinct()
    hit = hits.select(*keys).distinct().withColumn("_h", F.lit(True))
    return paths.join(up, keys, "left_semi").join(hit, keys, "left").select(*keys, "depth", F.col("_h").isNull().alias("is_context"))


def slots(df: DataFrame, count: int) -> DataFrame:
    """A row for each slot 0..count-1 of every table."""
    return df.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))


def flag_names(value: Column, names: Sequence[str]) -> Column:
    """Names of the bits set, lowest first, joined by ``|``."""
    return F.array_join(F.filter(F.array(*(F.when(F.getbit(value.cast("long"), F.lit(i)) == 1, F.lit(n)) for i, n in enumerate(names))), lambda x: x.isNotNull()), "|")

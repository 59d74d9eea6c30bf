"""Mixing sources to target weights as a time-varying curriculum (DataFrame functions only).

Each source gets a share of all words by weight. No source may be repeated more than ``MAX_EPOCHS`` times: a target
beyond that stops there and the excess is shared again by weight among the rest (water filling, solved in closed form).

Over the schedule's time t in [0, 1] a source's weight follows a linear schedule around its mean, so its cumulative demand is
``T * (t + a * (t*t - t))`` with tilt ``a`` in [-1, 1]. Each pass over a document occupies an interval of its source's
cumulative words; inverting the demand at the middle of that interval gives the pass's position, and range-sorting all
passes by position yields the curriculum. At time t a source has the share ``T * (1 + a * (2*t - 1))`` of the sum of all
sources' demands, so shares add up to one at any time; that sum makes ``t + m * (t*t - t)`` the part of all words that is
trained on by then, m being the mean tilt by target.

Edge cases: a null text has size 0; a null source is a source of its own and ranks last; a null doc_id orders first;
documents of size 0 take 0 words; repeated rows are mixed like any other (the rows are interchangeable); an empty table
gives an empty result; extra columns are ignored by ``plan_mix`` and carried by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, bucket_prefix_sums, materialize

WEIGHTS = (5, 2, 1)
#: Tilt of the schedule by weight class: heavy sources late, light ones early.
TILTS = (0.5, 0.0, -0.5)
MAX_EPOCHS = 3
#: Hex digits of the md5 order that name a bucket: 16^3 buckets a source.
BUCKET_DIGITS = 3
#: Words of a partition of the mixture, about.
PART_WORDS = 4_000_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, tilts: Sequence[float] = TILTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target, tilt, mean_tilt). One row a source, so single-task windows are small.

    With sources in order of ``max_epochs * size / weight`` the first ones are capped; the level ``lambda`` of the others
    is what remains over their weights, at the first source whose share stays below its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = lambda xs, kind: F.element_at(F.array(*(F.lit(x) for x in xs)), ((F.col("_rn") - 1) % len(xs) + 1).cast("int")).cast(kind)
    s = sizes.withColumn("_rn", F.row_number().over(by_name))
    s = s.withColumns({"_w": pick(weights, "double"), "tilt": pick(tilts, "double"), "_cap": F.lit(float(max_epochs)) * F.col("source_size")})
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), "_rn")
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"_k": F.row_number().over(by_cap), "_level": (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)})
    level = F.min_by("_level", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_k"))).over(everything)
    s = s.select("source", "source_size", F.least(F.col("_cap"), level * F.col("_w")).alias("target"), "tilt")
    mean = F.try_divide(F.sum(F.col("target") * F.col("tilt")).over(everything), F.sum("target").over(everything))
    return s.withColumn("mean_tilt", F.coalesce(mean, F.lit(0.0)))


def _sized(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    # The text takes part, so that many texts under one doc_id, or under none, spread over the buckets.
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = [F.col(c).alias(f"_cd_{i}") for i, c in enumerate(carry)]
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # never null, so joins and windows share a partitioning
    return docs.select("doc_id", "source", name.alias("_name"), size.alias("size"), key.alias("_key"), F.substring(key, 1, BUCKET_DIGITS).alias("_bucket"), *own)


def _placed(base: DataFrame, slim: DataFrame, weights, tilts, max_epochs) -> DataFrame:
    """``base`` rows with source_size, target, mean_tilt and ``passes``: an array of (pass, position), empty if none is taken."""
    offsets = materialize(bucket_prefix_sums(slim, ["_name", "source"], "_bucket", {"_off": F.col("size")}, totals=["_off"]), "mix-offsets")
    targets = source_targets(offsets.groupBy("source").agg(F.max("_off_total").alias("source_size")), weights, tilts, max_epochs)
    targets = targets.withColumnRenamed("source", "_s")
    per_bucket = offsets.join(targets, F.col("source").eqNullSafe(F.col("_s"))).select("_name", "_bucket", "_off", "source_size", "target", "tilt", "mean_tilt")
    joined = base.join(per_bucket, ["_name", "_bucket"])
    within = Window.partitionBy("_name", "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_off") + F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = joined.withColumn("_start", start)
    a = F.col("tilt")

    def one(e: int):
        # The middle of the interval decides, so a source misses its target by half a document at most.
        mid2 = (F.col("_start") + e * F.col("source_size")) * 2 + F.col("size")
        x = mid2 / (F.col("target") * 2)
        t = F.when(a == 0, x).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * x)) / (2 * a))
        # A pass whose position is below 1 is taken; whole numbers decide that without rounding.
        return F.when((F.col("size") > 0) & (mid2 < F.col("target") * 2), F.struct(F.lit(e).alias("pass"), t.alias("position")))

    return placed.withColumn("passes", F.filter(F.array(*(one(e) for e in range(max_epochs))), lambda p: p.isNotNull()))


def _in_order(rows: DataFrame, position: str, slim: DataFrame) -> DataFrame:
    """``rows`` in training order: partitions of about ``PART_WORDS`` words that follow each other, sorted; unused rows last.

    The part of all words before a position is known from the schedule, so no sample is needed to find the ranges.
    """
    words = slim.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-words // PART_WORDS))
    t = F.col(position)
    before = t + F.col("mean_tilt") * (t * t - t)
    used = F.least(F.floor(before * parts), F.lit(parts - 1)).cast("int")
    part = F.coalesce(used, F.lit(parts) + F.pmod(F.hash("_key"), F.lit(parts)))
    return rows.repartitionById(2 * parts, part).sortWithinPartitions(t.asc_nulls_last(), "_name", "_key")


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, tilts: Sequence[float] = TILTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words, repeats counted), first_position (null: unused).

    Rows come in the order in which the curriculum first uses the documents.
    """
    slim = materialize(_sized(docs, []), "mix-sizes")
    out = _placed(slim, slim, weights, tilts, max_epochs).withColumn("first_position", F.get(F.col("passes.position"), F.lit(0)))
    taken = (F.col("size") * F.size("passes")).alias("taken")
    return _in_order(out, "first_position", slim).select("doc_id", "size", "source_size", "target", taken, "first_position")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, tilts: Sequence[float] = TILTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixture itself: the columns of ``docs``, a row for each pass over a document, range-sorted by position."""
    slim = materialize(_sized(docs, []).select("_name", "source", "size", "_bucket"), "mix-sizes")
    out = _placed(_sized(docs, docs.columns), slim, weights, tilts, max_epochs)
    own = [f"_cd_{i}" for i in range(len(docs.columns))]
    rows = out.select(*own, "_name", "_key", "mean_tilt", F.explode("passes").alias("_p")).withColumn("_t", F.col("_p.position"))
    return _in_order(rows, "_t", slim).select(*(F.col(k).alias(c) for k, c in zip(own, docs.columns, strict=True)))

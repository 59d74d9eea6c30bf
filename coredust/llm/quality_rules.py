"""Quality rules: fixed base rules, then robust multivariate outliers (DataFrame functions only).

For every language and source, a regularised minimum-covariance-determinant estimate is made of the transformed text
statistics. From each of several starts (the medians and quartile ranges, exact by histogram, and the moments of the
``STARTS`` shares of rows nearest to them) concentration steps keep the ``SUPPORT`` share of rows with the smallest
Mahalanobis distances and refit mean and covariance until ``STEPS`` are done; the start that ends with the least
determinant is taken. Each step is one aggregation over (group, start, distance bucket): the buckets carry the moments,
so neither the quantile of the distances nor the refit needs the rows of a group together, however large a group is. Rows
beyond ``CUTOFF`` are rejected.

Edge cases: a null or empty text has no words and fails the base rules; null lang and source form groups of their own;
groups with fewer than ``MIN_GROUP`` fitting rows are judged by the estimate over all fitting rows of their language, or of
the whole table where the language has fewer as well, so every row that passes the base rules has a distance; repeated
rows weigh as often as they occur; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE, materialize

WINDOW = 5
SUPPORT = 0.75
STARTS = (0.5, 1.0)
STEPS = 4
MIN_GROUP = 60
#: Squared distance beyond which a row is rejected: above the 0.99999 quantile of chi-square with five degrees of freedom
#: (30.9), as the statistics have heavier tails than a normal distribution.
CUTOFF = 40.0
#: Least standard deviation of each feature; MCD is degenerate where most rows share one value. Fixed values.
FLOORS = {"length": 0.8, "word_len": 0.12, "symbols": 0.5, "dup_lines": 0.5, "repeats": 0.7}
FEATURES = tuple(FLOORS)
#: Width of the histogram buckets: of features for the medians, and of ln(1 + squared distance).
BIN, DISTANCE_BIN = 0.02, 0.02


def text_statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text.

    With ``carry`` also ``_cd_row``: the whole input row as a struct.
    """
    ids = ["doc_id", "lang", "source"] + ["_cd_row"] * carry
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", "source", text.alias("_t"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_cd_row")] if carry else []))
    d = d.select(*ids, "_t", F.filter(F.split("_t", SPACE), lambda w: w != "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    chained = lambda w, i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))
    hashes = F.when(F.size("_w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: chained(F.col("_w"), i))).otherwise(F.array().cast("array<bigint>"))
    d = d.select(
        *ids, F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), hashes.alias("_h"),
    )
    # Most texts repeat no window; only the others are sorted by (hash, position) to find the repeated ones.
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: (x["h"] == F.get(F.col("_s"), k - 1)["h"]) | (x["h"] == F.get(F.col("_s"), k + 1)["h"])
    hit = F.sort_array(F.transform(F.filter("_s", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))
    d = d.withColumn("_p", hit)
    # A window at p adds the words that the one before does not cover.
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("_p", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    return d.select(*ids, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def features() -> dict[str, Column]:
    """Transformed statistics; logarithms of rates make the vectors comparable between short and long texts."""
    per = lambda c, k: F.log1p(F.col(c) * k / F.greatest(F.col("n_words"), F.lit(1)))
    return {"length": F.log1p(F.col("n_words")), "word_len": per("word_chars", 1.0), "symbols": per("n_symbols", 100.0), "dup_lines": per("n_dup_lines", 100.0), "repeats": per("n_repeat_words", 100.0)}


#: What an estimate is made for: level 0 is a language and source, 1 a language (null source), 2 the table (both null).
KEY = ("level", "lang", "source")
#: One estimate under way: the start tells those of a KEY apart.
FIT = (*KEY, "start")
PAIRS = list(combinations_with_replacement(range(len(FEATURES)), 2))


def _start(rows: DataFrame) -> DataFrame:
    """KEY -> mean m_i from medians and a diagonal covariance c_i_j from quartile ranges, by exact histograms."""
    long = rows.select(*KEY, F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.floor(F.col(n) / BIN).alias("b")) for i, n in enumerate(FEATURES)))).alias("x")).select(*KEY, "x.*")
    counts = long.groupBy(*KEY, "f", "b").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*KEY, "f")
    counts = counts.withColumn("cum", F.sum("n").over(whole.orderBy("b"))).withColumn("all", F.sum("n").over(whole))
    at = lambda q: F.min(F.when(F.col("cum") >= F.col("all") * q, (F.col("b") + 0.5) * BIN))
    per = counts.groupBy(*KEY, "f").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"), F.max("all").alias("n"))
    floor = F.element_at(F.array(*(F.lit(FLOORS[n]) for n in FEATURES)), F.col("f") + 1)
    per = per.withColumn("sd", F.greatest((F.col("q3") - F.col("q1")) / 1.349, floor))
    pick = lambda i, c: F.max(F.when(F.col("f") == i, F.col(c)))
    cols = [pick(i, "q2").alias(f"m{i}") for i in range(len(FEATURES))]
    cols += [(pick(i, "sd") * pick(i, "sd") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    return per.groupBy(*KEY).agg(F.max("n").alias("n"), *cols).withColumn("start", F.lit(0))


def _factored(est: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_ij (i >= j) of the covariance; its diagonal has the floors added, so it is positive."""
    k = len(FEATURES)
    for j in range(k):
        new = {f"l{j}{j}": F.sqrt(F.greatest(F.col(f"c{j}{j}") - sum((F.col(f"l{j}{p}") * F.col(f"l{j}{p}") for p in range(j)), F.lit(0.0)), F.lit(1e-9)))}
        est = est.withColumns(new)
        est = est.withColumns({f"l{i}{j}": (F.col(f"c{j}{i}") - sum((F.col(f"l{i}{p}") * F.col(f"l{j}{p}") for p in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, k)} or {"_": F.lit(0)})
    return est.select(*FIT, *(f"m{i}" for i in range(k)), *(f"l{i}{j}" for i in range(k) for j in range(i + 1)))


def _distances(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Rows with their squared Mahalanobis distance d2 from each estimate of their KEY, null where there is none."""
    right = est.withColumnsRenamed({c: f"_{c}" for c in KEY})
    keep = rows.columns + [c for c in ("start",) if c in est.columns]
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = rows.join(right, same("level") & same("lang") & same("source"), "left")
    for i, name in enumerate(FEATURES):
        out = out.withColumn(f"y{i}", (F.col(name) - F.col(f"m{i}") - sum((F.col(f"l{i}{p}") * F.col(f"y{p}") for p in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(len(FEATURES))), F.lit(0.0))).select(*keep, "d2")


def _concentrated(rows: DataFrame, est: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One concentration step: mean and covariance of the ``support`` share with the smallest distances, floors added."""
    d = _distances(rows, est).filter(F.col("d2").isNotNull()).withColumn("b", F.floor(F.log1p("d2") / DISTANCE_BIN))
    sums = [F.sum(n).alias(f"s{i}") for i, n in enumerate(FEATURES)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i, j in PAIRS]
    per = d.groupBy(*FIT, "b").agg(F.count(F.lit(1)).alias("n"), *sums)
    whole = Window.partitionBy(*FIT)
    per = per.withColumn("before", F.coalesce(F.sum("n").over(whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(whole))
    kept = per.filter(F.col("before") < F.col("all") * support)
    tot = kept.groupBy(*FIT).agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in [f"s{i}" for i in range(len(FEATURES))] + [f"p{i}{j}" for i, j in PAIRS]))
    mean = {f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(len(FEATURES))}
    tot = tot.withColumns(mean)
    cov = {f"c{i}{j}": F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + F.lit(FLOORS[FEATURES[i]] ** 2 if i == j else 0.0) for i, j in PAIRS}
    return tot.withColumns(cov).select(*FIT, "n", *mean, *cov)


def _levels(rows: DataFrame) -> DataFrame:
    """(_lang, _source) -> level of the estimate that judges the group, and the levels that its fitting rows enter.

    A language is pooled where it has a small group and enough fitting rows in all, the table where a language has too few.
    """
    counts = rows.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("n"))
    language, small = Window.partitionBy("lang"), F.col("n") < MIN_GROUP
    counts = counts.withColumn("of_lang", F.sum("n").over(language)).withColumn("pooled", F.max(small).over(language))
    rare = F.col("of_lang") < MIN_GROUP
    level = F.when(~small, 0).when(~rare, 1).otherwise(2)
    groups = materialize(counts.select("lang", "source", level.alias("level"), (F.col("pooled") & ~rare).alias("pooled")), "mcd-groups")
    whole = not groups.filter("level = 2").isEmpty()
    enters = F.array_compact(F.array(F.when(F.col("level") == 0, 0), F.when(F.col("pooled"), 1), F.lit(2 if whole else None).cast("int")))
    return groups.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "level", enters.alias("_enters"))


def _keyed(rows: DataFrame, level: str) -> DataFrame:
    """Rows with KEY for their level: lang and source are null where it pools them."""
    return rows.select(F.col(level).alias("level"), F.when(F.col(level) < 2, F.col("lang")).alias("lang"), F.when(F.col(level) < 1, F.col("source")).alias("source"), *FEATURES)


def fit(rows: DataFrame) -> DataFrame:
    """One row a KEY with the factored estimate, from rows with the features."""
    # Every step runs once and is written: at most a row a group and start, far below any broadcast limit unless groups abound.
    first = materialize(_factored(_start(rows)), "mcd")
    est = first
    for i, share in enumerate(STARTS, 1):
        est = est.unionByName(_factored(_concentrated(rows, first, share)).withColumn("start", F.lit(i)))
    est = materialize(est, "mcd")
    for _ in range(STEPS):
        est = materialize(_factored(_concentrated(rows, est)), "mcd")
    spread = sum((F.log(f"l{i}{i}") for i in range(len(FEATURES))), F.lit(0.0))
    whole = [c for c in est.columns if c not in KEY]
    best = est.withColumn("_v", F.round(spread, 9)).groupBy(*KEY).agg(F.min_by(F.struct(*whole), F.struct("_v", "start")).alias("x"))
    return best.select(*KEY, "x.*").drop("start")


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The statistics are written once with their rows: texts need no join by doc_id, and no filter on a statistic can be
    pushed into the expressions that compute it.
    """
    rows = materialize(text_statistics(docs, carry=True), "quality-rows")
    return _judged(rows, cutoff).filter("kept").select(*(F.col(f"_cd_row.`{c}`").alias(c) for c in docs.columns))


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2."""
    return _judged(materialize(text_statistics(docs), "quality-stats"), cutoff)


def _judged(stats: DataFrame, cutoff: float) -> DataFrame:
    rows = stats.withColumn("base_failed", base_failed()).withColumns(features())
    levels = _levels(rows)
    rows = rows.join(levels, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_lang", "_source")
    est = fit(_keyed(rows.filter(~F.col("base_failed")).withColumn("_level", F.explode("_enters")), "_level"))
    pooled = {"lang": F.when(F.col("level") < 2, F.col("lang")), "source": F.when(F.col("level") < 1, F.col("source"))}
    own = rows.withColumns({"_own_lang": F.col("lang"), "_own_source": F.col("source")}).withColumns(pooled)
    out = _distances(own, est).withColumns({"lang": F.col("_own_lang"), "source": F.col("_own_source")})
    kept = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= cutoff))
    return out.withColumn("kept", kept).select(*stats.columns, "base_failed", "d2", "kept")

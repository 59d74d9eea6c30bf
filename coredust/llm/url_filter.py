"""URL filter: host and path rules first, else logistic regression on hashed character n-grams (DataFrame functions only).

The model is trained by full-batch gradient descent inside one SQL expression over a small labelled URL table; its size is
bounded by that table. Scoring is a per-row expression: n-grams of ``^host path$`` are hashed to weights and summed.

Edge cases: a null url or one without ``://`` has empty host and path, so only the model's bias and the n-gram ``^$``
judge it; repeated rows get equal verdicts; ties between rules of equal length go to the longer host, then to the smaller
rule string; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = 4096
GRAMS = (3, 4)
EPOCHS = 120
RATE = 1.0
L2 = 1e-3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The labelled table: hosts made of words that blocklists and directories of the web go by, with the same layouts for
#: either class, so that only the words tell them apart. Fixed values.
UNWANTED = (
    "casino", "poker", "roulette", "blackjack", "baccarat", "slots", "jackpots", "lottery", "bingo", "betting", "bookmaker", "wager", "viagra", "cialis", "pills", "pharmacy-discount", "steroids", "weightloss", "payday", "quick-loan", "credit-repair",
    "forex", "binary-options", "replica", "fake-watches", "counterfeit", "adult", "xxx", "porn", "webcam", "escort", "hookup", "singles", "warez", "keygen", "serials", "cracked", "torrent", "malware", "phishing", "adserver", "popunder", "spammer",
    "clickbait", "prize", "winner", "giveaway", "get-rich", "miracle", "free-money",
)
WANTED = (
    "library", "museum", "archive", "university", "college", "school", "science", "physics", "chemistry", "biology", "astronomy", "geology", "history", "literature", "poetry", "grammar", "dictionary", "encyclopedia", "journal", "magazine", "newspaper",
    "weather", "climate", "travel", "railway", "cycling", "hiking", "garden", "recipes", "cooking", "bakery", "theatre", "orchestra", "gallery", "photography", "painting", "architecture", "carpentry", "engineering", "software", "documentation",
    "research", "hospital", "medicine", "parliament", "council", "statistics", "maps", "wildlife", "forest", "education", "information", "translation", "conservation", "foundation", "institute", "academy", "teacher", "student", "lecture", "philosophy",
    "theology", "theorem", "algebra", "mathematics", "thermodynamics", "electronics", "radio", "television", "cinema", "festival", "concert", "choir", "guitar", "violin", "dance", "football", "tennis", "rowing", "athletics", "mountain", "river", "island",
    "harbour", "lighthouse", "airport", "station", "transport", "traffic", "bridge", "castle", "village", "city", "heritage", "tradition", "folklore", "language", "spelling", "writing", "reading", "author", "novel", "publisher", "bookshop", "printing",
    "pottery", "weaving", "knitting", "sewing", "woodwork", "farming", "orchard", "vineyard", "beekeeping", "fishing", "sailing", "veterinary", "nutrition", "fitness", "yoga", "parenting", "children", "family", "wedding", "charity", "volunteer",
    "community", "parish", "court", "justice", "police", "fire-brigade", "election", "budget", "economy", "insurance", "energy", "solar", "recycling", "ocean", "fossils", "planets", "robotics", "compiler", "database", "network",
)
LAYOUTS = ("{}.com/", "www.{}-online.org/index.html", "my-{}.net/articles/2019/03/", "best.{}.info/page/2")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled URL table: (host and path, 1 if unwanted). Every word is in it with every layout."""
    return [(layout.format(name), y) for names, y in ((UNWANTED, 1), (WANTED, 0)) for name in names for layout in LAYOUTS]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def hashed_ngrams(text: Column, dims: int = DIMS, sizes: Sequence[int] = GRAMS) -> Column:
    """Array of the hashed character n-grams of ``^text$``, each bucket once."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

    def grams(cs: Column, n: int) -> Column:
        full = F.transform(F.sequence(F.lit(0), F.greatest(F.size(cs) - n, F.lit(0))), lambda i: F.concat(*(F.coalesce(F.get(cs, i + k), F.lit("")) for k in range(n))))
        return F.transform(full, lambda g: F.pmod(F.xxhash64(g), F.lit(dims)).cast("int"))

    return F.array_distinct(F.concat(*(grams(chars, n) for n in sizes)))


def train(spark: SparkSession, labelled: Sequence[tuple[str, int]] | None = None, dims: int = DIMS, epochs: int = EPOCHS) -> tuple[float, list[float]]:
    """Bias and ``dims`` weights. The labelled table is a parameter; all of it is used, in one row of one task."""
    rows = json.dumps([{"u": u, "y": y, "row": i} for i, (u, y) in enumerate(labelled_urls() if labelled is None else labelled)])
    table = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<u:string,y:int,row:int>>")).alias("x")).select("x.*")
    rows = table.select("row", F.col("y").cast("double").alias("y"), hashed_ngrams(F.col("u"), dims).alias("g"))
    cells = rows.select("row", F.explode("g").alias("feature"), (1 / F.sqrt(F.size("g"))).alias("v"))
    forward = rows.agg(F.sort_array(F.collect_list(F.struct("row", "y", "g"))).alias("fwd"))
    inverse = spark.range(dims).withColumnRenamed("id", "feature").join(cells, "feature", "left").groupBy("feature")
    inverse = inverse.agg(F.sort_array(F.collect_list(F.when(F.col("row").isNotNull(), F.struct("row", "v")))).alias("cells"))
    inverse = inverse.agg(F.sort_array(F.collect_list(F.struct("feature", "cells"))).alias("inv"))
    # One row each: the labelled table's size bounds them.
    both = forward.withColumn("one", F.lit(1)).join(inverse.withColumn("one", F.lit(1)), "one")
    step = f"""
      aggregate(sequence(1, {2 * epochs}),
        named_struct('w', transform(inv, f -> 0D), 'b', 0D, 'e', transform(fwd, r -> 0D)),
        (a, t) -> CASE WHEN t % 2 = 1
          THEN named_struct('w', a.w, 'b', a.b, 'e', transform(fwd, r -> r.y - 1D / (1D + exp(-(a.b + aggregate(r.g, 0D, (s, k) -> s + a.w[k]) / sqrt(size(r.g)))))))
          ELSE named_struct('w', transform(inv, (f, j) -> a.w[j] * {1 - RATE * L2}D + {RATE}D * aggregate(f.cells, 0D, (s, c) -> s + a.e[c.row] * c.v)),
                            'b', a.b + {RATE}D * aggregate(a.e, 0D, (s, x) -> s + x) / size(a.e), 'e', a.e) END)"""
    model = both.select(F.expr(step).alias("m")).select("m.b", "m.w").first()
    return model["b"], list(model["w"])


def probability(host: Column, path: Column, model: tuple[float, list[float]]) -> Column:
    """The model's probability that a url is unwanted."""
    bias, weights = model
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    grams = hashed_ngrams(F.concat(host, path), len(weights))
    return 1 / (1 + F.exp(-(F.lit(bias) + F.aggregate(grams, F.lit(0.0), lambda s, k: s + F.get(table, k)) / F.sqrt(F.size(grams)))))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as (rule, verdict), null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.host + r.path))
    out = None
    for r in ordered:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], model: tuple[float, list[float]] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), probability (the model's, null where a rule decided)."""
    model = model or train(pages.sparkSession)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("probability", F.when(F.col("_rule").isNull(), probability(F.col("host"), F.col("path"), model)))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("probability") >= threshold, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "probability")

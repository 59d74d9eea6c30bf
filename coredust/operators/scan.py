"""Pattern scans over byte layers cut into chunks, and rules over their hits.

A chunk is read with an overlap into the next. A literal counts if it starts in the chunk proper. Regular expressions are
matched from left to right without overlaps over a whole layer, as if it were not cut: a match may run into the next
chunk, which then begins behind it. No match is longer than ``maxsize`` bytes, which the overlap must not fall short of.
So neither hits nor their extents depend on the chunk size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written


def chunked(df: DataFrame, key: str, data: str, size: int, overlap: int) -> DataFrame:
    """(key, start, bytes) with ``overlap`` bytes of the next chunk; ``start`` counts from 0."""
    raw = F.col(data).cast("binary")
    n = F.length(raw)
    # Only slices leave the expression, not the whole value once for each of them.
    cut = lambda i: F.struct(i.cast("long").alias("start"), F.substring(raw, i + 1, F.lit(size + overlap)).alias("bytes"))
    return df.filter(n > 0).select(F.col(key), F.explode(F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), cut)).alias("_c")).select(key, "_c.start", "_c.bytes")


def scan(chunks: DataFrame, key: str, patterns: Mapping[str, bytes], size: int) -> DataFrame:
    """(key, pattern, hit_offset) of literals that start within the chunk proper; hits may overlap each other."""
    compiled = {n: re.compile(b"(?=" + re.escape(p) + b")", re.DOTALL) for n, p in patterns.items()}
    names = list(compiled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, which, at = [], [], []
            for k, start, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = data.as_buffer() or b""
                for n in names:
                    for m in compiled[n].finditer(raw):
                        if m.start() >= size:
                            break
                        keys.append(k)
                        which.append(n)
                        at.append(start + m.start())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(which, pa.string()), pa.array(at, pa.int64())], names=[key, "pattern", "hit_offset"])

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.select(key, "start", "bytes").mapInArrow(run, f"{key} {kind}, pattern string, hit_offset long")


def matches(pattern: re.Pattern, raw: bytes, begin: int, size: int, maxsize: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the matches that start from ``begin`` up to ``size``, left to right, none over ``maxsize``."""
    while (m := pattern.search(raw, begin)) and m.start() < size:
        at, end = m.span()
        if end - at > maxsize:
            m = pattern.match(raw, at, at + maxsize)
            if m is None:  # it does not match within so few bytes
                begin = at + 1
                continue
            end = m.end()
        yield at, end
        begin = max(end, at + 1)


#: Rounds in which chunks are scanned anew side by side, before a layer's remaining chunks are scanned one after another.
ROUNDS = 3


def regex_scan(chunks: DataFrame, keys: Sequence[str], patterns: Mapping[str, bytes], maxsize: int, size: Column | int, start: str = "start", data: str = "bytes", grab: int = 0) -> DataFrame:
    """(keys, pattern, offset, hit_bytes, hex): Python byte regular expressions over layers in chunks.

    ``keys`` name a layer, ``size`` is the length of a chunk without its overlap. ``hex`` holds the match or, with
    ``grab``, that many bytes from its start. Chunks are scanned in parallel as if no match ran into them; those into
    which one does are scanned again behind it, until nothing changes. Where matches run on from chunk to chunk for more
    than ``ROUNDS`` of them, the layer is scanned in order by one task.
    """
    compiled = {n: re.compile(p, re.DOTALL) for n, p in patterns.items()}
    names, keys, skips = list(compiled), list(keys), [f"_skip{i}" for i in range(len(patterns))]
    rows = chunks.select(*keys, F.col(start).cast("long").alias("_start"), F.col(data).alias("_data"), (size if isinstance(size, Column) else F.lit(size)).cast("long").alias("_size"))
    kinds = [rows.schema[c].dataType.simpleString() for c in keys]
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(keys, kinds, strict=True)) + ", pattern string, chunk long, offset long, hit_bytes int, hex binary, beyond long"
    # Counted from the end: the key columns come first, however many there are.
    def run(batches: Iterator[pa.RecordBatch], in_order: bool = False) -> Iterator[pa.RecordBatch]:
        left: dict[str, tuple] = {}  # pattern -> (layer, end of the last match), for chunks in order
        for b in batches:
            ix, which, chunk, at, length, value, beyond = [], [], [], [], [], [], []
            cols = b.columns[len(keys) :]
            layers = list(zip(*(c.to_pylist() for c in b.columns[: len(keys)]), strict=True)) if in_order else None
            for i, (base, raw, n) in enumerate(zip(cols[0].to_pylist(), cols[1], cols[2].to_pylist(), strict=True)):
                raw = raw.as_py() or b""
                for j, name in enumerate(names):
                    if in_order:
                        layer, to = left.get(name, (None, 0))
                        begin = max(0, to - base) if layer == layers[i] else 0
                    else:
                        begin = cols[3 + j][i].as_py()
                        if begin is None:  # this pattern is not asked for
                            continue
                    end = 0
                    for a, end in matches(compiled[name], raw, begin, n, maxsize):
                        ix.append(i)
                        which.append(name)
                        chunk.append(base)
                        at.append(base + a)
                        length.append(end - a)
                        value.append(raw[a : a + grab] if grab else raw[a:end])
                        beyond.append(None)
                    # A chunk into which a match runs past its end hands that on as well.
                    end = max(end, begin)
                    if in_order:
                        left[name] = (layers[i], base + end)
                    elif end > n:
                        for held, x in zip((ix, which, chunk, at, length, value, beyond), (i, name, base, None, None, None, base + end), strict=True):
                            held.append(x)
            place = pa.array(ix, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(place) for c in b.columns[: len(keys)]), pa.array(which, pa.string()), pa.array(chunk, pa.int64()), pa.array(at, pa.int64()), pa.array(length, pa.int32()), pa.array(value, pa.binary()), pa.array(beyond, pa.int64())],
                names=[*keys, "pattern", "chunk", "offset", "hit_bytes", "hex", "beyond"],
            )

    found = written(rows.withColumns({c: F.lit(0).cast("long") for c in skips}).mapInArrow(run, schema), "scan")
    used = None
    for round_ in range(ROUNDS + 1):
        # Where the next chunk must begin, by the chunks before as they were scanned last.
        into = found.filter("beyond IS NOT NULL").join(rows.select(*keys, F.col("_start").alias("chunk"), (F.col("_start") + F.col("_size")).alias("_next")).distinct(), [*keys, "chunk"])
        into = into.select(*keys, "pattern", F.col("_next").alias("chunk"), (F.col("beyond") - F.col("_next")).alias("skip"))
        if used is None:
            change = into
        else:  # also chunks that need not skip any more
            change = into.join(used, [*keys, "pattern", "chunk", "skip"], "left_anti").unionByName(used.join(into, [*keys, "pattern", "chunk"], "left_anti").withColumn("skip", F.lit(0).cast("long")))
        change = written(change.join(rows.select(*keys, F.col("_start").alias("chunk")).distinct(), [*keys, "chunk"], "left_semi"), "scan-skips")
        if change.isEmpty():
            break
        if round_ == ROUNDS:
            again = change.select(*keys).distinct()
            part = rows.join(again, keys, "left_semi").repartition(*keys).sortWithinPartitions(*keys, "_start")
            found = found.join(again, keys, "left_anti").unionByName(part.mapInArrow(lambda it: run(it, True), schema))
            break
        wide = change.groupBy(*keys, F.col("chunk").alias("_start")).agg(*(F.max(F.when(F.col("pattern") == n, F.col("skip"))).alias(c) for n, c in zip(names, skips, strict=True)))
        new = rows.join(wide, [*keys, "_start"]).select(*keys, "_start", "_data", "_size", *skips).mapInArrow(run, schema)
        found = written(found.join(change.select(*keys, "pattern", "chunk"), [*keys, "pattern", "chunk"], "left_anti").unionByName(new), "scan")
        used = written(change.unionByName(used.join(change, [*keys, "pattern", "chunk"], "left_anti")).filter("skip > 0") if used is not None else change, "scan-skips")
    return found.filter("offset IS NOT NULL").select(*keys, "pattern", "offset", "hit_bytes", "hex")


def count_of(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.floor((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(literal)))) / len(literal.encode())).cast("long")


def rule(df: DataFrame, text: str, strings: Mapping[str, str], at_least: int) -> DataFrame:
    """Rows in which at least ``at_least`` of the strings occur (the rule condition ``n of them``), with all counts."""
    d = df.withColumns({f"n_{n}": F.coalesce(count_of(F.col(text), s), F.lit(0)).cast("long") for n, s in strings.items()})
    return d.filter(sum((F.when(F.col(f"n_{n}") > 0, 1).otherwise(0) for n in strings), F.lit(0)) >= at_least)


SEED_WORDS = 3


def owners(passages: DataFrame, passage: str, docs: DataFrame, text: str, key: str) -> DataFrame:
    """Pairs of passages and the texts that contain them whole: the columns of both.

    A text that contains a passage has the passage's second to fourth word as whole words in a row. Those three are
    looked up among the word triples of the texts, as an equality join on their hash; only candidates are compared in
    full. Passages of fewer than five words are looked up by their first characters instead. Only ``key``, which names a
    document, travels with a triple; each text is fetched once for a candidate.
    """
    space = r"[\x20\x09-\x0D]+"
    p = passages.withColumn("_w", F.split(F.trim(passage), space))
    triple = lambda w, i: F.xxhash64(*(F.get(w, i + k) for k in range(SEED_WORDS)))
    long = p.filter(F.size("_w") >= SEED_WORDS + 2).withColumn("_seed", triple(F.col("_w"), F.lit(1))).drop("_w")
    d = docs.select(F.col(key).alias("_key"), F.split(text, space).alias("_t")).filter(F.size("_t") >= SEED_WORDS)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_t") - SEED_WORDS), lambda i: triple(F.col("_t"), i)))
    pairs = long.join(d.select("_key", F.explode(grams).alias("_seed")), "_seed").drop("_seed")
    short = p.filter(F.size("_w") < SEED_WORDS + 2).drop("_w")

    def pieces(n: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_c") - n), lambda i: F.concat(*(F.get("_c", i + k) for k in range(n)))))

    lengths = [r[0] for r in short.filter(F.length(passage) > 0).select(F.least(F.length(passage), F.lit(8))).distinct().collect()]
    for n in sorted(lengths):  # at most eight lengths
        heads = short.filter(F.least(F.length(passage), F.lit(8)) == n).withColumn("_seed", F.substring(passage, 1, n))
        chars = docs.select(F.col(key).alias("_key"), F.split(text, "").alias("_c")).filter(F.size("_c") >= n)
        pairs = pairs.unionByName(heads.join(chars.select("_key", F.explode(pieces(n)).alias("_seed")), "_seed").drop("_seed"))
    pairs = pairs.distinct()
    return pairs.join(docs, F.col("_key").eqNullSafe(F.col(key))).filter(F.contains(F.col(text), F.col(passage))).drop("_key")


def distinct_hits(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits once each; overlapping readers may report one twice."""
    return hits.dropDuplicates(list(keys))

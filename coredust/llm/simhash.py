"""SimHash near-duplicate detection by a binary trie self-join.

Fingerprints are computed from whole texts; equal ones form a class at once. The distinct fingerprints, rotated so that
each of several blocks of bits leads once, are held as sorted arrays, which are binary tries: a node is a range of the
array and a bit splits it in two. Two fingerprints within the budget differ in at most ``budget // blocks`` bits of some
block (pigeonhole); with ``budget + 1`` blocks that is none. So in each rotation, node pairs are traversed together from
the root: a pair of unequal children adds one differing bit, and a pair is pruned as soon as its bits exceed what the
leading block, or below it the budget, allows. Many pairs are advanced at once with numpy, depth first in bounded pieces.

Sub-tries with more than ``SUBTRIE_ROWS`` fingerprints are divided further: a row goes to every pair of child nodes that
is still within the budget, so any sub-trie becomes many bounded tasks and no pair is lost. A fingerprint has at most
64 + 64*63/2 neighbours within two bits, so links grow in proportion to fingerprints, never with a group's square; for
components each task emits a spanning forest of the links it finds.

Near-duplicates by similarity are sought with a larger budget, which alone is not selective: ``NEAR_BUDGET`` bits let far
too many strangers pass in a large table. There the leading part of a key is not a block of the fingerprint but a band:
a hash of ``BAND_ROWS`` minima of the five-word shingles, which must agree; the trie below it is that of the band's
fingerprints. Each text has ``BANDS`` such keys at any table size, and those that no other text shares fall away before
anything but numbers is shuffled. Every pair that the trie finds must be borne out by a sketch of the distinct five-word
shingles (``BINS`` bins of two bits), which estimates their Jaccard similarity: it must be ``SIMILARITY`` or more. Texts
of a similarity of 0.8 share a band in 0.995 of all cases, and of 0.85 in 0.9994; the sketch's standard error is about
0.015. Node pairs whose texts are all linked already are pruned like those over budget, so that a group of near copies
costs its size, not its square.

Edge cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other; a text with
fewer words than a shingle is hashed whole; repeated rows share a class; a null doc_id never becomes a component's id
unless all are null; of rows without a doc_id ``keep_first`` keeps one for each component of such rows; an empty table
gives an empty result; extra columns are ignored by ``cluster`` and carried by ``keep_first``. Texts are the same in
``keep_first`` if their lower-cased words are (by a 64-bit hash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import drop_path, materialize, new_path

WORDS = 3
BUDGET = 2
SEED = 42
#: Fingerprints of a sub-trie beyond which it is divided, and by how many bits at a time.
SUBTRIE_ROWS, SPLIT_BITS = 100_000, 6
_CHUNK = 1 << 16
#: For near-duplicates by similarity: words of a shingle, least similarity, bits in which the three-word fingerprints of
#: such texts may differ (7.5 are expected at 0.8, with a deviation of 2.6), and the bands.
NEAR_WORDS, SIMILARITY, NEAR_BUDGET = 5, 0.8, 16
BANDS, BAND_ROWS = 10, 4
BINS = 1024
#: Multipliers and offsets of the minima: odd and even numbers of a fixed stream.
_RNG = np.random.default_rng(8)
_MUL = _RNG.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)
#: Node pairs advanced at once, and links held before they are reduced to a forest.
_PIECE, _HELD = 1 << 16, 1 << 20


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only, as the word rule asks


def _shingle_hashes(tokens: list[bytes], words: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; of the whole sequence if it is shorter."""
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, n, digest = b" ".join(tokens), len(tokens), xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - words] + 1)).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        octets = hashes[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned."""
    return _majority(_shingle_hashes(_tokens(text), words))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A hash for each band of the minima of the shingles' hashes under fixed orders; none for a text without words."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = np.full(len(_MUL), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _CHUNK >> 4):
        x = shingles[at : at + (_CHUNK >> 4), None] * _MUL + _ADD
        np.minimum(low, (x ^ (x >> np.uint64(29))).min(0), out=low)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, BAND_ROWS))], np.uint64).view(np.int64)


def sketch(shingles: np.ndarray) -> bytes:
    """Two bits a bin: 1 to 3 from the least hash of the distinct shingles in it, 0 for an empty bin; four bins a byte."""
    h = (shingles ^ (shingles >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)  # another order than the fingerprint's
    h.sort()
    where, first = np.unique((h & np.uint64(BINS - 1)).astype(np.int64), return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[where] = 1 + (h[first] >> np.uint64(20)) % np.uint64(3)
    return (out[0::4] | out[1::4] << 2 | out[2::4] << 4 | out[3::4] << 6).tobytes()


def similar(sketches: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether the estimated Jaccard similarity of rows i and j is ``least`` or more; filled bins agree by chance once in 3."""
    out = np.zeros(len(i), bool)
    odd = np.uint64(0x5555_5555_5555_5555)  # the lower bit of every bin
    words = sketches.view(np.uint64)
    for at in range(0, len(i), _CHUNK >> 2):
        a, b = words[i[at : at + (_CHUNK >> 2)]], words[j[at : at + (_CHUNK >> 2)]]
        full_a, full_b, differ = (a | a >> np.uint64(1)) & odd, (b | b >> np.uint64(1)) & odd, a ^ b
        count = lambda x: np.bitwise_count(x).sum(1, dtype=np.int64)
        union, both = count(full_a | full_b), count(full_a & full_b)
        equal = both - count(full_a & full_b & (differ | differ >> np.uint64(1)))
        matches = equal - (both - equal) / 2
        out[at : at + (_CHUNK >> 2)] = (matches >= least * union) | (union == 0)
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, near: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a long; with ``near`` also (id, bands, sketch) of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, more = [], ([], [], [])
            for t in b.column(1):
                tokens = _tokens(t.as_py())
                fps.append(_majority(_shingle_hashes(tokens, words)))
                if near:
                    shingles = np.unique(_shingle_hashes(tokens, NEAR_WORDS))
                    for held, value in zip(more, (xxhash.xxh64_intdigest(b" ".join(tokens), SEED), bands(shingles), sketch(shingles)), strict=True):
                        held.append(value)
            out = [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))]
            if near:
                out += [pa.array(np.array(more[0], np.uint64).view(np.int64)), pa.array(more[1], pa.list_(pa.int64())), pa.array(more[2], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "fp"] + ["id", "bands", "sketch"] * near)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long" + ", id long, bands array<long>, sketch binary" * near)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Groups:
    """Which rows are linked so far: a label each, the least row of its group."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._mark()

    def _mark(self) -> None:
        self.steps = np.zeros(len(self.label), np.int64)
        np.cumsum(self.label[1:] != self.label[:-1], out=self.steps[1:])

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        self.label = _labels(self.label, i, j)
        self._mark()

    def whole(self, lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        """Whether all rows of two ranges are in one group."""
        return (self.steps[lo1] == self.steps[hi1 - 1]) & (self.steps[lo2] == self.steps[hi2 - 1]) & (self.label[lo1] == self.label[lo2])


def trie_pairs(values: np.ndarray, nodes: np.ndarray, budget: int, lead: int | None = None, groups: Groups | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of ``values`` (unsigned, sorted within each node) that differ in at most ``budget`` bits.

    ``nodes``: rows (lo1, hi1, lo2, hi2, bits differing so far, next bit, last bit of the leading block) of node pairs to
    start from; a node paired with itself has equal ranges. The next bit counts down from 63; all values of a range agree
    above it. In the leading block at most ``lead`` bits may differ; pairs beyond that are left to other rotations. Node
    pairs that ``groups``, which the caller may extend meanwhile, holds as linked throughout are left out.
    """
    lead = budget if lead is None else lead
    n = len(values)
    ones = np.zeros((64, n + 1), np.int32)
    for bit in range(64):
        np.cumsum((values >> np.uint64(bit)) & np.uint64(1), out=ones[bit, 1:])
    stack = [nodes[i : i + _PIECE].astype(np.int64) for i in range(0, len(nodes), _PIECE)]
    while stack:
        todo = stack.pop()
        if len(todo) < _PIECE // 4 and stack and len(stack[-1]) + len(todo) <= _PIECE:
            todo = np.concatenate((todo, stack.pop()))
        if groups is not None:
            todo = todo[~groups.whole(*todo[:, :4].T)]
        lo1, hi1, lo2, hi2, err, bit, last = todo.T
        same = lo1 == lo2
        size1, size2 = hi1 - lo1, hi2 - lo2
        # Small nodes, and those without a bit left, are compared value by value.
        direct = (size1 * size2 <= 64) | (bit < 0)
        for a, m, b, k, own in _rectangles(lo1[direct], size1[direct], lo2[direct], size2[direct], same[direct]):
            i, j = a + m, b + k
            close = (_popcount(values[i] ^ values[j]) <= budget) & (~own | (i < j))
            yield np.minimum(i[close], j[close]), np.maximum(i[close], j[close])
        lo1, hi1, lo2, hi2, err, bit, last = todo[~direct].T
        same = lo1 == lo2
        mid1 = hi1 - (ones[bit, hi1] - ones[bit, lo1])
        mid2 = hi2 - (ones[bit, hi2] - ones[bit, lo2])
        b = bit - 1
        children = np.concatenate([
            np.stack((lo1, mid1, lo2, mid2, err, b, last), 1), np.stack((mid1, hi1, mid2, hi2, err, b, last), 1),
            np.stack((lo1, mid1, mid2, hi2, err + 1, b, last), 1), np.stack((mid1, hi1, lo2, mid2, err + 1, b, last), 1)[~same],
        ])
        limit = np.where(children[:, 5] + 1 >= children[:, 6], lead, budget)
        children = children[(children[:, 4] <= limit) & (children[:, 1] > children[:, 0]) & (children[:, 3] > children[:, 2])]
        stack += [children[i : i + _PIECE] for i in range(0, len(children), _PIECE)]


def _rectangles(lo1, size1, lo2, size2, same) -> Iterator[tuple[np.ndarray, ...]]:
    """All cells of rectangles of indices, about ``_PIECE * 4`` at a time: (row start, row, column start, column, same)."""
    cells = size1 * size2
    if not len(cells):
        return
    big = np.cumsum(cells) // (_PIECE * 4)
    for part in np.split(np.arange(len(cells)), np.flatnonzero(np.diff(big)) + 1):
        c = cells[part]
        if len(part) == 1 and c[0] > _PIECE * 64:  # equal values below the last bit: row by row
            for r in range(int(size1[part[0]])):
                k = np.arange(size2[part[0]])
                yield np.full(len(k), lo1[part[0]]), np.full(len(k), r), np.full(len(k), lo2[part[0]]), k, np.full(len(k), same[part[0]])
            continue
        which = np.repeat(np.arange(len(part)), c)
        inner = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        width = size2[part][which]
        yield lo1[part][which], inner // width, lo2[part][which], inner % width, same[part][which]


def _labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` with the groups of i and j joined: minimum labels and pointer jumping."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for k in (i, j, label[i], label[j]):
            np.minimum.at(new, k, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star forest (node, root) of the links."""
    label = _labels(np.arange(n), i, j)
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


#: A node pair of the trie: rotation or band, the band's hash, depth, and the leading bits of either node.
NODE = ("k", "g", "depth", "a", "b")


def _links_in(batches: Iterator[pa.RecordBatch], budget: int, lead: int, floors: list[int], least: float | None, forest: bool) -> Iterator[pa.RecordBatch]:
    """Rows (NODE, r, id) sorted by all of them: each NODE is a pair of nodes with its fingerprints."""

    def linked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        k, g, depth, a, b, r, name = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in (*NODE, "r", "id"))
        values, n = r.view(np.uint64), len(r)
        key = np.stack((k, g, depth, a, b), 1)
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
        last = np.append(first[1:], n)
        nodes = []
        for lo, hi in zip(first.tolist(), last.tolist(), strict=True):
            if hi - lo > 1:
                d, floor = int(depth[lo]), floors[int(k[lo])]
                if a[lo] == b[lo]:
                    nodes.append((lo, hi, lo, hi, 0, 63 - d, floor))
                else:  # the rows of either node, told apart by their leading bits
                    own = (values[lo:hi] >> np.uint64(64 - d)).view(np.int64) == a[lo]
                    if own.any() and not own.all():
                        mid = lo + (int(own.sum()) if own[0] else int((~own).sum()))
                        nodes.append((lo, mid, mid, hi, int(_popcount(np.array([a[lo] ^ b[lo]]))[0]), 63 - d, floor))
        nodes = np.array(nodes or np.zeros((0, 7)), np.int64).reshape(-1, 7)
        near = lambda i, j: (i, j)
        groups = None
        if least is not None:
            flat = table.column("sketch").combine_chunks().cast(pa.binary(BINS // 4))
            sketches = np.frombuffer(flat.buffers()[1], np.uint8)[flat.offset * BINS // 4 :][: n * BINS // 4].reshape(n, -1)
            near = lambda i, j: (i[ok], j[ok]) if len(ok := similar(sketches, i, j, least)) else (i, j)
            # The rows of one text are one; each node is first compared with its least row, which links most of a group.
            groups = Groups(n)
            _, at, inverse = np.unique(name, return_index=True, return_inverse=True)
            groups.link(np.arange(n), at[inverse])
            own = nodes[nodes[:, 0] == nodes[:, 2]]
            size = own[:, 1] - own[:, 0]
            head = np.repeat(own[:, 0], size)
            rest = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + head
            close = _popcount(values[head] ^ values[rest]) <= budget
            groups.link(*near(head[close], rest[close]))
        left, right, held = [], [], 0
        for i, j in trie_pairs(values, nodes, budget, lead, groups):
            if groups is not None:
                apart = groups.label[i] != groups.label[j]
                i, j = near(i[apart], j[apart])
                if len(i):
                    groups.link(i, j)
                continue
            left.append(i)
            right.append(j)
            held += len(i)
            if held > _HELD:
                if forest:
                    u, v = _forest(n, np.concatenate(left), np.concatenate(right))
                    left, right, held = [u], [v], len(u) // 2
                else:
                    yield named(np.concatenate(left), np.concatenate(right), name)
                    left, right, held = [], [], 0
        if groups is not None:
            i = np.flatnonzero(groups.label != np.arange(n))
            j = groups.label[i]
            i, j = i[name[i] != name[j]], j[name[i] != name[j]]
        else:
            i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
            if forest:
                i, j = _forest(n, i, j)
        yield named(i, j, name)

    def named(i: np.ndarray, j: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(name[i]), pa.array(name[j])], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    rows, looked = 0, 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < _CHUNK or rows < looked + _CHUNK // 4:
            continue
        looked = rows
        table = pa.Table.from_batches(held)
        # The last node pair may go on in the next batch.
        changes = np.zeros(len(table) - 1, bool)
        for c in NODE:
            x = table.column(c).to_numpy()
            changes |= x[1:] != x[:-1]
        changes = np.flatnonzero(changes)
        if not len(changes):
            continue
        cut = int(changes[-1]) + 1
        yield from linked(table.slice(0, cut))
        held, rows, looked = table.slice(cut).to_batches(), len(table) - cut, 0
    if rows:
        yield from linked(pa.Table.from_batches(held))


def _blocks(count: int) -> list[tuple[int, int]]:
    """(start from the top, width) of ``count`` blocks of bits."""
    cuts = [round(i * 64 / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _masks(bits: int, most: int) -> list[int]:
    return [m for m in range(1 << bits) if m.bit_count() <= most]


def links(fps: DataFrame, budget: int = BUDGET, forest: bool = False, subtrie_rows: int = SUBTRIE_ROWS) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints ``fp`` within the budget; with ``forest`` a spanning forest of them.

    ``fps`` holds each fingerprint once. A pair may come once for every leading block on which it agrees.
    """
    cut = _blocks(budget + 1)
    parts = []
    for k, (start, width) in enumerate(cut):
        r = F.shiftleft("fp", start).bitwiseOR(F.shiftrightunsigned("fp", 64 - start)) if start else F.col("fp")
        node = F.shiftrightunsigned(r, 64 - width)
        parts.append(F.struct(F.lit(k).alias("k"), F.lit(0).cast("long").alias("g"), F.lit(width).alias("depth"), node.alias("a"), node.alias("b"), r.alias("r")))
    rows = fps.select(F.explode(F.array(*parts)).alias("x"), F.col("fp").alias("id")).select("x.*", "id")
    # No bit of the leading block may differ, so the trie starts below it.
    return _divided(rows, budget, 0, [w for _, w in cut], subtrie_rows, None, None, forest)


def near_links(texts: DataFrame, budget: int = NEAR_BUDGET, similarity: float = SIMILARITY, subtrie_rows: int = SUBTRIE_ROWS) -> DataFrame:
    """A forest (u, v) of the links between texts (id, fp, bands, sketch), each once: those of a similarity or more.

    Every band that two texts share is a trie of its own, whatever bits differ first: its leading part is the band.
    """
    zero = F.lit(0).cast("long")
    rows = texts.select("id", F.col("fp").alias("r"), F.posexplode("bands").alias("k", "g")).select("k", "g", F.lit(0).alias("depth"), zero.alias("a"), zero.alias("b"), "r", "id")
    return _divided(rows, budget, budget, [0] * BANDS, subtrie_rows, texts.select("id", "sketch"), similarity, True)


def _divided(rows: DataFrame, budget: int, lead: int, widths: list[int], subtrie_rows: int, sketches: DataFrame | None, similarity: float | None, forest: bool) -> DataFrame:
    """The links of node pairs (NODE, r, id): large pairs are divided until each is small, then all are traversed."""
    width_of = F.element_at(F.array(*(F.lit(w) for w in widths)), F.col("k") + 1)
    high = lambda bits: F.call_function("shiftrightunsigned", F.col("r"), bits.cast("int"))
    done = None
    while True:
        per = rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        # Nodes of one fingerprint have no pairs and fall away; the others say whether they must be divided.
        per = materialize(per.select(*NODE, (F.col("n") > 2 * subtrie_rows).alias("big")), "simhash-nodes")
        rows = rows.join(per, list(NODE))
        rows = materialize(rows, "simhash-rows") if per.filter("big").count() else rows  # else one pass is all there is
        fine = rows.filter(~F.col("big") | (F.col("depth") + SPLIT_BITS > 63)).drop("big")
        done = fine if done is None else done.unionByName(fine)
        if per.filter(F.col("big") & (F.col("depth") + SPLIT_BITS <= 63)).isEmpty():
            break
        big = rows.filter(F.col("big") & (F.col("depth") + SPLIT_BITS <= 63)).drop("big")
        deeper = high(F.lit(64 - SPLIT_BITS) - F.col("depth"))
        # At depth zero there is one node only; a shift by 64 bits would be one by none.
        partner = F.when((F.col("depth") == 0) | (high(F.lit(64) - F.col("depth")) == F.col("a")), F.col("b")).otherwise(F.col("a"))
        low = deeper.bitwiseAND(F.lit((1 << SPLIT_BITS) - 1))
        spent = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        limit = F.when(F.col("depth") + SPLIT_BITS <= width_of, lead).otherwise(budget)
        mask = F.explode(F.filter(F.array(*(F.lit(m).cast("long") for m in _masks(SPLIT_BITS, budget))), lambda m: F.bit_count(m) + spent <= limit))
        big = big.select(*NODE, "r", "id", deeper.alias("_own"), partner.alias("_p"), low.alias("_low"), mask.alias("_m"))
        other = F.shiftleft("_p", SPLIT_BITS).bitwiseOR(F.col("_low").bitwiseXOR(F.col("_m")))
        rows = big.select("k", "g", (F.col("depth") + SPLIT_BITS).alias("depth"), F.least("_own", other).alias("a"), F.greatest("_own", other).alias("b"), "r", "id")
    if sketches is not None:
        done = done.join(sketches, "id")  # only now, when lone keys have fallen away
    placed = done.repartition(*NODE).sortWithinPartitions(*NODE, F.col("r").bitwiseXOR(F.lit(-(1 << 63))))
    floors = [64 - w if w else 0 for w in widths]
    return placed.mapInArrow(lambda it: _links_in(it, budget, lead, floors, similarity, forest), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each linked node's component, by alternating large and small stars.

    Each round is written to the shared folder, so lineage stays short; hubs are aggregated before they are shuffled.
    """
    now, seen, spark = edges.filter("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct(), None, edges.sparkSession
    while True:
        path = new_path(spark, "simhash-edges")
        now.write.parquet(path)
        e = spark.read.schema("u long, v long").parquet(path)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen is not None and state == seen[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        if seen is not None:
            drop_path(spark, seen[1])
        seen = (state, path)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u")
        now = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_low.withColumnRenamed("m", "v")).distinct()


def cluster(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row a document.

    Links join fingerprints within ``budget`` or, with ``similarity``, texts of that five-word similarity or more.
    """
    near = similarity is not None
    rows = fingerprints(docs, words, near)
    rows = materialize(rows if near else rows.withColumn("id", F.col("fp")), "simhash-fp")
    of_text = ("fp", "bands", "sketch") if near else ()
    classes = materialize(rows.groupBy("id").agg(F.min("doc_id").alias("first"), *(F.any_value(c).alias(c) for c in of_text)), "simhash-classes")
    found = near_links(classes, budget, similarity) if near else links(classes.select(F.col("id").alias("fp")), budget, True)
    label = components(found)
    named = classes.join(label, classes.id == label.node, "left").select("id", "first", F.coalesce("label", "id").alias("label"))
    named = materialize(named, "simhash-labels")
    ids = named.groupBy("label").agg(F.min("first").alias("component_id"))
    per = named.select("id", "label").join(ids, "label").select("id", "component_id")
    out = rows.select("doc_id", "fp", "id").join(per, "id")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component, the row with the smallest doc_id.

    A row is known by its doc_id and text hash: rows equal in both count once, and different texts under one doc_id, or
    without one, are judged each in its own component. Of different texts under the smallest doc_id of a component the
    smallest text hash stays. A row without a doc_id stays only where its component has no other.
    """
    hashed = F.xxhash64("text")
    row = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"), hashed.alias("hash"))
    found = cluster(docs.select(row.alias("doc_id"), "text"), words, budget, similarity)
    # Keys that are never null for the join and the window, so texts are shuffled once.
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    firsts = found.filter("doc_id = component_id").select(key("doc_id.doc_id").alias("_cd_key"), F.col("doc_id.hash").alias("_cd_hash")).distinct()
    kept = docs.withColumn("_cd_key", key("doc_id")).withColumn("_cd_hash", hashed).join(firsts, ["_cd_key", "_cd_hash"], "left_semi")
    one = Window.partitionBy("_cd_key", "_cd_hash").orderBy("_cd_hash")
    return kept.withColumn("_cd_n", F.row_number().over(one)).filter("_cd_n = 1").select(*(F.col(f"`{c}`") for c in docs.columns))
